"""What a plan keeps between its steps, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local session without one gets one under the temporary folder; a cluster's must name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "kinelake-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept there, its lineage cut."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
