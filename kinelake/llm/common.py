"""What the operators share on the Spark side."""

from __future__ import annotations

import gc
import os
import pickle
import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Shared:
    """A value of bounded size broadcast to the workers with the code of its class.

    Spark pickles broadcast values by reference, which needs their modules on the workers.
    """

    def __init__(self, spark: SparkSession, value):
        self._data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        """The value, unpickled anew: take it once a task."""
        return pickle.loads(self._data.value)

    def destroy(self) -> None:
        self._data.destroy()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; NULL for a NULL key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def is_fold(key: str, n: int, k: int) -> Column:
    """Whether the key's fold is k; false for a NULL key."""
    return F.coalesce(fold(key, n) == k, F.lit(False))


def give_way(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator adds: its own take their place."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in names))


def packed(docs: DataFrame, *apart: str) -> DataFrame:
    """(_rest, columns `apart`): all other columns of docs are fields of _rest, where no operator's own column can clash with them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in apart]
    return docs.select(F.struct(*(rest or [F.lit(0).alias("_none")])).alias("_rest"), *(F.col(c).alias(c) for c in apart))


def unpacked(docs: DataFrame, *apart: str, without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of docs, in its order, from what `packed(docs, *apart)` gave."""
    return [F.col(f"`{c}`" if c.lower() in apart else f"_rest.`{c}`").alias(c) for c in docs.columns if c.lower() not in without]


def settled(df: DataFrame, kept: list[str], made: list[str]) -> DataFrame:
    """kept and made columns of df; filters on the made ones stay above the place where these are computed.

    A filter pushed below would repeat, many times over, the expressions that they share.
    Filters on a generator's output are not pushed; here it gives one row for each row.
    """
    held = df.select(*kept, F.explode_outer(F.array(F.struct(*made))).alias("_made"))
    return held.select(*kept, *(F.col(f"_made.{c}").alias(c) for c in made))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one set, or spark.checkpoint.dir.

    Where neither is there, a local session gets one under the temporary folder; a cluster's must name one.
    """
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    if given.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "kinelake-checkpoints"))
        given = context._jsc.sc().getCheckpointDir()
    return given.get()


def keep(df: DataFrame, *by: str) -> str:
    """Write df as a Parquet table in the shared folder, split by columns `by`: its path."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that `keep` wrote, and have Spark delete the shuffle files that nothing refers to any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the shared folder, and read from there."""
    return df.sparkSession.read.parquet(keep(df))


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
