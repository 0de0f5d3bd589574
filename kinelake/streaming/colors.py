"""Colours of ids remembered across runs and streams: a growing dictionary, first seen wins.

The dictionary is a Parquet table with a folder for each micro-batch. What a batch adds depends on the batches
before it alone, and its folder is replaced as a whole, so a batch that is run again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from kinelake.operators.vision import mask_color, remembered_color

SCHEMA = "geom_id int, color array<int>, batch_id long"


def known(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(geom_id, color) of the dictionary, or of its batches before one."""
    try:
        found = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], SCHEMA)
    return (found if before is None else found.where(F.col("batch_id") < before)).select("geom_id", "color")


def remember(rows: DataFrame, batch_id: int, path: str, order: list[str] | None = None) -> None:
    """Add the ids of rows (geom_id, and color where they bring one) that no batch before has (an action).

    Of an id's rows the first in `order` with a colour counts (by colour if no order is given); without one it gets its own. Use it as
    `stream.writeStream.foreachBatch(lambda rows, k: remember(rows, k, path))`. One writer at a time.
    """
    spark = rows.sparkSession
    own = F.col("color") if "color" in rows.columns else F.lit(None).cast("array<int>")
    place = F.struct(*(order or []), own.alias("_c"))
    first = rows.where("geom_id IS NOT NULL").groupBy("geom_id").agg(F.min_by(own, F.when(own.isNotNull(), place)).alias("given"))
    new = first.join(known(spark, path, batch_id), "geom_id", "left_anti")
    new.select(F.col("geom_id").cast("int"), F.coalesce("given", mask_color(F.col("geom_id"))).alias("color")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def colored(rows: DataFrame, path: str) -> DataFrame:
    """rows (a stream or not) with the colour each geom_id has in the dictionary, else its own."""
    held = known(rows.sparkSession, path).select("geom_id", F.col("color").alias("_known"))
    return rows.drop("color").join(held, "geom_id", "left").withColumn("color", remembered_color(F.col("_known"), F.col("geom_id"))).drop("_known")
