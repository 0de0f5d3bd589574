"""Run documents: nested JSON of one run, assembled, written, read and flattened again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.vec import round_even

_VECTOR = "ARRAY<DOUBLE>"
_EVENT = "STRUCT<category:STRING,subcategory:STRING,labels:ARRAY<STRING>>"
_STATE = f"STRUCT<velocity:{_VECTOR},angular_velocity:{_VECTOR},active_labels:ARRAY<STRING>,position:{_VECTOR},bbox:ARRAY<ARRAY<INT>>,taxonomy:ARRAY<{_EVENT}>>"
CAMERA = f"STRUCT<camera_name:STRING,lookat:{_VECTOR},distance:DOUBLE,azimuth:DOUBLE,elevation:DOUBLE,prev_lookat:{_VECTOR},prev_distance:DOUBLE,alpha:DOUBLE>"
OBJECTS = (
    "ARRAY<STRUCT<id:STRING,geom_id:INT,shape:STRING,material:STRING,material_shininess:INT,dimensions:MAP<STRING,DOUBLE>,mass:DOUBLE,density:DOUBLE,"
    f"elasticity:DOUBLE,friction:STRING,visual:STRUCT<rgba:STRING,specular:DOUBLE>,velocity:{_VECTOR},angular_velocity:{_VECTOR},mode:STRING,"
    f"init_possition_x:DOUBLE,init_possition_y:DOUBLE,collision_radius:DOUBLE,volume:DOUBLE,base_z:DOUBLE,geom_type:STRING,size_str:STRING,vel_prev:{_VECTOR}>>"
)
FRAMES = f"ARRAY<STRUCT<time:DOUBLE,objects:MAP<STRING,{_STATE}>,interations:ARRAY<ARRAY<INT>>>>"
DOCUMENT = f"camera {CAMERA}, objects {OBJECTS}, frames {FRAMES}"
# Camera settings where a document gives none.
CAMERA_DEFAULTS = {"lookat": [0.0, 0.0, 0.0], "distance": 2.23606797749979, "azimuth": -90.0, "elevation": -26.56505117707799}


def frames(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """(run_id, frame_idx, frame): one struct a frame from object states and contact pairs.

    states has (run_id, frame_idx, time, id, state), pairs (run_id, frame_idx, g1, g2).
    A frame without pairs has an empty list.
    """
    keys = ["run_id", "frame_idx"]
    entries = F.array_sort(F.collect_list(F.struct("id", "state")))
    objects = states.groupBy(*keys).agg(F.min("time").alias("time"), F.map_from_entries(entries).alias("objects"))
    met = pairs.distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(F.array("g1", "g2"))).alias("interations"))
    none = F.array().cast("array<array<int>>")
    return objects.join(met, keys, "left").select(*keys, F.struct("time", "objects", F.coalesce("interations", none).alias("interations")).alias("frame"))


def described(bodies: DataFrame) -> DataFrame:
    """(run_id, num_objects, objects): each run's bodies (as operators.scene.bodies gives them) as the document's objects, in index order."""
    size = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("radius", "height", "side", "length", "width")))
    named = {
        "material_shininess": F.col("shininess"), "dimensions": F.map_from_entries(F.filter(size, lambda e: e["value"].isNotNull())),
        "visual": F.struct("rgba", "specular"), "velocity": F.array("vx", "vy", "vz"), "angular_velocity": F.array("wx", "wy", "wz"),
        "init_possition_x": F.col("x"), "init_possition_y": F.col("y"), "vel_prev": F.transform(F.array("vx", "vy", "vz"), lambda v: round_even(v, 2)),
    }
    # The fields of an object, in the document's order and spelling.
    fields = (
        "id geom_id shape material material_shininess dimensions mass density elasticity friction visual velocity angular_velocity mode"
        " init_possition_x init_possition_y collision_radius volume base_z geom_type size_str vel_prev"
    ).split()
    body = F.struct(*(named.get(f, F.col(f)).alias(f) for f in fields))
    rows = F.array_sort(F.collect_list(F.struct("obj_idx", body.alias("o"))), lambda a, b: a["obj_idx"] - b["obj_idx"])
    return bodies.groupBy("run_id").agg(F.count(F.lit(1)).alias("num_objects"), F.transform(rows, lambda r: r["o"]).alias("objects"))


def annotated(states: DataFrame, *annotators: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """states with what each annotator (DataFrame to DataFrame) adds, in order; none leaves them as they are."""
    for annotator in annotators:
        states = states.transform(annotator)
    return states


def documents(framed: DataFrame, objects: DataFrame | None = None, cameras: DataFrame | None = None) -> DataFrame:
    """(run_id, [num_objects], json): each run's document as JSON text, its frames in order.

    objects as of `described`, cameras (run_id, camera); a part that isn't given is left
    out. A run is one row: the frame rate and the run's length bound it.
    """
    by_index = lambda a, b: F.when(a["frame_idx"] < b["frame_idx"], -1).when(a["frame_idx"] > b["frame_idx"], 1).otherwise(0)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "frame")), by_index), lambda f: f["frame"])
    out = framed.groupBy("run_id").agg(ordered.alias("frames"))
    for given in (cameras, objects):
        if given is not None:
            out = out.join(given, "run_id", "left")
    return text(out)


def text(whole: DataFrame) -> DataFrame:
    """(run_id, [num_objects], json) of rows that hold a whole document: run_id, frames and, if given, camera and objects."""
    more = ["num_objects"] if "num_objects" in whole.columns else []
    return whole.select("run_id", *more, F.to_json(F.struct(*(c for c in ("camera", "objects", "frames") if c in whole.columns))).alias("json"))


def parse(df: DataFrame, json: str = "json") -> DataFrame:
    """df with the document's columns, by schema (inference would make a field of every object id)."""
    return df.withColumn("_doc", F.from_json(json, DOCUMENT)).select(*df.columns, "_doc.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents under `path`, one a file."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("path", F.input_file_name())


def write(docs: DataFrame, path: str) -> None:
    """Documents (run_id, num_objects, json) as one JSON text a run under num_objects=<n>/run_id=<id>/ (an action).

    Only the folders of these runs are replaced: other runs, of the same size too, stay.
    """
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("num_objects", "run_id").text(path)


def flatten(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row a frame and object: keys, frame_idx, time, id and the state's fields. A missing taxonomy is empty."""
    framed = docs.select(*keys, F.posexplode("frames").alias("frame_idx", "f"))
    each = framed.select(*keys, "frame_idx", "f.time", F.explode("f.objects").alias("id", "s")).select(*keys, "frame_idx", "time", "id", "s.*")
    return each.withColumn("taxonomy", F.coalesce("taxonomy", F.array().cast(f"array<{_EVENT}>")))


def with_defaults(camera: str = "camera"):
    """The camera struct's init fields, defaults where missing."""
    return F.struct(*(F.coalesce(F.col(f"{camera}.{k}"), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in CAMERA_DEFAULTS.items()))


def variants(df: DataFrame, json: str = "json") -> DataFrame:
    """df with `doc`, the document as VARIANT with all its fields, and `malformed`: text that is no JSON has a NULL doc."""
    return df.withColumn("doc", F.try_parse_json(json)).withColumn("malformed", F.col("doc").isNull() & F.col(json).isNotNull())


def flatten_variants(docs: DataFrame, keys: list[str], doc: str = "doc") -> DataFrame:
    """One row a frame and object of VARIANT documents: keys, frame_idx, time, id, and `state` with whatever fields it has.

    Objects are maps by id, so ids make no fields. Documents without frames and frames without objects give no rows.
    """
    framed = docs.select(*keys, F.posexplode(F.try_variant_get(doc, "$.frames", "array<variant>")).alias("frame_idx", "f"))
    each = framed.select(*keys, "frame_idx", F.try_variant_get("f", "$.time", "double").alias("time"), F.try_variant_get("f", "$.objects", "map<string,variant>").alias("objects"))
    return each.select(*keys, "frame_idx", "time", F.explode("objects").alias("id", "state"))


def variant_text(docs: DataFrame, doc: str = "doc", out: str = "json") -> DataFrame:
    """docs with the VARIANT document as JSON text, unknown fields included."""
    return docs.withColumn(out, F.to_json(doc))
