"""Overlay rows: what is drawn on each video frame, as text lines with places and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.functions.vec import round_even
from kinelake.sources import document, video

LINE_HEIGHT = 20


def labels_of(taxonomy: Column) -> Column:
    """All labels of a list of events, in order, comma-joined."""
    return F.array_join(F.flatten(F.transform(taxonomy, lambda t: t["labels"])), ",")


def number(x: Column) -> Column:
    """A double rounded to two decimals, written with at least one: 1.0, -0.5, 0.25."""
    return round_even(x, 2).cast("string")


def vector(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, number), ", "), F.lit("]"))


def description(mass: Column, velocity: Column, material: Column, labels: Column) -> Column:
    return F.concat(
        F.format_string("Mass: %.2f kg", mass), F.lit("\nVelocity: "), velocity, F.lit("\nMaterial: "), material, F.lit("\nTaxonomy: "), labels
    )


def lines(df: DataFrame, text: str, x: str, y: str) -> DataFrame:
    """One row a text line, stacked upwards from (x, y): the first line is the lowest."""
    split = df.select("*", F.posexplode(F.split(text, "\n")).alias("line_idx", "line"))
    return split.withColumns({"line_x": F.col(x), "line_y": F.col(y) - LINE_HEIGHT * (F.col("line_idx") + 1)})


def color_parts(rgba: Column) -> Column:
    """(r, g, b) of a colour string as 0-255, truncated."""
    return F.transform(F.slice(F.split(F.trim(rgba), r"\s+"), 1, 3), lambda c: (c.cast("double") * 255).cast("int"))


def positional(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every left row with the right row of the same position, if there is one; further right rows are left out."""
    return left.join(right, keys, "left")


def first_match(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_first", place).where("_first = 1").drop("_first")


def annotate(spark: SparkSession, document_path: str, videos: DataFrame | None, out_path: str) -> DataFrame | None:
    """replay of the documents under a path on videos (path, fps, n_frames); nothing is done (None) if a path or the videos are missing."""
    if not document_path or videos is None or not out_path:
        return None
    found = replay(document.read(spark, document_path), video.frames(videos, ["path"]), ["path"])
    found.write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)


def swapped(color: Column) -> Column:
    """(b, g, r) of a colour (r, g, b): how it shows where the drawing library takes blue first."""
    return F.reverse(color)


def replay(docs: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    """Overlay lines of run documents on the frames shown (keys, frame_idx).

    Frame i of a video gets frame i of the document. Video frames past the document's end
    stay, with NULLs; document frames past the video's end are left out, and so are
    objects that the document does not describe. Each line has its box and its colour.
    """
    framed = docs.select(*keys, F.posexplode("frames").alias("frame_idx", "f")).withColumn("frame_idx", F.col("frame_idx").cast("long"))
    listed = docs.select(*keys, F.posexplode("objects").alias("_pos", "o")).withColumn("_id", F.col("o.id"))
    meta = first_match(listed, [*keys, "_id"], ["_pos"]).select(*keys, "o.id", "o.mass", "o.material", F.col("o.visual.rgba").alias("rgba"))
    states = framed.select(*keys, "frame_idx", F.explode("f.objects").alias("id", "s")).join(meta, [*keys, "id"])
    no_events = F.array().cast(states.schema["s"].dataType["taxonomy"].dataType)
    text = description(F.col("mass"), vector(F.col("s.velocity")), F.col("material"), labels_of(F.coalesce("s.taxonomy", no_events)))
    corner = lambda i, j: F.coalesce(F.get(F.get("s.bbox", F.lit(i)), F.lit(j)), F.lit(0))
    drawn = states.select(
        *keys, "frame_idx", "id", text.alias("text"), color_parts(F.col("rgba")).alias("color"), *(corner(i, j).alias(f"{'xy'[j]}{i + 1}") for i in range(2) for j in range(2))
    )
    return positional(shown, lines(drawn, "text", "x1", "y1").drop("text"), [*keys, "frame_idx"])
