"""Contact pairs: distinct pairs, keep-last, elastic or inelastic, fan-out to both bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions.vec import at, dot3, ratio_or_zero

# The ratio over which a collision is elastic, the label names, the floor's id.
ELASTIC_RATIO = 0.5
ELASTIC, INELASTIC = "Elastic Collision", "Inelastic Collision"
FLOOR = 0


def ordered_pairs(contacts: DataFrame, a: str = "geom1", b: str = "geom2") -> DataFrame:
    """contacts with g1 <= g2."""
    return contacts.withColumns({"g1": F.least(a, b), "g2": F.greatest(a, b)})


def distinct_pairs(contacts: DataFrame, frame: str = "frame_idx") -> DataFrame:
    """Each unordered pair once a frame, the floor's included."""
    return ordered_pairs(contacts).select(frame, "g1", "g2").distinct()


def without_floor(contacts: DataFrame) -> DataFrame:
    return contacts.where((F.col("geom1") != FLOOR) & (F.col("geom2") != FLOOR))


def keep_last(contacts: DataFrame, frame: str, index: str, values: list[str]) -> DataFrame:
    """Per frame and pair the values of the contact with the highest index, and first_seen, the lowest."""
    last = F.max_by(F.struct(*values), index)
    return (
        ordered_pairs(contacts)
        .groupBy(frame, "g1", "g2")
        .agg(last.alias("_last"), F.min(index).alias("first_seen"))
        .select(frame, "g1", "g2", "first_seen", "_last.*")
    )


def along_normal(one: Column, two: Column, normal: Column) -> Column:
    """The difference of two velocity vectors along a contact's normal."""
    return dot3(F.array(*(at(one, k) - at(two, k) for k in range(3))), normal)


def elasticity(contacts: DataFrame, state: DataFrame, frame: str = "frame_idx", normal: str | None = None) -> DataFrame:
    """contacts with ratio and label, from the bodies' velocity before and now along the normal.

    state has (frame, geom_id, v_prev, v_now). With `normal`, a column of contacts with a
    vector, the velocities are vectors too, and their differences are projected on each
    contact's own normal; without it they are numbers, in one dimension. Velocities are taken
    as given. Contacts of a body without state are left out; a missing component is inelastic.
    """
    one = state.select(frame, F.col("geom_id").alias("geom1"), F.col("v_prev").alias("_p1"), F.col("v_now").alias("_n1"))
    two = state.select(frame, F.col("geom_id").alias("geom2"), F.col("v_prev").alias("_p2"), F.col("v_now").alias("_n2"))
    joined = contacts.join(one, [frame, "geom1"]).join(two, [frame, "geom2"])
    difference = (lambda a, b: along_normal(a, b, F.col(normal))) if normal else (lambda a, b: a - b)
    ratio = ratio_or_zero(difference(F.col("_n1"), F.col("_n2")), difference(F.col("_p1"), F.col("_p2")))
    label = F.when(ratio > ELASTIC_RATIO, ELASTIC).otherwise(INELASTIC)
    return joined.withColumns({"ratio": ratio, "label": label}).drop("_p1", "_n1", "_p2", "_n2")


def fan_out(pairs: DataFrame) -> DataFrame:
    """Two rows a pair, one for each body (geom_id)."""
    return pairs.withColumn("geom_id", F.explode(F.array("g1", "g2")))
