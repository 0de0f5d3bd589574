"""Seeded sampling of rigid bodies: materials, shapes, placement, motion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions import geometry
from kinelake.functions.vec import round_even
from kinelake.sources import dimensions as dim
from kinelake.sources.tables import spread

TURN = 2 * math.pi


def weighted(u: Column, weights: list[float]) -> Column:
    """Index of the component that u in [0, 1) falls into by cumulative weight; the last one takes the rest."""
    out, edge = None, 0.0
    for i, w in enumerate(weights[:-1]):
        edge += w
        out = F.when(u < edge, i) if out is None else out.when(u < edge, i)
    return F.lit(0) if out is None else out.otherwise(len(weights) - 1)


def mixture(u: Column, z: Column, components) -> Column:
    """Mean + deviation * z of the component that u picks."""
    i = weighted(u, [c[2] for c in components])
    pick = lambda k: F.get(F.array(*(F.lit(float(c[k])) for c in components)), i)
    return pick(0) + pick(1) * z


def uniform_choice(u: Column, values) -> Column:
    """One of the values, each as likely."""
    return F.get(F.array(*map(F.lit, values)), F.floor(u * len(values)).cast("int"))


def allowed_or(given: Column, values, otherwise: Column) -> Column:
    """`given` if it is one of the values, else `otherwise` (also for NULL)."""
    return F.when(given.isin(*values), given).otherwise(otherwise)


def between(u: Column, low: float, high: float) -> Column:
    return F.lit(low) + F.lit(high - low) * u


def placement(mode: Column, u: dict[str, Column]) -> dict[str, Column]:
    """Columns x, y, vx, vy, vz, radius of a body by mode, from uniforms r, a, s, b, c, v in [0, 1).

    collision: on the circle, moving inwards; sliding: in the disk, any direction;
    stationary: in the disk, at rest; offset: beyond the circle, slower inwards.
    An unknown mode gives NULLs.
    """
    radius, angle = between(u["r"], 1.0, 2.0), F.lit(TURN) * u["a"]
    in_disk, heading = radius * F.sqrt(u["s"]), F.lit(TURN) * u["b"]
    away = between(u["s"], 1.2, 1.5) * radius
    speed = {"collision": between(u["c"], 2.0, 5.0), "sliding": between(u["c"], 1.0, 3.0), "offset": between(u["c"], 1.0, 2.0)}
    rest = F.lit(0.0)
    at = geometry.by_shape(mode, collision=radius, sliding=in_disk, stationary=in_disk, offset=away)
    toward = lambda f: geometry.by_shape(
        mode, collision=-speed["collision"] * f(angle), sliding=speed["sliding"] * f(heading), stationary=rest, offset=-speed["offset"] * f(angle)
    )
    lift = geometry.by_shape(mode, collision=between(u["v"], -0.2, 0.2), sliding=between(u["v"], -0.1, 0.1), stationary=rest, offset=between(u["v"], -0.1, 0.1))
    return {"x": at * F.cos(angle), "y": at * F.sin(angle), "vx": toward(F.cos), "vy": toward(F.sin), "vz": lift, "radius": radius}


def rgba_string(color: Column, alpha: Column) -> Column:
    """The colour's red, green and blue with the material's opacity, three decimals each."""
    parts = F.split(F.trim(color), r"\s+")
    return F.format_string("%.3f %.3f %.3f %.3f", *(F.get(parts, F.lit(i)).cast("double") for i in range(3)), alpha)


def draw(seed: int, *place: Column | str) -> Column:
    """A number in [0, 1) for a place (a run, a body, a name): the same in every task, partitioning and engine."""
    return fraction(F.concat_ws(":", F.lit(str(seed)), *(x.cast("string") if isinstance(x, Column) else F.lit(x) for x in place)))


def fraction(text: Column) -> Column:
    """A number in [0, 1) from a text, evenly: the first 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def normal(u: Column, v: Column) -> Column:
    """A standard normal number from two draws (Box and Muller's transform)."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(TURN) * v)


def bodies(
    spark: SparkSession, runs: int | DataFrame, seed: int, least: int = 2, most: int = 14, shape: str | None = None, material: str | None = None, given: DataFrame | None = None
) -> DataFrame:
    """Bodies of `runs` scenes (a number, or a table of run_id), each with least..most bodies; `shape` and `material` override the draw if known.

    Bodies that the caller gives (`given`, not empty) replace the draw.

    Every number derives from the seed, the run, the body and its name, whatever the partitioning. Runs are dealt by run_id
    before they grow to bodies, and bodies stay there: what groups them by run needs no shuffle.
    """
    if given is not None and not given.isEmpty():
        return given
    ids = spark.range(runs).withColumnRenamed("id", "run_id") if isinstance(runs, int) else runs.select("run_id")
    run = F.col("run_id")
    drawn = spread(ids, "run_id").withColumn("num_objects", (F.lit(least) + F.floor(draw(seed, run, "count") * (most - least + 1))).cast("int"))
    df = drawn.withColumn("obj_idx", F.explode(F.sequence(F.lit(0), F.col("num_objects") - 1)))
    names = ["shape", "material", "color", "mode", "e", "d", "f", "d1", "d2", "d3", "r", "a", "s", "b", "c", "v", "w1", "w2", "w3"]
    df = df.withColumn("_at", F.concat_ws(":", F.lit(str(seed)), run.cast("string"), F.col("obj_idx").cast("string")))  # once for all names
    own = lambda name: fraction(F.concat("_at", F.lit(f":{name}")))
    df = df.withColumns({f"_{n}": own(n) for n in names} | {f"_{n}z": normal(own(f"{n}z:radius"), own(f"{n}z:turn")) for n in "edf"})
    u = {n: F.col(f"_{n}") for n in names}
    df = df.withColumns(
        {
            "shape": allowed_or(F.lit(shape).cast("string"), geometry.SHAPES, uniform_choice(u["shape"], geometry.SHAPES)),
            "material": allowed_or(F.lit(material).cast("string"), list(dim.MATERIALS), uniform_choice(u["material"], list(dim.MATERIALS))),
            "mode": uniform_modes(u["mode"]),
            "color": uniform_choice(u["color"], list(dim.COLORS.values())),
        }
    )
    df = df.join(F.broadcast(dim.materials(spark)), "material")  # five rows
    metal = {k: mixture(F.col(f"_{k[0]}"), F.col(f"_{k[0]}z"), dim.METAL_MIXTURES[k]) for k in dim.METAL_MIXTURES}
    sizes = {
        "radius": F.when(F.col("shape").isin("ball", "cylinder"), between(u["d1"], 0.05, 0.1)),
        "height": F.when(F.col("shape") == "cylinder", between(u["d2"], 0.1, 0.2)).when(F.col("shape") == "block", between(u["d3"], 0.05, 0.1)),
        "side": F.when(F.col("shape") == "cube", between(u["d1"], 0.1, 0.3)),
        "length": F.when(F.col("shape") == "block", between(u["d1"], 0.1, 0.2)),
        "width": F.when(F.col("shape") == "block", between(u["d2"], 0.05, 0.2)),
    }
    df = df.withColumns(
        sizes
        | {
            "elasticity": F.coalesce("elasticity", round_even(metal["elasticity"], 3)),
            "density": F.coalesce("density", metal["density"]),
            "friction": F.coalesce("friction", F.format_string("%.2f", metal["friction"])),
            "rgba": rgba_string(F.col("color"), F.col("alpha")),
        }
        | {f"w{c}": between(u[f"w{i + 1}"], -20.0, 20.0) for i, c in enumerate("xyz")}
    )
    parts = [F.col(c) for c in ("shape", "radius", "height", "side", "length", "width")]
    placed = placement(F.col("mode"), u)
    placed["collision_radius"] = placed.pop("radius")  # `radius` is the body's own
    sized = {"volume": geometry.volume(*parts), "base_z": geometry.base_z(*parts[:4]), "geom_type": geometry.geom_type(parts[0]), "size_str": geometry.size_string(*parts)}
    df = df.withColumns(placed | sized)
    df = df.withColumns(
        {
            "mass": geometry.mass(F.col("density"), F.col("volume")),
            "geom_id": F.col("obj_idx") + 1,
            "id": F.concat(F.lit("geom_obj"), F.col("obj_idx").cast("string")),
        }
        | names_of(F.col("obj_idx"))
    )
    return df.drop(*(c for c in df.columns if c.startswith("_")), "color", "alpha")


def names_of(obj_idx: Column) -> dict[str, Column]:
    """The names of a body, its joint and its material in a scene."""
    i = obj_idx.cast("string")
    return {"body_name": F.concat(F.lit("obj"), i), "joint_name": F.concat(F.lit("obj"), i, F.lit("_free")), "material_name": F.concat(F.lit("mat_obj"), i)}


def uniform_modes(u: Column) -> Column:
    return F.get(F.array(*(F.lit(m) for m, _ in dim.MODES)), weighted(u, [w for _, w in dim.MODES]))


# The scene around the bodies, in the simulator's format.
_HEAD = (
    '<mujoco model="dynamic_objects"><size nconmax="200" njmax="200"/><option timestep="0.0005" gravity="0 0 -9.81"/>'
    '<visual><global offwidth="{width}" offheight="{height}"/></visual><asset>'
)
_FLOOR = (
    '<material name="floor_mat" specular="0.0" shininess="0.0" rgba="0.8 0.8 0.8 1.0"/></asset><worldbody><light name="light" pos="0 0 3"/>'
    '<geom name="floor" type="plane" size="50 50 0.1" pos="0 0 0" rgba="1 1 1 1" friction="0.05 0.3 0.5" group="0" material="floor_mat"/>'
)
_END = '<camera name="camera" pos="0 -2 1" xyaxes="0.8944 0 0 0 0.4472 0.8944"/></worldbody></mujoco>'


def scene_xml(df: DataFrame, width: int = 1440, height: int = 1024) -> DataFrame:
    """(run_id, xml): a whole simulator scene with the materials and bodies of each run in index order."""
    material = F.format_string('<material name="%s" specular="%.1f" shininess="%d" rgba="%s"/>', "material_name", "specular", "shininess", "rgba")
    body = F.format_string(
        '<body name="%s" pos="%.4f %.4f %.4f"><freejoint name="%s"/>'
        '<geom name="%s" type="%s" size="%s" mass="%.6f" friction="%s" material="%s" group="1"/></body>',
        "body_name", "x", "y", "base_z", "joint_name", "id", "geom_type", "size_str", "mass", "friction", "material_name",
    )
    rows = F.array_sort(F.collect_list(F.struct("obj_idx", material.alias("m"), body.alias("b"))))  # a run has few bodies
    joined = lambda k: F.array_join(F.transform("_rows", lambda s: s[k]), "")
    head = F.lit(_HEAD.format(width=width, height=height))
    return df.groupBy("run_id").agg(rows.alias("_rows")).select("run_id", F.concat(head, joined("m"), F.lit(_FLOOR), joined("b"), F.lit(_END)).alias("xml"))
