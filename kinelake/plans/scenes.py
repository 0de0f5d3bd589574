"""Queries on bodies: `part` rows stand for bodies, their numbers for shapes and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.functions import geometry, vec
from kinelake.operators import camera, overlay, scene
from kinelake.sources import dimensions as dim
from kinelake.sources import document
from kinelake.sources.tables import table

DENSITY = [c[2] for c in dim.METAL_MIXTURES["density"]]


def bodies(spark, sf_dir):
    """part with shape and dimensions, from p_size in hundredths and its own key."""
    size = F.col("p_size").cast("double")
    shape = F.get(F.array(*map(F.lit, geometry.SHAPES)), (F.col("p_partkey") % 4).cast("int"))
    named = {"radius": size / 200.0, "height": size / 100.0, "side": size / 50.0, "length": size / 40.0, "width": size / 100.0}
    return table(spark, sf_dir, "part").withColumns({"shape": shape} | named)


def _parts():
    return [F.col(c) for c in ("shape", "radius", "height", "side", "length", "width")]


def scan_project(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("geom_obj"), F.col("p_partkey").cast("string")).alias("id"),
        F.coalesce(F.col("p_size"), F.lit(0)).alias("size"),
        F.array_join(F.slice(F.split("p_name", " "), 1, 2), " ").alias("name_head"),
    )


def volume_by_shape(spark, sf_dir):
    vol = geometry.volume(*_parts())
    return bodies(spark, sf_dir).select(
        "p_partkey", "shape", vec.steady(vol).alias("volume"), vec.steady(geometry.mass(F.lit(2500.0), vol), 3).alias("mass"), geometry.base_z(*_parts()[:4]).alias("base_z")
    )


def size_strings(spark, sf_dir):
    return bodies(spark, sf_dir).select("p_partkey", geometry.geom_type(F.col("shape")).alias("geom_type"), geometry.size_string(*_parts()).alias("size_str"))


def rgba_parse(spark, sf_dir):
    """A part's colour (by its key) and material: as text, and as parts in the order given and in that of a library that takes blue first."""
    key = F.col("p_partkey")
    df = table(spark, sf_dir, "part").select("p_partkey", (key % len(dim.COLORS)).cast("int").alias("color_idx"), scene.uniform_choice(uniform("m", 7919), list(dim.MATERIALS)).alias("material"))
    look = df.join(F.broadcast(dim.colors(spark)), "color_idx").join(F.broadcast(dim.materials(spark)), "material")  # 13 and 5 fixed rows
    parts = overlay.color_parts(F.col("rgba"))
    other = overlay.swapped(parts)
    return look.select(
        "p_partkey", "color", "material", scene.rgba_string(F.col("rgba"), F.col("alpha")).alias("rgba_out"), *(parts[i].alias(c) for i, c in enumerate("rgb")), *(other[i].alias(f"shown_{c}") for i, c in enumerate("rgb"))
    )


def uniform(name: str, factor: int):
    """A number in [0, 1) with three decimals, from the part's key."""
    return (F.col("p_partkey") * factor % 1000).cast("double") / 1000.0


_FACTORS = {"r": 7919, "a": 104729, "s": 1299709, "b": 15485863, "c": 32452843, "v": 49979687}


def mode_placement(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("mode", scene.uniform_modes(uniform("m", 6947)))
    placed = scene.placement(F.col("mode"), {k: uniform(k, f) for k, f in _FACTORS.items()})
    return df.select("p_partkey", "mode", *(vec.steady(placed[k]).alias(k) for k in ("x", "y", "vx", "vy", "vz", "radius")))


def mixture_pick(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scene.weighted(uniform("m", 7919), DENSITY).alias("component"))


def allow_list(spark, sf_dir):
    """p_type's first word as a material where it is one, else one drawn by key."""
    given = F.lower(F.get(F.split("p_type", " "), F.lit(0)))
    drawn = scene.uniform_choice(uniform("m", 7919), list(dim.MATERIALS))
    return table(spark, sf_dir, "part").select("p_partkey", scene.allowed_or(given, list(dim.MATERIALS), drawn).alias("material"))


def material_lookup(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("material", scene.uniform_choice(uniform("m", 7919), list(dim.MATERIALS)))
    return df.join(F.broadcast(dim.materials(spark)), "material").select("p_partkey", "material", "density", "friction", "alpha", "specular", "shininess")


def string_concat(spark, sf_dir):
    """Bodies' ids joined in key order, by brand."""
    ids = F.expr("listagg(concat('obj', p_partkey), '') WITHIN GROUP (ORDER BY p_partkey)")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(ids.alias("ids"))


SEED = 7
_STEADY = ("mass", "volume", "density", "x", "y", "vx", "vy", "vz", "collision_radius", "wx", "wy", "wz", "base_z")


def runs(spark, sf_dir):
    """A run for each part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"))


def scene_random(spark, sf_dir):
    """Bodies of a run for each part, numbers rounded to what two engines agree on."""
    df = scene.bodies(spark, runs(spark, sf_dir), SEED)
    kept = ("run_id", "num_objects", "obj_idx", "id", "geom_id", "shape", "material", "mode", "rgba", "specular", "shininess", "geom_type", "joint_name", "material_name")
    return df.select(*kept, *(vec.steady(F.col(c), 3).alias(c) for c in _STEADY))


def scene_xml(spark, sf_dir):
    return scene.scene_xml(scene.bodies(spark, runs(spark, sf_dir), SEED))


def doc_whole(spark, sf_dir):
    """Whole documents (camera, bodies, the first frame) of the drawn scenes, written as JSON, parsed again, a row a body."""
    objects = document.described(scene.bodies(spark, runs(spark, sf_dir), SEED))
    none = F.array()
    state = lambda o: F.struct(
        o["velocity"].alias("velocity"), o["angular_velocity"].alias("angular_velocity"), none.cast("array<string>").alias("active_labels"),
        F.array(o["init_possition_x"], o["init_possition_y"], o["base_z"]).alias("position"), none.cast("array<array<int>>").alias("bbox"),
    )
    first = F.struct(
        F.lit(0.0).alias("time"), F.map_from_entries(F.transform("objects", lambda o: F.struct(o["id"].alias("id"), state(o).alias("state")))).alias("objects"), none.cast("array<array<int>>").alias("interations")
    )
    init = {k: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for k, v in document.CAMERA_DEFAULTS.items()}
    at = F.struct(F.lit("camera").alias("camera_name"), *(v.alias(k) for k, v in init.items()), init["lookat"].alias("prev_lookat"), init["distance"].alias("prev_distance"), F.lit(camera.ALPHA).alias("alpha"))
    # A scene's camera, bodies and frame are in one row already: no join, and bodies are drawn once.
    parsed = document.parse(document.text(objects.withColumns({"camera": at, "frames": F.array(first)})))
    # With explode, the optimizer would parse each document twice, to look for empty lists first.
    each = parsed.select("run_id", "num_objects", "camera", "frames", F.explode_outer("objects").alias("o")).where("o IS NOT NULL")
    shown = F.element_at(F.col("frames")[0]["objects"], F.col("o.id"))
    same = ("id", "geom_id", "shape", "material", "mode", "friction", "geom_type", "size_str")
    return each.select(
        "run_id", "num_objects", F.col("camera.distance").alias("distance"), F.col("camera.prev_lookat")[2].alias("lookat_z"), *(F.col(f"o.{c}").alias(c) for c in same), F.col("o.visual.rgba").alias("rgba"),
        F.size("o.dimensions").alias("dimensions"), vec.steady(F.col("o.mass"), 3).alias("mass"), vec.steady(shown["velocity"][0], 3).alias("vx"), F.col("o.vel_prev")[0].alias("vx_prev"), vec.steady(shown["position"][1], 3).alias("y"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        scan_project, volume_by_shape, size_strings, rgba_parse, mode_placement, mixture_pick, allow_list, material_lookup, string_concat, scene_random, scene_xml, doc_whole,
    )
}

_SHAPES = "CASE p_partkey % 4 WHEN 0 THEN 'ball' WHEN 1 THEN 'cylinder' WHEN 2 THEN 'cube' ELSE 'block' END"
_BODIES = f"""b AS (SELECT p_partkey, {_SHAPES} AS shape, p_size::DOUBLE / 200.0 AS radius, p_size::DOUBLE / 100.0 AS height, p_size::DOUBLE / 50.0 AS side,
  p_size::DOUBLE / 40.0 AS length, p_size::DOUBLE / 100.0 AS width FROM part)"""
_ball, _pi = repr(4.0 / 3.0 * 3.141592653589793), repr(3.141592653589793)
_u = lambda f: f"((p_partkey * {f} % 1000)::DOUBLE / 1000.0::DOUBLE)"
_six = lambda x, d=6: f"floor(({x}) * {10**d}.0 + 0.5) / {10**d}.0"


def _cumulative(u: str, weights: list[float], values: list[str]) -> str:
    edge, whens = 0.0, []
    for w, v in zip(weights[:-1], values[:-1], strict=True):
        edge += w
        whens.append(f"WHEN {u} < {edge!r}::DOUBLE THEN {v}")
    return f"CASE {' '.join(whens)} ELSE {values[-1]} END"


def _choice(u: str, values: list[str]) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], floor({u} * {len(values)})::INT + 1)"


_mode = _cumulative(_u(6947), [w for _, w in dim.MODES], [f"'{m}'" for m, _ in dim.MODES])
_lin = lambda u, a, b: f"({a!r}::DOUBLE + {b - a!r}::DOUBLE * {u})"
_turn = repr(scene.TURN)
_material_rows = ", ".join(
    "('{}', {}, {}, {}, {}, {})".format(
        m, "NULL" if dim.MATERIALS[m][1] is None else dim.MATERIALS[m][1], "NULL" if dim.MATERIALS[m][2] is None else f"'{dim.MATERIALS[m][2]}'", *dim.VISUALS[m]
    )
    for m in dim.MATERIALS
)
_material_drawn = _choice(_u(7919), list(dim.MATERIALS))

_draw = lambda name, of="run_id || ':' || obj_idx": f"(('0x' || substr(md5('{SEED}:' || {of} || ':{name}'), 1, 13))::BIGINT / {2**52}.0::DOUBLE)"
_normal = lambda name: f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {_draw(name + ':radius')})) * cos({scene.TURN!r}::DOUBLE * {_draw(name + ':turn')}))"
_three = lambda x: _six(x, 3)


def _mixed(name: str, rows) -> str:
    pick = lambda k: _cumulative(f"u_{name}", [r[2] for r in rows], [f"{r[k]!r}::DOUBLE" for r in rows])
    return f"({pick(0)} + {pick(1)} * z_{name})"


_NAMES = ("shape", "material", "color", "mode", "e", "d", "f", "d1", "d2", "d3", "r", "a", "s", "b", "c", "v", "w1", "w2", "w3")
_u2 = lambda name, a, b: f"({a!r}::DOUBLE + {b - a!r}::DOUBLE * u_{name})"
_SCENE = f"""m(material, density0, friction0, alpha, specular, shininess) AS (VALUES {_material_rows}),
n AS (SELECT p_partkey AS run_id, (2 + floor({_draw('count', 'p_partkey')} * 13))::INT AS num_objects FROM part),
o AS (SELECT run_id, num_objects, unnest(range(num_objects))::INT AS obj_idx FROM n),
u AS (SELECT *, {', '.join(f'{_draw(x)} AS u_{x}' for x in _NAMES)}, {', '.join(f"{_normal(x + 'z')} AS z_{x}" for x in 'edf')} FROM o),
k AS (SELECT *, {_choice('u_shape', list(geometry.SHAPES))} AS shape, {_choice('u_material', list(dim.MATERIALS))} AS material, {_choice('u_color', list(dim.COLORS.values()))} AS color,
        {_cumulative('u_mode', [w for _, w in dim.MODES], [f"'{x}'" for x, _ in dim.MODES])} AS mode FROM u),
s AS (SELECT k.*, alpha, specular::DOUBLE AS specular, shininess, coalesce(density0::DOUBLE, {_mixed('d', dim.METAL_MIXTURES['density'])}) AS density,
        coalesce(friction0, printf('%.2f', {_mixed('f', dim.METAL_MIXTURES['friction'])})) AS friction,
        {_u2('d1', 0.05, 0.1)} AS ball, {_u2('d2', 0.1, 0.2)} AS tall, {_u2('d1', 0.1, 0.3)} AS side, {_u2('d1', 0.1, 0.2)} AS length, {_u2('d2', 0.05, 0.2)} AS width, {_u2('d3', 0.05, 0.1)} AS flat,
        {_u2('r', 1.0, 2.0)} AS collision_radius, {scene.TURN!r}::DOUBLE * u_a AS angle, {scene.TURN!r}::DOUBLE * u_b AS heading FROM k JOIN m USING (material)),
v AS (SELECT *, CASE shape WHEN 'ball' THEN {_ball}::DOUBLE * ball * ball * ball WHEN 'cylinder' THEN {_pi}::DOUBLE * ball * ball * tall WHEN 'cube' THEN side * side * side ELSE length * width * flat END AS volume,
        CASE mode WHEN 'collision' THEN collision_radius WHEN 'offset' THEN {_u2('s', 1.2, 1.5)} * collision_radius ELSE collision_radius * sqrt(u_s) END AS away FROM s),
b AS (SELECT *, greatest(density * volume, 1e-6) AS mass, away * cos(angle) AS x, away * sin(angle) AS y,
        CASE mode WHEN 'collision' THEN -{_u2('c', 2.0, 5.0)} * cos(angle) WHEN 'sliding' THEN {_u2('c', 1.0, 3.0)} * cos(heading) WHEN 'stationary' THEN 0.0::DOUBLE ELSE -{_u2('c', 1.0, 2.0)} * cos(angle) END AS vx,
        CASE mode WHEN 'collision' THEN -{_u2('c', 2.0, 5.0)} * sin(angle) WHEN 'sliding' THEN {_u2('c', 1.0, 3.0)} * sin(heading) WHEN 'stationary' THEN 0.0::DOUBLE ELSE -{_u2('c', 1.0, 2.0)} * sin(angle) END AS vy,
        CASE mode WHEN 'collision' THEN {_u2('v', -0.2, 0.2)} WHEN 'stationary' THEN 0.0::DOUBLE ELSE {_u2('v', -0.1, 0.1)} END AS vz,
        {_u2('w1', -20.0, 20.0)} AS wx, {_u2('w2', -20.0, 20.0)} AS wy, {_u2('w3', -20.0, 20.0)} AS wz,
        CASE shape WHEN 'ball' THEN ball WHEN 'cylinder' THEN tall / 2 WHEN 'cube' THEN side / 2 ELSE flat / 2 END AS base_z,
        CASE shape WHEN 'ball' THEN 'sphere' WHEN 'cylinder' THEN 'cylinder' ELSE 'box' END AS geom_type,
        CASE shape WHEN 'ball' THEN printf('%.4f', ball) WHEN 'cylinder' THEN printf('%.4f %.4f', ball, tall / 2)
          WHEN 'cube' THEN printf('%.4f %.4f %.4f', side / 2, side / 2, side / 2) ELSE printf('%.4f %.4f %.4f', length / 2, width / 2, flat / 2) END AS size_str,
        printf('%.3f %.3f %.3f %.3f', split_part(color, ' ', 1)::DOUBLE, split_part(color, ' ', 2)::DOUBLE, split_part(color, ' ', 3)::DOUBLE, alpha::DOUBLE) AS rgba FROM v)"""

ORACLE = {
    "scene_random": f"""WITH {_SCENE} SELECT run_id, num_objects, obj_idx, 'geom_obj' || obj_idx AS id, obj_idx + 1 AS geom_id, shape, material, mode, rgba, specular, shininess, geom_type,
        'obj' || obj_idx || '_free' AS joint_name, 'mat_obj' || obj_idx AS material_name, {', '.join(f'{_three(c)} AS {c}' for c in _STEADY)} FROM b""",
    "doc_whole": f"""WITH {_SCENE} SELECT run_id, num_objects, 2.23606797749979::DOUBLE AS distance, 0.0::DOUBLE AS lookat_z, 'geom_obj' || obj_idx AS id, obj_idx + 1 AS geom_id, shape, material, mode, friction, geom_type, size_str, rgba,
        CASE shape WHEN 'ball' THEN 1 WHEN 'cylinder' THEN 2 WHEN 'cube' THEN 1 ELSE 3 END AS dimensions, {_three('mass')} AS mass, {_three('vx')} AS vx, round_even(vx, 2) AS vx_prev, {_three('y')} AS y FROM b""",
    "scene_xml": f"""WITH {_SCENE}, t AS (SELECT run_id, obj_idx, '<material name="mat_obj' || obj_idx || '" specular="' || printf('%.1f', specular) || '" shininess="' || shininess || '" rgba="' || rgba || '"/>' AS m,
          '<body name="obj' || obj_idx || '" pos="' || printf('%.4f %.4f %.4f', x, y, base_z) || '"><freejoint name="obj' || obj_idx || '_free"/><geom name="geom_obj' || obj_idx || '" type="' || geom_type
          || '" size="' || size_str || '" mass="' || printf('%.6f', mass) || '" friction="' || friction || '" material="mat_obj' || obj_idx || '" group="1"/></body>' AS g FROM b)
        SELECT run_id, '{scene._HEAD.format(width=1440, height=1024)}' || string_agg(m, '' ORDER BY obj_idx) || '{scene._FLOOR}' || string_agg(g, '' ORDER BY obj_idx) || '{scene._END}' AS xml FROM t GROUP BY run_id""",
    "scan_project": "SELECT 'geom_obj' || p_partkey AS id, coalesce(p_size, 0) AS size, array_to_string(string_split(p_name, ' ')[1:2], ' ') AS name_head FROM part",
    "volume_by_shape": f"""WITH {_BODIES}, v AS (SELECT *, CASE shape WHEN 'ball' THEN {_ball}::DOUBLE * radius * radius * radius
          WHEN 'cylinder' THEN {_pi}::DOUBLE * radius * radius * height WHEN 'cube' THEN side * side * side ELSE length * width * height END AS v FROM b)
        SELECT p_partkey, shape, {_six('v')} AS volume, {_six('greatest(2500.0::DOUBLE * v, 1e-6)', 3)} AS mass,
          CASE shape WHEN 'ball' THEN radius WHEN 'cube' THEN side / 2 ELSE height / 2 END AS base_z FROM v""",
    "size_strings": f"""WITH {_BODIES} SELECT p_partkey, CASE shape WHEN 'ball' THEN 'sphere' WHEN 'cylinder' THEN 'cylinder' ELSE 'box' END AS geom_type,
        CASE shape WHEN 'ball' THEN printf('%.4f', radius) WHEN 'cylinder' THEN printf('%.4f %.4f', radius, height / 2)
          WHEN 'cube' THEN printf('%.4f %.4f %.4f', side / 2, side / 2, side / 2) ELSE printf('%.4f %.4f %.4f', length / 2, width / 2, height / 2) END AS size_str FROM b""",
    "rgba_parse": f"""WITH c(color_idx, color, rgba) AS (VALUES {', '.join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(dim.COLORS.items()))}),
        m(material, density, friction, alpha, specular, shininess) AS (VALUES {_material_rows}),
        k AS (SELECT p_partkey, p_partkey % {len(dim.COLORS)} AS color_idx, [{', '.join(f"'{m}'" for m in dim.MATERIALS)}][least(floor({_u(7919)} * {len(dim.MATERIALS)})::INT, {len(dim.MATERIALS) - 1}) + 1] AS material FROM part),
        p AS (SELECT p_partkey, color, material, alpha, list_transform(string_split(rgba, ' '), lambda x: x::DOUBLE) AS v FROM k JOIN c USING (color_idx) JOIN m USING (material)),
        t AS (SELECT *, trunc(v[1] * 255)::INT AS r, trunc(v[2] * 255)::INT AS g, trunc(v[3] * 255)::INT AS b FROM p)
        SELECT p_partkey, color, material, printf('%.3f %.3f %.3f %.3f', v[1], v[2], v[3], alpha::DOUBLE) AS rgba_out, r, g, b, b AS shown_r, g AS shown_g, r AS shown_b FROM t""",
    "mode_placement": f"""WITH u AS (SELECT p_partkey, {_mode} AS mode, {', '.join(f'{_u(f)} AS u{k}' for k, f in _FACTORS.items())} FROM part),
        r AS (SELECT *, {_lin('ur', 1.0, 2.0)} AS radius, {_turn}::DOUBLE * ua AS angle, {_turn}::DOUBLE * ub AS heading FROM u),
        d AS (SELECT *, CASE mode WHEN 'collision' THEN radius WHEN 'offset' THEN {_lin('us', 1.2, 1.5)} * radius ELSE radius * sqrt(us) END AS away FROM r)
        SELECT p_partkey, mode, {_six('away * cos(angle)')} AS x, {_six('away * sin(angle)')} AS y,
          {_six(f"CASE mode WHEN 'collision' THEN -{_lin('uc', 2.0, 5.0)} * cos(angle) WHEN 'sliding' THEN {_lin('uc', 1.0, 3.0)} * cos(heading) WHEN 'stationary' THEN 0.0::DOUBLE ELSE -{_lin('uc', 1.0, 2.0)} * cos(angle) END")} AS vx,
          {_six(f"CASE mode WHEN 'collision' THEN -{_lin('uc', 2.0, 5.0)} * sin(angle) WHEN 'sliding' THEN {_lin('uc', 1.0, 3.0)} * sin(heading) WHEN 'stationary' THEN 0.0::DOUBLE ELSE -{_lin('uc', 1.0, 2.0)} * sin(angle) END")} AS vy,
          {_six(f"CASE mode WHEN 'collision' THEN {_lin('uv', -0.2, 0.2)} WHEN 'stationary' THEN 0.0::DOUBLE ELSE {_lin('uv', -0.1, 0.1)} END")} AS vz,
          {_six('radius')} AS radius FROM d""",
    "mixture_pick": f"SELECT p_partkey, {_cumulative(_u(7919), DENSITY, [str(i) for i in range(len(DENSITY))])} AS component FROM part",
    "allow_list": f"""SELECT p_partkey, CASE WHEN lower(split_part(p_type, ' ', 1)) IN ({', '.join(repr(m) for m in dim.MATERIALS)})
        THEN lower(split_part(p_type, ' ', 1)) ELSE {_material_drawn} END AS material FROM part""",
    "material_lookup": f"""WITH m(material, density, friction, alpha, specular, shininess) AS (VALUES {_material_rows})
        SELECT p_partkey, material, density::DOUBLE AS density, friction, alpha::DOUBLE AS alpha, specular::DOUBLE AS specular, shininess
        FROM (SELECT p_partkey, {_material_drawn} AS material FROM part) JOIN m USING (material)""",
    "string_concat": "SELECT p_brand, string_agg('obj' || p_partkey, '' ORDER BY p_partkey) AS ids FROM part GROUP BY p_brand",
}
