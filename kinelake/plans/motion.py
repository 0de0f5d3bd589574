"""Queries on trajectories: `events` per user is a body's speed over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions import vec
from kinelake.operators import frames, kinematics, state
from kinelake.sources.tables import table

EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"
DAY_US = 86_400_000_000
FRAME_US = 2 * DAY_US
KEYS, ORDER = ["user_id"], ["ts", "event_id"]


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with us, the microseconds since the first day."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "value", F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)").alias("us")
    )


def position():
    return F.col("us") / F.lit(float(FRAME_US))


def frame_gate(spark, sf_dir):
    df = frames.frame_gate(trajectory(spark, sf_dir), KEYS, ORDER, position())
    return df.select("user_id", "event_id", "frame_idx")


def bucket_first(spark, sf_dir):
    df = frames.bucket_first(trajectory(spark, sf_dir), KEYS, ORDER, position())
    return df.select("user_id", "event_id", "frame_idx")


def step_delta(spark, sf_dir):
    df = trajectory(spark, sf_dir).withColumn("t", F.col("us") / F.lit(1e6))
    return frames.step_delta(df, KEYS, ORDER, "t").select("event_id", "user_id", "dt")


def lag_seeded(spark, sf_dir):
    df = frames.lag_seeded(trajectory(spark, sf_dir), KEYS, ORDER, "value", F.lit(0.0), "value_prev")
    return df.select("event_id", "user_id", "value", "value_prev")


def linear_motion(spark, sf_dir):
    gated = frames.frame_gate(trajectory(spark, sf_dir), KEYS, ORDER, position())
    moved = frames.lag_seeded(gated.withColumn("x", position()), KEYS, ORDER, "x", F.col("x"), "x_prev")
    moved = frames.lag_seeded(moved, KEYS, ORDER, "value", F.col("value"), "value_prev")
    dt = F.greatest(F.col("x") - F.col("x_prev"), F.lit(frames.MIN_DT))
    label = kinematics.linear_motion([F.col("value")], [F.col("value_prev")], dt)
    return moved.select("user_id", "event_id", "frame_idx", label.alias("label"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as states: velocity 0-2, spin 3-5, quaternion 6-9, previous velocity 10-12, normal 13-15."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("e"))


def linear_motion_3d(spark, sf_dir):
    e = F.col("e")
    now, before = [vec.at(e, i) for i in range(3)], [vec.at(e, 10 + i) for i in range(3)]
    acc = [a - b for a, b in zip(now, before, strict=True)]
    norm = F.sqrt(acc[0] * acc[0] + acc[1] * acc[1] + acc[2] * acc[2])
    return vectors(spark, sf_dir).select(
        "vec_id",
        kinematics.linear_motion(now, before, F.lit(1.0)).alias("motion"),
        vec.steady(norm).alias("acc_norm"),
    )


def state_labels(spark, sf_dir):
    e = F.col("e")
    return vectors(spark, sf_dir).select(
        "vec_id",
        kinematics.is_stopped(vec.norm3(e), vec.norm3(e, 3), 0.2).alias("stopped"),
        vec.tilt_degrees(e, 6, normalise=True).alias("tilt"),
    )


def stopped(spark, sf_dir):
    return state_labels(spark, sf_dir).select("vec_id", "stopped")


def tipped(spark, sf_dir):
    return state_labels(spark, sf_dir).select(
        "vec_id", kinematics.is_tipped(F.col("tilt")).alias("tipped"), vec.steady(F.col("tilt")).alias("tilt_deg")
    )


def active_labels(spark, sf_dir):
    labels = kinematics.active_labels(F.col("stopped"), kinematics.is_tipped(F.col("tilt")))
    return state_labels(spark, sf_dir).select("vec_id", F.array_join(labels, ",").alias("active_labels"))


def final_state(spark, sf_dir):
    return trajectory(spark, sf_dir).groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


def _sampled(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.col("e").cast("array<double>").alias("qvel"), F.col("e").cast("array<double>").alias("qpos"))


def _body_states(spark, sf_dir, compat):
    df = state.states(_sampled(spark, sf_dir), F.lit(8), compat)
    tilt = vec.tilt_degrees(F.col("quaternion"))
    return df.select(
        "vec_id", "obj_idx", "id", "geom_id", *(F.col("velocity")[i].alias(f"v{i}") for i in range(3)), *(F.col("angular_velocity")[i].alias(f"w{i}") for i in range(3)),
        *(F.col("position")[i].alias(f"p{i}") for i in range(3)), vec.steady(tilt).alias("tilt"),
    )


def body_states(spark, sf_dir):
    """Embeddings as samples of eight bodies, each read at its own address."""
    return _body_states(spark, sf_dir, "fixed")


def body_states_exact(spark, sf_dir):
    """The same with positions read at the velocity's address."""
    return _body_states(spark, sf_dir, "exact")


def body_labels(spark, sf_dir):
    df = state.annotated(state.states(_sampled(spark, sf_dir), F.lit(8)), 0.2, 45.0)
    return df.select("vec_id", "obj_idx", F.array_join("active_labels", ",").alias("active_labels"))


def later_velocity(spark, sf_dir):
    """For bodies 1-8 in contact: the body whose velocity counts afterwards, in both readings."""
    geoms = vectors(spark, sf_dir).select("vec_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("geom_id"))
    index = {c: state.later_body(F.col("geom_id"), F.lit(8), c) for c in state.COMPAT}
    df = geoms.join(_sampled(spark, sf_dir), "vec_id")
    return df.select("vec_id", "geom_id", *(F.get("qvel", index[c] * state.VELOCITIES).alias(f"v_{c}") for c in state.COMPAT))


QUERIES = {
    "body_states": body_states,
    "body_states_exact": body_states_exact,
    "body_labels": body_labels,
    "later_velocity": later_velocity,
    "frame_gate": frame_gate,
    "bucket_first": bucket_first,
    "step_delta": step_delta,
    "lag_seeded": lag_seeded,
    "linear_motion": linear_motion,
    "linear_motion_3d": linear_motion_3d,
    "stopped": stopped,
    "tipped": tipped,
    "active_labels": active_labels,
    "final_state": final_state,
}

_TRAJECTORY = f"""t AS (
  SELECT event_id, user_id, ts, value, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS us,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))::DOUBLE / {float(FRAME_US)!r} AS x
  FROM events)"""
_GATE = f"""{_TRAJECTORY},
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM t),
n AS (SELECT *, k + least(0, min(ceil(x)::BIGINT - k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS n FROM k),
p AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS was FROM n),
g AS (SELECT *, (n - 1)::BIGINT AS frame_idx FROM p WHERE n > was)"""
_STATE = """s AS (
  SELECT vec_id, e[1]*e[1]+e[2]*e[2]+e[3]*e[3] AS v2, e[4]*e[4]+e[5]*e[5]+e[6]*e[6] AS w2,
         e[7]*e[7]-e[8]*e[8]-e[9]*e[9]+e[10]*e[10] AS c, e[7]*e[7]+e[8]*e[8]+e[9]*e[9]+e[10]*e[10] AS q
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
l AS (
  SELECT vec_id, sqrt(v2) < 0.2 AND sqrt(w2) < 0.2 AS stopped,
         CASE WHEN q <> 0 THEN degrees(acos(greatest(-1.0, least(1.0, c / q)))) END AS tilt FROM s)"""

_SAMPLES = "b AS (SELECT vec_id, e, i::INT AS obj_idx FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), range(8) r(i))"
_Q = lambda a: [f"e[{a} * obj_idx + {4 + k}]" for k in range(4)]


def _tilt(a: int) -> str:
    w, x, y, z = _Q(a)
    return f"degrees(acos(greatest(-1.0, least(1.0, {w}*{w}-{x}*{x}-{y}*{y}+{z}*{z}))))"


def _states_sql(a: int) -> str:
    numbers = [f"e[6 * obj_idx + {k + 1}] AS v{k}" for k in range(3)] + [f"e[6 * obj_idx + {k + 4}] AS w{k}" for k in range(3)] + [f"e[{a} * obj_idx + {k + 1}] AS p{k}" for k in range(3)]
    return f"""WITH {_SAMPLES} SELECT vec_id, obj_idx, 'geom_obj' || obj_idx AS id, obj_idx + 1 AS geom_id, {', '.join(numbers)},
        floor({_tilt(a)} * 1000000.0 + 0.5) / 1000000.0 AS tilt FROM b"""


_speed = lambda k: "sqrt(" + "+".join(f"e[6 * obj_idx + {k + i}]*e[6 * obj_idx + {k + i}]" for i in range(3)) + ")"
ORACLE = {
    "body_states": _states_sql(7),
    "body_states_exact": _states_sql(6),
    "body_labels": f"""WITH {_SAMPLES}, l AS (SELECT vec_id, obj_idx, {_speed(1)} < 0.2 AND {_speed(4)} < 0.2 AS stopped, {_tilt(7)} > 45.0 AS tipped FROM b)
        SELECT vec_id, obj_idx, CASE WHEN stopped AND tipped THEN 'Stopped,Tipped' WHEN stopped THEN 'Stopped' WHEN tipped THEN 'Tipped' ELSE '' END AS active_labels FROM l""",
    "later_velocity": """SELECT vec_id, (i + 1)::INT AS geom_id, e[6 * i + 1] AS v_fixed, e[6 * least(i + 1, 7) + 1] AS v_exact
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), range(8) r(i)""",
    "frame_gate": f"WITH {_GATE} SELECT user_id, event_id, frame_idx FROM g",
    "bucket_first": f"""WITH {_TRAJECTORY} SELECT user_id, event_id, f AS frame_idx FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, f ORDER BY ts, event_id) AS r
        FROM (SELECT *, ceil(x)::BIGINT - 1 AS f FROM t)) WHERE r = 1""",
    "step_delta": f"""WITH {_TRAJECTORY}, d AS (SELECT *, us::DOUBLE / 1000000.0 AS s FROM t)
        SELECT event_id, user_id, greatest(s - coalesce(lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id), s), 1e-6) AS dt FROM d""",
    "lag_seeded": f"""WITH {_TRAJECTORY} SELECT event_id, user_id, value,
        coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0.0) AS value_prev FROM t""",
    "linear_motion": f"""WITH {_GATE},
        m AS (SELECT *, coalesce(lag(x) OVER w, x) AS xp, coalesce(lag(value) OVER w, value) AS vp FROM g
              WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        a AS (SELECT *, (value - vp) / greatest(x - xp, 1e-6) AS a FROM m)
        SELECT user_id, event_id, frame_idx,
          CASE WHEN round_even(sqrt(a * a), 3) < 0.01 THEN 'Constant Velocity'
               WHEN abs(value * a) < 1e-6 THEN NULL
               WHEN value * a > 0 THEN 'Accelerating' WHEN value * a < 0 THEN 'Decelerating' END AS label FROM a""",
    "linear_motion_3d": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        a AS (SELECT *, e[1]-e[11] AS x, e[2]-e[12] AS y, e[3]-e[13] AS z FROM v),
        n AS (SELECT *, sqrt(x*x+y*y+z*z) AS n, e[1]*x+e[2]*y+e[3]*z AS s FROM a)
        SELECT vec_id, CASE WHEN round_even(n, 3) < 0.01 THEN 'Constant Velocity' WHEN abs(s) < 1e-6 THEN NULL
                 WHEN s > 0 THEN 'Accelerating' WHEN s < 0 THEN 'Decelerating' END AS motion,
               floor(n * 1000000.0 + 0.5) / 1000000.0 AS acc_norm FROM n""",
    "stopped": f"WITH {_STATE} SELECT vec_id, stopped FROM l",
    "tipped": f"WITH {_STATE} SELECT vec_id, tilt > 45.0 AS tipped, floor(tilt * 1000000.0 + 0.5) / 1000000.0 AS tilt_deg FROM l",
    "active_labels": f"""WITH {_STATE} SELECT vec_id, CASE WHEN stopped AND tilt > 45.0 THEN 'Stopped,Tipped'
        WHEN stopped THEN 'Stopped' WHEN tilt > 45.0 THEN 'Tipped' ELSE '' END AS active_labels FROM l""",
    "final_state": "SELECT user_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id",
}
