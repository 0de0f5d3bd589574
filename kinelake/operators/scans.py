"""Scans over long runs: what a window over a whole run gives, without a task that holds a run.

A run is cut into pieces: ranges of its leading order column, by a Column that never falls along the
order (`pieces` makes one of even sizes). Each (run, piece) is handled alone. What a piece must know of
those before it is a summary (a count, a least value, the last row, an affine map); the few
summaries of a run are combined and put before the rows of each piece as one row more.
One shuffle of the rows, by (run, piece).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces that a table's order is cut into.
PIECES = 64


def pieces(df: DataFrame, at: Column, n: int = PIECES) -> Column:
    """The piece, 0 to n - 1, of a numeric value: n ranges of about as many rows (one action: approximate quantiles).

    Rows with equal values stay together; NULL is in the first piece, NaN in the last.
    """
    value = at.cast("double")
    if n < 2:
        return F.lit(0)
    bounds = sorted(set(df.select(value.alias("at")).approxQuantile("at", [k / n for k in range(1, n)], 1 / (4 * n))))
    if not bounds:
        return F.lit(0)
    side = max(1, round(len(bounds) ** 0.5))  # look among every side-th bound first, then between two of these
    wide, every = F.array(*map(F.lit, bounds[side - 1 :: side])), F.array(*map(F.lit, bounds))
    passed = F.size(F.filter(wide, lambda b: b <= value)) * side
    return F.coalesce(passed + F.size(F.filter(F.slice(every, passed + 1, side), lambda b: b <= value)), F.lit(0))


def _window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, "_piece").orderBy(F.desc("_ahead"), *order)


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)


def _led(df: DataFrame, ahead: DataFrame) -> DataFrame:
    """df, and before the rows of a piece the one that `ahead` has for it."""
    return df.withColumn("_ahead", F.lit(False)).unionByName(ahead.withColumn("_ahead", F.lit(True)), allowMissingColumns=True)


def _rows(df: DataFrame, *also: str) -> DataFrame:
    return df.where(~F.col("_ahead")).drop("_ahead", "_piece", *also)


def numbered(df: DataFrame, keys: list[str], order: list[str], piece: Column, out: str = "n") -> DataFrame:
    """df with the row's number in its run, from 1: row_number over the whole run."""
    cut = df.withColumn("_piece", piece)
    sizes = cut.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_size"))
    ahead = sizes.select(*keys, "_piece", F.coalesce(F.sum("_size").over(_before(keys)), F.lit(0)).alias("_offset"))
    w = _window(keys, order)
    led = _led(cut, ahead).withColumn(out, (F.first("_offset").over(w) + F.row_number().over(w) - 1).cast("long"))
    return _rows(led, "_offset")


def lagged(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, piece: Column, default: Column | None = None) -> DataFrame:
    """df with the value of the row before in its run, `default` (of the row's own columns) in the first row.

    A piece gets the last row's value of the piece before it as a row of its own.
    """
    cut = df.withColumn("_piece", piece)
    last = cut.groupBy(*keys, "_piece").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    following = last.select(*keys, F.lead("_piece").over(Window.partitionBy(*keys).orderBy("_piece")).alias("_piece"), "_last")
    w = _window(keys, order)
    led = _led(cut.withColumn("_last", F.struct(F.col(value).alias("v"))), following.where("_piece IS NOT NULL"))
    was = F.lag("_last").over(w)
    found = was["v"] if default is None else F.when(was.isNull(), default).otherwise(F.coalesce(was["v"], default))
    return _rows(led.withColumn(out, found), "_last")


def gated(df: DataFrame, keys: list[str], order: list[str], position: Column, piece: Column) -> DataFrame:
    """The steps at which a frame is due, with frame_idx: `frames.frame_gate` over pieces.

    A piece brings (rows, least of ceil(position) - number) to those after it.
    """
    cut = df.withColumns({"_piece": piece, "_x": F.ceil(position).cast("long")})
    local = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*order))
    sums = cut.withColumn("_d", F.col("_x") - local).groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_size"), F.min("_d").alias("_least"))
    counted = sums.withColumn("_offset", F.coalesce(F.sum("_size").over(_before(keys)), F.lit(0)))
    least = F.least(F.lit(0).cast("long"), F.min(F.col("_least") - F.col("_offset")).over(_before(keys)))
    ahead = counted.select(*keys, "_piece", "_offset", F.coalesce(least, F.lit(0).cast("long")).alias("_low"))
    w = _window(keys, order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    led = _led(cut, ahead).withColumn("_k", F.first("_offset").over(w) + F.row_number().over(w) - 1)
    low = F.least(F.first("_low").over(w), F.min(F.when(~F.col("_ahead"), F.col("_x") - F.col("_k"))).over(so_far))
    counted = led.withColumn("_n", F.col("_k") + low)
    due = counted.withColumn("_was", F.lag("_n").over(w)).where(~F.col("_ahead") & (F.col("_n") > F.col("_was")))
    return _rows(due.withColumn("frame_idx", (F.col("_n") - 1).cast("long")), "_x", "_k", "_n", "_was", "_offset", "_low", "_size", "_least")


def _folded(df: DataFrame, keys: list[str], order: list[str], values: list[str], alpha: float, piece: Column) -> DataFrame:
    """(keys, _piece, _size, _first and _map of each value): a piece takes y to (1 - alpha)^size y + map.

    A NULL among a piece's values makes its map NULL, and so all that comes after.
    """
    back = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*(F.desc(c) for c in order))) - 1
    cut = df.withColumn("_piece", piece).withColumn("_weight", F.lit(alpha) * F.pow(F.lit(1 - alpha), back))
    total = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(F.col("_weight") * F.col(c)))
    first = lambda c: F.min_by(F.struct(F.col(c).alias("v")), F.struct(*order))["v"]
    columns = [x for i, c in enumerate(values) for x in (first(c).alias(f"_first_{i}"), total(c).alias(f"_map_{i}"))]
    return cut.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_size"), *columns)


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, piece: Column, seed: Column | None = None) -> DataFrame:
    """(keys, n, ema): the smoothed value after a run's last row, y = alpha x + (1 - alpha) y; any alpha, any length.

    Starts at `seed`, a Column of keys (the run's first value if None). The maps of a run's pieces are weighted by the rows
    that follow them, and summed. A NULL value makes the result NULL.
    """
    parts = _folded(df, keys, order, [value], alpha, piece)
    after = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weighted = parts.withColumn("_rest", F.pow(F.lit(1 - alpha), after) * F.col("_map_0"))
    n = F.sum("_size")
    whole = F.when(F.count("_rest") == F.count(F.lit(1)), F.sum("_rest"))
    start = F.min_by("_first_0", "_piece") if seed is None else F.first(seed)
    return weighted.groupBy(*keys).agg(n.alias("n"), (F.pow(F.lit(1 - alpha), n) * start + whole).alias("ema"))


def smoothed(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, float | str | None]], alpha: float, piece: Column, number: str = "n") -> DataFrame:
    """(keys, order, number, smoothed columns): every row's smoothed values in its run, and its number from 1.

    values gives for each column the name of its smoothed one and where smoothing starts: a number, a column of
    df (equal in all rows of a run), or None for a run's first value, which is then taken as it is. After a NULL all is NULL, and
    after a value that is not finite NaN or infinite.

    Rows are numbered and cut into blocks over which the weight of a value falls to 1e-100. In a block, with d = 1 - alpha, the j-th
    value is d^(j+1) times what the block begins with, plus d^j times a running sum of alpha d^-i x. A block begins with what the blocks
    before it end with, each weighted by d to the rows in between: after four blocks that is zero in double arithmetic.
    """
    d = 1 - alpha
    rows = max(1, int(230 / -math.log(d))) if 0 < d < 1 else 1 if d <= 0 else 1 << 30
    back = [i for i in range(8) if d ** (rows * i) > 0] or [0]  # blocks whose weight a double can tell from zero
    power = lambda k: F.pow(F.lit(float(d)), k)
    columns, names = list(values), [name for name, _ in values.values()]
    starts = [F.col(c if start is None else start).cast("double") if start is None or isinstance(start, str) else F.lit(float(start)) for c, (_, start) in values.items()]
    numbers = numbered(df, keys, order, piece, "_n").withColumn("_k", F.col("_n") - 1)
    cut = numbers.select(*keys, *order, "_n", F.floor(F.col("_k") / rows).alias("_piece"), (F.col("_k") % rows).alias("_j"), *(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)), *(s.alias(f"_s{i}") for i, s in enumerate(starts)))
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    sums = cut.groupBy(*keys, "_piece").agg(
        *(x for i in range(len(columns)) for x in (
            F.sum(F.lit(float(alpha)) * power(F.lit(rows - 1) - F.col("_j")) * F.col(f"_v{i}")).alias(f"_q{i}"), F.min_by(F.col(f"_s{i}"), F.col("_j")).alias(f"_s{i}"),
            F.max(F.when(F.col(f"_v{i}").isNull(), 2).when(odd(f"_v{i}"), 1).otherwise(0)).alias(f"_o{i}"),
        ))
    )
    run = Window.partitionBy(*keys).orderBy("_piece")

    def begin(i: int) -> Column:
        """What a block begins with: from its forerunners, and from the start while that has any weight."""
        terms = [F.coalesce(F.lag(f"_q{i}", b + 1).over(run), F.lit(0.0)) * F.lit(float(d ** (rows * b))) for b in back]
        first = F.first(f"_s{i}").over(run)
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        total = total + F.when(F.col("_piece") < len(back), power(F.col("_piece") * rows) * first).otherwise(F.lit(0.0))
        before = F.max(f"_o{i}").over(run.rowsBetween(Window.unboundedPreceding, -1))
        return F.when(before == 2, F.lit(None).cast("double")).when(before == 1, F.lit(float("nan"))).otherwise(total)

    ahead = sums.select(*keys, "_piece", *(begin(i).alias(f"_y{i}") for i in range(len(columns))))
    w = _window(keys, order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    led = _led(cut, ahead)

    def smooth(i: int) -> Column:
        summed = F.coalesce(F.sum(F.lit(float(alpha)) * power(-F.col("_j")) * F.col(f"_v{i}")).over(so_far), F.lit(0.0)) if d > 0 else F.lit(0.0)
        last = power(F.col("_j")) * summed if d > 0 else F.col(f"_v{i}")
        missing = F.max(F.when(~F.col("_ahead") & F.col(f"_v{i}").isNull(), 1).otherwise(0)).over(so_far)
        return F.when(missing == 0, power(F.col("_j") + 1) * F.first(f"_y{i}").over(w) + last)

    found = led.select(*keys, *order, "_ahead", F.col("_n").alias(number), *(smooth(i).alias(name) for i, name in enumerate(names)))
    return found.where(~F.col("_ahead")).drop("_ahead")
