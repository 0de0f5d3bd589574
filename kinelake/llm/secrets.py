"""Secret scan: known formats, then a randomness test battery for other tokens.

All of it is DataFrame expressions, no Python on the executors. Known formats are found by regular expressions; the places of matches are
rebuilt from the lengths of the texts between them. Other long tokens of two or more kinds of
characters are tested against being ordinary ones (identifiers, slugs, file names), by the
alphabet of the encoding that their characters suggest, in three ways: the chi-squared
statistic of the symbol counts is lower than ordinary letter use gives, runs of one kind of
character are more, and the lag-1 serial correlation is lower. Fisher's method joins the
three p-values. Over the tokens of the whole table the Benjamini-Hochberg procedure at level
FDR, with weights proportional to token length (long tokens carry more evidence), decides
which are too random to be ordinary: these are reported as `random`, so that the share of
ordinary tokens among them is bounded as far as the p-values hold. Its limit is taken from a
histogram of p / length (one shuffle of counts; bins of a 32nd of the natural logarithm, so
of at most some 2,100 rows whatever the table), rounded down to a bin's edge. The table is
scanned twice: once for the histogram, once for the spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import packed, settled, table, unpacked

# Formats of the known kinds, in their order. A match of "assign" counts if its value has 12 characters.
ASSIGN = (
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same matches as AKIA[A-Z0-9]+ of 18 or more characters
HEX = r"[0-9a-f]{16,}"  # the same as [0-9a-f]+ of 16 or more
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 12
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
# Fixed values, by encoding (16, 36, 62 and 64 symbols), of ordinary tokens: the chance that two of their symbols are
# equal (the chi-squared statistic as a rate), the share of neighbours of different kinds (lower, upper, digit, other) and
# the serial correlation; and the spread of each, times the root of the length.
EQUAL, EQUAL_SPREAD = (0.090, 0.037, 0.036, 0.049), (0.13, 0.12, 0.06, 0.11)
CHANGE, CHANGE_SPREAD = (0.20, 0.10, 0.31, 0.30), (0.45, 0.40, 0.52, 0.46)
CORRELATION, CORRELATION_SPREAD = (0.20, 0.25, 0.10, 0.20), (1.30, 1.20, 1.40, 1.45)
FDR = 0.01
_BIN = "CAST(floor(-ln(c.p / c.n) * 32) AS INT)"
_NONE = 1 << 30
_SPAN = "array<struct<start:int,kind:int,stop:int>>"
_BLOCK = 256


def _with_matches(df: DataFrame, pattern: str, name: str, group: int = 0) -> DataFrame:
    """df with {name}: structs (start, stop, found, value) of the matches in _text, places in code points.

    Lengths are summed within blocks of 256 matches and over blocks, so the work stays
    near linear for texts with very many matches.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    hit = f"rlike(_text, '{quoted}')"
    df = df.withColumn("_hit", F.expr(hit))
    df = df.withColumns(
        {
            "_between": F.expr(f"CASE WHEN _hit THEN transform(split(_text, '{quoted}', -1), x -> length(x)) END"),
            "_found": F.expr(f"CASE WHEN _hit THEN regexp_extract_all(_text, '{quoted}', 0) END"),
            "_value": F.expr(f"CASE WHEN _hit THEN regexp_extract_all(_text, '{quoted}', {group}) END"),
        }
    )
    # Length of the text before match i, from match i - 1's start on.
    df = df.withColumn("_step", F.expr("transform(_found, (x, i) -> get(_between, i) + coalesce(length(get(_found, i - 1)), 0))"))
    df = df.withColumn(
        "_block",
        F.expr(f"transform(sequence(0, CAST((size(_step) - 1) DIV {_BLOCK} AS INT)), b -> aggregate(slice(_step, b * {_BLOCK} + 1, {_BLOCK}), 0, (a, x) -> a + x))"),
    )
    df = df.withColumn("_before", F.expr("transform(_block, (x, b) -> aggregate(slice(_block, 1, b), 0, (a, y) -> a + y))"))
    start = (
        f"get(_before, CAST(i DIV {_BLOCK} AS INT)) + aggregate(slice(_step, CAST(i DIV {_BLOCK} AS INT) * {_BLOCK} + 1, CAST(i % {_BLOCK} AS INT) + 1), 0, (a, y) -> a + y)"
    )
    df = df.withColumn("_start", F.expr(f"transform(_found, (x, i) -> {start})"))
    whole = "transform(_found, (x, i) -> struct(get(_start, i) AS start, get(_start, i) + length(x) AS stop, x AS found, get(_value, i) AS value))"
    df = df.withColumn(name, F.expr(f"coalesce({whole}, array())"))
    return df.drop("_hit", "_between", "_found", "_value", "_step", "_block", "_before", "_start")


def _spans(matches: str, kind: str) -> Column:
    return F.expr(f"transform({matches}, m -> struct(m.start AS start, {KINDS.index(kind)} AS kind, m.stop AS stop))").cast(_SPAN)


def upper_tail(z: str) -> str:
    """SQL for the upper tail of the normal distribution at z (rational approximation, error under 1.5e-7)."""
    x = f"(abs({z}) / sqrt(2D))"
    t = f"(1D / (1D + 0.3275911D * {x}))"
    tail = f"(0.5D * {t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D)))) * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1D - {tail} END)"


def battery(candidates: str) -> Column:
    """Structs (start, stop, n, p) of an array of structs (start, stop, found): p under the hypothesis of an ordinary token."""
    lower, digits, upper = "abcdefghijklmnopqrstuvwxyz", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alphabets = [f"{digits}abcdef", f"{digits}{lower}", f"{digits}{upper}{lower}", f"{upper}{lower}{digits}+/"]
    kinds = "a" * 26 + "A" * 26 + "0" * 10
    # The encoding inferred from a token's characters, and the token as that encoding writes it (UUIDs without their dashes).
    coded = f"""transform({candidates}, c -> named_struct('start', c.start, 'stop', c.stop, 'found', c.found,
        'e', CASE WHEN rlike(c.found, '^[0-9a-fA-F]+(-[0-9a-fA-F]+)*$') THEN 0 WHEN rlike(c.found, '^([0-9a-z]+|[0-9A-Z]+)$') THEN 1
                  WHEN rlike(c.found, '^[0-9A-Za-z]+$') THEN 2 ELSE 3 END))"""
    written_ = f"""transform({coded}, c -> named_struct('start', c.start, 'stop', c.stop, 'e', c.e,
        'alphabet', get(array({", ".join(f"'{a}'" for a in alphabets)}), c.e),
        'token', CASE WHEN c.e = 0 THEN lower(replace(c.found, '-', '')) WHEN c.e = 1 THEN lower(c.found) WHEN c.e = 2 THEN c.found
                      ELSE translate(rtrim('=', c.found), '-_=', '+/') END))"""
    constant = lambda values: f"get(array({', '.join(f'{v}D' for v in values)}), c.e)"
    valued = f"""transform({written_}, c -> named_struct('start', c.start, 'stop', c.stop, 'e', c.e, 'alphabet', c.alphabet, 'token', c.token,
        'n', CAST(length(c.token) AS DOUBLE),
        'kinds', split(translate(c.token, '{lower}{upper}{digits}', '{kinds}'), ''),
        'v', transform(split(c.token, ''), x -> CAST(instr(c.alphabet, x) - 1 AS DOUBLE))))"""
    counted = f"""transform({valued}, c -> named_struct('start', c.start, 'stop', c.stop, 'e', c.e, 'n', c.n, 'v', c.v,
        'squares', aggregate(transform(sequence(1, length(c.alphabet)), j -> CAST(length(c.token) - length(replace(c.token, substr(c.alphabet, j, 1), '')) AS DOUBLE)), 0D, (a, x) -> a + x * x),
        'changes', aggregate(transform(c.kinds, (x, i) -> CASE WHEN i > 0 AND x <> get(c.kinds, i - 1) THEN 1D ELSE 0D END), 0D, (a, x) -> a + x),
        'mean', aggregate(c.v, 0D, (a, x) -> a + x) / c.n))"""
    summed = f"""transform({counted}, c -> named_struct('start', c.start, 'stop', c.stop, 'e', c.e, 'n', c.n,
        'equal', (c.squares - c.n) / (c.n * (c.n - 1D)), 'change', c.changes / (c.n - 1D),
        'spread', aggregate(c.v, 0D, (a, x) -> a + (x - c.mean) * (x - c.mean)),
        'lag', aggregate(transform(c.v, (x, i) -> CASE WHEN i > 0 THEN (x - c.mean) * (get(c.v, i - 1) - c.mean) ELSE 0D END), 0D, (a, x) -> a + x)))"""
    scored = f"""transform({summed}, c -> named_struct('start', c.start, 'stop', c.stop, 'n', c.n,
        'z1', ({constant(EQUAL)} - c.equal) * sqrt(c.n) / {constant(EQUAL_SPREAD)},
        'z2', (c.change - {constant(CHANGE)}) * sqrt(c.n) / {constant(CHANGE_SPREAD)},
        'z3', CASE WHEN c.spread > 0 THEN ({constant(CORRELATION)} - c.lag / c.spread - 1D / c.n) * sqrt(c.n) / {constant(CORRELATION_SPREAD)} ELSE -9D END))"""
    logs = " - ".join(f"ln(greatest(1e-12D, {upper_tail(f'c.z{i}')}))" for i in (1, 2, 3))
    joined = f"transform({scored}, c -> named_struct('start', c.start, 'stop', c.stop, 'n', c.n, 's', -{logs}))"
    return F.expr(f"transform({joined}, c -> named_struct('start', c.start, 'stop', c.stop, 'n', c.n, 'p', exp(-c.s) * (1D + c.s + c.s * c.s / 2D)))")


def tested(docs: DataFrame) -> DataFrame:
    """docs packed with its text apart, with base and _tested: known kinds, and the battery's results for other tokens."""
    df = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    df = _with_matches(df, ASSIGN, "_assign", 1)
    df = df.withColumn("_assign", F.expr(f"filter(_assign, m -> length(m.value) >= {LEAST_VALUE})"))
    for pattern, name in ((ACCESS, "_access"), (HEX, "_hex"), (CANDIDATE, "_candidates")):
        df = _with_matches(df, pattern, name)
    df = df.withColumn("base", F.sort_array(F.concat(_spans("_assign", "assign"), _spans("_access", "access"), _spans("_hex", "hex"))))
    mixed = (
        "filter(_candidates, c -> CAST(rlike(c.found, '[0-9]') AS INT) + CAST(rlike(c.found, '[a-z]') AS INT) + CAST(rlike(c.found, '[A-Z]') AS INT) > 1"
        " AND NOT exists(base, b -> b.start < c.stop AND b.stop > c.start))"
    )
    return df.withColumn("_mixed", F.expr(mixed)).withColumn("_tested", battery("_mixed"))


def limit(docs: DataFrame) -> int:
    """The least bin of p / length that is reported as `random` in docs; a very large number if none is.

    Counts of bins alone reach the driver. A table without tokens to test reports none; repeated rows count as often as they are there.
    """
    # An inner explode would push a filter below, and repeat the expressions that its array shares.
    tokens = tested(packed(docs.select("text"), "text")).select(F.explode_outer("_tested").alias("c"))
    bins = tokens.selectExpr(f"{_BIN} AS bin", "c.n").groupBy("bin").agg(F.count("n"), F.sum("n")).collect()
    bins = sorted(((b, count, n) for b, count, n in bins if b is not None), reverse=True)
    tokens, length = (sum(x[i] for x in bins) for i in (1, 2))
    least, so_far = _NONE, 0
    for b, count, _ in bins:
        so_far += count
        if length / tokens * math.exp(-b / 32) <= FDR * so_far / tokens:
            least = b
    return least


def find(docs: DataFrame, least: int | None = None) -> DataFrame:
    """docs with base and spans: arrays of (start, kind, stop), kind a place in KINDS, stop exclusive.

    base holds the known kinds, spans these and `random`, both by start, then kind. What is
    random is decided by `least`, as `limit` gives it: of docs itself (a job that runs at once), if
    none is given. A NULL or empty text has none, an empty table stays empty, repeated rows are
    each scanned, and a very long text is scanned whole. A candidate that overlaps a known kind
    isn't tested. Columns of docs named base or spans give way; all others keep their values.
    """
    least = limit(docs) if least is None else least
    df = tested(packed(docs, "text"))
    random = f"transform(filter(_tested, c -> {_BIN} >= {int(least)}), c -> struct(c.start AS start, {KINDS.index('random')} AS kind, c.stop AS stop))"
    df = df.withColumn("spans", F.sort_array(F.concat("base", F.expr(random).cast(_SPAN))))
    return settled(df, ["_rest", "text"], ["base", "spans"]).select(*unpacked(docs, "text", without=("base", "spans")), "base", "spans")


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    each = F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(each, ",")


def query(spark, sf_dir):
    """Secrets of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


QUERY = ("op9_secrets", query)
