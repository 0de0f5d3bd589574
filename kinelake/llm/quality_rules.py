"""Quality rules: word and repetition counts, and divergence from language references.

Everything is DataFrame expressions on one row at a time: no shuffle, no Python on the
executors. The verdict compares two histograms of a text with fixed references by the
Jensen-Shannon distance: the classes of its characters, and its most common words. A
text is kept if it is near both references of one language. Words count without case (A-Z)
and the punctuation around them. Texts too short for a histogram are not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import packed, settled, table, unpacked

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"'()+,-./:;=?@[\\]^_`{}~"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
WINDOW = 5
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance")
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Characters in words, and words, from which the class and the word histogram count.
CLASS_GUARD, WORD_GUARD = 100, 40
#: A text passes up to this class distance, and up to this sum of both distances
#: (Jensen-Shannon, natural logarithm: each is at most 0.833).
CLASS_LIMIT, SUM_LIMIT = 0.30, 0.38

# Shares of lower-case, upper-case, digits, punctuation, symbols and other
# characters in words of running text, and the share of each language's commonest words.
CLASS_REFERENCE = {
    "en": (0.940, 0.030, 0.005, 0.023, 0.001, 0.001),
    "de": (0.890, 0.060, 0.005, 0.024, 0.001, 0.020),
    "fr": (0.900, 0.030, 0.005, 0.030, 0.001, 0.034),
    "es": (0.915, 0.030, 0.005, 0.025, 0.001, 0.024),
}
WORD_REFERENCE = {
    "en": {"the": 0.060, "of": 0.030, "and": 0.028, "to": 0.026, "a": 0.022, "in": 0.021, "is": 0.011, "that": 0.010, "for": 0.009, "it": 0.009, "was": 0.008, "with": 0.007},
    "de": {"der": 0.030, "die": 0.030, "und": 0.027, "in": 0.017, "den": 0.012, "von": 0.010, "zu": 0.010, "das": 0.010, "mit": 0.009, "ist": 0.008, "auf": 0.007, "nicht": 0.007},
    "fr": {"de": 0.045, "la": 0.028, "le": 0.022, "et": 0.020, "les": 0.018, "des": 0.017, "en": 0.015, "un": 0.012, "du": 0.011, "une": 0.010, "que": 0.009, "est": 0.008},
    "es": {"de": 0.050, "la": 0.032, "que": 0.028, "el": 0.026, "en": 0.024, "y": 0.022, "los": 0.014, "se": 0.012, "del": 0.011, "un": 0.010, "por": 0.009, "con": 0.008},
}
COMMON = sorted({w for words in WORD_REFERENCE.values() for w in words})


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def word_reference(language: str) -> list[float]:
    """Shares of COMMON's words in the language, then of all other words."""
    shares = [WORD_REFERENCE[language].get(w, 0.0) for w in COMMON]
    return [*shares, 1.0 - sum(shares)]


def js_distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of an array of shares from fixed ones: sqrt of the divergence in nats."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        own = F.when(p > 0, p * F.log(p / m)).otherwise(0.0)
        return own + F.when(q > 0, q * F.log(q / m)).otherwise(0.0)

    terms = F.zip_with(shares, F.array(*map(F.lit, reference)), term)
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance.

    A NULL text counts as none: zeros, and NULL distances. A distance is NULL for texts
    under its guard; both are of one language, the nearest. An empty table stays empty, repeated
    rows are each measured, very long texts are measured whole. Columns of docs named like
    the added ones give way, all others keep their values.
    """
    return _measured(packed(docs, "text")).select(*unpacked(docs, "text", without=ADDED), *ADDED)


def _bare(word: Column) -> Column:
    return F.btrim(F.translate(word, UPPER, LOWER), F.lit(PUNCTUATION))


def _measured(docs: DataFrame) -> DataFrame:
    """(_rest, text, ADDED columns) of docs packed with its text apart."""
    df = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    stripped = F.btrim("_text", F.lit(BLANKS))
    df = df.withColumn("_words", F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, r"[\x20\x09-\x0D]+")))
    # Characters of words, class after class taken out.
    df = df.withColumn("_c0", _without(F.col("_text"), BLANKS))
    for k, out in enumerate((SYMBOLS, LOWER, UPPER, DIGITS, PUNCTUATION)):
        df = df.withColumn(f"_c{k + 1}", _without(F.col(f"_c{k}"), out))
    size = [F.length(f"_c{k}") for k in range(6)]
    symbols, lower, upper, digits, marks = (size[k] - size[k + 1] for k in range(5))
    # Lines with a word, and windows of words.
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": size[0].cast("long"),
            "n_symbols": symbols.cast("long"),
            "_classes": F.array(*(x.cast("double") for x in (lower, upper, digits, marks, symbols, size[5]))),
            "_lines": lines,
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
            "_common": F.array_join(F.filter(F.transform("_words", _bare), lambda w: w.isin(COMMON)), "  "),
        }
    )
    windows = F.expr(
        "CASE WHEN n_words >= 5 THEN transform(sequence(0, CAST(n_words AS INT) - 5), i ->"
        " xxhash64(get(_hashes, i), get(_hashes, i + 1), get(_hashes, i + 2), get(_hashes, i + 3), get(_hashes, i + 4))) ELSE array() END"
    )
    df = df.withColumns({"n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_windows": windows})
    # Only texts with an equal pair of windows sort them, by hash and place.
    ordered = F.expr("CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i))) END")
    df = df.withColumn("_ordered", ordered)
    again = F.expr(
        "CASE WHEN _ordered IS NOT NULL THEN sort_array(transform("
        "filter(_ordered, (x, j) -> coalesce(get(_ordered, j - 1).h = x.h, false) OR coalesce(get(_ordered, j + 1).h = x.h, false)), x -> x.i)) END"
    )
    df = df.withColumn("_again", again)
    covered = F.expr(
        "CASE WHEN _again IS NULL THEN 0L ELSE"
        " aggregate(transform(_again, (p, k) -> least(5, coalesce(get(_again, k + 1) - p, 5))), 0L, (a, x) -> a + x) END"
    )
    padded = F.concat(F.lit(" "), F.col("_common"), F.lit(" "))
    df = df.withColumns({"n_repeat_words": covered, "_padded": padded})
    counts = [((F.length("_padded") - F.length(F.replace("_padded", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("double") for w in COMMON]
    df = df.withColumn("_counts", F.array(*counts))
    class_shares = F.transform("_classes", lambda x: x / F.col("word_chars"))
    known = F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x)
    word_shares = F.transform(F.concat("_counts", F.array(F.col("n_words") - known)), lambda x: x / F.col("n_words"))
    df = df.withColumns(
        {"_p": F.when(F.col("word_chars") >= CLASS_GUARD, class_shares), "_q": F.when(F.col("n_words") >= WORD_GUARD, word_shares)}
    )
    by_language = [F.struct(js_distance(F.col("_p"), list(CLASS_REFERENCE[x])).alias("c"), js_distance(F.col("_q"), word_reference(x)).alias("w")) for x in CLASS_REFERENCE]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    # The language of the smallest sum; of those within the class limit, if any.
    ranked = F.transform(F.array(*by_language), lambda s: F.struct((zero(s["c"]) > CLASS_LIMIT).alias("far"), (zero(s["c"]) + zero(s["w"])).alias("sum"), s["c"].alias("c"), s["w"].alias("w")))
    df = df.withColumn("_best", F.array_min(ranked))
    df = df.withColumns({"class_distance": F.col("_best.c"), "word_distance": F.col("_best.w")})
    return settled(df, ["_rest", "text"], list(ADDED))


def _verdict(measured: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    by_class, by_word = F.coalesce("class_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    near = (by_class <= CLASS_LIMIT) & (by_class + by_word <= SUM_LIMIT)
    return measured.withColumns({"base_failed": failed, "kept": ~failed & near})


def judged(docs: DataFrame) -> DataFrame:
    """measures(docs) with base_failed (too few or repeated words) and kept; these names give way too."""
    added = (*ADDED, "base_failed", "kept")
    return _verdict(_measured(packed(docs, "text"))).select(*unpacked(docs, "text", without=added), *added)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns, whatever their names. NULL and empty texts have too few words."""
    return _verdict(_measured(packed(docs, "text"))).where("kept").select(*unpacked(docs, "text"))


def query(spark, sf_dir):
    """Quality counts and verdict of every document.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept.
    """
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERY = ("op5_quality_rules", query)


def _sql_distance(shares: list[str], reference: list[float]) -> str:
    terms = []
    for p, q in zip(shares, reference, strict=True):
        m = f"(({p} + {q!r}::DOUBLE) / 2)"
        own = f"CASE WHEN {p} > 0 THEN {p} * ln({p} / {m}) ELSE 0 END"
        ref = f" + {q!r}::DOUBLE * ln({q!r}::DOUBLE / {m})" if q > 0 else ""
        terms.append(f"({own}{ref})")
    return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0.0))"


def _oracle() -> str:
    quote = lambda x: x.replace("'", "''")
    count = lambda chars: f"length(text) - length(translate(text, '{quote(chars)}', ''))"
    classes = ["lower_", "upper_", "digits", "marks", "n_symbols", "other"]
    by_class = [f"({c}::DOUBLE / word_chars)" for c in classes]
    by_word = [f"(c{k}::DOUBLE / n_words)" for k in range(len(COMMON))] + ["((n_words - known)::DOUBLE / n_words)"]
    in_class = {x: f"CASE WHEN word_chars >= {CLASS_GUARD} THEN {_sql_distance(by_class, list(r))} ELSE 0 END" for x, r in CLASS_REFERENCE.items()}
    in_words = {x: f"CASE WHEN n_words >= {WORD_GUARD} THEN {_sql_distance(by_word, word_reference(x))} ELSE 0 END" for x in WORD_REFERENCE}
    distances = ", ".join(f"{in_class[x]} AS class_{x}, {in_words[x]} AS word_{x}" for x in CLASS_REFERENCE)
    near = " OR ".join(f"(class_{x} <= {CLASS_LIMIT} AND class_{x} + word_{x} <= {SUM_LIMIT})" for x in CLASS_REFERENCE)
    found = ", ".join(f"len(list_filter(bare, lambda x: x = '{c}')) AS c{k}" for k, c in enumerate(COMMON))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        {count(SYMBOLS)} AS n_symbols, {count(LOWER)} AS lower_, {count(UPPER)} AS upper_, {count(DIGITS)} AS digits, {count(PUNCTUATION)} AS marks FROM d),
m AS (SELECT *, list_transform(w, lambda x: trim(translate(x, '{UPPER}', '{LOWER}'), '{quote(PUNCTUATION)}')) AS bare, len(w)::BIGINT AS n_words, length(array_to_string(w, '')) AS word_chars, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w),
c AS (SELECT *, word_chars - n_symbols - lower_ - upper_ - digits - marks AS other, {found} FROM m),
k AS (SELECT *, {" + ".join(f"c{k}" for k in range(len(COMMON)))} AS known FROM c),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM m)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM v) WHERE n > 1),
a AS (SELECT doc_id, count(DISTINCT q) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 5)) AS q FROM r) GROUP BY doc_id),
s AS (SELECT k.*, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
        {distances}
      FROM k LEFT JOIN a USING (doc_id)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND ({near}) AS kept FROM f"""


ORACLE = _oracle()
