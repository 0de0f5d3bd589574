"""Benchmark decontamination: exact containment of item windows, by a prefix-filtered join.

Each benchmark item gives its windows of ten consecutive words (a shorter item is one
window). The tokens of the join are shingles of four consecutive words, or of all words of
a window that has fewer. The documents are read once: positions whose shingle passes a
filter of the benchmark's shingles form runs, and a run stays only if it is as long as the
shortest window needs, as a window that occurs has all its shingles in one run. Equal runs
are handled once, so a passage that many documents share is a single row.

Shingles are ordered by their frequency in the runs. As a window must be contained whole, its
rarest shingle is its necessary prefix: windows and runs are joined on these alone.
Positional and length bounds drop windows that would not fit into the run, and all words
of the rest are compared, by 64-bit hashes. Both sides of the join are tables of any size;
the filter alone is broadcast, and its size is bounded (a full filter lets more runs
through to the join, with the same result).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm import arrowtext as at
from kinelake.llm.common import Shared, cut, keep, packed, table, unpacked, written
from kinelake.llm.pitman_yor import mixed

WINDOW, SHINGLE = 10, 4
#: The most bits of the filter (as a power of two), and bits a shingle below that.
FILTER_POWER, FILTER_BITS = 28, 32
#: Bytes of matched runs that are broadcast; beyond them the join is by salted run.
BROADCAST_BYTES, SALTS = 16 << 20, 32
ADDED = ("n_words", "n_hit", "spans", "items")
_SPANS = "array<struct<first:bigint,last:bigint>>"
_ITEMS = "array<string>"


def hashed_words(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the bounds of each text's."""
    found, bounds = at.alnum_words(array)
    return at.hashed(found), bounds


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all `size` consecutive words (those across two texts included)."""
    out = np.full(max(len(words) - size + 1, 0), size, np.uint64)
    for k in range(size):
        out = mixed(out + words[k : k + len(out)])
    return out


def windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, wid, n, words): the windows of all items; items without id or words have none."""

    def run(batches):
        for batch in at.slices(batches):
            words, bounds = hashed_words(at.texts(batch.column("text")))
            count = np.diff(bounds)
            n = np.minimum(count, WINDOW)
            many = np.where(count > 0, count - n + 1, 0)
            row = np.repeat(np.arange(len(count)), many)
            start = bounds[row] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            size = n[row]
            edge = np.concatenate([[0], np.cumsum(size)])
            flat = words[np.repeat(start - edge[:-1], size) + np.arange(edge[-1])].view(np.int64)
            wid = np.zeros(len(row), np.uint64)
            for k in range(WINDOW):
                own = size > k
                wid[own] = mixed(wid[own] * np.uint64(31) + words[start[own] + k])
            lists = pa.ListArray.from_arrays(edge.astype(np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(row)), pa.array(wid.view(np.int64)), pa.array(size), lists], ["item_id", "wid", "n", "words"])

    named = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return named.mapInArrow(run, "item_id string, wid long, n long, words array<bigint>")


def _shingled(df: DataFrame, key: str) -> DataFrame:
    """(key, copies, at, shingle, n, around, lead) of rows (key, copies, n, size, words): each shingle with the words near it, its own first one being `lead`."""

    def run(batches):
        for batch in batches:
            for name, copies, n, size, words in zip(*(batch.column(c).to_pylist() for c in (key, "copies", "n", "size", "words")), strict=True):
                words = np.array(words, np.int64)
                found = shingles(words.view(np.uint64), size).view(np.int64)
                m, place = len(found), np.arange(len(found))
                low, high = np.maximum(place - WINDOW + size, 0), np.minimum(place + WINDOW, len(words))
                edge = np.concatenate([[0], np.cumsum(high - low)])
                near = words[np.repeat(low - edge[:-1], high - low) + np.arange(edge[-1])]
                fixed = [pa.array(np.full(m, x)) for x in (name, copies, n)]
                lists = pa.ListArray.from_arrays(edge.astype(np.int32), pa.array(near))
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(place), pa.array(found), lists, pa.array(place - low)], [key, "copies", "n", "at", "shingle", "around", "lead"])

    return df.mapInArrow(run, f"{key} long, copies long, n long, at long, shingle long, around array<bigint>, lead long")


class Filter:
    """The benchmark's shingles, two bits each, and the shortest window of each shingle size."""

    def __init__(self, power: int, bits: np.ndarray, shortest: dict[int, int]):
        self.power, self.bits, self.shortest = power, bits, shortest

    @staticmethod
    def places(hashes, power: int):
        return hashes >> np.uint64(64 - power), (hashes << np.uint64(power)) >> np.uint64(64 - power)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in self.places(hashes, self.power):
            out &= (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return out


def build_filter(parts: DataFrame, lengths: DataFrame) -> Filter:
    """From the windows' shingles and the table of sizes (actions; what comes to the driver is the filter)."""
    distinct = parts.agg(F.approx_count_distinct("shingle")).first()[0] or 0
    power = int(np.clip(np.ceil(np.log2(max(distinct, 1) * FILTER_BITS)), 10, FILTER_POWER))
    h = F.col("shingle")
    places = [F.shiftrightunsigned(h, 64 - power), F.shiftrightunsigned(F.shiftleft(h, power), 64 - power)]
    each = parts.select(F.explode(F.array(*places)).alias("p"))
    found = each.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (power - 6), np.uint64)
    bits[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return Filter(power, bits, {r["size"]: r["n"] for r in lengths.collect()})


def scan(docs: DataFrame, known: Filter, with_text: bool) -> DataFrame:
    """(row, _rest, [text], n_words, runs) of packed documents; a run is (start, n, size, words)."""
    shared = Shared(docs.sparkSession, known)
    run_type = pa.struct([("start", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("rid", pa.int64()), ("words", pa.list_(pa.int64()))])
    carried = ["_rest", "text"] if with_text else ["_rest"]

    def run(batches):
        known, row = shared.value, TaskContext.get().partitionId() << 33
        for batch in at.slices(batches):
            words, bounds = hashed_words(at.texts(batch.column("text")))
            found: list[tuple[int, int, int]] = []  # first word, words, shingle size
            for size, shortest in known.shortest.items():
                hit = known.holds(shingles(words, size))
                if not hit.any():
                    continue
                cross = bounds[1:-1][:, None] - np.arange(1, size)[None, :] if size > 1 else np.zeros((0, 0), np.int64)
                cross = cross[(cross >= 0) & (cross < len(hit))] if cross.size else np.zeros(0, np.int64)
                hit[cross] = False  # shingles over two texts
                place = np.flatnonzero(hit)
                new = np.concatenate([[True], np.diff(place) > 1])
                new |= np.isin(place, bounds[:-1])  # a run ends with its text
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(place)))
                good = many >= shortest - size + 1
                found += [(int(a), int(m) + size - 1, size) for a, m in zip(place[first[good]], many[good], strict=True)]
            found.sort()
            start = np.array([x[0] for x in found], np.int64)
            owner = np.searchsorted(bounds, start, side="right") - 1
            runs = []
            for (a, n, size), i in zip(found, owner.tolist(), strict=True):
                own = words[a : a + n]
                rid = int(np.frombuffer(xxhash.xxh64_digest(own.tobytes() + bytes([size]), seed=7), "<i8")[0])
                runs.append({"start": a - int(bounds[i]), "n": n, "size": size, "rid": rid, "words": own.view(np.int64)})
            lists = pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32), pa.array(runs, run_type))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(batch.num_rows)), *(batch.column(c) for c in carried), pa.array(np.diff(bounds)), lists], ["row", *carried, "n_words", "runs"]
            )
            row += batch.num_rows

    runs = F.lit(None).cast("array<struct<start:bigint,n:bigint,size:bigint,rid:bigint,words:array<bigint>>>")
    plain = docs.select(F.lit(0).cast("long").alias("row"), *carried, F.lit(0).cast("long").alias("n_words"), runs.alias("runs"))
    return docs.mapInArrow(run, plain.schema)


def match(runs: DataFrame, every: DataFrame, items: DataFrame) -> DataFrame:
    """(rid, spans, items) of the runs in which windows occur: spans (start, n), relative to the run."""
    once = cut(runs.groupBy("rid").agg(F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("size").alias("size"), F.first("words").alias("words")))
    placed = cut(_shingled(once, "rid"))
    counts = placed.groupBy("shingle").agg(F.sum("copies").alias("frequency"))
    # A window with a shingle that no run has does not occur. The rarest shingle is the prefix; the join drops those that miss one.
    parts = every.join(counts, "shingle")
    prefix = parts.groupBy("wid").agg(
        F.count(F.lit(1)).alias("met"), F.min(F.struct("frequency", "shingle", "at")).alias("p"), F.first("n").alias("n"), F.first("size").alias("size")
    )
    prefix = prefix.where(F.col("met") == F.col("n") - F.col("size") + 1).select("wid", "n", F.col("p.shingle").alias("shingle"), F.col("p.at").alias("offset"))
    prefix = prefix.join(items.select("wid", "words").dropDuplicates(["wid"]), "wid")
    run = placed.select("rid", F.col("n").alias("room"), "at", "shingle", "around", "lead")
    fits = (F.col("at") >= F.col("offset")) & (F.col("at") - F.col("offset") + F.col("n") <= F.col("room"))
    same = F.expr("slice(around, CAST(lead - offset + 1 AS INT), CAST(n AS INT)) = words")
    hits = cut(run.join(prefix, "shingle").where(fits).where(same).select("rid", "wid", (F.col("at") - F.col("offset")).alias("start"), "n").distinct())
    # A run of m words has at most m windows of each length; an item's id comes once a run.
    spans = hits.groupBy("rid").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    named = hits.select("rid", "wid").distinct().join(items.select("wid", "item_id").distinct(), "wid").select("rid", "item_id").distinct()
    return spans.join(named.groupBy("rid").agg(F.collect_set("item_id").alias("items")), "rid")


def _merged(df: DataFrame) -> DataFrame:
    """(row, spans, items): overlapping and touching spans (first word, words) of each row united to (first, last)."""

    def run(batches):
        for batch in batches:
            out = []
            for spans in batch.column("spans").to_pylist():
                own: list[list[int]] = []
                for first, n in sorted((s["start"], s["n"]) for s in spans):
                    if own and first <= own[-1][1] + 1:
                        own[-1][1] = max(own[-1][1], first + n - 1)
                    else:
                        own.append([first, first + n - 1])
                out.append([{"first": a, "last": b} for a, b in own])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, kind), batch.column("items")], ["row", "spans", "items"])

    return df.mapInArrow(run, f"row long, spans {_SPANS}, items {_ITEMS}")


def found(docs: DataFrame, benchmark: DataFrame, with_text: bool = True) -> DataFrame:
    """(_rest, [text], n_words, n_hit, spans, items) of `docs` packed with its text apart (actions)."""
    spark = docs.sparkSession
    carried = ["_rest", "text"] if with_text else ["_rest"]
    items = cut(windows(benchmark).distinct())
    size = F.least("n", F.lit(SHINGLE))
    distinct = items.dropDuplicates(["wid"]).select("wid", F.lit(1).cast("long").alias("copies"), "n", size.alias("size"), "words")
    every = cut(_shingled(distinct, "wid").select("wid", "n", F.least("n", F.lit(SHINGLE)).alias("size"), "at", "shingle"))
    known = build_filter(every, items.groupBy(size.alias("size")).agg(F.min("n").alias("n")))
    scanned = scan(docs, known, with_text).withColumn("suspect", (F.size("runs") > 0).cast("int"))
    read = spark.read.schema(scanned.schema).parquet(keep(scanned, "suspect"))
    none = [F.lit(0).cast("long").alias("n_hit"), F.array().cast(_SPANS).alias("spans"), F.array().cast(_ITEMS).alias("items")]
    clean = read.where("suspect = 0").select(*carried, "n_words", *none)
    suspects = read.where("suspect = 1")
    runs = suspects.select("row", F.explode("runs").alias("r")).select("row", "r.*")
    matched = written(match(runs.select("rid", "n", "size", "words"), every, items))
    bytes_ = matched.agg(F.sum(F.size("spans") * 16 + 40 + F.length(F.array_join("items", " ")))).first()[0] or 0
    places = runs.select("row", "start", "rid")
    if bytes_ <= BROADCAST_BYTES:
        joined = places.join(F.broadcast(matched), "rid")
    else:
        salted = matched.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = places.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["rid", "salt"])
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), s["n"].alias("n")))
    by_row = joined.select("row", moved.alias("spans"), "items").groupBy("row")
    by_row = by_row.agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = suspects.drop("runs").join(_merged(by_row), "row", "left")
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.last - s.first + 1)")
    hit = joined.select(*carried, "n_words", *(F.coalesce(x, y).alias(c) for x, y, c in zip((n_hit, F.col("spans"), F.col("items")), none, ADDED[1:], strict=True)))
    return clean.unionAll(hit)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_words, n_hit, spans (runs of hit words) and items (ids as strings); actions.

    A NULL or empty text has no words, and no item without id or words counts. Rows with
    equal doc_id and text are each reported; rows of benchmark with equal item_id are one
    item with the windows of all. An empty table on either side gives no hits. A very long
    text is read whole. Columns of docs with these four names give way; all others keep
    their values, whatever their names.
    """
    return found(packed(docs, "text"), benchmark).select(*unpacked(docs, "text", without=ADDED), *ADDED)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any window of the benchmark, with their own columns whatever their names (actions)."""
    return found(packed(docs, "text"), benchmark).where("n_hit = 0").select(*unpacked(docs, "text"))


def query(spark, sf_dir):
    """Benchmark hits of every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    NULL and empty texts have no words and no hits; their items_sha256 is that of "".
    """
    docs = packed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), with_text=False).select(
        "_rest.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERY = ("op8_decontaminate", query)

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM i WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS t FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM s)),
c AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS t FROM (
        SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
h AS (SELECT doc_id, p, c.n AS n, item_id FROM c JOIN b USING (n, t)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM h)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""
