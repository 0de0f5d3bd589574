"""Ranked lexical search: document-at-a-time merge of compressed postings.

Texts are dealt into shards as they lie in Spark's partitions, a bounded number of bytes each. A
shard is one row: its documents in order of their ids, and for each term the compressed
postings (gaps and counts). Searching a shard merges the postings of an item's terms through
a heap of the lists' next documents, and keeps the best documents in a bounded heap keyed by score,
then id. Lists whose greatest gains together can't reach the heap are only looked up, not merged.
A task keeps its best over its shards; the tasks' best meet in one grouped ranking.

Items are searched in blocks of bounded size, each against all shards. Scores are integers.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm import arrowtext as at
from kinelake.llm.common import Shared, discard, keep, table, written

#: Best documents of an item.
K = 10
#: Bytes of text in a shard (a longer text is a shard alone).
SHARD_BYTES = 1 << 25
#: (item, term) entries searched at once; one item with more is a block alone.
BLOCK_ENTRIES = 500_000
#: If all items have no more distinct terms than this, other terms are left out of the index. Results are equal either way.
INDEX_TERMS = 200_000


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 to 2^35 - 1 as bytes, seven bits each, the lowest first; and the bytes that each takes."""
    sizes = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    start = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(5):
        has = np.flatnonzero(sizes > k)
        out[start[has] + k] = (values[has] >> 7 * k) & 127 | np.where(sizes[has] > k + 1, 128, 0)
    return out, sizes


def numbers(raw: np.ndarray) -> np.ndarray:
    """The inverse of `varints`."""
    ends = np.flatnonzero(raw < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts)


class Builder:
    """Gathers documents of a shard. terms: those to index, or None for all."""

    def __init__(self, terms: pa.Array | None):
        self.given, self.terms, self.number = terms, [], {}
        self.ids, self.lengths, self.found, self.n_docs, self.n_bytes = [], [], [], 0, 0

    def _numbered(self, values: pa.Array) -> np.ndarray:
        """Numbers of the terms, -1 for those left out."""
        if self.given is not None:
            return pc.fill_null(pc.index_in(values, value_set=self.given), -1).to_numpy().astype(np.int64)
        return np.array([self.number.setdefault(t, len(self.number)) for t in values.to_pylist()], np.int64)

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        found, bounds = at.alnum_words(at.texts(texts))
        n = np.diff(bounds)
        codes, values = at.coded(found)
        term = self._numbered(values)[codes] if len(codes) else codes
        doc = np.repeat(np.arange(len(n)), n)
        known = term >= 0
        width = max(len(self.number) if self.given is None else len(self.given), 1)
        keys, tf = np.unique(doc[known] * width + term[known], return_counts=True)
        has = n > 0  # a document without a term is none
        place = self.n_docs + np.cumsum(has) - 1
        self.found.append((keys % width, place[keys // width], tf))
        self.ids.append(ids.filter(pa.array(has)))
        self.lengths.append(n[has])
        self.n_docs += int(has.sum())
        self.n_bytes += texts.nbytes

    def row(self) -> dict | None:
        if not self.n_docs:
            return None
        ids, lengths = pa.concat_arrays(self.ids), np.concatenate(self.lengths)
        order = pc.array_sort_indices(ids).to_numpy().astype(np.int64) if ids.null_count == 0 else pc.sort_indices(pa.table({"i": ids}), [("i", "ascending")], null_placement="at_end").to_numpy().astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        term, doc, tf = (np.concatenate(x).astype(np.int64) for x in zip(*self.found, strict=True))
        doc = rank[doc]
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], tf[by]
        terms, start, df = np.unique(term, return_index=True, return_counts=True)
        gaps = np.diff(doc, prepend=0)
        gaps[start] = doc[start]
        first = np.repeat(start, df) + np.arange(len(doc))  # a term's gaps, then its counts
        values = np.empty(2 * len(doc), np.int64)
        values[first], values[first + np.repeat(df, df)] = gaps, tf
        raw, sizes = varints(values)
        ends = np.cumsum(sizes)[2 * (start + df) - 1] if len(start) else np.zeros(0, np.int64)
        names = self.given if self.given is not None else pa.array(list(self.number), pa.string())
        return {
            "n_docs": len(lengths), "n_terms": int(lengths.sum()), "ids": ids.take(pa.array(order)), "lengths": lengths[order],
            "terms": names.take(pa.array(terms)), "df": df, "ends": ends, "postings": raw.tobytes(),
        }


COLUMNS = ("n_docs", "n_terms", "ids", "lengths", "terms", "df", "ends", "postings")


def index(docs: DataFrame, terms: list[str] | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard of docs (doc_id, text): (n_docs, n_terms, ids, lengths, terms, df, ends, postings).

    Texts without a term (NULL and empty ones too) are no documents. Repeated rows are documents
    of their own. NULL ids come last. terms: leave out all others (lengths count every term).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    only = Shared(docs.sparkSession, pa.array(terms, pa.string())) if terms is not None else None

    def run(batches):
        given = only.value if only else None
        now = Builder(given)

        def batch(row):
            whole = {"n_docs": pa.int64(), "n_terms": pa.int64(), "lengths": pa.list_(pa.int64()), "terms": pa.list_(pa.string()), "df": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "postings": pa.binary(), "ids": pa.list_(row["ids"].type)}
            return pa.RecordBatch.from_arrays([pa.array([row[c]], whole[c]) if not isinstance(row[c], pa.Array) else pa.ListArray.from_arrays([0, len(row[c])], row[c]) for c in COLUMNS], list(COLUMNS))

        for part in at.slices(batches):
            now.add(part.column("doc_id"), part.column("text"))
            if now.n_bytes >= shard_bytes:
                if row := now.row():
                    yield batch(row)
                now = Builder(given)
        if row := now.row():
            yield batch(row)

    return docs.select("doc_id", "text").mapInArrow(run, f"n_docs long, n_terms long, ids array<{kind}>, lengths array<long>, terms array<string>, df array<long>, ends array<long>, postings binary")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def gains(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int, w: int) -> np.ndarray:
    """What a term adds to documents of these lengths that hold it tf times."""
    if len(lengths) and 90 * int(lengths.max()) * n_docs >= 1 << 63:
        lengths = lengths.astype(object)
    m = 10 + (90 * lengths * n_docs) // n_terms
    return (w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))).astype(np.int64)


def best(lists: list[tuple[list[int], list[int], int]], k: int, floor: int) -> list[tuple[int, int]]:
    """(score, -document) of the k best documents with scores over floor; of equal scores the first documents.

    lists: a term's documents in order, what it adds to each, and the most it adds. Lists are merged by a
    heap of their next documents; those that together cannot exceed the k-th score are looked up only for
    documents that the others bring.
    """
    lists = sorted(lists, key=lambda x: x[2])
    n, bound, total = len(lists), [], 0
    for _, _, most in lists:
        total += most
        bound.append(total)
    heap, first = [], 0
    while first < n and bound[first] <= floor:
        first += 1
    place = [0] * n
    fronts = [lists[i][0][0] * n + i for i in range(first, n)]
    heapify(fronts)
    while fronts:
        doc, score = fronts[0] // n, 0
        while fronts and fronts[0] // n == doc:
            i = fronts[0] % n
            docs, gain, _ = lists[i]
            p = place[i]
            score += gain[p]
            place[i] = p = p + 1
            if p < len(docs):
                heapreplace(fronts, docs[p] * n + i)
            else:
                heappop(fronts)
        for i in range(first - 1, -1, -1):
            if score + bound[i] <= floor:
                break
            docs, gain, _ = lists[i]
            place[i] = p = bisect_left(docs, doc, place[i])
            if p < len(docs) and docs[p] == doc:
                score += gain[p]
        else:
            if score > floor:
                heappush(heap, (score, -doc))
                if len(heap) > k:
                    heappop(heap)
                if len(heap) == k and heap[0][0] > floor:
                    floor, before = heap[0][0], first
                    while first < n and bound[first] <= floor:
                        first += 1
                    if first > before:
                        fronts = [x for x in fronts if x % n >= first]
                        heapify(fronts)
    return heap


class Block:
    """Items to search: their ids and term numbers, the terms with their weights, N and L."""

    def __init__(self, items: list, of: list[list[int]], weights: dict[str, int], numbers_of: dict[str, int], n_docs: int, n_terms: int):
        self.items, self.of, self.n_docs, self.n_terms = items, of, n_docs, n_terms
        self.weights = [0] * len(numbers_of)
        for t, w in weights.items():
            self.weights[numbers_of[t]] = w
        self.terms = pa.array(list(numbers_of), pa.string())

    def lists(self, shard: dict) -> dict[int, tuple[list[int], list[int], int]]:
        """The block's terms in a shard (terms without weight are left out)."""
        lengths, df, ends = shard["lengths"], shard["df"], shard["ends"]
        raw = np.frombuffer(shard["postings"], np.uint8)
        number = pc.fill_null(pc.index_in(shard["terms"], value_set=self.terms), -1).to_numpy()
        out = {}
        for j in np.flatnonzero(number >= 0).tolist():
            t = int(number[j])
            if self.weights[t] > 0:
                values = numbers(raw[ends[j - 1] if j else 0 : ends[j]])
                docs, tf = np.cumsum(values[: df[j]]), values[df[j] :]
                gain = gains(tf, lengths[docs], self.n_docs, self.n_terms, self.weights[t])
                out[t] = (docs.tolist(), gain.tolist(), int(gain.max()))
        return out


def _order(pair):
    """Best first: by score, then id, NULL last."""
    return (-pair[0], pair[1] is None, pair[1] if pair[1] is not None else 0)


def _searched(shards: DataFrame, block: Shared, k: int, kind: str, item_kind: str) -> DataFrame:
    def run(batches):
        b = block.value
        top = [[] for _ in b.items]
        types = None
        for batch in batches:
            types = batch.column("ids").type.value_type
            for i in range(batch.num_rows):
                shard = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("lengths", "df", "ends")} | {"terms": batch.column("terms")[i].values, "postings": batch.column("postings")[i].as_py()}
                ids, lists = batch.column("ids")[i].values, b.lists(shard)
                for q, terms in enumerate(b.of):
                    own = [lists[t] for t in terms if t in lists]
                    if own:
                        # documents of this shard may have smaller ids than those at hand, so equal scores pass
                        floor = max(0, top[q][-1][0] - 1) if len(top[q]) == k else 0
                        if more := best(own, k, floor):
                            top[q] = sorted([*top[q], *((score, ids[-doc].as_py()) for score, doc in more)], key=_order)[:k]
        if types is not None:
            rows = [(b.items[q], doc, score) for q, found in enumerate(top) for score, doc in found]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]) if rows else pa.nulls(0), pa.array(columns[1], types), pa.array(columns[2], pa.int64())], ["item_id", "doc_id", "score"]) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema([("item_id", pa.string()), ("doc_id", types), ("score", pa.int64())]))

    return shards.mapInArrow(run, f"item_id {item_kind}, doc_id {kind}, score long")


def _blocks(items: DataFrame, entries: int):
    """Lists of (item_id, terms) with at most that many terms in all, or one item."""
    now, size = [], 0
    for r in items.toLocalIterator():
        if now and size + len(r["terms"]) > entries:
            yield now
            now, size = [], 0
        now.append((r["item_id"], sorted(r["terms"])))
        size += len(r["terms"])
    if now:
        yield now


def terms_of(items: DataFrame) -> DataFrame:
    """(item_id, terms) of items (item_id, text); rows with the same id, or none, are one item."""
    def run(batches):
        for part in at.slices(batches):
            found, bounds = at.alnum_words(at.texts(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), found)], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    each = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<string>")
    return each.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def search(docs: DataFrame, items: DataFrame, k: int = K, shard_bytes: int = SHARD_BYTES, block_entries: int = BLOCK_ENTRIES, index_terms: int = INDEX_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with scores over 0 (actions).

    Equal scores rank by ascending doc_id, NULL last. A NULL or empty text has no terms: such documents do not
    count, such items have no rows. Repeated document rows are documents of their own;
    rows of items with the same id (or none) make one item. Empty tables give no rows. Texts are
    read whole, however long. Other columns of docs and items are not read.
    """
    spark = docs.sparkSession
    asked = written(terms_of(items))
    distinct = asked.select(F.explode("terms").alias("term")).distinct()
    few = distinct.limit(index_terms + 1).toArrow()["term"].to_pylist()
    path = keep(index(docs, sorted(few) if len(few) <= index_terms else None, shard_bytes))
    shards = spark.read.parquet(path)
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {item_kind}, doc_id {kind}, score long")
    counts = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
    if n_docs:
        counts = written(counts.join(distinct, "term", "left_semi"))
        for block in _blocks(asked, block_entries):
            number = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
            these = spark.createDataFrame([(t,) for t in number], "term string") if len(few) > index_terms else None
            df = counts.join(F.broadcast(these), "term", "left_semi") if these is not None else counts
            weights = {r["term"]: weight(n_docs, r["df"]) for r in df.toLocalIterator() if r["term"] in number}
            shared = Shared(spark, Block([i for i, _ in block], [[number[t] for t in terms] for _, terms in block], weights, number, n_docs, n_terms))
            found = found.unionAll(_searched(shards, shared, k, kind, item_kind))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    discard(spark, path)
    return out


def query(spark, sf_dir):
    """The 10 best of all documents for each benchmark item: item_id, rank, doc_id, score."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERY = ("op13_search", query)

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) AS nn, sum(len(ts)) AS ll FROM d WHERE len(ts) > 0),
t AS (SELECT doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM t GROUP BY doc_id, n, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, s),
g AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll::BIGINT)))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id HAVING score > 0),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM g)
SELECT * FROM r WHERE rank <= {K}"""
