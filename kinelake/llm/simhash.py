"""SimHash near-duplicates: exact search within a Hamming radius, bit-sliced.

Equal fingerprints are one node. Seven blocks of the 64 bits leave, for two fingerprints
at most four bits apart, at least three equal blocks; so each node enters 35 buckets, one
for each three blocks, and all links lie within buckets. A bucket is chosen by 27 bits or
more, so unrelated fingerprints seldom meet: about one a bucket for 10^8 of them. Inside a bucket the bits are
stored vertically: one word holds the same bit of 64 fingerprints. Distances to many
fingerprints are then kept as a few vertical counters, updated by carry-save additions,
and a block of comparisons is abandoned as soon as all of them exceed the radius.

For near copies in a wider sense (`similar`: a Jaccard similarity of word shingles of 0.8 or
more) fingerprints may differ in up to SIMILAR_RADIUS bits. Buckets are then the smallest
hashes of a text's shingles under KEYS orders, one of which two such texts share but in one
case of 600; pairs within the radius are compared by sketches of their shingles, which are
the whole sets for texts of up to SKETCH shingles.

A task emits at most one link for each row it holds (to its root in the bucket), never
pairs. Buckets over BUCKET rows are split into chunks, and each two chunks meet in a
task of their own, so no task holds more than about two chunks of one bucket.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm import arrowtext as at
from kinelake.llm.common import cut, give_way, table, written
from kinelake.llm.components import components
from kinelake.llm.pitman_yor import mixed

SHINGLE, RADIUS = 4, 4
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
EQUAL_BLOCKS = len(BLOCKS) - RADIUS
BUCKET = 2048
#: Up to so many rows of a bucket are compared as single pairs, more as tiles.
_SMALL = 48
_TILE = 256
_LANES = 1 << 18
_BROADCAST_KEYS = 50_000
# Near copies by similarity: words a shingle, the least similarity, bits that fingerprints may differ in, orders, hashes a sketch.
SIMILAR_SHINGLE, SIMILARITY, SIMILAR_RADIUS, KEYS, SKETCH = 5, 0.8, 16, 4, 256
_NONE = np.uint32(0xFFFFFFFF)


def fingerprint(array: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text over XXH64 (seed 42) of its word shingles; 0 without words."""
    found, bounds = at.words(pc.ascii_lower(array))
    n = len(bounds) - 1
    out = np.zeros(n, np.uint64)
    if not len(found):
        return out
    count = np.diff(bounds)
    joined = pc.binary_join(pa.ListArray.from_arrays(bounds.astype(np.int32), found), " ")
    raw, _ = at.buffers(joined)
    size = pc.binary_length(found).to_numpy().astype(np.int64)
    end = np.cumsum(size + 1) - 1 - np.repeat(np.cumsum(count > 0) - 1, count)
    start = end - size
    some = np.flatnonzero(count > 0)
    many = np.maximum(1, count[some] - shingle + 1)
    edge = np.concatenate([[0], np.cumsum(many)])
    first = np.arange(edge[-1]) + np.repeat(bounds[some] - edge[:-1], many)
    last = np.minimum(first + shingle - 1, np.repeat(bounds[some + 1] - 1, many))
    view, digest = memoryview(raw.tobytes()), partial(xxhash.xxh64_intdigest, seed=42)
    hashes = np.array([digest(view[i:j]) for i, j in zip(start[first].tolist(), end[last].tolist(), strict=True)], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, edge[:-1], axis=0, dtype=np.int32)
    voted = np.packbits(2 * ones > many[:, None], axis=1, bitorder="little")
    out[some] = np.ascontiguousarray(voted).view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, plus fp (the fingerprint as a signed long); a column fp gives way."""
    docs = give_way(docs, "fp")
    rest = [c for c in docs.columns if c != text]

    def run(batches):
        for batch in at.slices(batches, text, 1 << 20):
            fp = fingerprint(at.texts(batch.column(text))).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fp)], [*rest, "fp"])

    return docs.mapInArrow(run, docs.drop(text).withColumn("fp", F.lit(0).cast("long")).schema)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Vertical form: row b holds bit b of all values, 64 values a word (padded with zeros)."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view(np.uint64)


def _lanes(words: np.ndarray) -> np.ndarray:
    """The bits of vertical words, as 0 and 1, one a value."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")


def _within(plane, shape: tuple[int, ...], radius: int) -> np.ndarray | None:
    """Vertical flags of the lanes with at most `radius` set bits among the 64 planes.

    plane(b) gives plane b. None as soon as every lane is known to exceed the radius.
    """
    counters = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(shape, np.uint64)
    full = ~np.uint64(0)

    def exceeding():
        more, equal = over.copy(), np.full(shape, full)
        for k in range(len(counters) - 1, -1, -1):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                more |= equal & counters[k]
                equal &= ~counters[k]
        return more

    for b in range(64):
        carry = plane(b)
        for k, c in enumerate(counters):
            counters[k], carry = c ^ carry, c & carry
        over |= carry
        if b % 8 == 7 and b >= 15 and (exceeding() == full).all():
            return None
    return ~exceeding()


def close_pairs(x: np.ndarray, y: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Places at which x and y differ in at most `radius` bits."""
    found, block = [], 64 * 64
    for i in range(0, len(x), block):
        planes = bit_planes(x[i : i + block] ^ y[i : i + block])
        near = _within(lambda b, p=planes: p[b], planes.shape[1:], radius)
        if near is not None:
            found.append(i + np.flatnonzero(_lanes(near)[: len(x[i : i + block])]))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def close_in_group(values: np.ndarray, radius: int = RADIUS):
    """(i, j) arrays, i < j, of all values at most `radius` bits apart, tile by tile."""
    planes, n = bit_planes(values), len(values)
    query = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    for i in range(0, n, _TILE):
        masks = np.where(query[i : i + _TILE].T, ~np.uint64(0), np.uint64(0))
        from_word = i // 64
        near = _within(lambda b, m=masks, f=from_word: planes[b, f:][None, :] ^ m[b][:, None], (masks.shape[1], planes.shape[1] - from_word), radius)
        if near is not None:
            q, j = np.nonzero(_lanes(near))
            q, j = q + i, j + from_word * 64
            keep = (j > q) & (j < n)
            yield q[keep], j[keep]


def _root(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[k] and b[k] for all k; a root is its set's smallest place."""
    while len(a):
        a, b = _root(parent, a), _root(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def alike(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sketches (sorted, distinct, padded with _NONE) have at least the similarity.

    Of two whole sets it is exact, else it is estimated from the SKETCH smallest hashes of the union.
    """
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 4096):
        a, b = sketch[i[k : k + 4096]], sketch[j[k : k + 4096]]
        both = np.sort(np.concatenate([a, b], axis=1), axis=1)
        twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)
        new = np.concatenate([np.ones((len(both), 1), bool), both[:, 1:] != both[:, :-1]], axis=1) & (both != _NONE)
        rank = np.cumsum(new, axis=1)
        cut_off = np.where((a[:, -1] != _NONE) | (b[:, -1] != _NONE), sketch.shape[1], 2 * sketch.shape[1])[:, None]
        shared = (twice & (rank[:, 1:] <= cut_off)).sum(axis=1)
        out[k : k + 4096] = shared >= similarity * np.minimum(rank[:, -1], cut_off[:, 0])
    return out


def _unite_alike(parent: np.ndarray, q: np.ndarray, j: np.ndarray, test) -> None:
    """Unite the pairs that pass the test; pairs that others have united already aren't tested."""
    while True:
        apart = _root(parent, q) != _root(parent, j)
        q, j = q[apart], j[apart]
        if not len(q):
            return
        first = np.unique(j, return_index=True)[1]
        good = test(q[first], j[first])
        unite(parent, q[first][good], j[first][good])
        rest = np.ones(len(q), bool)
        rest[first] = False
        q, j = q[rest], j[rest]


def _linked(group: np.ndarray, fp: np.ndarray, radius: int, test=None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (sorted by group) with the root each is linked to, for rows that aren't roots; test: of pairs within the radius, which are linked."""
    join = unite if test is None else partial(_unite_alike, test=test)
    n = len(group)
    parent = np.arange(n)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(start, n))
    small = np.repeat(size <= _SMALL, size)
    for d in range(1, min(int(size[size <= _SMALL].max(initial=1)), n)):
        i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d])
        for k in range(0, len(i), _LANES):
            own = i[k : k + _LANES]
            own = own[close_pairs(fp[own], fp[own + d], radius)]
            join(parent, own, own + d)
    for s, m in zip(start[size > _SMALL].tolist(), size[size > _SMALL].tolist(), strict=True):
        for q, j in close_in_group(fp[s : s + m], radius):
            join(parent, q + s, j + s)
    root = _root(parent, np.arange(n))
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _bucket_keys(fp: Column) -> Column:
    """The buckets of a fingerprint: table number and the bits of EQUAL_BLOCKS blocks."""
    at_bit = np.concatenate([[0], np.cumsum(BLOCKS)]).tolist()
    keys = []
    for t, chosen in enumerate(combinations(range(len(BLOCKS)), EQUAL_BLOCKS)):
        key = F.lit(t).cast("long")
        for c in chosen:
            bits = F.shiftrightunsigned(fp, at_bit[c]).bitwiseAND(F.lit(2 ** BLOCKS[c] - 1).cast("long"))
            key = F.shiftleft(key, BLOCKS[c]).bitwiseOR(bits)
        keys.append(key)
    return F.array(*keys)


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, keys: Column | None = None, similarity: float | None = None) -> DataFrame:
    """(a, b) links between nodes (fp, node) with fp at most `radius` bits apart.

    Not all links: each bucket gives a spanning set of its own, which connects whatever
    is connected. keys: the buckets of a row, by default those of fingerprints at most
    RADIUS bits apart. With a similarity, only pairs are linked whose column `sketch` has it.
    """
    more = [] if similarity is None else ["sketch"]
    keys = _bucket_keys(F.col("fp")) if keys is None else keys
    placed = nodes.select("fp", "node", *more, F.explode(keys).alias("key"))
    hot = cut(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key", F.ceil(F.col("n") / bucket).cast("int").alias("chunks")))
    n_hot = hot.count()
    whole = placed.withColumn("part", F.lit(0).cast("long"))
    if n_hot:
        near = F.broadcast(hot) if n_hot <= _BROADCAST_KEYS else hot
        joined = placed.join(near, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp", "key"), F.col("chunks")).cast("int"))
        meets = F.expr(
            "CASE WHEN chunks IS NULL THEN array(0L) ELSE transform(filter(sequence(0, chunks - 1), d -> d <> own),"
            " d -> 1L + CAST(least(own, d) AS BIGINT) * chunks + greatest(own, d)) END"
        )
        whole = joined.select("fp", "node", *more, "key", F.explode(meets).alias("part"))
    dealt = whole.repartition("key", "part").sortWithinPartitions("key", "part", "fp")

    def run(batches):
        held = None

        def columns(batch):
            out = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "fp", "node")]
            if more:
                raw, _ = at.buffers(batch.column("sketch").cast(pa.binary()))
                out.append(raw.view(np.uint32).reshape(batch.num_rows, -1))
            return out

        def work(rows):
            key, part, fp, node, *sketch = rows
            group = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            test = (lambda i, j: alike(sketch[0], i, j, similarity)) if sketch else None
            moved, root = _linked(group, fp.view(np.uint64), radius, test)
            return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = columns(batch)
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            key, part = rows[:2]
            other = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            whole_to = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
            if whole_to:
                yield work([x[:whole_to] for x in rows])
            held = [x[whole_to:] for x in rows]
        if held is not None and len(held[0]):
            yield work(held)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, fp, component_id) of documents (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most RADIUS bits, the
    document's own included. A NULL text has no words (fingerprint 0, linked like any
    other). A row without doc_id keeps its fingerprint and gets no component_id.
    Repeated rows are each reported.
    """
    own = cut(fingerprints(docs.select("doc_id", *carried, "text")))
    nodes = cut(own.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes))
    labelled = nodes.join(found, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("_c"))
    joined = own.join(labelled, own["fp"] == labelled["_fp"], "left")
    return joined.select("doc_id", *carried, "fp", F.when(F.col("doc_id").isNotNull(), F.col("_c")).alias("component_id"))


def sketches(array: pa.Array, shingle: int = SIMILAR_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: fingerprint (0 without words), [KEYS] smallest hashes and [SKETCH] smallest 32-bit hashes of its word shingles.

    A text of fewer words is one shingle; without words keys are 0 and the sketch is empty.
    """
    found, bounds = at.words(pc.ascii_lower(array))
    words, count = at.hashed(found), np.diff(bounds)
    n, some = len(count), np.flatnonzero(count > 0)
    many = np.maximum(1, count[some] - shingle + 1)
    edge = np.concatenate([[0], np.cumsum(many)])
    first = np.arange(edge[-1]) + np.repeat(bounds[some] - edge[:-1], many)
    end = np.repeat(bounds[some + 1], many)
    hashes = np.full(len(first), 11, np.uint64)
    for k in range(shingle):
        inside = first + k < end
        hashes[inside] = mixed(hashes[inside] + words[first[inside] + k])
    out, keys, sketch = np.zeros(n, np.uint64), np.zeros((n, KEYS), np.uint64), np.full((n, SKETCH), _NONE)
    if not len(some):
        return out, keys, sketch
    for i in range(0, len(some), 64):  # a few texts at a time: bits take 64 bytes a shingle
        j = min(i + 64, len(some))
        ones = np.zeros((j - i, 64), np.int64)
        for low in range(edge[i], edge[j], 1 << 18):
            high = min(edge[j], low + (1 << 18))
            bits = np.unpackbits(hashes[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cuts = np.clip(edge[i : j + 1], low, high) - low
            full = np.flatnonzero(np.diff(cuts))
            ones[full] += np.add.reduceat(bits, cuts[:-1][full], axis=0, dtype=np.int64)
        out[some[i:j]] = np.ascontiguousarray(np.packbits(2 * ones > many[i:j, None], axis=1, bitorder="little")).view(np.uint64)[:, 0]
    for k in range(KEYS):
        keys[some, k] = np.minimum.reduceat(mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)), edge[:-1])
    small = np.minimum((hashes >> np.uint64(32)).astype(np.uint32), _NONE - np.uint32(1))
    for k, i in enumerate(some.tolist()):
        own = np.unique(small[edge[k] : edge[k + 1]])[:SKETCH]
        sketch[i, : len(own)] = own
    return out, keys, sketch


def similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE, radius: int = SIMILAR_RADIUS) -> DataFrame:
    """(_rest, component_id) of rows (_rest, doc_id, text): documents linked by near copies, of word shingles.

    Equal fingerprints are one node. component_id is the smallest doc_id reachable. NULL and
    empty texts have no words and are copies of each other. A row without doc_id gets no
    component_id.
    """
    carried = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in at.slices(batches):
            fp, keys, sketch = sketches(at.texts(batch.column("text")), shingle)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), KEYS).cast(pa.list_(pa.int64()))
            raw = pa.array([row.tobytes() for row in sketch], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(fp.view(np.int64)), lists, raw], [*carried, "fp", "keys", "sketch"])

    plain = docs.drop("text").withColumns({"fp": F.lit(0).cast("long"), "keys": F.lit(None).cast("array<bigint>"), "sketch": F.lit(None).cast("binary")})
    own = written(docs.mapInArrow(run, plain.schema))
    nodes = written(own.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"), F.min_by("keys", "doc_id").alias("keys"), F.min_by("sketch", "doc_id").alias("sketch")))
    held = F.transform("keys", lambda k: F.xxhash64(k))  # equal smallest hashes under two orders are one bucket
    found = components(links(nodes, radius, keys=F.array_distinct(held), similarity=similarity))
    labelled = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    joined = own.select(*carried, "fp").join(labelled, "fp", "left")
    return joined.select(*carried, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each component of near copies (`similar`): the one with the smallest doc_id (actions).

    Of rows that share this doc_id, the one whose text has the smallest hash stays, once.
    Rows without doc_id stay. NULL and empty texts are copies of each other. An empty table
    stays empty, very long texts are read whole, and all columns keep their names and values.
    """
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_rest"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    keyed = keyed.withColumn("hash", F.xxhash64("text"))
    found = written(similar(keyed.select("doc_id", "hash", "text"), similarity).where("doc_id IS NOT NULL"))
    kept = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "hash")).alias("k")).select("k.*")
    stay = keyed.join(kept, ["doc_id", "hash"], "left_semi")
    again = found.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():
        stay = stay.dropDuplicates(["doc_id", "hash"])
    return stay.select("_rest.*").unionAll(keyed.where("doc_id IS NULL").select("_rest.*"))


def query(spark, sf_dir):
    """Near-duplicate components of all documents: doc_id, fingerprint, component_id."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERY = ("op7_simhash", query)
