"""Spelling variants: words one edit apart, found by automata over compact tries.

The words are split by length and order into tries of bounded size, which are broadcast in waves of
bounded size. A word's automaton of distance one runs over each trie of a wave
depth-first: along the word itself, and from the nodes on that way into every child by a replaced or an
inserted code point and past one of the word's own. Each trie is there for the words and for the words reversed:
edits in the second half of a word are met behind its first half, those in the first half behind its reversed second one, so that
ways branch only where tries are narrow. An edit that another place gives as well (within a run of equal
code points) is made at the last one only, so each neighbour is met once. A task gives a row for a
word, with the number of neighbours and the best of them; rows of all waves are summed by word.
"""

from __future__ import annotations

import pickle
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm import arrowtext as at
from kinelake.llm.common import Shared, cut, discard, keep, table, written

#: Words of a trie and code points in them (one longer word is a trie alone), and bytes of tries broadcast at once.
TRIE_WORDS, TRIE_SIZE, WAVE_BYTES = 1 << 17, 1 << 21, 1 << 26
#: Words that a task looks up, and words that it gathers before it gives their counts.
TASK_WORDS, HELD_WORDS = 8192, 200_000
#: What the contract takes as a word, and how much more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, RATIO, EVERY = 7, 2, 10, 31


def _crc_tables() -> np.ndarray:
    """[length][byte place][byte]: the CRC-32 register after so many zero bytes more."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [now]
    for _ in range(64):
        now = (now >> np.uint32(8)) ^ byte[now & 255]
        out.append(now)
    return np.stack(out)


_CRC = _crc_tables()


def _crc_after(before: np.ndarray, own: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings one after the other, by the CRC of each and the length of the second (64 at most)."""
    out = own.copy()
    for k in range(4):
        out ^= _CRC[length, k, (before >> np.uint32(8 * k)) & 255]
    return out


def runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, and the bounds of each text's."""
    raw, offsets = at.buffers(texts)
    low = raw | 32
    letter = (low >= 97) & (low <= 122) & (raw < 128)
    c3 = raw == 0xC3  # the first byte of U+00C0 to U+00FF
    after = np.concatenate([[False], c3[:-1]]) if len(raw) else c3
    out = np.where(letter, low, np.where(c3 | after, raw, 32)).astype(np.uint8)
    return at.words(at.strings(out, offsets))


def _marked(ids: list[str], words: pa.Array, doc: np.ndarray, code: np.ndarray, every: int) -> np.ndarray:
    """Of each (document, word), the CRC-32 of `<id>:<word>` if `every` divides it, else -1."""
    raw = words.cast(pa.binary()).to_pylist()
    own = np.array([zlib.crc32(x) for x in raw], np.uint32)
    size = np.array([len(x) for x in raw], np.int64)
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    crc = _crc_after(before[doc], own[code], np.minimum(size[code], 64)).astype(np.int64)
    for p in np.flatnonzero(size[code] > 64).tolist():
        crc[p] = zlib.crc32(raw[code[p]], int(before[doc[p]]))
    return np.where(crc % every == 0, crc, -1)


def counted(ids: list[str], texts: pa.Array, least: int, every: int) -> tuple[list[str], np.ndarray]:
    """Words of at least that many code points in the texts, and how often each occurs; of a marked run (see `words`) one code point is gone."""
    found, bounds = runs(texts)
    codes, values = at.coded(found)
    length = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = at.row_of(bounds)
    fits = length[codes] >= least
    width = max(len(values), 1)
    keys, n = np.unique(doc[fits] * width + codes[fits], return_counts=True)
    doc, code = keys // width, keys % width
    crc = _marked(ids, values, doc, code, every) if every else np.full(len(keys), -1)
    plain = np.bincount(code[crc < 0], n[crc < 0], minlength=len(values)).astype(np.int64)
    there = np.flatnonzero(plain)
    out, total = values.take(pa.array(there)).to_pylist(), [plain[there]]
    cut_at = np.flatnonzero((crc >= 0) & (length[code] > least) if len(keys) else crc >= 0)
    for p, w in zip(cut_at.tolist(), values.take(pa.array(code[cut_at])).to_pylist(), strict=True):
        k = int(crc[p]) % len(w)
        out.append(w[:k] + w[k + 1 :])
    total.append(n[cut_at])
    return out, np.concatenate(total).astype(np.int64)


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): the words of all whole texts of docs (doc_id, text), and how often each occurs.

    A word is a run of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, with at least `least_length` code points. If `every`
    divides the CRC-32 of `<doc_id>:<word>` (UTF-8), the word loses its code point number CRC-32 % length
    (every=0: none does). A NULL text has no words; a NULL doc_id is the empty text there.
    """

    def run(batches):
        held: dict[str, int] = {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for part in at.slices(batches):
            for w, n in zip(*(x if isinstance(x, list) else x.tolist() for x in counted(part.column("id").to_pylist(), at.texts(part.column("text")), least_length, every)), strict=True):
                held[w] = held.get(w, 0) + n
            if len(held) >= HELD_WORDS:
                yield rows()
        yield rows()

    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Nodes:
    """Words with counts, as numbered nodes: the children of a node are numbered in a row and sorted by label.

    labels: a code point for each node (the root, 0, has a blank); first: a node's first child, its
    last one is before the next node's first; count: a word's count at its last node, else 0.
    """

    def __init__(self, these: list[str], counts: np.ndarray):
        length = np.array([len(w) for w in these], np.int64)
        code = np.frombuffer("".join(these).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start = np.cumsum(length) - length
        node, live = np.zeros(len(these), np.int64), np.arange(len(these))
        parents, labels, n, depth = [], [], 1, 0
        while len(live := live[length[live] > depth]):
            keys, which = np.unique(node[live] << 21 | code[start[live] + depth], return_inverse=True)
            node[live] = n + which
            parents.append(keys >> 21)
            labels.append(keys & (1 << 21) - 1)
            n, depth = n + len(keys), depth + 1
        parent = np.concatenate([np.zeros(0, np.int64), *parents])
        self.labels = " " + np.concatenate([np.zeros(0, np.int64), *labels]).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        self.first = array("i", (1 + np.searchsorted(parent, np.arange(n + 1))).astype(np.int32).tobytes())
        count = np.zeros(n, np.int64)
        count[node] = counts
        self.count = array("q", count.tobytes())

    def walk(self, node: int, word: str, start: int, stop: int) -> int:
        """The node at the end of the way from node along word[start:stop], -1 if there is none."""
        find, labels_first = self.labels.find, self.first
        for i in range(start, stop):
            node = find(word[i], labels_first[node], labels_first[node + 1])
            if node < 0:
                return -1
        return node

    def end(self, node: int, word: str, start: int) -> int:
        """The count of the word that ends the way from node along word[start:], 0 if there is none."""
        node = self.walk(node, word, start, len(word))
        return self.count[node] if node >= 0 else 0


class Trie:
    """Words with counts, as nodes of the words and of the words reversed."""

    def __init__(self, these: list[str], counts: np.ndarray):
        self.there, self.back = Nodes(these, counts), Nodes([w[::-1] for w in these], counts)
        self.shortest, self.longest = min(map(len, these)), max(map(len, these))

    def near(self, word: str):
        """(count, word) of each word at a distance of exactly one."""
        n = len(word)
        half = n // 2
        yield from self._late(word, half, n)
        yield from self._early(word, half, n)

    def _late(self, word: str, half: int, n: int):
        """Edits at places from half on: of word[i], or before it."""
        nodes = self.there
        labels, find, first, count, end = nodes.labels, nodes.labels.find, nodes.first, nodes.count, nodes.end
        node = nodes.walk(0, word, 0, half)
        for i in range(half, n + 1):
            if node < 0:
                return
            lo, hi = first[node], first[node + 1]
            own, after = word[i : i + 1], word[i + 1 : i + 2]
            if own and after != own and (c := end(node, word, i + 1)):
                yield c, word[:i] + word[i + 1 :]
            stop = first[lo] if lo < hi else 0
            for child in range(lo, hi):
                start, stop = stop, first[child + 1]  # the child's own children
                label = labels[child]
                if label == own:
                    continue
                if not own:
                    if c := count[child]:
                        yield c, word + label
                    continue
                below = find(own, start, stop)
                if below >= 0 and (c := end(below, word, i + 1)):
                    yield c, word[:i] + label + word[i:]
                if not after:
                    if c := count[child]:
                        yield c, word[:i] + label
                else:
                    below = find(after, start, stop)
                    if below >= 0 and (c := end(below, word, i + 2)):
                        yield c, word[:i] + label + word[i + 1 :]
            node = find(own, lo, hi) if own else -1

    def _early(self, word: str, half: int, n: int):
        """Edits at places before half, met from the word's end."""
        nodes, turned = self.back, word[::-1]
        labels, find, first, count, end = nodes.labels, nodes.labels.find, nodes.first, nodes.count, nodes.end
        node = nodes.walk(0, turned, 0, n - half)
        for j in range(n - half, n + 1):
            if node < 0:
                return
            i = n - j  # place behind which the way has matched the word
            lo, hi = first[node], first[node + 1]
            own, before, after = turned[j : j + 1], turned[j + 1 : j + 2], word[i : i + 1]
            if own and own != after and (c := end(node, turned, j + 1)):
                yield c, word[: i - 1] + word[i:]
            stop = first[lo] if lo < hi else 0
            for child in range(lo, hi):
                start, stop = stop, first[child + 1]
                label = labels[child]
                if i < half and label != after:
                    if not own:
                        if c := count[child]:
                            yield c, label + word
                    else:
                        below = find(own, start, stop)
                        if below >= 0 and (c := end(below, turned, j + 1)):
                            yield c, word[:i] + label + word[i:]
                if own and label != own:
                    if not before:
                        if c := count[child]:
                            yield c, label + word[i:]
                    else:
                        below = find(before, start, stop)
                        if below >= 0 and (c := end(below, turned, j + 2)):
                            yield c, word[: i - 1] + label + word[i:]
            node = find(own, lo, hi) if own else -1


def _tries(known: DataFrame, n_words: int, trie_words: int, trie_size: int) -> DataFrame:
    """(trie, shortest, longest, size, data): tries of the words, in ranges of length and order."""

    def run(batches):
        k = TaskContext.get().partitionId() << 24
        these, counts, size = [], [], 0

        def row():
            nonlocal k, these, counts, size
            t = Trie(these, np.array(counts, np.int64))
            data = cloudpickle.dumps(t)
            out = pa.RecordBatch.from_pydict({"trie": [k], "shortest": pa.array([t.shortest], pa.int32()), "longest": pa.array([t.longest], pa.int32()), "size": [len(data)], "data": pa.array([data], pa.binary())})
            k, these, counts, size = k + 1, [], [], 0
            return out

        for batch in batches:
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if these and (len(these) >= trie_words or size + len(w) > trie_size):
                    yield row()
                these.append(w)
                counts.append(n)
                size += len(w)
        if these:
            yield row()

    parts = -(-n_words // trie_words)
    ranged = known.repartitionByRange(parts, F.length("word"), "word").sortWithinPartitions(F.length("word"), "word")
    return ranged.mapInArrow(run, "trie long, shortest int, longest int, size long, data binary")


def _met(known: DataFrame, wave: Shared) -> DataFrame:
    """(word, n_near, form_n, form): what each word meets in the wave's tries; words that meet nothing have no row."""

    def run(batches):
        tries = [pickle.loads(x) for x in wave.value]
        for batch in batches:
            rows = []
            for word in batch.column("word").to_pylist():
                k, most, form = 0, 0, None
                for t in tries:
                    if t.shortest - 1 <= len(word) <= t.longest + 1:
                        for n, other in t.near(word):
                            k += 1
                            if n > most or n == most and other < form:
                                most, form = n, other
                if k:
                    rows.append((word, k, most, form))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "form_n", "form"])

    return known.mapInArrow(run, "word string, n_near long, form_n long, form string")


def _waves(tries: DataFrame, most: int) -> list[tuple[list[int], int, int]]:
    """(tries, shortest, longest) of each wave: tries in order, with at most that many bytes in all, or one."""
    out, size = [], 0
    for r in tries.select("trie", "shortest", "longest", "size").orderBy("shortest", "trie").collect():
        if not out or size + r["size"] > most:
            out.append(([], r["shortest"], r["longest"]))
            size = 0
        ids, shortest, longest = out[-1]
        out[-1] = ([*ids, r["trie"]], min(shortest, r["shortest"]), max(longest, r["longest"]))
        size += r["size"]
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word reached by following forms (actions).

    A form is at least RATIO times as frequent, so a way has 18 steps at most; each round doubles the steps made.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    moved = now.count()
    while moved:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = after.where("moved").count()
        now = after.drop("moved")
    return now


def group(known: DataFrame, ratio: int = RATIO, trie_words: int = TRIE_WORDS, trie_size: int = TRIE_SIZE, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n) with n > 0 (actions).

    n_near counts the words at an edit distance of exactly one. form is the most frequent of them (ties: the first in code-point
    order) if it occurs at least `ratio` (2 or more) times as often as the word, form_n its count; else both are NULL. root follows the
    forms from the word to the last one. An empty table stays empty; words may be of any length.
    """
    spark = known.sparkSession
    at_known = keep(known.select("word", "n").where("word IS NOT NULL"))
    known = spark.read.parquet(at_known)
    n_words = known.count()
    met, paths = [], [at_known]
    if n_words:
        paths.append(keep(_tries(known, n_words, trie_words, trie_size)))
        tries = spark.read.parquet(paths[-1])
        asked = known.select("word")
        for ids, shortest, longest in _waves(tries, wave_bytes):
            wave = Shared(spark, [bytes(r["data"]) for r in tries.where(F.col("trie").isin(ids)).select("data").collect()])
            these = asked.where(F.length("word").between(shortest - 1, longest + 1))
            met.append(keep(_met(these.repartition(-(-n_words // TASK_WORDS), "word"), wave)))
            wave.destroy()
    all_met = spark.read.parquet(*met) if met else spark.createDataFrame([], "word string, n_near long, form_n long, form string")
    best = all_met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    counts = known.join(best, "word", "left")
    enough = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    paths.append(keep(counts.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))))
    formed = spark.read.parquet(paths[-1])
    last = roots(formed.where("form IS NOT NULL"))
    out = written(formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    discard(spark, *paths, *met)
    return out


def query(spark, sf_dir):
    """Variants of the words of all documents: word, form, root, n, n_near, form_n."""
    return group(words(table(spark, sf_dir, "documents")))


QUERY = ("op12_spelling", query)

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: CRC-32 is spelt out, byte by byte; neighbours are found by the words less one code point.
ORACLE = f"""
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, i)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_AZ}), '[a-zÀ-ÿ]+')) AS w FROM documents),
o AS (SELECT w, coalesce(doc_id::VARCHAR, '') || ':' || w AS s, count(*) AS n FROM r WHERE length(w) >= {LEAST_LENGTH} GROUP BY ALL),
b AS (SELECT w, n, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM o),
h AS (SELECT w, n, xor(list_reduce(bytes, lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1]), 4294967295), 4294967295) AS h FROM b, c),
m AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v),
d AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS less FROM k),
p AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.less = b.less AND a.k = b.k AND a.word <> b.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.less = v.word),
e AS (SELECT word, count(*) AS n_near, max(n) AS most FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(e.n_near, 0) AS n_near, CASE WHEN e.most >= {RATIO} * v.n THEN e.most END AS form_n FROM v LEFT JOIN e USING (word)),
g AS (SELECT f.word, f.n, f.n_near, f.form_n, min(p.other) AS form FROM f LEFT JOIN p ON p.word = f.word AND p.n = f.form_n GROUP BY ALL),
z AS (SELECT word, word AS root, form AS next FROM g UNION ALL SELECT z.word, g.word, g.form FROM z JOIN g ON z.next = g.word)
SELECT g.word, g.form, z.root, g.n, g.n_near, g.form_n FROM g JOIN z ON z.word = g.word AND z.next IS NULL"""
