"""Language-model scores of documents: a hierarchical Pitman-Yor model.

* contexts: a restaurant for each training token, and for the start of a text, whose
  customers are the tokens that follow it;
* words: their common parent. Its customers are the tables of all context restaurants; its
  base is uniform over the V training tokens and one place for any other.

Seatings are sampled by Gibbs (see `pitman_yor`); probabilities are averaged over SAMPLES
sweeps that follow BURN others. Every word and every pair of words of the training texts is
counted and seated; nothing is collected or cut off.

Texts are written once as batches of word numbers. Words and pairs are dealt to nodes by
hash, so a frequent word or pair is one entry a batch, and no node holds more than its
share. Word nodes count and number the words; batches then send their pairs of numbers. A
sweep has two exchanges: word nodes send each pair node the restaurants' gamma variables and
the words' customers and tables, pair nodes seat their pairs and send back the numbers of
tables. Pairs seen once have one table in every seating and enter by their sums. Last, the
nodes answer each batch, and it scores its texts.

Words are known by 64-bit hashes until they have their numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm import arrowtext as at
from kinelake.llm import pitman_yor as py
from kinelake.llm.blobs import SCHEMA, Rows, joined, pack, received, unpack
from kinelake.llm.common import discard, is_fold, keep, table

BURN, SAMPLES = 5, 4
SEED = 20_240_101
#: Bytes of text a batch (or one longer text), and tokens of the corpus for each node.
TEXT_BYTES, NODE_TOKENS = 8 << 20, 2_000_000
#: No word is empty or holds a space: these are the end and the start of a text.
END, START = (xxhash.xxh64_intdigest(x, seed=42) for x in (b"", b" "))

# Kinds of rows: of words (asked for, counted, plan to answer by (numbers told, seen from the node), numbers; links to pair nodes
# and sums from them), of pairs, others.
WORDS, COUNTED, WORD_PLAN, NUMBERS, ONE_U, ONE_W, SUB_U, SUB_W, WORD_STATE, WORD_SEATING, LINK_U, LINK_W, SUM_U, SUM_W = range(14)
PAIRS, PAIR_PLAN, PAIR_STATE, PAIR_SEATING, GAMMA, CUSTOMERS, SCALARS, TEXTS, HASHES, WORD_ANSWER, PAIR_ANSWER = range(14, 25)


def node_of(hashes: np.ndarray, nodes: int) -> np.ndarray:
    """Equal ranges of 64-bit hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(nodes)) >> np.uint64(32)).astype(np.int64)


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of the numbers of two words."""
    return py.mixed(py.mixed(u.astype(np.uint64) + np.uint64(SEED)) + w.astype(np.uint64))


def _sorted_by(node: np.ndarray, nodes: int) -> np.ndarray:
    return np.argsort(node.astype(np.uint16 if nodes < 1 << 16 else np.int64), kind="stable")  # NumPy sorts the former by radix


def _starts(values: np.ndarray) -> np.ndarray:
    """Places at which a run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, modulo 2^64, from 0 on: np.cumsum gives the values back."""
    return np.diff(values, prepend=values.dtype.type(0))


def signless(x: np.ndarray) -> np.ndarray:
    """Integers as others of a like size that are never negative."""
    return (x << 1) ^ (x >> 63)


def signed(x: np.ndarray) -> np.ndarray:
    return (x >> 1) ^ -(x & 1)


# --- texts


def encode(docs: DataFrame, held_out: str) -> tuple[str, str]:
    """Write the texts as batches of places of words among the batch's own, and these words' hashes and training counts in rows apart.

    Returns the path and the schema.

    A batch's words are in the order of their hashes, so that of their nodes, whatever the number of nodes.
    """
    plain = docs.select("doc_id", held_out)

    def run(batches):
        task, k = TaskContext.get().partitionId() << 32, 0
        for batch in at.slices(batches, limit=TEXT_BYTES):
            found, bounds = at.words(pc.ascii_lower(at.texts(batch.column("text"))))
            codes, values = at.coded(found)
            hashes = np.array([xxhash.xxh64_intdigest(x, seed=42) for x in values.cast(pa.binary()).to_pylist()], np.uint64)
            order = np.argsort(hashes)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            held = batch.column(held_out).to_numpy(zero_copy_only=False).astype(bool)
            n = len(codes) + len(held)
            train = int((np.diff(bounds) + 1)[~held].sum())
            one = [pa.array([x, x]) for x in (task + k, n, train, int((~held).sum()))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(held), len(held)], pa.int32()), batch.column(c)) for c in ("doc_id", held_out)]
            word, size = place[codes], np.diff(bounds)
            c = np.append(np.bincount(word[~np.repeat(held, size)], minlength=len(order)), [(~held).sum(), 0])
            data = [pack(size.astype(np.uint32), word, np.array([len(order)]), held.astype(np.uint8)), pack(steps(hashes[order]), c)]
            kinds = [pa.array([TEXTS, HASHES], pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays([*one, *lists, *kinds], ["node", "n", "train", "texts", "doc_id", "held", "kind", "data"])
            k += 1

    kind = plain.schema["doc_id"].dataType.simpleString()
    schema = f"node long, n long, train long, texts long, doc_id array<{kind}>, held array<boolean>, kind int, data binary"
    return keep(docs.select("doc_id", held_out, "text").mapInArrow(run, schema), "kind"), schema


class Pairs:
    """Words and distinct pairs of a batch of texts, given the words' numbers, by the nodes that count and seat them."""

    def __init__(self, data: bytes, nodes: int, numbers: list):
        size, codes, d, held = unpack(data)
        self.held, self.size, self.d = held.astype(bool), size.astype(np.int64) + 1, int(d[0])
        self.edge = np.concatenate([[0], np.cumsum(self.size)])
        self.word = np.full(self.edge[-1], self.d)
        inner = np.ones(self.edge[-1], bool)
        inner[self.edge[1:] - 1] = False
        self.word[inner] = codes
        self.of_held = np.repeat(self.held, self.size)
        ends = node_of(np.array([END, START], np.uint64), nodes)
        told = np.zeros(nodes, np.int64)
        for src, (index,) in numbers:
            told[src] = len(index)
        np.subtract.at(told, ends, 1)
        node = np.concatenate([np.repeat(np.arange(nodes), told), ends])
        self.order = _sorted_by(node, nodes)
        self.number = np.empty(len(node), np.int64)
        self.number[self.order] = joined(numbers, 0, np.int64) * nodes + node[self.order]
        context = np.concatenate([[0], self.word[:-1]])[: len(self.word)]
        context[self.edge[:-1]] = self.d + 1
        self.key = context * (self.d + 2) + self.word
        ordered = np.sort(self.key * 2 + self.of_held)
        key = ordered >> 1
        first = _starts(key)
        self.pairs = key[first]
        self.trained = np.add.reduceat(1 - (ordered & 1), first)
        self.u, self.w = self.pairs // (self.d + 2), self.pairs % (self.d + 2)
        self.pair_node = node_of(pair_hash(self.number[self.u], self.number[self.w]), nodes)
        self.pair_order = _sorted_by(self.pair_node, nodes)
        self.pair_edge = np.searchsorted(self.pair_node[self.pair_order], np.arange(nodes + 1))


def _ask_words(nodes: int):
    """A batch sends each node its words (ascending, then the end and the start of a text), with their counts in training texts."""

    def run(batches):
        for batch in batches:
            for me, data in zip(batch.column("node").to_pylist(), batch.column("data"), strict=True):
                (known, c), out = unpack(data.as_py()), Rows()
                hashes = np.concatenate([np.cumsum(known), np.array([END, START], np.uint64)])
                node = node_of(hashes, nodes)
                order = _sorted_by(node, nodes)
                out.deal(node[order], nodes, WORDS, me, hashes[order], c[order])
                yield from out.table().to_batches()

    return run


def _number_words(key, rows):
    """Sum up a node's words; a word's number is its place among them (times the nodes, plus the node)."""
    me, asked, out = key[0].as_py(), received(rows)[WORDS], Rows()
    hashes, index = np.unique(joined(asked, 0, np.uint64), return_inverse=True)
    c = np.bincount(index, joined(asked, 1, np.int64), len(hashes)).astype(np.int64)
    out.add(me, COUNTED, me, hashes, c)
    edge = np.cumsum([0, *(len(a[0]) for _, a in asked)])
    for (src, _), i, j in zip(asked, edge[:-1], edge[1:], strict=True):
        out.add(src, NUMBERS, me, index[i:j])
    out.add(-1, SCALARS, me, np.array([(c > 0).sum()], np.int64))
    return out.table()


def _ask_pairs(nodes: int):
    """A batch sends each node its pairs by their words' numbers, ascending: runs of the first word, the second, training counts."""

    def run(key, rows):
        me, out = key[0].as_py(), Rows()
        own, numbers = _own(rows), received(rows.filter(pc.not_equal(rows["kind"], TEXTS)))[NUMBERS]
        own = Pairs(own["data"][0].as_py(), nodes, numbers)
        for k in np.flatnonzero(np.diff(own.pair_edge)).tolist():
            pairs = own.pair_order[own.pair_edge[k] : own.pair_edge[k + 1]]
            first = _starts(own.u[pairs])
            out.add(k, PAIRS, me, own.number[own.u[pairs[first]]], np.diff(np.append(first, len(pairs))), own.number[own.w[pairs]], own.trained[pairs])
        return out.table()

    return run


def _own(rows: pa.Table) -> pa.Table:
    return rows.filter(pc.equal(rows["kind"], TEXTS))


def _count_pairs(nodes: int):
    """Sum up a node's pairs; those seen twice or more stay, linked to the nodes of their words."""

    def run(key, rows):
        me, asked, out = key[0].as_py(), received(rows)[PAIRS], Rows()
        w, k = joined(asked, 2, np.int64), joined(asked, 3, np.int64)
        u = np.concatenate([np.zeros(0, np.int64), *(np.repeat(a[0], a[1]) for _, a in asked)])
        order = np.lexsort((w, u)) if max(u.max(initial=0), w.max(initial=0)) >= 1 << 31 else np.argsort(u << 32 | w)
        first = np.flatnonzero(np.concatenate([[True], (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1])])) if len(order) else order
        total = np.add.reduceat(k[order], first) if len(first) else k
        kind = np.where(total > 1, np.cumsum(total > 1), np.where(total == 1, 0, -1))
        entry = np.zeros(len(order), np.int64)
        entry[order] = np.repeat(kind, np.diff(np.append(first, len(order))))
        edge = np.cumsum([0, *(len(a[2]) for _, a in asked)])
        for (src, _), i, j in zip(asked, edge[:-1], edge[1:], strict=True):
            # A training text's pair that isn't answered was seen once, a held-out text's never.
            told = np.flatnonzero((entry[i:j] > 0) | ((entry[i:j] == 0) & (k[i:j] == 0)))
            out.add(me, PAIR_PLAN, src, np.diff(told, prepend=0), entry[i:j][told])
        place = order[first]
        once, many = place[total == 1], place[total > 1]
        distinct, index = [], []
        for values, sub, one in ((u, SUB_U, ONE_U), (w, SUB_W, ONE_W)):
            for found, at_kind in ((once, one), (many, sub)):
                numbers, inverse, n = np.unique(values[found], return_inverse=True, return_counts=True)
                by_node = _sorted_by(numbers % nodes, nodes)
                out.deal((numbers % nodes)[by_node], nodes, at_kind, me, (numbers // nodes)[by_node], n[by_node])
            rank = np.empty(len(numbers), np.int64)
            rank[by_node] = np.arange(len(numbers))
            index.append(rank[inverse])
            distinct.append(numbers[by_node])
        out.add(me, PAIR_STATE, me, *distinct, *index, total[total > 1])
        out.add(-1, SCALARS, me, np.array([(total == 1).sum(), (total == 2).sum()], np.int64))
        return out.table()

    return run


# --- nodes


def _words_step(sweep: int, nodes: int, scalars: dict, last: bool):
    """Customers and tables of the word restaurant, and what pair nodes (last: and batches) need of them."""

    def run(key, rows):
        me, got, out = key[0].as_py(), received(rows), Rows()
        if sweep == 0:
            hashes, c = got[COUNTED][0][1] if got[COUNTED] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            links = {kind: [(src, *a) for src, a in got[sub]] for kind, sub in ((LINK_U, SUB_U), (LINK_W, SUB_W))}
            for kind, found in links.items():
                for src, place, _ in found:
                    out.add(me, kind, src, place)
            once = [np.bincount(joined(got[k], 0, np.int64), joined(got[k], 1, np.int64), len(hashes)).astype(np.int64) for k in (ONE_U, ONE_W)]
            out.add(me, WORD_STATE, me, hashes, c, *once)
            history = []
        else:
            hashes, c, *once = got[WORD_STATE][0][1]
            own, *history = got[WORD_SEATING][0][1]
            links = {}
            for kind, sums in ((LINK_U, SUM_U), (LINK_W, SUM_W)):
                sent = {src: a[0] for src, a in got[sums]}
                links[kind] = [(src, a[0], sent[src]) for src, a in got[kind]]
        tables, customers = once[0].copy(), once[1].copy()
        for total, kind in ((tables, LINK_U), (customers, LINK_W)):
            for _, place, n in links[kind]:
                total[place] += n  # a node has each word once
        if sweep == 0:
            own = np.minimum(customers, 1)
        else:
            own = py.reseat(hashes, sweep, customers, np.full(len(hashes), scalars["strength"]), scalars["d0"], own)
        if sweep > BURN:
            now = [tables, customers, own]
            history = [*history, *(signless(x - first) for x, first in zip(now, history, strict=False))] if history else now
        out.add(-1, SCALARS, me, np.array([customers.sum(), own.sum(), (customers == 1).sum(), (customers == 2).sum(), tables.sum()], np.int64))
        if last:
            for src, (place,) in got[WORD_PLAN]:
                out.add(src, WORD_ANSWER, me, *(x[place] for x in (c, *history)))
            return out.table()
        out.add(me, WORD_SEATING, me, own, *history)
        g = py.gamma(hashes, 1000 + sweep, py.THETA / scalars["d"] + tables)
        for src, place, _ in links[LINK_U]:
            out.add(src, GAMMA, me, g[place])
        for src, place, _ in links[LINK_W]:
            out.add(src, CUSTOMERS, me, customers[place], own[place])
        return out.table()

    return run


def _pairs_step(sweep: int, nodes: int, scalars: dict):
    """Seat the pairs of context restaurants, and send the numbers of tables by context and by word."""

    def run(key, rows):
        me, got, out = key[0].as_py(), received(rows), Rows()
        of_u, of_w, u, w, c = got[PAIR_STATE][0][1]
        t, total = got[PAIR_SEATING][0][1] if got[PAIR_SEATING] else np.zeros((2, len(c)), np.int64)
        g = joined(got[GAMMA], 0, float)
        m, own = (joined(got[CUSTOMERS], k, float) for k in (0, 1))
        parent = (m - scalars["d0"] * own + scalars["rest"]) / scalars["total"]
        t = py.reseat(pair_hash(of_u[u], of_w[w]), sweep, c, scalars["d"] * g[u] * parent[w], scalars["d"], t)
        total = total + t if sweep >= BURN else total
        out.add(me, PAIR_SEATING, me, t, total)
        for kind, index, numbers in ((SUM_U, u, of_u), (SUM_W, w, of_w)):
            out.deal(numbers % nodes, nodes, kind, me, np.bincount(index, t, len(numbers)).astype(np.int64))
        return out.table()

    return run


def _pairs_answer(key, rows):
    me, got, out = key[0].as_py(), received(rows), Rows()
    c, total = got[PAIR_STATE][0][1][4], got[PAIR_SEATING][0][1][1]
    c, total = np.append(1, c), np.append(SAMPLES, total)  # 0: a pair seen once
    for src, (place, entry) in got[PAIR_PLAN]:
        out.add(src, PAIR_ANSWER, me, place, c[entry], total[entry])
    return out.table()


def _scores(nodes: int, scalars: dict, schema: pa.Schema):
    """The texts of a batch, from the answers of all nodes."""

    def run(key, rows):
        own, got = _own(rows), received(rows.filter(pc.not_equal(rows["kind"], TEXTS)))
        batch = Pairs(own["data"][0].as_py(), nodes, got[NUMBERS])
        c, *history = (np.empty(len(batch.number), np.int64) for _ in range(1 + 3 * SAMPLES))
        for k, x in enumerate((c, *history)):
            x[batch.order] = joined(got[WORD_ANSWER], k, np.int64)
        follow = c.copy()
        follow[-2:] = 0, scalars["texts"]
        d, x = scalars["d"], np.where(batch.trained > 0, 1 - scalars["d"], 0.0)
        for src, (step, count, tables) in got[PAIR_ANSWER]:
            x[batch.pair_order[batch.pair_edge[src] + np.cumsum(step)]] = count - d * (tables / SAMPLES)
        above = np.zeros(len(x))
        for s in range(SAMPLES):
            tables, m, t = (x + signed(more) for x, more in zip(history, history[3 * s : 3 * s + 3], strict=False)) if s else history[:3]
            parent = (m - scalars["d0"] * t + scalars["rests"][s]) / scalars["totals"][s]
            above += ((py.THETA + d * tables) / (py.THETA + follow))[batch.u] * parent[batch.w]
        p = np.log10(x / (py.THETA + follow[batch.u]) + above / SAMPLES)
        first = batch.edge[:-1]
        score, base, known = (
            np.add.reduceat(v, first) for v in (p[np.searchsorted(batch.pairs, batch.key)], np.log10(c + 1.0)[batch.word], (c > 0).astype(np.int64)[batch.word])
        )
        columns = [
            own["doc_id"].combine_chunks().flatten(), pa.array(batch.held), pa.array(batch.size), pa.array(known), pa.array(np.full(len(score), scalars["N"])),
            pa.array(base - batch.size * np.log10(scalars["N"] + scalars["V"] + 1)), pa.array(score), pa.array(10 ** (-score / batch.size)),
        ]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def score(docs: DataFrame, held_out, trace: list | None = None) -> DataFrame:
    """Scores of documents (doc_id, text); the model learns from rows where `held_out` is false (actions).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    perplexity; other columns are left out, whatever their names. A NULL text is empty: its
    only token is the end. An empty table gives no rows; without any training text all words
    are unknown and have probability 1 (the only place is that of an unknown token). Repeated
    rows are scored each; NULL doc_ids stay. A very long text is a batch of its own.
    trace: a list that gets a dict of counts for each sweep.
    """
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out)
    spark = docs.sparkSession

    def step(df: DataFrame, run) -> str:
        return keep(df.groupBy("node").applyInArrow(run, SCHEMA), "kind")

    def rows(path: str, *kinds: int) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(path).where(F.col("kind").isin(*kinds)).select("node", "kind", "src", "data")

    def all_of(path: str) -> np.ndarray:
        found = rows(path, SCALARS).toArrow()["data"].to_pylist()
        return np.sum([unpack(x)[0] for x in found], axis=0) if found else np.zeros(5, np.int64)

    encoded, form = encode(docs, "held_out")
    texts, hashes = (spark.read.schema(form).parquet(encoded).where(F.col("kind") == k) for k in (TEXTS, HASHES))
    n, train, train_texts = (int(x or 0) for x in texts.agg(F.sum("n"), F.sum("train"), F.sum("texts")).first())
    nodes = max(1, -(-n // NODE_TOKENS))
    numbered = step(hashes.select("node", "data").mapInArrow(_ask_words(nodes), SCHEMA), _number_words)
    discard(spark, f"{encoded}/kind={HASHES}")
    distinct = int(all_of(numbered)[0])
    whole = texts.select("node", F.lit(TEXTS).alias("kind"), F.lit(0).cast("long").alias("src"), "data")
    counted = step(whole.unionAll(rows(numbered, NUMBERS)).groupBy("node").applyInArrow(_ask_pairs(nodes), SCHEMA), _count_pairs(nodes))
    ones, twos = (int(x) for x in all_of(counted)[:2])
    scalars = {"N": train, "V": distinct, "texts": train_texts, "d": py.discount(ones, twos), "rests": [], "totals": []}
    linked = words = pairs = None
    discard(spark)
    for sweep in range(BURN + SAMPLES + 1):
        last = sweep == BURN + SAMPLES
        if sweep == 0:
            df = rows(numbered, COUNTED).unionAll(rows(counted, SUB_U, SUB_W, ONE_U, ONE_W))
        else:
            df = rows(linked, WORD_STATE, LINK_U, LINK_W).unionAll(rows(words, WORD_SEATING)).unionAll(rows(pairs, SUM_U, SUM_W))
            if last:
                plan = rows(numbered, NUMBERS).select(F.col("src").alias("node"), F.lit(WORD_PLAN).alias("kind"), F.col("node").alias("src"), "data")
                df = df.unionAll(plan)
            g0 = np.random.default_rng([SEED, sweep]).gamma(py.THETA / scalars["d0"] + scalars["tables"])
            scalars["strength"] = scalars["d0"] * g0 / (distinct + 1)
        before, words = words, step(df, _words_step(sweep, nodes, dict(scalars), last))
        linked = linked or words
        customers, tables, ones, twos, t = (int(x) for x in all_of(words))
        if sweep == 0:
            scalars["d0"] = py.discount(ones, twos)
        scalars |= {"tables": tables, "rest": (py.THETA + scalars["d0"] * tables) / (distinct + 1), "total": py.THETA + customers}
        if trace is not None:
            trace.append({"sweep": sweep, "tables": t, "customers": customers, "own_tables": tables, "d": scalars["d"], "d0": scalars["d0"]})
        if sweep > BURN:
            scalars["rests"].append(scalars["rest"])
            scalars["totals"].append(scalars["total"])
        if before and before != linked:
            discard(spark, before)
        if last:
            break
        df = rows(counted, PAIR_STATE).unionAll(rows(words, GAMMA, CUSTOMERS))
        df = df.unionAll(rows(pairs, PAIR_SEATING)) if pairs else df
        before, pairs = pairs, step(df, _pairs_step(sweep, nodes, dict(scalars)))
        if before:
            discard(spark, before)
    told = step(rows(counted, PAIR_STATE, PAIR_PLAN).unionAll(rows(pairs, PAIR_SEATING)), _pairs_answer)
    discard(spark, counted, pairs, linked)
    answers = rows(words, WORD_ANSWER).unionAll(rows(numbered, NUMBERS)).unionAll(rows(told, PAIR_ANSWER))
    none = [F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in ("doc_id", "held")]
    whole = texts.select("node", F.lit(TEXTS).alias("kind"), F.lit(0).cast("long").alias("src"), "data", "doc_id", "held").unionAll(answers.select("*", *none))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    arrow = spark.createDataFrame([], schema).toArrow().schema
    return whole.groupBy("node").applyInArrow(_scores(nodes, scalars, arrow), schema)


def query(spark, sf_dir):
    """Scores of every document by a model of those whose fold (crc32 of doc_id mod 7) is not 2."""
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), is_fold("doc_id", 7, 2))


QUERY = ("op3_lm_score", query)
