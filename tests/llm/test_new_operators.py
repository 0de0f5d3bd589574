"""Sharding, spelling variants and ranked search against plain versions of their definitions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinelake.llm import ranked, sharding, spelling
from kinelake.llm.queries import queries
from tests.llm.conftest import lower

SF_DIR = "/root/testdata/sf0.001"

# --- op11


def plain_draw(total, good, n, u):
    mean = n * good / max(total, 1)
    sd = math.sqrt(mean * (1.0 - good / max(total, 1)) * float(total - n) / max(total - 1, 1))
    low, high = max(0, n - (total - good), math.floor(mean - 9.0 * sd - 30.0)), min(n, good, math.ceil(mean + 9.0 * sd + 30.0))
    weights, w = [], 1.0
    for k in range(low, high + 1):
        weights.append(w)
        w = w * (float(good - k) * float(n - k) / (float(k + 1) * float(total - good - n + k + 1)))
    goal, s = u * sum_of(weights), 0.0
    for x, w in zip(range(low, high + 1), weights, strict=True):
        s += w
        if s > goal:
            return x
    return high


def sum_of(values):
    s = 0.0
    for v in values:
        s += v
    return s


def share(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2.0**52


def plain_matrix(children, left, label, node):
    left, out = list(left), {}
    for child, n in sorted(children.items()):
        took = []
        for j in range(len(left)):
            took.append(plain_draw(sum(left[j:]), left[j], n - sum(took), share(f"{label}:{node}:{child}:{j}")))
        out[child] = took
        left = [a - b for a, b in zip(left, took, strict=True)]
    assert not any(left)
    return out


def plain_places(rows, shards, seed, size):
    """Sorted (doc_id, size, crc, shard, slot) of (doc_id, text)."""
    copies, each = collections.Counter(), []
    for doc_id, text in rows:
        raw = (text or "").encode()
        same = (doc_id, len(raw) + 1, zlib.crc32(raw))
        each.append((*same, copies[same]))
        copies[same] += 1
    total = len(each)
    side, blocks = max(1, math.ceil(math.sqrt(total / size))), max(1, math.ceil(total / shards / size))
    name = lambda r: ":".join(["" if r[0] is None else str(r[0]), *map(str, r[1:])])
    key = lambda way, r: hashlib.md5(f"{seed}:{way}:{name(r)}".encode()).hexdigest()
    parts = collections.defaultdict(list)
    for r in each:
        k = key("from", r)
        parts[math.floor(int(k[:13], 16) / 2.0**52 * (side * side))].append((k, r))
    groups = collections.defaultdict(dict)
    for p, own in parts.items():
        groups[p // side][p] = len(own)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    top = plain_matrix({g: sum(own.values()) for g, own in groups.items()}, capacity, f"{seed}:groups", 0)
    got = collections.defaultdict(list)
    for g, own in groups.items():
        for p, quota in plain_matrix(own, top[g], f"{seed}:parts", g).items():
            ordered = iter(r for _, r in sorted(parts[p]))
            for j, n in enumerate(quota):
                got[j] += [next(ordered) for _ in range(n)]
    out = []
    for j, own in got.items():
        order = sorted(own, key=lambda r: (math.floor(int(key("to", r)[:13], 16) / 2.0**52 * blocks), key("to", r)))
        out += [(*r[:3], j, slot) for slot, r in enumerate(order)]
    return sorted(out, key=repr)


def placed(df):
    return sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shards, size", [(16, 16_384), (16, 8), (3, 20), (7, 1)])
def test_places(spark, documents, shards, size):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = sharding.place(documents, shards, "s", size)
    assert placed(got) == plain_places(rows, shards, "s", size)


def test_places_query(spark, documents):
    got = queries()["op11_shard"](spark, SF_DIR)
    assert placed(got) == plain_places([(r["doc_id"], r["text"]) for r in documents.collect()], 16, "0", sharding.ROWS)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {(r["law"], r["grown_shard"]) for r in got.collect()} == {("rows", None)}


def test_places_of_odd_rows(spark, odd, empty):
    clashing = odd.withColumns({c: F.lit("mine") for c in ("size", "shard", "slot", "copies", "part", "key", "at")})
    want = plain_places([(r["doc_id"], r["text"]) for r in odd.collect()], 4, "0", 2)
    assert placed(sharding.place(odd, 4, rows=2)) == placed(sharding.place(clashing.repartition(3), 4, rows=2)) == want
    assert sharding.place(empty).count() == 0 and sharding.dealt(empty).count() == 0


def test_a_row_repeated_without_end_spreads(spark):
    """10,000 equal rows and 100 others: exact sizes, gapless slots, and equal rows in all shards alike."""
    docs = spark.createDataFrame([(1, "same")], "doc_id long, text string").crossJoin(spark.range(10_000)).drop("id").union(spark.range(2, 102).select("id", F.lit("x")))
    rows = sharding.place(docs, 5, rows=256).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert [sorted(by[j]) for j in range(5)] == [list(range(2020))] * 5


def test_texts_in_shards(spark, odd, tmp_path):
    more = odd.withColumn("shard", F.lit("mine")).withColumn("other", F.lit(1))
    out = sharding.dealt(more, 4, rows=2)
    assert sorted(map(repr, out.select(*odd.columns).collect())) == sorted(map(repr, odd.collect()))
    sharding.write(odd, f"{tmp_path}/out", 4, rows=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["n"] for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()) == [2, 2, 3, 3]


@pytest.mark.parametrize("total, good, n", [(1, 1, 1), (10, 3, 4), (50, 45, 20), (4000, 37, 900), (2000, 1000, 1000)])
def test_draws_follow_the_law(spark, total, good, n):
    """Chi-squared over 4,000 draws against the exact probabilities."""
    df = spark.range(4000).select(sharding.hypergeometric(F.lit(total).cast("long"), F.lit(good).cast("long"), F.lit(n).cast("long"), sharding.hashed(F.md5(F.col("id").cast("string")))).alias("x"))
    seen = collections.Counter(r["x"] for r in df.collect())
    law = {k: math.comb(good, k) * math.comb(total - good, n - k) / math.comb(total, n) for k in range(max(0, n - total + good), min(n, good) + 1)}
    assert set(seen) <= set(law)
    likely = [k for k, p in law.items() if p * 4000 >= 5]
    chi = sum((seen[k] - 4000 * law[k]) ** 2 / (4000 * law[k]) for k in likely)
    assert chi < len(likely) + 5 * math.sqrt(2 * len(likely)) + 1


def test_any_place_is_as_likely(spark):
    """Over 60 seeds each of 40 rows visits each of 4 shards about 15 times; first slots spread over the rows."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = [(i, "t") for i in range(40)]
    where, firsts = collections.Counter(), collections.Counter()
    for seed in range(400):
        for doc_id, _, _, shard, slot in plain_places(rows, 4, str(seed), 4):
            where[doc_id, shard] += 1
            firsts[doc_id] += (shard, slot) == (0, 0)
    assert placed(sharding.place(docs, 4, "17", 4)) == plain_places(rows, 4, "17", 4)
    chi = sum((where[i, j] - 100) ** 2 / 100 for i in range(40) for j in range(4))
    assert 60 < chi < 200  # 117 degrees of freedom
    assert sum((firsts[i] - 10) ** 2 / 10 for i in range(40)) < 85  # 39


# --- op12


def plain_words(rows):
    count = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(words, near):
    form = {}
    for w, n in words.items():
        best = min(near(w), key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near(w)), words[form[w]] if form[w] else None)
    return out


def grouped(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_query(spark, documents):
    words = plain_words([(r["doc_id"], r["text"]) for r in documents.collect()])
    less = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            less[w[:k] + w[k + 1 :]].add(w)
            less[w].add(w)
    near = lambda w: [x for x in set().union(*(less[w[:k] + w[k + 1 :]] for k in range(len(w))), less[w]) if one_apart(w, x)]
    assert grouped(queries()["op12_spelling"](spark, SF_DIR)) == plain_groups(words, near)


@pytest.mark.parametrize("trie_words, wave", [(1000, 1 << 25), (7, 1), (50, 4000)])
def test_variants_of_short_alphabets(spark, trie_words, wave):
    """Runs of equal letters, chains of forms, words of all lengths; any split into tries and waves."""
    rng = random.Random(trie_words)
    words = {"".join(rng.choice("abé\U0001f600") for _ in range(rng.randrange(0, 7))): rng.choice([1, 2, 15, 150, 1500, 15_000]) for _ in range(400)} | {"a" * 3000: 30, "a" * 3001: 3, "a" * 2999 + "b": 300}
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_apart(w, x)] for w in words}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert grouped(spelling.group(df, trie_words=trie_words, wave_bytes=wave)) == plain_groups(words, near.get)


def test_words_of_odd_rows(spark, odd, empty):
    more = odd.union(spark.createDataFrame([(None, "Straßenbahn STRAßENBAHN École ×÷×÷×÷× nähmlich" + " z" * 9 + "z" * 100_000, "x", "y", 1)] * 2, odd.schema))
    want = plain_words([(r["doc_id"], r["text"]) for r in more.collect()])
    got = {r["word"]: r["n"] for r in spelling.words(more.withColumns({"word": F.lit("mine"), "n": F.lit(9), "id": F.lit(0)})).collect()}
    assert got == want and len(got) > 2
    assert spelling.words(empty).count() == 0 and spelling.group(spelling.words(empty)).count() == 0


def test_check_sums_of_parts():
    rng = random.Random(1)
    ids = [str(i) for i in range(50)]
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    doc, code = np.repeat(np.arange(50), 60), np.tile(np.arange(60), 50)
    got = spelling._marked(ids, pa.array(words), doc, code, 5)
    crc = [zlib.crc32(f"{ids[d]}:{words[c]}".encode()) for d, c in zip(doc, code, strict=True)]
    assert got.tolist() == [x if x % 5 == 0 else -1 for x in crc]


# --- op13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=10):
    """Sorted (item_id, rank, doc_id, score) of rows (id, text)."""
    counts = [(i, collections.Counter(TERM.findall(lower(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall(lower(t)))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def searched(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_query(spark, documents):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    want = plain_search([(r["doc_id"], r["text"]) for r in documents.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert searched(queries()["op13_search"](spark, SF_DIR)) == want


@pytest.mark.parametrize("shard, block, terms", [(1 << 25, 10, 200_000), (400, 500_000, 0), (2000, 7, 3)])
def test_search_by_shards_blocks_and_whole_index(spark, shard, block, terms):
    """Many ties, few terms; any shards and blocks, with all terms indexed or those asked only."""
    rng = random.Random(shard)
    docs = [(rng.randrange(90), " ".join(rng.choices(["a", "B", "c", "dd", "É", "f1", "g", "h"], [9, 8, 7, 2, 2, 1, 1, 1], k=rng.randrange(0, 12)))) for _ in range(300)] + [(None, "f1 g"), (None, "h"), (5, None)]
    items = [(i, " ".join(rng.choices("A b c dd É f1 g h zz".split(), k=rng.randrange(0, 9)))) for i in range(20)] + [(3, "h h"), (None, "c"), (99, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    assert searched(ranked.search(d, q, 10, shard, block, terms)) == plain_search(docs, items)


def test_search_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([("i", "word1 seven ELEVEN"), ("j", None), (None, "漢 x")], "item_id string, text string")
    want = plain_search([(r["doc_id"], r["text"]) for r in odd.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    more = odd.withColumns({c: F.lit("mine") for c in ("score", "rank", "item_id", "terms", "ids")})
    assert searched(ranked.search(more, items.withColumn("doc_id", F.lit(1)))) == want
    assert ranked.search(empty, items).count() == 0 and ranked.search(odd, items.limit(0)).count() == 0
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r["doc_id"] for r in ranked.search(named, items).collect()} == {None if r[2] is None else f"d{r[2]}" for r in want}


def test_numbers_round_trip():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**21, 2**28, 2**35 - 1, 5], np.int64)
    assert ranked.numbers(ranked.varints(values)[0]).tolist() == values.tolist()
    assert len(ranked.numbers(ranked.varints(values[:0])[0])) == 0


def test_merge_keeps_the_best():
    """Against all sums, for lists of any overlap, with ties and a floor."""
    rng = random.Random(4)
    for _ in range(300):
        lists, sums = [], collections.Counter()
        for _ in range(rng.randrange(1, 6)):
            docs = sorted(rng.sample(range(40), rng.randrange(1, 30)))
            gain = [rng.randrange(0, 4) for _ in docs]
            lists.append((docs, gain, max(gain)))
            for d, g in zip(docs, gain, strict=True):
                sums[d] += g
        k, floor = rng.randrange(1, 8), rng.randrange(0, 5)
        want = sorted(((s, -d) for d, s in sums.items() if s > floor), reverse=True)[:k]
        assert sorted(ranked.best(lists, k, floor), reverse=True) == want
