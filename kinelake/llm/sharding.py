"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are dealt into source partitions by hash. How many rows each partition sends to each shard is drawn
beforehand: partition after partition, shard after shard, from the hypergeometric law that a uniform
permutation of all rows gives these counts, so that every shard gets exactly its size. Within a
partition rows are put in random order, the first ones go to shard 0, the next ones to shard 1, and so on;
within a shard they are put in random order again. The draws are made in two levels (groups of partitions,
then the partitions of each group), each a row of arrays, so no row grows with more than the root of the table.

All by DataFrame functions. Random numbers are hashes of the seed and of what is drawn, so the
result does not depend on how the rows lie in files or partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.common import discard, give_way, keep, table, written

SHARDS = 16
#: Rows of a source partition, and of a block of a shard that is ordered at once, on average.
ROWS = 16_384
#: Copies of one row that are handled at once.
COPIES = 4096
#: Standard deviations, and places besides, from the mean to which the law is summed: what is beyond is less than a double can tell.
SPREAD, BESIDES = 9, 30


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def hashed(md5: Column) -> Column:
    """The first 52 bits of an MD5 as a number from 0 to 1."""
    return F.conv(F.substring(md5, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def hypergeometric(total: Column, good: Column, n: Column, u: Column) -> Column:
    """How many of n places, taken at random from total, are among the good ones: inversion of u, in [0, 1), on the sums of the law.

    Weights are taken from one to the next by their ratio, twice: for their sum, then up to u times the sum.
    """
    double = lambda c: c.cast("double")

    def bounds(z):
        mean = double(z.n) * double(z.good) / double(F.greatest(z.total, F.lit(1)))
        sd = F.sqrt(mean * (F.lit(1.0) - double(z.good) / double(F.greatest(z.total, F.lit(1)))) * double(z.total - z.n) / double(F.greatest(z.total - 1, F.lit(1))))
        low = F.greatest(F.lit(0).cast("long"), z.n - (z.total - z.good), F.floor(mean - F.lit(float(SPREAD)) * sd - F.lit(float(BESIDES))))
        high = F.least(z.n, z.good, F.ceil(mean + F.lit(float(SPREAD)) * sd + F.lit(float(BESIDES))))
        return F.struct(z.total.alias("total"), z.good.alias("good"), z.n.alias("n"), z.u.alias("u"), low.alias("low"), high.alias("high"))

    def ratio(z, k):
        return double(z.good - k) * double(z.n - k) / (double(k + 1) * double(z.total - z.good - z.n + k + 1))

    def inverted(z):
        weights = F.aggregate(F.sequence(z.low, z.high), F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")), lambda a, k: F.struct((a.w * ratio(z, k)).alias("w"), (a.s + a.w).alias("s")), lambda a: a.s)
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), (z.u * weights).alias("goal"), z.low.alias("x"))
        step = lambda a, k: F.struct((a.w * ratio(z, k)).alias("w"), (a.s + a.w).alias("s"), a.goal.alias("goal"), (a.x + F.when(a.s + a.w <= a.goal, 1).otherwise(0)).alias("x"))
        return F.when(z.low >= z.high, z.low).otherwise(F.least(z.high, F.aggregate(F.sequence(z.low, z.high), start, step, lambda a: a.x)))

    return let(let(F.struct(total.alias("total"), good.alias("good"), n.alias("n"), u.alias("u")), bounds), inverted)


def matrix(children: Column, capacity: Column, label: str, node: Column) -> Column:
    """[child][shard]: how many rows each child, of array<struct<id, n>>, sends to each shard, whose capacities they fill exactly."""
    counts = "array<bigint>"

    def drawn(left, child):
        def cell(took, j):
            key = F.concat_ws(":", F.lit(label), node, child.id, j)
            return F.array_append(took, hypergeometric(_sum(F.slice(left, j + 1, F.size(left))), F.element_at(left, j + 1), child.n - _sum(took), hashed(F.md5(key))))

        return F.aggregate(F.sequence(F.lit(0), F.size(left) - 1), F.array().cast(counts), cell)

    def step(a, child):
        return let(drawn(a.left, child), lambda x: F.struct(F.zip_with(a.left, x, lambda p, q: p - q).alias("left"), F.array_append(a.out, F.struct(child.id.alias("id"), x.alias("quota"))).alias("out")))

    start = F.struct(capacity.alias("left"), F.array().cast(f"array<struct<id:bigint,quota:{counts}>>").alias("out"))
    return F.aggregate(children, start, step, lambda a: a.out)


def quotas(sizes: DataFrame, total: int, shards: int, side: int, seed: str) -> DataFrame:
    """(part, bounds) of sizes (part, n): a partition's rows up to bounds[j] go to shards 0 to j."""
    capacity = F.array(*(F.lit(total // shards + (j < total % shards)).cast("long") for j in range(shards)))
    children = lambda key: F.array_sort(F.collect_list(F.struct(F.col(key).alias("id"), F.col("n").cast("long").alias("n"))))
    group = F.expr(f"part div {side}")
    groups = sizes.groupBy(group.alias("g")).agg(F.sum("n").alias("n"), children("part").alias("parts"))
    top = groups.groupBy().agg(children("g").alias("groups")).select(F.explode(matrix(F.col("groups"), capacity, f"{seed}:groups", F.lit(0))).alias("q"))
    each = groups.select("g", "parts").join(top.select(F.col("q.id").alias("g"), F.col("q.quota").alias("quota")), "g")
    each = each.select(F.explode(matrix(F.col("parts"), F.col("quota"), f"{seed}:parts", F.col("g"))).alias("q"))
    upto = F.transform(F.col("q.quota"), lambda _, j: _sum(F.slice(F.col("q.quota"), 1, j + 1)))
    return each.select(F.col("q.id").alias("part"), upto.alias("bounds"))


def place(docs: DataFrame, shards: int = SHARDS, seed: str = "0", rows: int = ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs (doc_id, text) (actions).

    size is the bytes of the text and one more; a NULL text has the size 1 and the CRC-32 of the empty text. Shard sizes differ by
    one at most, the larger ones first; slots are numbered from 0 in each shard. Every order of all rows
    is equally likely, over seeds. The law is `rows`; grown_shard is NULL under it. Rows that agree in doc_id, size and CRC-32 are
    counted before they are dealt, so that however many there are, they spread. A NULL doc_id is a value like any
    other; an empty table gives no rows. Other columns are not read.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    same = ("doc_id", "size", "text_crc32")
    slim = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    path = keep(slim.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")))
    each = spark.read.parquet(path)
    total = each.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    side, blocks = max(1, math.ceil(math.sqrt(total / rows))), max(1, math.ceil(total / shards / rows))
    each = each.select(*same, "copies", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")).alias("chunk"))
    each = each.select(*same, F.explode(F.expr(f"sequence(chunk * {COPIES}, least(copies - 1, chunk * {COPIES} + {COPIES - 1}))")).alias("copy"))
    key = lambda way: F.md5(F.concat_ws(":", F.lit(f"{seed}:{way}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *same[1:], "copy"))
    share = lambda n: F.floor(hashed(F.col("key")) * F.lit(n)).alias("part")
    keyed = each.select(*same, "copy", key("from").alias("key")).select("*", share(side * side))
    bounds = written(quotas(keyed.groupBy("part").agg(F.count(F.lit(1)).alias("n")), total, shards, side, seed))
    ranked = keyed.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("key", *same, "copy")))
    sent = written(ranked.join(bounds, "part").select(*same, "copy", F.size(F.filter("bounds", lambda b: b < F.col("at"))).alias("shard")))
    discard(spark, path)
    keyed = sent.select(*same, "copy", "shard", key("to").alias("key")).select("*", share(blocks))
    before = keyed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    ranked = keyed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", *same, "copy")))
    out = ranked.join(before, ["shard", "part"])
    return out.select(*same, F.lit("rows").alias("law"), "shard", (F.col("before") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def dealt(docs: DataFrame, shards: int = SHARDS, seed: str = "0", rows: int = ROWS) -> DataFrame:
    """All rows of docs with columns shard and slot (as `place` gives them), whose own columns of these names give way.

    Rows that agree in doc_id, size and CRC-32 of the text take their places in any order.
    """
    rest = give_way(docs, "shard", "slot")
    text = F.coalesce(F.col("text"), F.lit(""))
    same = F.struct(F.col("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    mine = rest.select(F.struct(*(F.col(f"`{c}`") for c in rest.columns)).alias("_row"), F.to_json(same, {"ignoreNullFields": "false"}).alias("_same"))
    mine = mine.withColumn("_copy", F.row_number().over(Window.partitionBy("_same").orderBy(F.lit(0))))
    placed = place(docs, shards, seed, rows)
    placed = placed.select(F.to_json(F.struct("doc_id", "size", "text_crc32"), {"ignoreNullFields": "false"}).alias("_same"), "shard", "slot")
    placed = placed.withColumn("_copy", F.row_number().over(Window.partitionBy("_same").orderBy("shard", "slot")))
    return mine.join(placed, ["_same", "_copy"]).select("_row.*", "shard", "slot")


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: str = "0", rows: int = ROWS) -> None:
    """Write docs as Parquet, a folder `shard=n` for each shard, its files and their rows in the order of slots."""
    out = dealt(docs, shards, seed, rows)
    out.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir):
    """Places of all documents in 16 shards: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return place(table(spark, sf_dir, "documents"))


QUERY = ("op11_shard", query)
