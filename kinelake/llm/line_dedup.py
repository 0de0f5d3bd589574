"""Line deduplication by site-relative frequency.

A line is boilerplate of its site if more than RATIO of the site's pages contain it
(and at least MIN_PAGES do). Pages are counted by (site, line identity), so a hot site
spreads over its lines and a hot line is summed before the shuffle. A site of P pages
with L lines a page has at most L / RATIO boilerplate lines, however large it is.

Lines are looked up by hash, in time proportional to the text. Boilerplate lines of
all sites are broadcast if they are few; else a join gives each page its own ones.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm import arrowtext as at
from kinelake.llm.common import Shared, cut, table, unpacked, written

RATIO = 0.1
MIN_PAGES = 5
#: Boilerplate lines (of all sites) that are broadcast.
BROADCAST_LINES = 200_000
ADDED = ("n_lines", "n_dropped")


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; NULL without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def _identity(line: Column) -> tuple[Column, Column]:
    """Two independent hashes of a line, 96 bits in all."""
    return F.xxhash64(line), F.crc32(line.cast("binary"))


def _identities(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same of Python strings."""
    raw = [x.encode() for x in lines]
    return np.array([xxhash.xxh64_intdigest(x, seed=42) for x in raw], np.uint64).view(np.int64), np.array([zlib.crc32(x) for x in raw], np.int64)


def _distinct_lines(text: Column) -> Column:
    return F.array_distinct(F.transform(F.split(text, "\n"), F.trim))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, h, g): the identities of each site's boilerplate lines, of pages (site, text)."""
    pages = pages.where(F.col("site").isNotNull())
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    each = pages.select("site", F.explode(_distinct_lines(F.col("text"))).alias("line")).where("line <> ''")
    h, g = _identity(F.col("line"))
    counts = each.select("site", h.alias("h"), g.alias("g")).groupBy("site", "h", "g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    return counts.join(totals, "site").where(F.col("n") > F.col("pages") * F.lit(ratio)).select("site", "h", "g")


class Known:
    """Boilerplate lines by site: sorted hashes, and the second hash of each."""

    def __init__(self, found: pa.Table):
        found = found.sort_by([("site", "ascending"), ("h", "ascending")])
        sites, h, g = found["site"].to_pylist(), found["h"].to_numpy(), found["g"].to_numpy()
        edge = [i for i in range(len(sites)) if not i or sites[i] != sites[i - 1]] + [len(sites)]
        self.of = {sites[i]: (h[i:j], g[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)}

    def holds(self, site: str, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        own = self.of.get(site)
        if own is None:
            return np.zeros(len(h), bool)
        place = np.minimum(np.searchsorted(own[0], h), len(own[0]) - 1)
        return (own[0][place] == h) & (own[1][place] == g)


def _without(batch: pa.RecordBatch, dropped) -> list[pa.Array]:
    """text, n_lines and n_dropped of a batch; dropped(row, h, g) says which lines of a row go."""
    text = batch.column("text")
    lists = pc.split_pattern(at.texts(text), "\n")
    lines, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    codes, values = at.coded(pc.utf8_trim(lines, " "))
    h, g = _identities(values.to_pylist())
    blank = pc.equal(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    goes = np.zeros(len(lines), bool)
    for i in range(batch.num_rows):
        own = codes[bounds[i] : bounds[i + 1]]
        goes[bounds[i] : bounds[i + 1]] = dropped(i, h[own], g[own]) & ~blank[own]
    before = np.concatenate([[0], np.cumsum(~goes)])
    kept = pc.binary_join(pa.ListArray.from_arrays(before[bounds].astype(np.int32), lines.filter(pa.array(~goes))), "\n")
    there = text.is_valid().to_numpy(zero_copy_only=False)
    n = np.diff(bounds)
    out = pc.if_else(pa.array(there), kept, pa.scalar(None, pa.string()))
    return [out, pa.array(np.where(there, n, 0)), pa.array(np.where(there, n - np.diff(before[bounds]), 0))]


def found(docs: DataFrame, host: Column, ratio: float, min_pages: int, copies: bool) -> DataFrame:
    """(_rest, text, n_lines, n_dropped) of docs packed with its text apart (actions)."""
    site = docs.select(host.cast("string").alias("site"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "text") or [F.lit(0)]).alias("_rest"), F.col("text").alias("text"))
    pages = site.select("site", "text")
    if not copies:
        pages = pages.groupBy("site", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).drop("h")
    lines = cut(boilerplate(pages, ratio, min_pages))
    few = lines.count() <= BROADCAST_LINES
    if few:
        shared = Shared(docs.sparkSession, Known(lines.toArrow()))
    else:
        site = written(site.withColumn("row", F.monotonically_increasing_id()))
        h, g = _identity(F.col("line"))
        each = site.select("row", "site", F.explode(_distinct_lines(F.col("text"))).alias("line")).select("row", "site", h.alias("h"), g.alias("g"))
        own = each.join(lines, ["site", "h", "g"]).groupBy("row").agg(F.collect_list(F.struct("h", "g")).alias("own"))
        site = site.join(own, "row", "left").drop("row")

    def run(batches):
        known = shared.value if few else None
        for batch in at.slices(batches):
            if few:
                sites = batch.column("site").to_pylist()
                dropped = lambda i, h, g: known.holds(sites[i], h, g)
            else:
                sets = [{(x["h"], x["g"]) for x in r or ()} for r in batch.column("own").to_pylist()]
                dropped = lambda i, h, g: np.array([x in sets[i] for x in zip(h.tolist(), g.tolist(), strict=True)], bool)
            yield pa.RecordBatch.from_arrays([batch.column("_rest"), *_without(batch, dropped)], ["_rest", "text", *ADDED])

    zero = F.lit(0).cast("long")
    return site.mapInArrow(run, site.select("_rest", "text", zero.alias(ADDED[0]), zero.alias(ADDED[1])).schema)


def drop_boilerplate(docs: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """docs with boilerplate lines removed from text, plus n_lines and n_dropped (actions).

    Lines are compared without surrounding spaces; blank lines always stay. Rows with a
    NULL site keep all lines; a NULL text stays NULL with 0 lines, an empty one has one line.
    Each row is a page, also where doc_ids or texts repeat; with copies=False equal texts of a
    site count as one page. A text whose lines are all boilerplate becomes empty. An empty
    table stays empty; very long texts are read whole. Columns of docs named like the two
    added ones give way, all others keep their values, whatever their names.
    """
    return found(docs, host, ratio, min_pages, copies).select(*unpacked(docs, "text", without=ADDED), *ADDED)


def clean(docs: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs without boilerplate lines, with their own columns whatever their names; n_chars is brought up to date.

    Equal texts of a site count as one page, so that copies don't make each other's lines boilerplate.
    """
    columns = unpacked(docs, "text")
    size = F.length("text").cast("long").alias("n_chars")
    return found(docs, host, ratio, min_pages, False).select(*(size if c == "n_chars" else x for c, x in zip(docs.columns, columns, strict=True)))


def query(spark, sf_dir):
    """Every document without its source's boilerplate lines: doc_id, source, n_lines, n_dropped, text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, F.col("source")).select("doc_id", "source", "n_lines", "n_dropped", "text")


QUERY = ("op1_line_dedup", query)

ORACLE = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
t AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source),
b AS (SELECT source, trim(line) AS line FROM l JOIN t USING (source) WHERE trim(line) <> ''
      GROUP BY source, trim(line), pages HAVING count(DISTINCT doc_id) >= {MIN_PAGES} AND count(DISTINCT doc_id) > pages * {RATIO}::DOUBLE),
k AS (SELECT l.*, b.line IS NULL AS stays FROM l LEFT JOIN b ON l.source = b.source AND trim(l.line) = b.line),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (stays) AS text FROM k GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN coalesce(a.text, '') END AS text
FROM documents d LEFT JOIN a USING (doc_id)"""
