"""WARC derivatives: metadata and plain-text conversion records from response records.

A response gives a metadata record (JSON: the source's WARC and HTTP headers and
digests, title, links) and a conversion record (the page's text). Both refer to the
response, each names the other, and both carry the response's URI, date and payload
digest. Record ids derive from the response's id, and this from the page and, where rows repeat, its
number among the equal ones: the same pages give the same ids, however they lie in files and partitions.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
from urllib.parse import quote, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import arrowtext as at
from kinelake.llm.common import table, written

CRAWL_DATE = "2024-01-01T00:00:00Z"
VERSION = "WARC/1.0"
#: Bytes of a plain file that a task reads, and equal rows that are dealt out at once.
RANGE_BYTES = 1 << 26
COPIES = 4096
RESPONSE_SCHEMA = "page_id long, record_id string, target_uri string, warc_date string, warc_headers string, http_headers string, payload string, payload_digest string"
DERIVED_SCHEMA = (
    "page_id long, warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string,"
    " content_type string, content_length long, block_digest string, payload_digest string, block string, record string"
)

# Elements that end a line of text, elements whose content is no text, attributes that hold links.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN_TAGS = "head|noscript|script|style|svg|template|textarea"
LINK_ATTRIBUTES = "action|href|src"
LINKS = frozenset(LINK_ATTRIBUTES.split("|"))

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({HIDDEN_TAGS})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|</?([a-zA-Z][a-zA-Z0-9]*)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?([a-zA-Z][a-zA-Z0-9]*)[^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
# Pages are matched up to their last '>' only: then each '<' with a letter begins a tag that ends, and matching is linear.
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][a-zA-Z0-9]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_ANY_LINK = re.compile(LINK_ATTRIBUTES, re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}
_SPACE = re.compile(r"[^\S\n]+")


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def page_text(page: str) -> str:
    """Visible text: one line for each block element, spaces collapsed, blank lines left out."""
    cut = page.rfind(">") + 1
    open_end = False  # an element or comment that nothing closes goes on to the end

    def seen(m: re.Match) -> str:
        nonlocal open_end
        if m.end() == cut:
            whole = m[0]
            open_end = whole.startswith("<!--") and not whole.endswith("-->") or bool(m[1]) and not re.search(r"</[a-zA-Z]+\s*>\Z", whole)
        tag = (m[2] or m[3] or "").lower()
        return "\n" if tag in BLOCK_TAGS else ""

    text = _TOKEN.sub(seen, page[:cut])
    text = html.unescape(text if open_end else text + page[cut:]).replace("\r", "\n")
    lines = (_SPACE.sub(" ", x).strip() for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def page_title(page: str) -> str:
    m = _TITLE.search(page)
    return " ".join(html.unescape(m[1]).split()) if m else ""


def page_links(page: str, base: str | None) -> list[dict[str, str]]:
    """All link attributes in order: element@attribute and the absolute URL (as written where it can't be joined)."""
    out, at_char, page = [], 0, page[: page.rfind(">") + 1]
    while m := _TAG.search(page, at_char):
        at_char = m.end()
        tag, attributes = (m[1] or m[3] or "").lower(), m[2] or m[4] or ""
        if tag and _ANY_LINK.search(attributes):
            seen = set()
            for x in _ATTRIBUTE.finditer(attributes):
                name = x[1].lower()
                if name not in LINKS or name in seen:
                    continue
                seen.add(name)
                url = html.unescape(x[2] or x[3] or x[4] or "").strip()
                try:
                    url = urljoin(base or "", url)
                except ValueError:
                    pass
                out.append({"path": f"{tag}@{name}", "url": url})
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at_char)
            at_char = end.end() if end else len(page)
    return out


def record_text(headers: list[tuple[str, str]], block: str) -> str:
    """A whole record as it stands in a file; header values lose line breaks."""
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}" for k, v in headers)]
    return "\r\n".join(lines) + "\r\n\r\n" + block + "\r\n\r\n"


def _numbered(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, copy): copy counts equal rows from 0 (an action).

    Rows are compared by hash first. Those whose hash is another's too are grouped as a whole, which sums
    equal ones before the shuffle, and are dealt out again in chunks.
    """
    mine = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("_h"))
    twice = written(mine.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_h"))
    once = mine.join(twice, "_h", "left_anti").select("page_id", "url", "html", F.lit(0).cast("long").alias("copy"))
    same = mine.join(twice, "_h", "left_semi").groupBy("page_id", "url", "html").agg(F.count(F.lit(1)).alias("n"))
    chunks = same.select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")).alias("_c"))
    return once.unionAll(chunks.select("page_id", "url", "html", F.explode(F.expr(f"sequence(_c * {COPIES}, least(n - 1, _c * {COPIES} + {COPIES - 1}))")).alias("copy")))


def responses(pages: DataFrame, date: str = CRAWL_DATE) -> DataFrame:
    """Response records of pages (page_id, url, html); other columns are left out, whatever their names (an action).

    A NULL url leaves the URI out, a NULL html is an empty page, and a NULL page_id enters
    the record id as an empty string. page_id may be of any type. Repeated rows are records of their own, with their own
    ids; an empty table gives none; a very long page is one record.
    """
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, {RESPONSE_SCHEMA.partition(', ')[2]}"

    def run(batches):
        for batch in at.slices(batches, "html"):
            rows = []
            for i, url, page, copy in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "copy")), strict=True):
                absent = [k for k, x in (("url", url), ("html", page)) if x is None]  # a NULL isn't an empty text
                page = page or ""
                payload = page.encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                digest = sha1_digest(payload)
                own = derived_id("response", "" if i is None else f"={i}", url or "", digest, *absent, str(copy))
                block = http.encode() + b"\r\n" + payload
                headers = [
                    ("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Date", date), *([("WARC-Target-URI", url)] if url else []),
                    ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
                    ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", sha1_digest(block)),
                ]
                rows.append((i, own, url, date, "\r\n".join(f"{k}: {' '.join(v.split())}" for k, v in headers), http, page, digest))
            yield _batch(rows, schema, batch.column("page_id").type)

    return _numbered(pages).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: str, key: pa.DataType) -> pa.RecordBatch:
    """Rows of a schema whose first column is of type `key`."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    types = [key, *(pa.int64() if k == "long" else pa.string() for k in kinds[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))


def _headers(text: str) -> list[tuple[str, str]]:
    return [(k, v.strip()) for k, _, v in (x.partition(":") for x in text.split("\r\n") if ":" in x)]


def _named(headers: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """Headers by name; the values of a repeated one are a list, in order."""
    out: dict[str, str | list[str]] = {}
    for k, v in headers:
        out[k] = v if k not in out else [*(out[k] if isinstance(out[k], list) else [out[k]]), v]
    return out


def derive(source: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response of `source` (RESPONSE_SCHEMA; other columns are left out).

    A NULL payload is an empty page, NULL headers are none, and NULL ids, dates, URIs and
    digests are left out of the records (a NULL record id enters theirs as an empty string).
    Repeated rows give repeated records; an empty table gives none; very long pages take time in
    proportion to their length.
    """
    schema = f"page_id {source.schema['page_id'].dataType.simpleString()}, {DERIVED_SCHEMA.partition(', ')[2]}"

    def run(batches):
        for batch in at.slices(batches, "payload"):
            rows = []
            for i, own, uri, date, warc, http, page, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = page or ""
                ids = {kind: derived_id(kind, own or "") for kind in ("metadata", "conversion")}
                status, _, http_lines = (http or "").partition("\r\n")
                about = {
                    "Envelope": {
                        "WARC-Header-Metadata": _named(_headers(warc or "")),
                        "Payload-Metadata": {
                            "Actual-Content-Type": "application/http; msgtype=response",
                            "HTTP-Response-Metadata": {
                                "Response-Message": status,
                                "Headers": _named(_headers(http_lines)),
                                "Entity-Digest": digest,
                                "Entity-Length": str(len(page.encode())),
                                "HTML-Metadata": {"Title": page_title(page), "Links": page_links(page, uri)},
                            },
                        },
                    }
                }
                blocks = {"metadata": (json.dumps(about, ensure_ascii=False), "application/json"), "conversion": (page_text(page), "text/plain")}
                for kind, other in (("metadata", "conversion"), ("conversion", "metadata")):
                    block, content = blocks[kind]
                    raw = block.encode()
                    headers = [
                        ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", own), ("WARC-Concurrent-To", ids[other]), ("WARC-Date", date),
                        ("WARC-Target-URI", uri), ("Content-Type", content), ("Content-Length", str(len(raw))),
                        ("WARC-Block-Digest", sha1_digest(raw)), ("WARC-Refers-To-Payload-Digest", digest),
                    ]
                    headers = [(k, v) for k, v in headers if v]
                    rows.append((i, kind, ids[kind], own, ids[other], uri, date, content, len(raw), sha1_digest(raw), digest, block, record_text(headers, block)))
            yield _batch(rows, schema, batch.column("page_id").type)

    columns = [x.split()[0] for x in RESPONSE_SCHEMA.split(",")]
    return source.select(*columns).mapInArrow(run, schema)


def write(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write `record` of each row as WARC files, one a partition (an action). Rows whose record is NULL give an empty line; other columns are left out.

    A record ends with a line break, which is the one that the text sink adds.
    """
    records.selectExpr("substring(record, 1, length(record) - 1) AS value").write.option("compression", compression).text(path)


def _opened(path: str, buffer: int):
    """A file that Spark has listed, for reading; a gzipped one as what it holds."""
    from pyarrow import fs

    local = path.startswith("file:")
    store, name = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(quote(path, safe="/:@?=&+%"))
    if path.endswith(".gz"):
        return gzip.GzipFile(fileobj=io.BufferedReader(store.open_input_stream(name, compression=None), buffer))
    return io.BufferedReader(store.open_input_file(name), buffer)


def _head(file) -> tuple[list[tuple[str, str]], int] | None:
    """Headers of the next record and the length of its block, the file standing at the block; None at the end."""
    line = file.readline()
    while line in (b"\r\n", b"\n"):
        line = file.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/1."):
        raise ValueError(f"a record begins with {line[:40]!r}: the one before is longer than it says")
    lines = []
    while (line := file.readline()) not in (b"\r\n", b"\n", b""):
        lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
    headers = _headers("\r\n".join(lines))
    return headers, int(next((v for k, v in headers if k.lower() == "content-length"), "-1"))


def _short(got: int, size: int) -> ValueError:
    return ValueError(f"a record of {got} bytes says that it has {size}: it is cut short")


def parse(file, stop: int | None = None):
    """(headers, block) of the records of an open file, framed by their lengths, up to one that begins at `stop` or later."""
    while (stop is None or file.tell() < stop) and (head := _head(file)):
        headers, size = head
        block = file.read(max(size, 0))
        if size < 0 or len(block) < size:
            raise _short(len(block), size)
        yield headers, block


def _ranges(path: str, length: int, most: int) -> list[tuple[str, int, int]]:
    """Parts of a plain file, each of whole records and about `most` bytes: from record to record by their lengths, blocks unread."""
    out, start = [], 0
    with _opened(path, 1 << 13) as file:
        while head := _head(file):
            end = file.tell() + max(head[1], 0)
            if head[1] < 0 or end > length:
                raise _short(length - file.tell(), head[1])
            file.seek(end)
            if end - start >= most:
                out.append((path, start, end))
                start = end
    return [*out, (path, start, length)] if start < length else out


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(headers, block) of every record under `path`, plain or gzipped (.gz); headers are (name, value) pairs in order.

    Records are framed by their lengths, so a block may hold anything, WARC records too. A plain file is cut into
    ranges of whole records, which tasks read one record at a time; a gzipped one can only be read from its beginning, by one
    task. A record that is shorter or longer than it says raises ValueError. Spark lists no empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")

    def cut(batches):
        for batch in batches:
            rows = []
            for name, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                rows += [(name, 0, -1)] if name.endswith(".gz") else _ranges(name, length, range_bytes)
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "start", "stop"])

    def run(batches):
        pairs = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))

        def given(found):
            rows = [[{"name": k, "value": v} for k, v in h] for h, _ in found]
            return pa.RecordBatch.from_arrays([pa.array(rows, pairs), pa.array([b for _, b in found], pa.binary())], ["headers", "block"])

        for batch in batches:
            for name, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop")), strict=True):
                found, size = [], 0
                with _opened(name, 1 << 20) as file:
                    if start:
                        file.seek(start)
                    for record in parse(file, stop if stop >= 0 else None):
                        found.append(record)
                        size += len(record[1])
                        if size >= at.SLICE_BYTES:
                            yield given(found)
                            found, size = [], 0
                yield given(found)

    ranges = files.repartition("path").mapInArrow(cut, "path string, start long, stop long")
    return ranges.repartition("path", "start").mapInArrow(run, "headers array<struct<name:string,value:string>>, block binary")


def query(spark, sf_dir):
    """The metadata and conversion records of every page's response (DERIVED_SCHEMA without `record`)."""
    return derive(responses(table(spark, sf_dir, "pages"))).drop("record")


QUERY = ("op10_warc_derivatives", query)
