"""WARC: write pages as archives, read archives back, assemble transactions.

Writing. Each page becomes one transaction of three records: a request, a
response (or a revisit that holds the HTTP head only), and a metadata record.
Request and metadata name the response in ``WARC-Concurrent-To``. Of records with
equal payloads of at least ``MIN_REVISIT`` bytes, the one with the largest page id
is the response and the others revisit it. Records are made by column
expressions and written by Spark's text writer (gzip, CRLF CRLF after each record),
``PAGES_PER_ARCHIVE`` pages to a file at most.

Reading. Each archive is one row of the binary file source, so an archive must
fit into memory (2 GB at most); a task walks it record by record by
Content-Length.

Assembly. Responses and revisits, requests, and metadata meet by the
concurrent-to identifiers in equi joins on the record id and give one nested row per
capture. Payloads stay out of the joins unless asked for.

Defined cases: null html is an empty payload; a null url leaves the target out;
a null page id is carried as null and loses to any other as the response, so
copies whose ids are all null are all responses, as are rows repeating the largest
page id. Repeated rows (same id, url and html) share their record ids and are each
returned. Extra columns are ignored. An empty table writes an empty archive and
reads back no row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disputelens.llm.common import prepare, scratch_path, store

MIN_REVISIT = 1000
PAGES_PER_ARCHIVE = 1000
#: Copies of each group's response that the revisits of a large group are spread over.
SALTS = 8
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


# --- writing -----------------------------------------------------------------------

def _urn(kind: str, page: Column, url: Column, digest: Column) -> Column:
    """A record id from the kind of record and what it is about: the same whenever it is computed."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("\x00"))
    h = F.md5(F.concat_ws("\n", F.lit(kind), text(page), digest, text(url)))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record without its closing CRLF CRLF; headers that are null are left out."""
    lines = [F.lit(f"WARC/1.1{CRLF}")]
    for name, value in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit(CRLF), block)


def with_roles(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, n_bytes, and ``first`` (for revisits): the response's page id and url."""
    rows = pages.select(
        "page_id", F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha1("html"), "n_bytes": F.octet_length("html").cast("long")})
    groups = (rows.filter(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes")
              .agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
              .filter((F.col("n") > 1) & F.col("first.page_id").isNotNull())
              .select("digest", "n_bytes", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(groups, ["digest", "n_bytes", "salt"], "left").drop("salt")
    return joined.withColumn("first", F.when(~F.col("first.page_id").eqNullSafe(F.col("page_id")), F.col("first")))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT) -> None:
    """Write the archives of ``pages`` (page_id, url, html) under ``path``."""
    p = with_roles(pages, min_bytes)
    uri = F.regexp_replace("url", r"[\r\n]", "%0A")
    about_page = F.col("page_id"), F.col("url"), F.col("digest")
    of = {kind: _urn(kind, *about_page) for kind in ("request", "response", "metadata")}
    host = F.coalesce(F.regexp_extract(uri, "^[a-z]+://([^/?#]*)", 1), F.lit(""))
    path_of = F.regexp_extract(uri, "^[a-z]+://[^/?#]*([^#]*)", 1)
    target = F.when(path_of.startswith("/"), path_of).otherwise(F.concat(F.lit("/"), F.coalesce(path_of, F.lit(""))))
    request = F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("first.page_id").isNotNull()
    field = lambda name, value: F.coalesce(
        F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))
    about = F.concat(field("page-id", F.col("page_id")), field("payload-length", F.col("n_bytes")),
                     field("refers-to-page", F.col("first.page_id")))
    common: list[tuple[str, Column | str]] = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    records = [
        _record([("WARC-Type", "request"), ("WARC-Record-ID", of["request"]),
                 ("WARC-Concurrent-To", of["response"]), *common,
                 ("Content-Type", "application/http;msgtype=request")], request),
        _record([("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", of["response"]),
                 ("WARC-Refers-To", F.when(revisit, _urn("response", F.col("first.page_id"), F.col("first.url"),
                                                         F.col("digest")))),
                 ("WARC-Profile", F.when(revisit, PROFILE)), *common,
                 ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
                 ("Content-Type", "application/http;msgtype=response")],
                F.concat(head, F.when(revisit, "").otherwise(F.col("html")))),
        _record([("WARC-Type", "metadata"), ("WARC-Record-ID", of["metadata"]),
                 ("WARC-Concurrent-To", of["response"]), *common,
                 ("Content-Type", "application/warc-fields")], about),
    ]
    (p.select(F.concat_ws(CRLF * 2, *records).alias("value")).write.option("lineSep", CRLF * 2)
     .option("compression", "gzip").option("maxRecordsPerFile", PAGES_PER_ARCHIVE).text(path))


# --- reading -----------------------------------------------------------------------

def parse_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an uncompressed archive."""
    at = 0
    while True:
        while archive.startswith(b"\r\n", at):
            at += 2
        if at >= len(archive):
            return
        stop = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:stop].decode("utf-8").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = stop + 4
        at = start + int(headers["content-length"])
        if at > len(archive):
            raise ValueError(f"record at byte {start} is cut short")
        yield headers, archive[start:at]


def _inflate(content: bytes) -> bytes:
    """All gzip members of a file, or the file itself if it isn't compressed."""
    out = []
    while content[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(content))
        content = z.unused_data
    return b"".join(out) + content


_FIELDS = (("type", "warc-type"), ("record_id", "warc-record-id"), ("concurrent_to", "warc-concurrent-to"),
           ("refers_to", "warc-refers-to"), ("target_uri", "warc-target-uri"), ("date", "warc-date"),
           ("payload_digest_header", "warc-payload-digest"), ("content_type", "content-type"))
_RECORD_SCHEMA = (", ".join(f"{n} string" for n, _ in _FIELDS)
                  + ", http_head string, payload_bytes long, payload_digest string, payload binary")


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for n, _ in _FIELDS] + ["http_head", "payload_bytes", "payload_digest", "payload"]
        types = [pa.string()] * (len(_FIELDS) + 1) + [pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column("content"):
                rows: list[list] = []
                for headers, block in parse_records(_inflate(content.as_py())):
                    row: list = [headers.get(k) for _, k in _FIELDS]
                    if headers.get("content-type", "").startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                    else:
                        head, payload = b"", block
                    keep = with_payload or headers["warc-type"] == "metadata"
                    rows.append([*row, head.decode("utf-8", "replace"), len(payload),
                                 hashlib.sha1(payload).hexdigest(), payload if keep else None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=names)
    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path`` (plain or gzip)."""
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read(with_payload), _RECORD_SCHEMA)


# --- transactions -----------------------------------------------------------------

def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture`` (response or revisit), ``request``, ``metadata``.

    A capture without a request or metadata has null there; of several, the
    one with the least record id is taken. Records that no capture answers to are left out.
    """
    body = F.struct(*[c for c in records.columns if c != "concurrent_to"])

    def beside(kind: str) -> DataFrame:
        return (records.filter(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("record_id"))
                .agg(F.min_by(body, "record_id").alias(kind)))

    captures = records.filter(F.col("type").isin("response", "revisit")).select("record_id", body.alias("capture"))
    return (captures.join(beside("request"), "record_id", "left").join(beside("metadata"), "record_id", "left")
            .select("record_id", "capture", "request", "metadata"))


def captures_of(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages``, read the archives back, and describe each page's capture."""
    spark = prepare(pages.sparkSession)
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    t = assemble(store(read_records(spark, path, with_payload=False), "records"))
    fields = F.decode("metadata.payload", "utf-8")
    kind = pages.schema["page_id"].dataType

    def number(name: str) -> Column:
        found = F.regexp_extract(fields, f"(?m)^{name}: (.*?)\r?$", 1)
        return F.when(found != "", found)

    revisit = F.col("capture.type") == "revisit"
    return t.select(
        number("page-id").cast(kind).alias("page_id"),
        # a revisit holds no payload: its own record names the digest, its metadata the length
        F.when(revisit, number("payload-length").cast("long")).otherwise(F.col("capture.payload_bytes"))
        .alias("payload_bytes"),
        F.when(revisit, F.substring_index("capture.payload_digest_header", ":", -1))
        .otherwise(F.col("capture.payload_digest")).alias("payload_digest"),
        F.col("capture.type").alias("record_type"), number("refers-to-page").cast(kind).alias("refers_to"))
