"""WARC archives: written from pages, read back, and assembled into one nested row per capture.

``write_warc`` gives each page a request, a response (or revisit) and a metadata record, tied by
``WARC-Concurrent-To``. Archives are gzip files in the WARC 1.1 layout, written by Spark's own text writer:
a record's closing ``CRLF CRLF`` is the writer's line separator, so any file system that Spark writes to will
do, and a lost task is simply written again. Files hold about ``FILE_BYTES`` of payload. ``read_warc`` takes one archive
file into memory at a time and streams its records by their ``Content-Length``. ``assemble`` joins request and metadata records to
the response or revisit through concurrent-to identifiers, in whichever direction they point.

Defined results: null html is the empty payload. Payloads shorter than ``min_revisit_bytes`` are always
responses. Of equal payloads the smallest page_id (null last) is the response; repeated rows of that same
page become its revisits. Null urls and page_ids survive the round trip. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise, table

#: Compressed bytes that are taken from an archive at a time.
SLICE = 1 << 20
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 6_000
FILE_BYTES = 64e6
BROADCAST_DIGESTS = 200_000

RECORD = ("record_id string, warc_type string, target_uri string, warc_date string, concurrent_to array<string>, "
          "refers_to string, payload_digest string, content_type string, block_bytes bigint, payload_bytes bigint, "
          "payload_sha256 string, fields map<string,string>, payload binary")


def _record(kind: Column | str, headers: list[Column], block: Column) -> Column:
    """One record without its closing CRLF CRLF; null headers are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = F.concat_ws(CRLF, F.concat(F.lit("WARC/1.1" + CRLF + "WARC-Type: "), kind), *headers,
                       F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(CRLF + CRLF), block)


def _header(name: str, value: Column) -> Column:
    """``name: value``, null for a null value; line breaks in a value become spaces."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\r\n]+", " "))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes ``pages`` (page_id, url, html) as gzip WARC files below ``path``.

    Only digests and ids are aggregated to find each payload's first capture, and what has copies is broadcast up to
    ``BROADCAST_DIGESTS`` digests; beyond that the payloads are shuffled to meet it. ``pages`` should be a table read,
    whose partitions are the same each time it is scanned.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"), F.monotonically_increasing_id().alias("rid"))
    base = base.withColumns({"digest": F.sha2("html", 256), "n": F.octet_length("html")})
    key = F.struct(F.col("page_id").isNull().alias("missing"), F.col("page_id").alias("page_id"), F.col("rid").alias("rid"))
    first = (base.where(F.col("n") >= min_revisit_bytes).groupBy("digest")
             .agg(F.min(key).alias("first"), F.count("*").alias("copies"))
             .where("copies > 1").select("digest", F.col("first.page_id").alias("first_page"), F.col("first.rid").alias("first_rid")))
    first = materialise(first, "digests")
    first = F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0.0
    records_per_file = int(min(RECORDS_PER_FILE, max(3, 3 * FILE_BYTES / max(mean, 1.0))))
    made = base.join(first, "digest", "left")
    revisit = F.col("first_rid").isNotNull() & (F.col("first_rid") != F.col("rid"))
    made = made.withColumn("revisit", revisit)
    part = lambda kind, rid: _uuid(F.lit(kind), F.col("digest"), F.col(rid).cast("string"))
    uri, when = _header("WARC-Target-URI", F.col("url")), _header("WARC-Date", F.lit(date))
    capture = part("response", "rid")
    hostless = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_replace(F.when(F.substring(hostless, 1, 1) == "/", hostless).otherwise(F.concat(F.lit("/"), hostless)), "[\r\n ]+", "%20")
    ask = F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1" + CRLF + "Host: "), F.regexp_replace(host, "[\r\n]+", " "), F.lit(CRLF + CRLF))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    answer = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    facts = F.concat_ws(CRLF, _header("page-id", F.col("page_id").cast("string")), _header("payload-length", F.col("n").cast("string")),
                        F.when(F.col("revisit"), _header("refers-to-page-id", F.col("first_page").cast("string"))), F.lit(""))
    records = F.array(
        _record("request", [_header("WARC-Record-ID", part("request", "rid")), uri, when, _header("WARC-Concurrent-To", capture), F.lit("Content-Type: application/http; msgtype=request")], ask),
        _record(F.when(F.col("revisit"), "revisit").otherwise("response"),
                [_header("WARC-Record-ID", capture), uri, when, _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
                 F.when(F.col("revisit"), _header("WARC-Refers-To", part("response", "first_rid"))),
                 F.when(F.col("revisit"), F.lit(f"WARC-Profile: {REVISIT_PROFILE}")), F.lit("Content-Type: application/http; msgtype=response")], answer),
        _record("metadata", [_header("WARC-Record-ID", part("metadata", "rid")), uri, when, _header("WARC-Concurrent-To", capture), F.lit("Content-Type: application/warc-fields")], facts))
    (made.select(F.explode(records).alias("value")).write.option("lineSep", CRLF + CRLF)
     .option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def _open(content: bytes):
    """A readable stream of an archive's bytes, gunzipped (any number of members) if it is gzip."""
    if content[:2] != b"\x1f\x8b":
        return io.BufferedReader(io.BytesIO(content))

    class Members(io.RawIOBase):
        """Bytes go in by slices of a megabyte, so what is left of the archive is never copied."""

        def __init__(self) -> None:
            self.at, self.rest, self.z = 0, b"", zlib.decompressobj(31)

        def more(self) -> bool:
            self.rest = content[self.at : self.at + SLICE]
            self.at += len(self.rest)
            return bool(self.rest)

        def readable(self) -> bool:
            return True

        def readinto(self, buffer) -> int:
            while True:
                if self.z.eof:
                    self.rest = self.z.unused_data.lstrip(b"\0")
                    while not self.rest:  # zeros may pad a member's end
                        if not self.more():
                            return 0
                        self.rest = self.rest.lstrip(b"\0")
                    self.z = zlib.decompressobj(31)
                elif not self.rest and not self.more():
                    # the object may still hold output
                    out = self.z.decompress(b"", len(buffer))
                    if not out:
                        raise ValueError("a gzip member of the archive is cut off")
                    buffer[: len(out)] = out
                    return len(out)
                out = self.z.decompress(self.rest, len(buffer))
                self.rest = self.z.unconsumed_tail
                if out:
                    buffer[: len(out)] = out
                    return len(out)

    return io.BufferedReader(Members(), 1 << 16)


def parse_records(content: bytes, keep_payload: bool = True):
    """Yields a dict per record of an archive's bytes, fields as in ``RECORD``."""
    stream = _open(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()).strip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(headers["content-length"][0])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record of the archive is cut off")
        get = lambda k, h=headers: h.get(k, [None])[0]
        kind, content_type = get("warc-type"), get("content-type") or ""
        payload, fields = block, []
        if content_type.startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        elif content_type.startswith("application/warc-fields"):
            fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)]
        yield {"record_id": get("warc-record-id"), "warc_type": kind, "target_uri": get("warc-target-uri"), "warc_date": get("warc-date"),
               "concurrent_to": headers.get("warc-concurrent-to", []), "refers_to": get("warc-refers-to"),
               "payload_digest": re.sub("^sha256:", "", get("warc-payload-digest") or "") or None, "content_type": content_type,
               "block_bytes": size, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
               "fields": fields, "payload": payload if keep_payload else None}


_ARROW = pa.schema([
    *[(c, pa.string()) for c in ("record_id", "warc_type", "target_uri", "warc_date")], ("concurrent_to", pa.list_(pa.string())),
    *[(c, pa.string()) for c in ("refers_to", "payload_digest", "content_type")], ("block_bytes", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_sha256", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``; without payloads (but with their sizes and digests) if asked."""

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for row in parse_records(content.as_py(), keep_payload):
                    rows.append(row)
                    size += row["payload_bytes"] if keep_payload else 0
                    if len(rows) >= 500 or size > 16e6:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, target_uri, warc_date, response, request (null if none), metadata (array).

    A capture is a response or revisit record. Others belong to it if they name it in concurrent-to, or it
    names them. Of several requests of one capture the smallest record id is kept.
    """
    inner = F.struct(*[c for c in records.columns if c not in ("target_uri", "warc_date")])
    captures = (records.where("warc_type in ('response', 'revisit')")
                .select(F.col("record_id").alias("capture_id"), "target_uri", "warc_date", inner.alias("response")))
    others = records.where("warc_type in ('request', 'metadata')").select("record_id", "warc_type", "concurrent_to", inner.alias("other"))
    named = others.select(F.explode("concurrent_to").alias("capture_id"), "warc_type", "other")
    naming = (captures.select("capture_id", F.explode("response.concurrent_to").alias("record_id"))
              .join(others, "record_id").select("capture_id", "warc_type", "other"))
    beside = (named.unionByName(naming).groupBy("capture_id")
              .agg(F.min_by(F.when(F.col("warc_type") == "request", F.col("other")), F.when(F.col("warc_type") == "request", F.col("other.record_id"))).alias("request"),
                   F.array_sort(F.collect_list(F.when(F.col("warc_type") == "metadata", F.col("other"))),
                                lambda x, y: F.when(x["record_id"] < y["record_id"], -1).when(x["record_id"] > y["record_id"], 1).otherwise(0)).alias("metadata")))
    return captures.join(beside, "capture_id", "left")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as WARC, read back and assembled; a row per page from its capture."""
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    captures = assemble(materialise(read_warc(spark, path, keep_payload=False).drop("payload"), "records"))  # parsed once
    facts = F.col("metadata")[0]["fields"]
    revisit = F.col("response.warc_type") == "revisit"
    return captures.select(
        F.try_element_at(facts, F.lit("page-id")).cast("bigint").alias("page_id"),
        F.when(revisit, F.try_element_at(facts, F.lit("payload-length")).cast("bigint")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("response.payload_digest")).otherwise(F.col("response.payload_sha256")).alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        F.try_element_at(facts, F.lit("refers-to-page-id")).cast("bigint").alias("refers_to"),
        "target_uri")


OP3_SQL = """
with p as (
  select page_id, url, octet_length(encode(coalesce(html, ''))) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
f as (select payload_digest, min(page_id) first_page from p where payload_bytes >= 100 group by payload_digest)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when f.first_page is not null and f.first_page <> p.page_id then 'revisit' else 'response' end record_type,
       case when f.first_page is not null and f.first_page <> p.page_id then f.first_page end refers_to,
       p.url target_uri
from p left join f using (payload_digest)
"""
