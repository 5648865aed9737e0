"""WARC archives: captures are written as request, response and metadata records, and assembled again from the archives.

Each capture's request and metadata records name its response (or revisit) record as concurrent to them. Reading joins the
three through these identifiers into one nested row per capture. Records are written by Spark's own text sink, whose line
separator is the end of a WARC record, and so go wherever Spark can write; they are read whole by Content-Length.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.shared import bounded, cut, shared_dir, small

LEAST = 100
#: Captures in an archive at most, and about how many bytes of payload, as an archive is read whole.
PER_FILE, FILE_BYTES = 6000, 1 << 27
DATE = "2024-01-01T00:00:00Z"
NL = "\r\n"


def _id(kind: str) -> Column:
    """A record's id from the page's id, address and payload, in the form of a UUID."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "uri", "digest"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: Column, ident: Column, headers: list[tuple[str, Column]], block: Column, size: Column) -> Column:
    lines = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), ident), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in headers]  # a null header is left out
    return F.concat(F.lit("WARC/1.1" + NL), F.concat_ws(NL, *lines, F.concat(F.lit("Content-Length: "), size.cast("string"))), F.lit(NL + NL), block)


def write(pages: DataFrame, path: str) -> None:
    """Archive pages (page_id, url, html) under path. Null html counts as an empty payload, a null url as none.

    Of pages with equal payloads of LEAST bytes or more, the one with the smallest page_id keeps its payload; others become
    revisits. Repeated rows become repeated records. Line ends in a url are percent-encoded.
    """
    uri = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), uri.alias("uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    full = full.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    large = full.where(f"size >= {LEAST}").select("page_id", "uri", "digest")
    firsts = large.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uri"))).alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null").select("digest", "first")
    known = full.join(small(firsts, 4 * firsts.count()), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    known = known.withColumns({"again": again, "request": _id("request"), "capture": _id("capture"), "metadata": _id("metadata")})
    other = F.md5(F.concat_ws("|", F.lit("capture"), F.col("first.page_id").cast("string"), F.col("first.uri"), "digest"))
    refers = F.when(F.col("again"), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(other, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">")))
    target = ("WARC-Target-URI", F.nullif(F.col("uri"), F.lit("")))
    ask = F.concat(F.lit("GET "), F.coalesce(target[1], F.lit("/")), F.lit(f" HTTP/1.1{NL}{NL}"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "), F.col("size").cast("string"), F.lit(NL + NL))
    body = F.when(F.col("again"), http).otherwise(F.concat(http, F.col("html")))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(NL))
    records = F.array(
        _record(F.lit("request"), F.col("request"), [target, ("WARC-Concurrent-To", F.col("capture")), ("Content-Type", F.lit("application/http; msgtype=request"))], ask, F.octet_length(ask)),
        _record(
            F.when(F.col("again"), "revisit").otherwise("response"), F.col("capture"),
            [target, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), ("WARC-Refers-To", refers), ("WARC-Profile", F.when(F.col("again"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", F.lit("application/http; msgtype=response"))],
            body, F.octet_length(body),
        ),
        _record(F.lit("metadata"), F.col("metadata"), [target, ("WARC-Concurrent-To", F.col("capture")), ("Content-Type", F.lit("application/warc-fields"))], fields, F.octet_length(fields)),
    )
    mean = full.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    per_file = max(1, min(PER_FILE, int(FILE_BYTES / (mean + 1))))
    known.select(F.explode(records).alias("value")).write.option("lineSep", NL + NL).option("compression", "gzip").option("maxRecordsPerFile", 3 * per_file).text(path)


RECORD = "record_id string, type string, uri string, date string, concurrent_to string, refers_to string, digest string, content_type string, http_length long, payload_bytes long, payload_sha256 string, fields string, payload binary"
_HEADERS = {b"warc-record-id": 0, b"warc-type": 1, b"warc-target-uri": 2, b"warc-date": 3, b"warc-concurrent-to": 4, b"warc-refers-to": 5, b"warc-payload-digest": 6, b"content-type": 7}


def parse(data: bytes, payload: bool = True) -> Iterator[tuple]:
    """RECORD rows of one archive, plain or gzipped as a whole or by record. Damaged archives raise."""
    while data[:2] == b"\x1f\x8b":
        parts, rest = [], data
        while rest:
            z = zlib.decompressobj(31)
            parts.append(z.decompress(rest))
            if not z.eof:
                raise ValueError("the archive ends within a gzip member")
            rest = z.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if data[at : at + 5] != b"WARC/" or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        row: list = [None] * 13
        length = None
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            k, v = k.strip().lower(), v.strip().decode("utf-8", "replace")
            if k in _HEADERS:
                row[_HEADERS[k]] = v
            elif k == b"content-length":
                length = int(v)
        if length is None or end + 4 + length > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        block = data[end + 4 : end + 4 + length]
        at = end + 8 + length
        if row[1] in ("response", "revisit", "request"):
            head, _, body = block.partition(b"\r\n\r\n")
            for line in head.split(b"\r\n"):
                if line[:15].lower() == b"content-length:":
                    row[8] = int(line[15:])
            if row[1] == "response":
                row[9], row[10] = len(body), hashlib.sha256(body).hexdigest()
                row[12] = body if payload else None
        elif row[1] == "metadata":
            row[11] = block.decode("utf-8", "replace")
        yield tuple(row)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under path; payload: whether to hand the payloads on, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in map(str.split, RECORD.split(", "))])
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for row in parse(content.as_py() or b"", payload):
                    rows.append(row)
                    held += len(row[12] or b"")
                    if len(rows) >= 5000 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return bounded(spark).read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, times (how often it was written) and the structs response, request, metadata.

    Records meet by the identifier that they are concurrent to, or their own. Parts that an archive lacks are null. response
    holds revisits too, by its type. The first of repeated records stands for all of them.
    """
    key = F.coalesce("concurrent_to", "record_id")
    whole = F.struct(*(c.split()[0] for c in RECORD.split(", ")))
    one = lambda test: F.first(F.when(test, whole), ignorenulls=True)
    kind = F.col("type")
    return records.groupBy(key.alias("capture_id")).agg(
        F.count(F.when(kind.isin("response", "revisit"), 1)).alias("times"), one(kind.isin("response", "revisit")).alias("response"), one(kind == "request").alias("request"), one(kind == "metadata").alias("metadata")
    )


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages, read the archives back, and return per page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Bytes and digest of a response are those of the payload as read, of a revisit those that its headers state. Repeated rows
    come back as often as they were written. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/agora/warc-{uuid.uuid4().hex}"
    write(pages, path)
    whole = assemble(read(spark, path, payload=False)).where("response is not null")
    page = F.expr("try_cast(nullif(regexp_extract(metadata.fields, 'page-id: (-?[0-9]+)', 1), '') as long)")
    flat = whole.select(
        "capture_id", "times", page.alias("page_id"), F.coalesce("response.payload_bytes", "response.http_length").alias("payload_bytes"),
        F.coalesce("response.payload_sha256", F.substring("response.digest", 8, 64)).alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("target"),
    )
    flat = cut(flat, "captures")  # else the archives are parsed for each side of the join
    # Responses look themselves up, so that their missing targets do not meet in one task.
    responses = flat.where("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers"))
    out = flat.withColumn("target", F.coalesce("target", "capture_id")).join(responses, "target", "left")
    out = out.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("refers"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
