import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from agora.llm import shards, warc


def pages(spark):
    long = "<p>é</p>" * 30
    rows = [(3, "http://a/3", long), (1, "http://a/1", long), (2, None, long), (4, "u\r\nx", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (7, "u", ""), (None, "u", long), (8, "u", "WARC/1.1\r\n\r\n" + "x" * 100 + "\r\n\r\n")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string"), rows


def test_round_trip(spark):
    df, rows = pages(spark)
    got = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.round_trip(df).collect())
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and raw.startswith(b"<p>") and i != 1
        want.append((i or 0, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else 0))
    assert got == sorted(want)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_nested_captures_and_payloads(spark, tmp_path):
    df, _ = pages(spark)
    warc.write(df, str(tmp_path / "w"))
    whole = warc.assemble(warc.read(spark, str(tmp_path / "w"))).where("metadata.fields like 'page-id: 8%'").first()
    assert whole.response.payload.startswith(b"WARC/1.1") and whole.request.type == "request" and whole.request.concurrent_to == whole.response.record_id


def test_parser_takes_gzip_by_record_and_refuses_damage(spark, tmp_path):
    df, _ = pages(spark)
    warc.write(df.where("page_id = 4"), str(tmp_path / "w"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*.gz"))
    records = [r for r in raw.split(b"\r\n\r\n") if r]
    assert len(list(warc.parse(raw))) == 3 and records[0].startswith(b"WARC/1.1\r\n")
    each = gzip.compress(raw[: len(raw) // 2]) + gzip.compress(raw[len(raw) // 2 :])
    assert list(warc.parse(each)) == list(warc.parse(raw))
    for bad in (raw[:-20], raw[3:], each[:-9]):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.parse(bad))


def check_shards(df, rows, n):
    got = rows.collect()
    assert len(got) == df.count()
    for s in range(n):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None for r in got)
    return [sum(r["size"] for r in got if r.shard == s) for s in range(n)]


def test_shards_have_equal_bytes(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").unionByName(spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("the same text in a third of all rows").alias("text"), F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.lit(36).cast("long").alias("n_chars")))
    sizes = check_shards(df, shards.assign(df, 24), 24)
    largest = df.agg(F.max(F.octet_length("text"))).first()[0]
    assert max(sizes) - min(sizes) <= 2 * largest
    r = shards.assign(df, 24).where("doc_id = 5 and size > 50").first()
    text = df.where("doc_id = 5").where(F.octet_length("text") > 42).first().text
    assert r["size"] == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())


def test_shards_of_odd_rows(odd, none):
    check_shards(odd, shards.assign(odd, 3), 3)
    assert shards.assign(none, 3).count() == 0


def test_equal_rows_are_divided(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    sizes = check_shards(df, shards.assign(df, 4), 4)
    assert max(sizes) <= 1.3 * min(sizes)
