import hashlib
import random

import pytest
from pyspark.sql import functions as F

from agora.llm import licenses, lines, quality, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])


def test_quality_of_odd_rows(odd, none):
    got = {(r.doc_id, r.n_words): r for r in quality.assess(odd).collect()}
    assert quality.assess(odd).count() == odd.count() and not got[2, 0].kept and got[2, 0].base_failed and got[7, 30_000].n_repeat_words == 30_000
    assert quality.assess(none).count() == 0
    kept = quality.passing(odd)
    assert kept.columns == odd.columns and kept.count() == quality.assess(odd).where("kept").count()


def test_coverage_by_hand(spark):
    text = "\n".join(["a b c d e f g"] * 2 + [" ".join(f"w{k}" for k in range(60))])
    r = quality.assess(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_dup_lines, r.n_repeat_words, r.chars_rep_5, r.chars_dup_lines, r.kept) == (1, 14, 14, 7, True)


def brute_lines(docs):
    where = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        part = (t or "").split("\n")
        for k in range(len(part) - 2):
            where.setdefault(tuple(part[k : k + 3]), []).append((i, k))
    gone = {(i, k + j) for places in where.values() for i, k in sorted(set(places))[1:] for j in range(3)}
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone) for i, t in docs}


def test_lines_against_brute_force(spark):
    rng = random.Random(6)
    docs = [(k, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))) for k in range(120)] + [(500, None), (501, ""), (502, "a\nb")]
    df = spark.createDataFrame([(i, t, "keep", 7) for i, t in docs], "doc_id long, text string, _id string, n_lines int")
    out = lines.dedup(df)
    assert out.columns == ["doc_id", "text", "_id", "n_lines", "n_removed"] or set(out.columns) == {"doc_id", "text", "_id", "n_lines", "n_removed"}
    got, want = {r.doc_id: r.text for r in out.collect()}, brute_lines(docs)
    assert all((got[i] or "") == want[i] for i in want) and got[500] is None


def test_lines_of_odd_rows(odd, none):
    assert lines.dedup(odd).count() == odd.count() and lines.dedup(none).count() == 0
    assert sorted(r.text or "" for r in lines.dedup(odd).collect()) == sorted(r.text or "" for r in odd.collect())


def test_lines_use_no_python(spark, odd):
    for df in (lines.dedup(odd), licenses.scan(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_licenses(spark, odd, none):
    apache, mit = licenses.TEMPLATES["Apache-2.0"], licenses.TEMPLATES["MIT-grant"]
    docs = [(1, f"some words {apache.upper()}!! and more"), (2, f"{mit} plus {licenses.TEMPLATES['MIT']}"), (3, mit.replace("documentation", "other")), (4, "Licensed under another license"), (5, None), (6, ("filler text here " * 300) + apache)]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "Apache-2.0", 2: "MIT,MIT-grant", 3: "MIT-grant", 4: "", 5: "", 6: "Apache-2.0"}
    assert licenses.scan(odd).agg(F.sum("n_licenses")).first()[0] == 0 and licenses.scan(none).count() == 0
    with pytest.raises(Exception, match="too short"):
        licenses.scan(odd, {"x": "a b"}).collect()


def test_line_digest_is_of_the_text(spark, data):
    r = queries.op7_line_dedup(spark, data).where("n_removed = 0").first()
    text = spark.read.parquet(f"{data}/documents.parquet").where(F.col("doc_id") == r.doc_id).first().text
    assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
