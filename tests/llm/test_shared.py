from pyspark.sql import functions as F

from agora.llm import lines, shared
from tests.llm.test_texts import brute_lines


def test_look_up_of_few_and_of_many_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 7 if k % 7 else None, k) for k in range(40)] + [(3, k) for k in range(100, 160)], "key int, v int")
    found = spark.createDataFrame([(3, 66, "hot"), (4, 6, "cold"), (5, 5, "cold"), (99, 1, "none")], "key int, c long, name string")
    want = {how: sorted(map(str, rows.join(found.drop("c"), "key", how).collect())) for how in ("inner", "left")}
    for limit in (1000, 3, 1):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", limit)
        for how, w in want.items():
            assert sorted(map(str, shared.look_up(rows, found, ["key"], "c", how).select("key", "v", "name").collect())) == w


def test_a_window_that_most_documents_hold(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 2)
    docs = [(k, f"a{k}\nthe one\npassage that\nall hold\nb{k}") for k in range(300)] + [(1000 + k, f"x{k % 9}\ny{k % 9}\nz{k % 9}") for k in range(40)]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    assert got == brute_lines(docs)
    assert spark.createDataFrame(docs, "doc_id long, text string").select(F.count("*")).first()[0] == len(got)
