import time

import pytest

from agora.operators import runs
from agora.plans import documents, records  # noqa: F401  fills records.QUERIES
from agora.streaming import folds, incremental

SHAPE = "member long, position long, body string, total long"


@pytest.fixture(scope="module")
def one(spark):
    return folds.session(spark)


def turns(members=4, n=11):
    return [(m, i, None if i == 3 else "the tax" if (i + m) % 3 else "of", n) for m in range(members) for i in range(n)]


def told(df):
    return sorted((r.member, tuple(sorted(r.profile.items())), r.next_index, r.total, r.final) for r in runs.last_states(df).collect())


def test_query_equals_sql_and_the_batch_fold(same):
    same(records.QUERIES["st4_streamed_fold"], records.SQL["st4_streamed_fold"])
    assert records.SQL["st4_streamed_fold"] == records.SQL["st4_resumed_fold"]


def test_stopped_run_goes_on(spark, one, tmp_path):
    """A query that is stopped between its files, in no order and with repeats, gives the states of a batch fold."""
    rows = turns()
    for i in range(5):
        one.createDataFrame([*rows[i::5], *rows[i : i + 3]], SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: one.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    place = str(tmp_path / "out"), str(tmp_path / "at")
    q = folds.keep(folds.states(source(), ["the", "tax"], every=4), *place, processingTime="0 seconds")
    until = time.time() + 120
    while not (q.lastProgress and q.lastProgress["batchId"] >= 1) and time.time() < until:
        time.sleep(0.1)
    q.stop()
    folds.keep(folds.states(source(), ["the", "tax"], every=4), *place).awaitTermination(240)
    got = folds.kept(spark, place[0])
    batch = runs.fold_states(spark.createDataFrame([r[:3] for r in rows], "member long, position long, body string"), ["the", "tax"], 4)
    assert told(got) == told(batch)
    assert {r.next_index for r in got.where("member = 0").collect()} == {4, 8, 11}


def test_states_go_out_after_some_seconds(spark, one, tmp_path):
    one.createDataFrame([r for r in turns(2) if r[1] < 2], SHAPE).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = folds.keep(folds.states(incremental.read_files(one, str(tmp_path / "in"), SHAPE), ["the"], every=20, seconds=0.2), str(tmp_path / "out"), str(tmp_path / "at"), processingTime="1 second")
    until = time.time() + 120
    got = []
    while len(got) < 2 and time.time() < until:
        time.sleep(1)
        if (tmp_path / "out").exists():
            got = folds.kept(spark, str(tmp_path / "out")).collect()
    q.stop()
    assert sorted((r.member, r.next_index, r.total, r.final) for r in got) == [(0, 2, 11, False), (1, 2, 11, False)]


def test_earlier_states_are_taken_up_if_the_total_is_unchanged(spark, one, tmp_path):
    rows = turns(2, 6)
    one.createDataFrame(rows, SHAPE).write.parquet(str(tmp_path / "in"))
    before = one.createDataFrame([(0, {"the": 40}, 5, 6), (1, {"the": 40}, 5, 7)], "member long, profile map<string,int>, next_index long, total long")
    folds.keep(folds.states(incremental.read_files(one, str(tmp_path / "in"), SHAPE), ["the"], before=before), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(240)
    got = {r.member: (r.profile["the"], r.next_index, r.final) for r in folds.kept(spark, str(tmp_path / "out")).collect()}
    fresh = sum(1 for m, i, b, _ in rows if m == 1 and b and "the" in b)
    assert got == {0: (40 + ("the" in rows[5][2]), 6, True), 1: (fresh, 6, True)}
