from pyspark.sql import functions as F

from agora.functions import shapes
from agora.operators.counts import STATE

ROW = """select named_struct('bioguideId', 'A1', 'name', 'Lee, Ann', 'partyName', 'Democratic', 'state', 'CA', 'district', cast(null as string), 'imageUrl', cast(null as string),
    'terms', array(named_struct('chamber', 'House of Representatives', 'endYear', cast(null as int)))) m"""


def one(spark, sql, f):
    return spark.sql(sql).select(f.alias("y")).first()["y"]


def test_members(spark):
    got = one(spark, ROW, shapes.member_metadata(F.col("m")))
    assert (got.firstName, got.lastName, got.partyCode, got.chamber, got.profileUrl, got.district) == ("Ann", "Lee", "D", "House of Representatives", "https://lee.house.gov", "")
    assert one(spark, "select 'B2' i", shapes.unknown_member(F.col("i"))).name == "Unknown"
    assert one(spark, ROW, shapes.current_house_member(F.col("m.terms"))) is True
    assert one(spark, "select 1", shapes.member_label(F.lit(""), F.lit("D"), F.lit(None).cast("string"), F.lit("A1"))) == "A1 (D, -) [A1]"


def test_votes_and_bills(spark):
    vote = "select named_struct('rollCall', 1, 'date', 'd', 'memberVote', 'Yea', 'result', 'Passed') v, named_struct('congress', 119, 'type', 'HR', 'number', '7', 'title', 't') l, cast(null as struct<congress: int, type: string, number: string, title: string>) x"
    assert one(spark, vote, shapes.vote_record(F.col("v"), F.col("l"))).billId == "119-hr-7" and one(spark, vote, shapes.vote_record(F.col("v"), F.col("x"))).billId is None
    bill = "select named_struct('congress', 1, 'type', 'S', 'number', '2', 'title', 't', 'subjects', array(named_struct('name', 'Tax'), named_struct('name', '')), 'cosponsors', cast(null as int)) b"
    got = one(spark, bill, shapes.bill_record(F.col("b")))
    assert (got.subjects, got.cosponsors) == (["Tax"], 0)
    totals = one(spark, "select array(named_struct('voteText', 'NV'), named_struct('voteText', 'Yea'), named_struct('voteText', 'Excused'), named_struct('voteText', '?')) m", shapes.vote_totals(F.col("m"), STATE))
    assert totals.asDict() == {"yea": 1, "nay": 0, "notVoting": 1, "absent": 1, "other": 1}


def test_topics_and_search_texts(spark):
    t = lambda s, **k: one(spark, "select 1", shapes.topic_candidate(F.lit("jobs"), F.lit(s).cast("string"), F.lit(-3), **k))
    assert tuple(t(" x ")) == ("jobs", "x", 0) and t(None) is None and t("", include_empty=True).text == shapes.PLACEHOLDER
    sql = "select 'T' t, array(named_struct('text', 'S1')) s, array(named_struct('question', 'Q', 'result', 'R', 'chamber', cast(null as string))) v, map('jobs', 'More  Jobs') p"
    assert one(spark, sql, shapes.bill_search_text(F.col("t"), F.lit("1-hr-2"), F.col("s"), F.col("v"))) == "t 1-hr-2 s1 q r"
    assert "jobs more jobs principles values" in one(spark, sql, shapes.profile_search_text([F.col("t")], F.col("p")))
    assert "Profile: {\"jobs\":\"More  Jobs\"}\nTitle: T\nDate: \nText: b" == one(spark, sql, shapes.fold_prompt(F.col("p"), F.col("t"), F.lit(None).cast("string"), F.lit("b")))


def test_small_forms(spark):
    w = one(spark, "select 1", shapes.wrapped(F.lit("aaa bbb ccc ddd"), 7, 2))
    assert w == "aaa bbb<br>ccc ddd" and one(spark, "select 1", shapes.wrapped(F.lit(None).cast("string"))) == ""
    assert [one(spark, "select 1", shapes.number_or_dash(F.lit(x).cast("double"))) for x in (1.23456, None, float("nan"))] == ["1.235", "-", "-"]
    assert tuple(one(spark, "select 3 r", shapes.style(F.col("r"), ("a", "b")))) == ("b", 412.524 % 360)
    match = lambda n, a: one(spark, "select 1", shapes.name_match(F.lit(n).cast("string"), a))
    assert match("Ann Lee", "ann") and match("Lee", "Ann  Lee") and not match("Bo", "ann") and not match("", "ann") and not match(None, "x")
    assert [len(one(spark, "select 1", shapes.terms_of(F.lit(x)))) for x in ('[{"chamber": "S"}]', '{"item": [{"chamber": "S"}, {}]}', '{"chamber": "S"}', "junk")] == [1, 2, 1, 0]
    assert [one(spark, "select 1", shapes.in_window(F.lit(x).cast("string"), "2024-01-01", "2024-12-31")) for x in ("2024-05-05", "2023-05-05", "0000-00-00", None)] == [True, False, True, True]
    assert one(spark, "select 1", shapes.is_amendment(F.lit("samdt"))) and not one(spark, "select 1", shapes.is_amendment(F.lit("hr")))
    assert not one(spark, "select 1", shapes.visible(F.lit(1), [])) and one(spark, "select 1", shapes.visible(F.lit(1), [1, 2]))
