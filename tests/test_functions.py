import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agora.functions import fuzzy, keys, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize(("f", "given_", "want"), [
    (text.text_or_empty, "  a b\t", "a b"), (text.text_or_empty, None, ""), (text.normalize, "  A  b\n C ", "a b c"), (text.strip_html, "<p>a  b</p>\n<i>c</i>", "a b c"), (text.strip_html, None, ""),
    (text.squeeze_html, " <a> \n <b>x</b> ", "<a><b>x</b>"), (text.repair_artifacts, "itâ€™s x", "it’s x"), (text.long_date, " February 5, 2026 ", "February 5, 2026"), (text.long_date, "2026-02-05", None),
    (text.known_date, "0000-00-00", ""), (text.to_int, " 12 ", 12), (text.to_int, "12.7", 0), (text.to_int, None, 0), (text.at_least_zero, "-4", 0),
    (text.vote_outcome, "Not Passed", "Passed"), (text.vote_outcome_strict, "Not Passed", "Not Passed"), (text.vote_outcome, "Motion Rejected", "Not Passed"), (text.vote_outcome, None, "Unknown"),
    (text.party_bucket, "Democratic", "Democrat"), (text.party_bucket, None, "Third party"), (text.party_code, "Republican", "R"), (text.party_code, None, "I"), (text.topic_name, "gun_control", "Gun Control"),
    (text.host, "https://Www.Senate.gov/x?y=1", "www.senate.gov"), (text.host, "no address", None), (text.last_name_slug, "O'Neil, Pat", "oneil"), (text.last_name_slug, "", None),
    (text.fenced_json, "x ```json\n{\"a\": 1}\n``` y", "{\"a\": 1}"), (text.fenced_json, " {} ", "{}"), (text.response_text, '{"output_text": "hi"}', "hi"), (text.response_text, '{"output": [{"content": [{"text": "a"}, {"text": "b"}]}]}', "ab"), (text.response_text, "junk", ""),
])
def test_text(spark, f, given_, want):
    assert one(spark, given_, f) == want


@pytest.mark.parametrize(("name", "want"), [("a/X_voting_issue_profile.json", ("X", "voting")), ("X_issue_profile.json", ("X", "public")), ("_issue_profile.json", None), ("other.json", None)])
def test_stance_file_tries_the_longer_suffix_first(spark, name, want):
    got = one(spark, name, text.stance_file)
    assert (tuple(got) if got else None) == want


def test_release_time(spark):
    rows = [("2026-02-05T10:00:00Z", None), (None, "February 5, 2026"), ("", "5-Feb-2026"), (None, "Feb 5, 2026"), ("2026-02-05T10:00:00+02:00", "x"), ("0000-00-00", "garbage"), (None, None)]
    got = spark.createDataFrame(rows, "p string, d string").select(F.date_format(text.release_time("p", "d"), "yyyy-MM-dd HH").alias("t")).collect()
    assert [r["t"] for r in got] == ["2026-02-05 10", "2026-02-05 00", "2026-02-05 00", "2026-02-05 00", "2026-02-05 08", None, None]


def test_summaries_and_proposers(spark):
    s = spark.createDataFrame([([("", ), ("<b>one</b>",), (None,), ("two ",)],), ([],), (None,)], "s array<struct<text: string>>")
    assert [tuple(r) for r in s.select(text.last_summary("s"), text.first_summary("s")).collect()] == [("two", "<b>one</b>"), ("", None), ("", None)]
    p = spark.createDataFrame([([" D ", "", None],), ([],), (None,)], "p array<string>")
    assert [r[0] for r in p.select(text.proposer_values("p")).collect()] == [["D"], ["Unknown"], ["Unknown"]]


def test_keys(spark):
    row = spark.createDataFrame([(119, " HR ", "7", None)], "c int, t string, n string, x string")
    got = row.select(keys.bill_key(F.col("c"), F.col("t"), F.col("n")).alias("a"), keys.bill_key(F.col("c"), F.col("t"), F.col("x")).alias("b"), keys.vote_key(F.col("c"), F.col("x"), F.col("n")).alias("v"), keys.release_slug(F.lit("2026-02-05"), F.lit("A Title That Is Long Indeed")).alias("s")).first()
    assert tuple(got) == ("119-hr-7", None, "119||7", "pr-2026-02-05-a-title-that-is-long")
    assert tuple(spark.sql("select '119-hr-7' k").select(keys.parse_bill_key(F.col("k"))).first()[0]) == (119, "HR", "7")
    assert spark.sql("select 'x-hr' k").select(keys.parse_bill_key(F.col("k"))).first()[0] is None


def naive_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_lcs_against_the_table(a, b):
    assert fuzzy._lcs(a, b) == naive_lcs(a, b)


def test_token_set_ratio():
    assert fuzzy.token_set_ratio("health care act", "care") == 100.0
    assert fuzzy.token_set_ratio("", "x") == 0.0
    assert fuzzy.token_set_ratio("abcd", "abxd") == pytest.approx(75.0)
    assert fuzzy.token_set_ratio("a b", "a c") == pytest.approx(max(200 * 2 / 6, 200 * 1 / 4))


def test_mojibake_is_kept_only_if_better():
    assert fuzzy.repair_text("itâ€™s") == "it’s"
    assert fuzzy.repair_text("château") == "château" or "â" not in fuzzy.repair_text("château")
    assert fuzzy.repair_text(None) is None
