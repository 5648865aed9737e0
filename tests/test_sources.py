import json
import zipfile

from pyspark.sql import functions as F

from agora import schemas
from agora.sources import files, rest


def test_json_and_zip(spark, tmp_path):
    bill = {"congress": "119", "billType": "HR", "billNumber": "1", "title": "t", "updateDate": "2026", "summaries": [{"text": "s"}], "votes": []}
    (tmp_path / "a.json").write_text(json.dumps([bill], indent=1))
    got = files.json_documents(spark, str(tmp_path / "a.json"), schemas.BILL).first()
    assert got["billNumber"] == "1" and got["_file"] == "a.json" and got["summaries"][0]["text"] == "s"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("bills.json", json.dumps([bill, bill]))
    assert [r["congress"] for r in files.zipped_json(spark, str(tmp_path / "z.zip"), schemas.BILL).collect()] == ["119", "119"]


def test_release_corpus(spark, tmp_path):
    corpus = {"membersByBioguideId": {"A1": {"name": "N", "status": "ok", "pressReleases": [{"title": "x"}, {"title": "y"}]}, "B2": {"status": "error", "pressReleases": [{"title": "z"}]}, "C3": None}}
    (tmp_path / "c.json").write_text(json.dumps(corpus))
    assert [(r.bioguideId, r.position, r.title) for r in files.release_corpus(spark, str(tmp_path / "c.json")).collect()] == [("A1", 0, "x"), ("A1", 1, "y")]


def test_roll_calls(spark):
    house = '<rollcall-vote><vote-data><recorded-vote><legislator name-id="A1" party="D" state="CA">Ann</legislator><vote>Yea</vote></recorded-vote><recorded-vote><vote>No</vote></recorded-vote></vote-data></rollcall-vote>'
    senate = "<roll_call_vote><members><member><member_full>Bo (R-TX)</member_full><party>R</party><state>TX</state><vote_cast>Nay</vote_cast><lis_member_id>S1</lis_member_id></member></members></roll_call_vote>"
    df = spark.createDataFrame([("https://clerk.house.gov/x", house), ("https://www.senate.gov/y", senate), ("https://example.com", house), (None, None)], "url string, xml string")
    got = [[tuple(v) for v in r[0]] for r in df.select(files.roll_call(F.col("url"), F.col("xml"))).collect()]
    assert got == [[("Ann", "A1", None, "D", "CA", "Yea")], [("Bo (R-TX)", None, "S1", "R", "TX", "Nay")], [], []]


def test_html_pages(spark):
    page = '<a href="/media/press-releases/one">1</a><a href="/about">x</a><a rel="next" href="?page=2">n</a>'
    body = '<h1> Title </h1><div class="col-auto">Share</div><div class="col-auto">February 5, 2026</div><div class="evo-press-release__body"><div>First</div> second &amp; third</div><div>no</div>'
    df = spark.createDataFrame([("https://h.gov/list", page), (None, None)], "u string, h string")
    got = [r[0] for r in df.select(files.listing("u", "h")).collect()]
    assert got[0]["links"] == ["https://h.gov/media/press-releases/one"] and got[0]["next"] == "https://h.gov/list?page=2" and got[1]["links"] == []
    later = body.replace("<div class=\"col-auto\">Share</div>", "<div class=\"col-auto\"></div>")
    d = [r[0] for r in spark.createDataFrame([(body,), (later,), ("",)], "h string").select(files.release_details(F.lit("u"), F.col("h"))).collect()]
    assert [(r.title, r.date, r.bodyText) for r in d] == [("Title", None, "First second & third"), ("Title", "February 5, 2026", "First second & third"), (None, None, None)]


def test_member_list_and_priorities(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# head\n\nAnn Lee (A1)\nnobody\nBo (B2) \n")
    assert [tuple(r) for r in files.member_list(spark, str(tmp_path / "m.txt")).collect()] == [("Ann Lee", "A1"), ("Bo", "B2")]
    a, b = spark.createDataFrame([("k", 1)], "k string, v int"), spark.createDataFrame([("k", 2), ("j", 3)], "k string, v int")
    assert [tuple(r) for r in files.first_source([a, b], "k", "v").collect()] == [("j", 3), ("k", 1)]
    hit, miss = files.read_through(b, a, "k")
    assert [r.k for r in hit.collect()] == ["k"] and [r.k for r in miss.collect()] == ["j"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "topic string, n int")
    files.write_by_key(df, str(tmp_path / "o"), "topic", "n")
    assert sorted(p.name for p in (tmp_path / "o").glob("topic=*")) == ["topic=a", "topic=b"] and spark.read.json(str(tmp_path / "o")).count() == 3
    for _ in range(2):
        files.ensure_collection(spark, "vecs", 64)
    assert spark.table("vecs").count() == 0


def test_rest_lists(spark, tmp_path):
    held = {"http://x/1": {"bills": [{"n": 1}], "pagination": {"next": "http://x/2"}}, "http://x/2": {"bills": [{"n": 2}], "pagination": {"next": "http://x/1"}}, "http://y": {"bills": []}}
    (tmp_path / "r.json").write_text(json.dumps(held))
    spark.dataSource.register(rest.RestLists)
    rows = spark.read.format("rest_lists").option("urls", "http://x/1 http://y").option("items", "bills").option("recorded", str(tmp_path / "r.json")).load().collect()
    assert [json.loads(r.item)["n"] for r in rows] == [1, 2]


def test_retries():
    calls = []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise rest.Failed(503)
        return {"status": "OK", "x": 1}

    assert rest.request("u", flaky, sleep=lambda s: None)["x"] == 1 and len(calls) == 3
    for bad in (lambda u: (_ for _ in ()).throw(rest.Failed(404)), lambda u: {"status": "ERROR"}):
        try:
            rest.request("u", bad, sleep=lambda s: None)
        except rest.Failed:
            continue
        raise AssertionError
    assert rest.with_parameter("http://x/?a=1&k=2", "k", 3) == "http://x/?a=1&k=3"
