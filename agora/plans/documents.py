"""Queries over documents as sources hold them: files, roll calls, pages, corpora; what is embedded of them; who is chosen."""

from __future__ import annotations

import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora import schemas
from agora.functions import shapes, text
from agora.operators import clusters, counts, merge, runs, select
from agora.operators.fold import event_text
from agora.operators.folders import scratch
from agora.plans.records import query, table
from agora.plans.shaped import members
from agora.sources import crawl, files, rest, sinks, versions
from agora.streaming import folds, incremental


@query("src1_json_documents", 'SELECT CAST(c_custkey AS VARCHAR) AS "bioguideId", c_name AS name, CAST(c_nationkey AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS district FROM customer')
def src1(spark: SparkSession, d: str) -> DataFrame:
    """Files of up to a hundred members each, an array over several lines, read under an explicit schema."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("bioguideId"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("state"), F.expr("c_custkey div 100").alias("batch"))
    path = scratch(spark, "members")
    listed = c.groupBy("batch").agg(F.to_json(F.collect_list(F.struct("bioguideId", "name", "state"))).alias("value"))
    listed.select("batch", F.replace("value", F.lit("},{"), F.lit("},\n{")).alias("value")).repartition("batch").write.partitionBy("batch").text(path)
    return files.json_documents(spark, path, "bioguideId string, name string, state string, district string").select("bioguideId", "name", "state", "district")


def _archived(rows: DataFrame, name: str) -> str:
    """A folder of archives, one for each value of batch, with an entry for each row (batch, name, value)."""
    path = scratch(rows.sparkSession, name)

    def write(part: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{part['batch'].iloc[0]}.zip") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for r in part.sort_values("name").itertuples():
                z.writestr(r.name, r.value)
        return pd.DataFrame({"n": [len(part)]})

    rows.groupBy("batch").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    return path


@query("src2_zipped_json", "SELECT o_orderkey, o_orderpriority FROM orders")
def src2(spark: SparkSession, d: str) -> DataFrame:
    """Archives of a thousand orders, each an array in its first .json, after a file of another kind and before another list."""
    o = table(spark, d, "orders").withColumn("batch", F.expr("o_orderkey div 1000"))
    listed = o.groupBy("batch").agg(F.to_json(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("value"))  # a thousand at most
    kinds = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("a.txt", F.lit("[]")), ("b.json", F.col("value")), ("c.json", F.lit('[{"o_orderkey": -1}]')))))
    path = _archived(listed.select("batch", F.explode(kinds).alias("e")).select("batch", "e.name", "e.value"), "orders")
    return files.zipped_json(spark, path, "o_orderkey long, o_orderpriority string")


@query("src3_first_archive", """SELECT CAST(s_suppkey AS VARCHAR) AS member, CASE WHEN s_suppkey % 2 = 0 THEN 0 WHEN s_suppkey % 3 = 0 THEN 1 ELSE -1 END AS archive,
    CASE WHEN s_suppkey % 2 = 0 THEN 'first ' || s_name WHEN s_suppkey % 3 = 0 THEN 'second ' || s_name END AS value FROM supplier""")
def src3(spark: SparkSession, d: str) -> DataFrame:
    """Two archives that overlap: the first that has a member counts, members of neither are left to another source."""
    s = table(spark, d, "supplier").withColumn("name", F.concat(F.lit("vectors/"), F.col("s_suppkey").cast("string"), F.lit(".json")))
    held = lambda by, batch: s.where(f"s_suppkey % {by} = 0").select(F.lit(batch).alias("batch"), "name", F.concat(F.lit(f"{batch} "), "s_name").alias("value"))
    path = _archived(held(2, "first").unionByName(held(3, "second")), "members")
    return crawl.first_archive(spark, [f"{path}/first.zip", f"{path}/second.zip"], s.select(F.col("s_suppkey").alias("member")))


@query("src4_member_files", "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'M' || c_custkey END AS member, CASE c_custkey % 3 WHEN 0 THEN 'voting' WHEN 1 THEN 'public' END AS source FROM customer")
def src4(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("out/M"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "_voting_issue_profile.json").when(F.col("c_custkey") % 3 == 1, "_issue_profile.json").otherwise(".txt"))
    found = table(spark, d, "customer").select("c_custkey", text.stance_file(name).alias("x"))
    return found.select("c_custkey", "x.member", "x.source")


LISTED = "SELECT CASE s_suppkey % 2 WHEN 0 THEN 'mem://even' ELSE 'mem://odd' END AS url, s_suppkey, s_name FROM supplier"


def _recorded(spark: SparkSession, d: str) -> tuple[str, str]:
    """A folder of answers: two lists of suppliers in pages of twenty, each naming the next; and the lists' starts."""
    s = table(spark, d, "supplier").withColumn("list", F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd"))
    # Twenty follow each other in a list of every other key.
    s = s.withColumn("page", F.expr("(s_suppkey - s_suppkey % 2) div 40"))
    at = lambda page: F.concat(F.lit("mem://"), F.col("list"), F.when(page > 0, F.concat(F.lit("?page="), page.cast("string"))).otherwise(""))
    found = s.groupBy("list", "page").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("items"))  # twenty at most
    last = F.col("page") == F.max("page").over(Window.partitionBy("list"))
    answer = F.to_json(F.struct("items", F.struct(F.when(~last, at(F.col("page") + 1)).alias("next")).alias("pagination")))
    path = scratch(spark, "answers")
    # A file for each page: few bytes, but much to write for one task.
    found.select(F.sha1(at(F.col("page"))).alias("key"), answer.alias("value")).repartition(spark.sparkContext.defaultParallelism, "key").write.partitionBy("key").text(path)
    return path, "mem://even mem://odd"


def _lists(spark: SparkSession, d: str, reader) -> DataFrame:
    path, urls = _recorded(spark, d)
    spark.dataSource.register(rest.RestLists)
    return reader.format("rest_lists").options(client="agora.sources.rest:folder_client", pages=path, urls=urls).load()


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select("url", F.from_json("item", "s_suppkey long, s_name string").alias("i")).select("url", "i.*")


@query("src5_rest_lists", LISTED)
def src5(spark: SparkSession, d: str) -> DataFrame:
    return _listed(_lists(spark, d, spark.read))


@query("src5_streamed_lists", LISTED)
def src5_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The lists as a stream that stops after a page or more of each, and goes on from its checkpoint."""
    rows, path, at = _lists(spark, d, spark.readStream), scratch(spark, "items"), scratch(spark, "offsets")
    write = lambda: rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", at).trigger(processingTime="0 seconds").start()
    q = write()
    while q.isActive and not (q.lastProgress and q.lastProgress["numInputRows"]):
        q.awaitTermination(0.1)
    q.stop()
    q = write()
    q.processAllAvailable()
    q.stop()
    return _listed(spark.read.schema(rows.schema).parquet(path))


@query("src8_master_list", "SELECT s_suppkey AS bill_id, s_name AS number FROM supplier WHERE s_suppkey % 4 <> 3")
def src8(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    bill = F.struct(F.when(F.col("s_suppkey") % 4 != 3, F.col("s_suppkey")).alias("bill_id"), F.col("s_name").alias("number"))
    payload = F.to_json(F.struct(F.lit("OK").alias("status"), F.struct(F.struct(F.lit("2025").alias("name")).alias("session"), bill.alias("0")).alias("masterlist")))
    return s.select(F.explode(crawl.master_bills(payload)).alias("b")).select("b.bill_id", "b.number")


@query("src9_roll_calls", """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 < 2 THEN 'S' || l_suppkey END AS name, CASE l_suppkey % 3 WHEN 0 THEN 'A' || l_suppkey END AS house_id, CASE l_suppkey % 3 WHEN 1 THEN 'L' || l_suppkey END AS senate_id,
    CASE WHEN l_suppkey % 3 < 2 THEN l_returnflag END AS vote FROM lineitem""")
def src9(spark: SparkSession, d: str) -> DataFrame:
    """By the host of the source: House XML with attributes, Senate XML with elements, nothing for other hosts."""
    key, vote = F.col("l_suppkey").cast("string"), F.col("l_returnflag")
    house = F.concat(F.lit('<rollcall-vote><vote-data><recorded-vote><legislator name-id="A'), key, F.lit('" party="D" state="CA">S'), key, F.lit("</legislator><vote>"), vote, F.lit("</vote></recorded-vote><recorded-vote><vote>x</vote></recorded-vote></vote-data></rollcall-vote>"))
    senate = F.concat(F.lit("<roll_call_vote><members><member><member_full>S"), key, F.lit("</member_full><party>R</party><state>TX</state><vote_cast>"), vote, F.lit("</vote_cast><lis_member_id>L"), key, F.lit("</lis_member_id></member></members></roll_call_vote>"))
    kind = F.col("l_suppkey") % 3
    url = F.when(kind == 0, "https://clerk.house.gov/x").when(kind == 1, "https://www.senate.gov/y").otherwise("https://example.org")
    v = files.roll_call(url, F.when(kind == 1, senate).otherwise(house))
    m = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.get(v, F.lit(0)).alias("m"))
    return m.select("l_orderkey", "l_linenumber", "m.name", F.col("m.bioguideId").alias("house_id"), F.col("m.lisMemberId").alias("senate_id"), F.col("m.voteCast").alias("vote"))


@query("src12_release_links", """SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '<a href="(/[^"/?#]+)"', 1))) AS BIGINT) AS links, 'https://h.gov/list?page=' || page_id AS next FROM pages""")
def src12(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of pages as links to releases, with others that are none: a deeper path, a query, a link tag, another host."""
    others = '<link href="/media/press-releases/css"><a href="/media/press-releases/a/b"></a><a href="/media/press-releases/a?x=1"></a><a href="https://x.org/media/press-releases/a"></a><a rel="nofollow NEXT" href="?page='
    html = F.concat(F.replace("html", F.lit('<a href="/'), F.lit('<a href="/media/press-releases/')), F.lit(others), F.col("page_id").cast("string"), F.lit('">'))
    found = table(spark, d, "pages").select("page_id", files.listing(F.lit("https://h.gov/list"), html).alias("l"))
    return found.select("page_id", F.size("l.links").cast("long").alias("links"), F.col("l.next").alias("next"))


#: Pages that one task parses.
PARSED = 50_000


@query("src13_release_details", """SELECT p_partkey, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'February 5, 2026' END AS date, '2026-02-05T10:00:00Z' AS published, '<p>' || p_type || '</p><div>' || p_brand || '</div>' AS html, p_type || ' ' || p_brand AS body FROM part""")
def src13(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("p_size") % 2 == 0, " February 5,\n2026 ").otherwise("Share")
    html = F.concat(
        F.lit('<meta name="x" property="article:published_time" content=" 2026-02-05T10:00:00Z"><h1>'), F.replace("p_name", F.lit(" "), F.lit("\n  ")), F.lit('</h1><div class="col-auto">'), day, F.lit('</div><div class="col-auto">March 1, 2020</div>'),
        F.lit('<div class="b evo-press-release__body">\n<p>'), F.col("p_type"), F.lit("</p> <!-- no --> <div>"), F.col("p_brand"), F.lit("</div>\n</div><div>after</div>"),
    )
    # Rows are short and lie in few row groups: they are dealt out before Python reads them.
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_type", "p_brand")
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, rows.count() // PARSED + 1))
    p = rows.select("p_partkey", files.release_details(F.lit("u"), html).alias("r"))
    return p.select("p_partkey", "r.title", "r.date", F.col("r.publishedTime").alias("published"), F.col("r.bodyHtml").alias("html"), F.col("r.bodyText").alias("body"))


@query("src15_member_list", "SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS \"bioguideId\" FROM customer WHERE c_custkey % 5 > 1")
def src15(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "list")
    line = F.concat(F.when(F.col("c_custkey") % 5 == 0, "# ").otherwise("  "), "c_name", F.when(F.col("c_custkey") % 5 == 1, "").otherwise(F.concat(F.lit(" ("), F.col("c_custkey").cast("string"), F.lit(") "))))
    table(spark, d, "customer").select(line.alias("value")).write.text(path)
    return files.member_list(spark, path)


@query("src16_first_source", "SELECT c_custkey AS member, CASE WHEN c_custkey % 2 = 0 THEN 'a' WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'c' END AS source FROM customer")
def src16(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("member"))
    parts = [c.where("member % 2 = 0").withColumn("source", F.lit("a")), c.where("member % 3 = 0").withColumn("source", F.lit("b")), c.withColumn("source", F.lit("c"))]
    return files.first_source(parts, "member", "source")


@query("src16_payload_shapes", "SELECT p_partkey, CAST(CASE WHEN p_size % 4 = 3 THEN 0 ELSE 1 END AS BIGINT) AS releases, CASE WHEN p_size % 4 <> 3 THEN p_name END AS title FROM part")
def src16_shapes(spark: SparkSession, d: str) -> DataFrame:
    one = F.to_json(F.array(F.struct(F.col("p_name").alias("title"))))
    raw = F.when(F.col("p_size") % 4 == 0, one).when(F.col("p_size") % 4 == 1, F.concat(F.lit('{"pressReleases": '), one, F.lit("}"))).when(F.col("p_size") % 4 == 2, F.concat(F.lit('{"releases": '), one, F.lit("}"))).otherwise('{"x": 1}')
    r = table(spark, d, "part").select("p_partkey", crawl.payload_releases(raw).alias("r"))
    return r.select("p_partkey", F.size("r").cast("long").alias("releases"), F.get("r", F.lit(0))["title"].alias("title"))


@query("src17_read_through", "SELECT o_custkey AS c_custkey, CASE WHEN o_custkey % 2 = 0 THEN 'cached' ELSE 'fetch' END AS what FROM (SELECT DISTINCT o_custkey FROM orders)")
def src17(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    hit, miss = files.read_through(wanted, table(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey"), "c_custkey")
    return hit.withColumn("what", F.lit("cached")).unionByName(miss.withColumn("what", F.lit("fetch")))


@query("src19_corpus_releases", """SELECT 'M' || s_nationkey AS member, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS BIGINT) AS position, s_name AS title FROM supplier WHERE s_nationkey % 5 <> 0""")
def src19(spark: SparkSession, d: str) -> DataFrame:
    """A corpus in one document: members by id, each with releases; those whose status is error go, and so do entries without a member."""
    per = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.struct(x["s_name"].alias("title"))).alias("pressReleases"))
    member = F.struct(F.when(F.col("s_nationkey") % 5 == 0, "error").otherwise("ok").alias("status"), "pressReleases")
    entries = per.select(F.concat(F.lit("M"), F.col("s_nationkey").cast("string")).alias("k"), member.alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("membersByBioguideId"))
    path = scratch(spark, "corpus")
    entries.write.json(path)
    return files.release_corpus(spark, path).select(F.col("bioguideId").alias("member"), F.col("position").cast("long").alias("position"), "title")


@query("snk3_file_per_key", "SELECT p_brand AS topic, count(*) AS n, min(p_size) AS least FROM part GROUP BY p_brand")
def snk3(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "topics")
    files.write_by_key(table(spark, d, "part").select(F.col("p_brand").alias("topic"), "p_size", "p_partkey"), path, "topic", "p_size")
    back = spark.read.schema("p_size int, p_partkey long, topic string").json(path)
    return back.groupBy("topic").agg(F.count("*").alias("n"), F.min("p_size").alias("least"))


@query("snk5_vector_upsert", "SELECT CAST(vec_id AS VARCHAR) AS key, CASE WHEN label >= 6 THEN 'new' ELSE 'old' END AS model FROM embeddings WHERE label < 8 OR vec_id % 2 = 0")
def snk5(spark: SparkSession, d: str) -> DataFrame:
    """Half of one label's vectors are new, those of two others replace what is stored; what is loaded twice is there once."""
    e = table(spark, d, "embeddings")
    rows = lambda df, model: sinks.vector_rows(df, ["vec_id"], "embedding", model, F.struct("label"))
    fresh = rows(e.where("label in (6, 7) or label >= 8 and vec_id % 2 = 0"), "new")
    return sinks.upserted(sinks.upserted(rows(e.where("label < 8"), "old"), fresh), fresh.union(fresh)).select("key", "model")


@query("snk5_committed_upsert", "SELECT CAST(vec_id AS VARCHAR) AS key, CASE WHEN label >= 6 THEN 'new' ELSE 'old' END AS model FROM embeddings WHERE label < 8 OR vec_id % 2 = 0")
def snk5_files(spark: SparkSession, d: str) -> DataFrame:
    """The same through files that a manifest names: what is stored, an upsert, and that upsert again."""
    e, path = table(spark, d, "embeddings"), scratch(spark, "collection")
    rows = lambda df, model: sinks.vector_rows(df, ["vec_id"], "embedding", model, F.struct("label"))
    fresh = rows(e.where("label in (6, 7) or label >= 8 and vec_id % 2 = 0"), "new")
    for part in (rows(e.where("label < 8"), "old"), fresh, fresh):
        sinks.upsert_files(spark, path, part)
    return versions.read(spark, path, "key string, model string")


@query("snk7_collection_stats", "SELECT 'bills' AS collection, count(*) AS points, 64 AS dimension FROM embeddings WHERE label < 5 UNION ALL SELECT 'releases', count(*), 64 FROM embeddings WHERE label >= 5")
def snk7(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return sinks.collection_stats({"bills": e.where("label < 5"), "releases": e.where("label >= 5")})


@query("snk10_run_envelope", """SELECT '2026-01-01T00:00:00Z' AS "runStartedAtUtc", 2 AS "yearsBack", '2024-01-02T00:00:00Z' AS "windowFromUtc", '2026-01-01T00:00:00Z' AS "windowToUtc", count(*) AS "fetchedBillsCount", count(*) FILTER (o_orderstatus = 'F') AS "resumedBillsCount",
    count(*) FILTER (o_orderstatus <> 'O') AS "enrichedBillsCount", count(*) - count(*) FILTER (o_orderstatus <> 'O') AS "remainingBillsCount", count(*) > count(*) FILTER (o_orderstatus <> 'O') AS "isPartial" FROM orders""")
def snk10(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return select.run_envelope(o, o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'O'"), "o_orderkey", 2, "2026-01-01T00:00:00Z", "2026-01-01T00:00:00Z")


@query("a19_run_counters", "SELECT count(DISTINCT o_custkey) AS source, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS existing, count(DISTINCT o_custkey) FILTER (o_custkey % 3 = 0) AS skipped, count(DISTINCT o_custkey) FILTER (o_custkey % 3 <> 0) AS new FROM orders")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return select.run_counters(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k")), "k")


@query("p1_vote_records", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN '119-hr-' || o_custkey END AS bill, o_orderpriority AS vote FROM orders")
def p1(spark: SparkSession, d: str) -> DataFrame:
    vote = F.struct(F.lit(1).alias("rollCall"), F.lit("").alias("date"), F.col("o_orderpriority").alias("memberVote"), F.lit("Passed").alias("result"))
    law = F.when(F.col("o_orderstatus") != "P", F.struct(F.lit(119).alias("congress"), F.lit("HR").alias("type"), F.col("o_custkey").cast("string").alias("number"), F.lit("t").alias("title")))
    r = table(spark, d, "orders").select("o_orderkey", shapes.vote_record(vote, law).alias("r"))
    return r.select("o_orderkey", F.col("r.billId").alias("bill"), "r.vote")


@query("p2_release_records", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'pr-2026-' || replace(lower(p_name[1:20]), ' ', '-') END AS id, p_name AS title, '' AS body FROM part")
def p2(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    r = F.struct(F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, "2026").alias("date"), none.alias("url"), none.alias("bodyText"))
    x = table(spark, d, "part").select("p_partkey", shapes.release_record(r).alias("r"))
    return x.select("p_partkey", "r.id", "r.title", "r.body")


@query("p4_bill_records", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS subjects, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS cosponsors FROM part")
def p4(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("name")), F.struct(F.lit("").alias("name")))
    b = F.struct(F.lit(1).alias("congress"), F.lit("hr").alias("type"), F.lit("1").alias("number"), F.lit("t").alias("title"), names.alias("subjects"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("cosponsors"))
    return table(spark, d, "part").select("p_partkey", shapes.bill_record(b).alias("b")).select("p_partkey", F.size("b.subjects").alias("subjects"), "b.cosponsors")


@query("p5_sponsors", "SELECT s_suppkey, s_name AS name, CAST(s_nationkey AS VARCHAR) AS state, s_suppkey % 2 = 1 AS committee FROM supplier")
def p5(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    raw = F.struct(F.col("s_suppkey").alias("people_id"), F.col("s_name").alias("name"), *(none.alias(c) for c in ("first_name", "middle_name", "last_name", "suffix", "party", "role", "district", "state_id")), F.col("s_nationkey").cast("string").alias("state"), F.lit(1).alias("sponsor_type_id"), F.lit(1).alias("sponsor_order"), F.when(F.col("s_suppkey") % 2 == 1, " 1 ").otherwise("no").alias("committee_sponsor"))
    x = table(spark, d, "supplier").select("s_suppkey", shapes.person(raw).alias("p"), shapes.sponsors(F.array(raw, F.when(F.col("s_suppkey") < 0, raw))).alias("s"))
    return x.select("s_suppkey", "p.name", "p.state", F.get("s", F.lit(0))["committeeSponsor"].alias("committee"))


@query("p6_state_vote_events", """SELECT l_orderkey, count(*) AS members, count(*) FILTER (l_returnflag = 'A') AS yea, count(*) FILTER (l_returnflag = 'N') AS nay, count(*) FILTER (l_returnflag = 'R') AS absent, l_orderkey % 2 = 1 AS passed FROM lineitem GROUP BY l_orderkey""")
def p6(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("l_returnflag") == "A", "Yes").when(F.col("l_returnflag") == "N", "nay").otherwise("Excused")
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(said.alias("voteText"))).alias("votes"))
    none = F.lit(None).cast("string")
    v = F.struct(F.col("l_orderkey").alias("roll_call_id"), *(none.alias(c) for c in ("date", "desc", "chamber", "yea", "nay", "nv", "absent", "total")), (F.col("l_orderkey") % 2).alias("passed"), "votes")
    x = per.select("l_orderkey", shapes.state_vote_event(v, counts.STATE).alias("e"))
    told = F.col("e.voteCountsFromMembers")
    return x.select("l_orderkey", F.col("e.members").cast("long").alias("members"), *(told[c].cast("long").alias(c) for c in ("yea", "nay", "absent")), "e.passed")


@query("p8_release_texts", "SELECT doc_id, concat_ws(chr(10) || chr(10), 'Title: ' || source, CASE WHEN text <> '' THEN 'Content: ' || text END) AS text FROM documents")
def p8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", shapes.release_text(F.col("source"), F.col("text")).alias("text"))


@query("p11_release_search_text", r"SELECT doc_id, trim(regexp_replace(lower(concat_ws(' ', source, lang, CAST(doc_id AS VARCHAR), text[1:800])), '\s+', ' ', 'g')) AS searched FROM documents")
def p11(spark: SparkSession, d: str) -> DataFrame:
    from agora.operators.search import release_text

    none = F.lit(None).cast("string")
    return table(spark, d, "documents").select("doc_id", release_text(F.col("source"), F.col("lang"), F.col("doc_id").cast("string"), none, none, F.col("text"), none).alias("searched"))


@query("p14_issue_rows", "SELECT 'M' || s_suppkey AS member, t AS topic, CASE WHEN t = 'crime' THEN 'Of ' || s_name ELSE '' END AS summary, CASE WHEN t = 'crime' THEN greatest(s_nationkey - 5, 0) ELSE 0 END AS evidence FROM supplier, (SELECT unnest(" + repr(list(schemas.TOPICS)) + ") AS t)")
def p14(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    profile = F.create_map(F.lit("crime"), F.struct(F.concat(F.lit("Of "), "s_name").alias("summary"), (F.col("s_nationkey") - 5).alias("evidence")))
    rows = select.issue_rows(s.select(F.concat(F.lit("M"), F.col("s_suppkey").cast("string")).alias("member"), F.lit("voting").alias("source"), profile.alias("profile")))
    return rows.select("member", "topic", "summary", "evidence")


@query("p16_vote_display", "SELECT s_suppkey, s_name AS name, 'Yea' AS cast FROM supplier")
def p16(spark: SparkSession, d: str) -> DataFrame:
    m = F.struct(F.col("s_name").alias("name"), F.lit("A").alias("bioguideId"), F.lit("L").alias("lisMemberId"), F.lit("D").alias("party"), F.lit("CA").alias("state"), F.lit("Yea").alias("voteCast"), F.lit("x").alias("firstName"))
    x = table(spark, d, "supplier").select("s_suppkey", shapes.vote_display(m).alias("m"))
    return x.select("s_suppkey", "m.name", F.col("m.voteCast").alias("cast"))


@query("p20_vector_rows", "SELECT vec_id AS idx, CASE WHEN vec_id % 3 = 0 THEN 'Press release ' || (vec_id + 1) ELSE 'title' END AS title, CASE WHEN vec_id % 2 = 0 THEN '-' ELSE '2026' END AS date FROM embeddings WHERE label <> 9")
def p20(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.when(F.col("vec_id") % 3 != 0, "title").alias("title"), F.lit("").alias("date"), F.when(F.col("vec_id") % 2 == 1, "2026").alias("publishedTime"), none.alias("url"), none.alias("textSource"), F.lit(None).cast("int").alias("bodyCharCount"), F.when(F.col("label") != 9, F.col("embedding")).alias("embedding"))
    return select.release_vector_rows(e).select("idx", "title", "date")


@query("p20_topic_vector_rows", "SELECT 'M' || vec_id AS member, CASE WHEN label % 2 = 0 THEN 'said' ELSE 'No summary available for gun control.' END AS title, 0 AS evidence FROM embeddings")
def p20_topics(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    e = table(spark, d, "embeddings").select(F.concat(F.lit(" m"), F.col("vec_id").cast("string")).alias("bioguideId"), F.when(F.col("label") % 2 == 0, " said ").alias("summary"), F.lit(None).cast("int").alias("evidence"), none.alias("updatedAt"), none.alias("sourceIssueFile"), none.alias("summaryHash"), "embedding")
    return select.topic_vector_rows(e, "gun_control").select(F.col("memberId").alias("member"), "title", "evidence")


@query("p22_prompts", "SELECT o_orderkey, 'Topics: a, b' || chr(10) || 'Bill: ' || o_orderpriority || chr(10) || 'Vote: Passed' || chr(10) || 'Summary: ' || o_orderstatus AS prompt, 'Topic: Gun Control' || chr(10) || 'Votes say: ' || o_orderstatus || chr(10) || 'Releases say: nothing' || chr(10) || 'Compare the two in Markdown: agreement, tension, evidence.' AS compare FROM orders")
def p22(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("<b>"), "o_orderstatus", F.lit("</b>"))
    return table(spark, d, "orders").select("o_orderkey", shapes.step_prompt(("a", "b"), F.col("o_orderpriority"), F.lit("Passed"), said).alias("prompt"), shapes.stance_prompt(F.lit("gun_control"), F.col("o_orderstatus"), F.lit("")).alias("compare"))


@query("p24_payloads", "SELECT p_partkey, p_type AS summary, 'N' AS member, 0 AS topics FROM part")
def p24(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    b = F.struct(*(none.alias(c) for c in ("billId", "congress", "type", "number", "title", "cosponsors", "url", "memberVote", "voteDate", "rollCall", "session", "result")), F.concat(F.lit("<p>"), "p_type", F.lit("</p>")).alias("summary"), F.array(F.lit("s")).alias("subjects"))
    m = F.struct(F.lit("A1").alias("bioguideId"), F.lit("N").alias("name"), F.lit("D").alias("party"), F.lit("CA").alias("state"))
    r = F.struct(*(none.alias(c) for c in ("id", "title", "date", "publishedTime", "url", "bodyText")), F.lit(None).cast("array<string>").alias("topics"), F.lit(None).cast("array<string>").alias("relatedBills"))
    x = table(spark, d, "part").select("p_partkey", shapes.bill_payload(b, m).alias("b"), shapes.release_payload(r, m).alias("r"))
    return x.select("p_partkey", "b.summary", F.col("r.memberName").alias("member"), F.size("r.topics").alias("topics"))


@query("w2_house_votes", "SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS member, l_returnflag AS vote FROM lineitem WHERE l_linestatus = 'O' AND l_suppkey % 7 <> 0")
def w2(spark: SparkSession, d: str) -> DataFrame:
    who = F.struct(F.lit("n").alias("name"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey").cast("string")).otherwise("").alias("bioguideId"), F.lit(None).cast("string").alias("lisMemberId"), F.lit("D").alias("party"), F.lit("CA").alias("state"), F.col("l_returnflag").alias("voteCast"))
    call = F.struct(F.when(F.col("l_linestatus") == "O", "House").otherwise("Senate").alias("chamber"), F.lit("2026").alias("recordedAt"), F.lit(1).alias("rollNumber"), F.array(who).alias("members"))
    rows = select.house_member_votes(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(call).alias("votes")))
    return rows.select("l_orderkey", "l_linenumber", F.col("bioguideId").alias("member"), F.col("voteCast").alias("vote"))


@query("w6_member_selection", "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_nationkey < 12 AND c_nationkey % 2 = 1 ORDER BY c_mktsegment || ', ' || c_custkey, id LIMIT 25")
def w6(spark: SparkSession, d: str) -> DataFrame:
    return select.select_members(members(spark, d).select("m.*"), True, None, 25).select(F.col("bioguideId").alias("id"))


@query("w10_member_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_mktsegment || ', ' || c_custkey), 'ing, 1')")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return select.matching_members(members(spark, d).select("m.*"), " ING,  1").select(F.col("bioguideId").cast("long").alias("c_custkey"))


@query("w12_summarised_votes", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'O') WHERE k <= 2")
def w12(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "O", "s").otherwise("").alias("summary"))
    return select.summarised(o, "o_custkey", [F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("w15_visible", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P')")
def w15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(shapes.visible(F.col("o_orderstatus"), ["O", "P"])).select("o_orderkey")


@query("w16_biggest_file", "SELECT s_nationkey AS member, max(s_suppkey) AS path FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1")
def w16(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "supplier").select(F.col("s_nationkey").alias("member"), F.col("s_suppkey").alias("path"), F.lit(3).alias("embeddingCount"), F.col("s_suppkey").alias("mtimeNs"), F.when(F.col("s_suppkey") % 2 == 0, "even").alias("sourceFolder"))
    return select.biggest_file(f, "member", "even").select("member", "path")


@query("w19_member_lookup", "SELECT c_custkey FROM customer WHERE c_custkey IN (3, 5, 8)")
def w19(spark: SparkSession, d: str) -> DataFrame:
    return select.only_members(table(spark, d, "customer"), [3, 5, 8], "c_custkey").select("c_custkey")


@query("j6_first_in_any_case", "SELECT o_orderkey, coalesce(f.n, 'Unknown') AS name FROM orders LEFT JOIN (SELECT c_custkey % 100 AS k, arg_min(c_name, c_custkey) AS n FROM customer WHERE c_custkey % 100 < 60 GROUP BY 1) AS f ON o_custkey % 100 = f.k")
def j6(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c, case: F.concat(F.lit(case), (F.col(c) % 100).cast("string")).alias("id")
    right = table(spark, d, "customer").where("c_custkey % 100 < 60").select(key("c_custkey", " m"), F.col("c_name").alias("name"), "c_custkey")
    return merge.with_first(table(spark, d, "orders").select("o_orderkey", key("o_custkey", "M")), right, "id", [F.col("c_custkey")], {"name": "Unknown"}).select("o_orderkey", "name")


@query("f3_summaries", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'a' ELSE o_orderstatus END AS last, '<i>a</i>' AS first FROM orders")
def f3(spark: SparkSession, d: str) -> DataFrame:
    s = F.array(F.struct(F.lit("").alias("text")), F.struct(F.lit("<i>a</i>").alias("text")), F.struct(F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("<p>"), "o_orderstatus", F.lit("</p> "))).alias("text")))
    return table(spark, d, "orders").select("o_orderkey", text.last_summary(s).alias("last"), text.first_summary(s).alias("first"))


@query("f7_artifacts", "SELECT p_partkey, p_name || chr(8217) || 's' AS fixed, p_name || ' x' AS blank FROM part")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.repair_artifacts(F.concat("p_name", F.lit("â€™s"))).alias("fixed"), text.repair_artifacts(F.concat("p_name", F.lit(" x"))).alias("blank"))


@query("f8_mojibake", "SELECT p_partkey, p_name || chr(233) AS kept, p_name || chr(8212) AS fixed FROM part")
def f8(spark: SparkSession, d: str) -> DataFrame:
    from agora.functions.fuzzy import repair_mojibake

    return table(spark, d, "part").select("p_partkey", repair_mojibake(F.concat("p_name", F.lit("é"))).alias("kept"), repair_mojibake(F.concat("p_name", F.lit("â€”"))).alias("fixed"))


@query("f12_dates", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'February 5, 2026' END AS long, CASE WHEN o_orderstatus = 'O' THEN 'February 5, 2026' WHEN o_orderstatus = 'F' THEN '' ELSE 'x' END AS known FROM orders")
def f12(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderstatus") == "O", " February 5, 2026 ").when(F.col("o_orderstatus") == "F", " 0000-00-00").otherwise("x ")
    return table(spark, d, "orders").select("o_orderkey", text.long_date(raw).alias("long"), text.known_date(raw).alias("known"))


@query("f18_at_least_zero", "SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_custkey % 4 = 0 THEN 0 ELSE CAST(floor(c_acctbal) AS BIGINT) END AS n FROM customer")
def f18(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 4 == 0, "none").otherwise(F.concat(F.lit(" "), F.floor("c_acctbal").cast("string")))
    return table(spark, d, "customer").select("c_custkey", text.at_least_zero(raw).alias("n"))


@query("f23_proposers", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'Unknown' END AS proposers FROM customer")
def f23(spark: SparkSession, d: str) -> DataFrame:
    raw = F.array(F.lit(" "), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_mktsegment")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(text.proposer_values(raw), ",").alias("proposers"))


@query("f30_fenced_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def f30(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nbye"))).when(kind == 1, F.concat(F.lit("```"), "props", F.lit("```"))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.get_json_object(text.fenced_json(raw), "$.k").alias("k"))


@query("f31_legacy_profiles", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'was' END AS summary, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS evidence FROM events")
def f31(spark: SparkSession, d: str) -> DataFrame:
    now = F.to_json(F.struct(F.struct(F.col("event_type").alias("summary"), F.lit(2).alias("evidence")).alias("crime")))
    x = table(spark, d, "events").select("event_id", shapes.legacy_profile(F.when(F.col("event_id") % 2 == 0, now).otherwise('{"crime": "was"}'))["crime"].alias("x"))
    return x.select("event_id", "x.summary", "x.evidence")


@query("f32_answers", "SELECT event_id, event_type AS answer FROM events")
def f32(spark: SparkSession, d: str) -> DataFrame:
    whole = F.to_json(F.struct(F.col("event_type").alias("output_text")))
    parts = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.substring("event_type", 1, 2).alias("text")), F.struct(F.expr("substring(event_type, 3)").alias("text"))).alias("content"))).alias("output")))
    return table(spark, d, "events").select("event_id", text.response_text(F.when(F.col("event_id") % 2 == 0, whole).otherwise(parts)).alias("answer"))


@query("f39_terms", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 3 THEN 0 ELSE 1 END AS terms FROM supplier")
def f39(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("s_suppkey") % 4
    raw = F.when(kind == 0, '[{"chamber": "House"}]').when(kind == 1, '{"item": [{"chamber": "House"}]}').when(kind == 2, '{"chamber": "House"}').otherwise("7")
    return table(spark, d, "supplier").select("s_suppkey", F.size(shapes.terms_of(raw)).alias("terms"))


FOLD = "coalesce(sum(CASE WHEN list_contains(string_split_regex(lower(trim(text)), '\\s+'), 'the') THEN 1 ELSE 0 END), 0)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("member"), F.col("turn").alias("position"), F.col("text").alias("body"))


@query("st4_resumed_fold", f"SELECT conv_id AS member, CAST({FOLD} AS BIGINT) AS evidence, count(*) AS next_index, true AS final FROM conversations GROUP BY conv_id")
def st4(spark: SparkSession, d: str) -> DataFrame:
    """Folds that an interrupt ends after two documents, with a state for each, are taken up where they stopped."""
    docs = _turns(spark, d)
    half = runs.last_states(runs.fold_states(docs, ["the"], 1, stop_after=2))
    whole = runs.last_states(runs.fold_states(docs, ["the"], 3, states=half))
    return whole.select("member", F.col("profile")["the"].cast("long").alias("evidence"), "next_index", "final")


@query("st4_streamed_fold", f"SELECT conv_id AS member, CAST({FOLD} AS BIGINT) AS evidence, count(*) AS next_index, true AS final FROM conversations GROUP BY conv_id")
def st4_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The fold as keyed state of a stream: one run takes the files of odd places, a second, from the checkpoint, the others."""
    one = folds.session(spark)
    w = Window.partitionBy("member").orderBy("position")
    docs = _turns(one, d).withColumns({"total": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "position": (F.row_number().over(w) - 1).cast("long")})
    path, out, at = (scratch(one, name) for name in ("turns", "states", "offsets"))
    shape = "member long, position long, body string, total long"
    for odd in (1, 0):
        docs.where(F.col("position") % 2 == odd).write.mode("append").parquet(path)
        folds.keep(folds.states(incremental.read_files(one, path, shape), ["the"], every=3), out, at).awaitTermination()
    return runs.last_states(folds.kept(spark, out)).select("member", F.col("profile")["the"].cast("long").alias("evidence"), "next_index", "final")


@query("st5_run_status", "SELECT conv_id AS member, count(*) AS releases, CASE WHEN conv_id % 5 = 0 THEN 'completed' WHEN count(*) > 6 THEN 'over_limit' WHEN count(*) > 4 THEN 'failed' ELSE 'done' END AS status FROM conversations GROUP BY conv_id")
def st5(spark: SparkSession, d: str) -> DataFrame:
    docs = _turns(spark, d)
    states = runs.fold_states(docs, ["the"], 10, stop_after=4)
    return runs.run_status(docs.withColumn("body", F.concat("body", F.lit(" x"))), docs.where("member % 5 = 0"), states, 6)


@query("st6_append_new", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def st6(spark: SparkSession, d: str) -> DataFrame:
    """A stream of files run twice: the first of each key is appended once."""
    path, at = scratch(spark, "appended"), scratch(spark, "offsets")
    shape = "o_orderkey long, o_custkey long"
    source = scratch(spark, "orders")
    table(spark, d, "orders").select("o_orderkey", "o_custkey").write.parquet(source)
    for _ in range(2):
        incremental.append_new(incremental.read_files(spark, source, shape), path, "o_custkey", "o_orderkey", at).awaitTermination()
    return spark.read.schema(shape).parquet(path)


@query("st8_resume_window", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'other' ELSE 'both' END AS left_in FROM orders")
def st8(spark: SparkSession, d: str) -> DataFrame:
    """What is left to fetch: all of it if the window changed, else what was not fetched before."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    done = o.where("o_orderstatus = 'F'")
    same, other = (incremental.resume_window(done, o, "o_orderkey", x) for x in (True, False))
    return other.join(same.select("o_orderkey", F.lit("both").alias("b")), "o_orderkey", "left").select("o_orderkey", F.coalesce("b", F.lit("other")).alias("left_in"))


@query("st9_streamed_answers", "SELECT event_id, event_type AS answer FROM events")
def st9(spark: SparkSession, d: str) -> DataFrame:
    """Answers in events: deltas with and without "data:", comments, broken lines, and whole answers, which beat deltas."""
    delta = F.concat(F.lit(': hi\n\ndata: {"delta": "'), F.substring("event_type", 1, 2), F.lit('"}\n{"choices": [{"delta": {"content": "'), F.expr("substring(event_type, 3)"), F.lit('"}}]}\n{broken\ndata: [DONE]'))
    whole = F.concat(F.lit('data: {"delta": "no"}\ndata: {"response": {"output": [{"content": [{"text": "'), "event_type", F.lit('"}]}]}}'))

    @F.pandas_udf("string")
    def read(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: event_text(x.split("\n")))

    return table(spark, d, "events").select("event_id", read(F.when(F.col("event_id") % 2 == 0, delta).otherwise(whole)).alias("answer"))


@query("v13_vector_guard", "SELECT 64 AS dimension, 'vectors of several sources: a, b' AS warning")
def v13(spark: SparkSession, d: str) -> DataFrame:
    dim, said = clusters.guard(table(spark, d, "embeddings").withColumn("folder", F.when(F.col("label") < 5, "a").otherwise("b")), "folder")
    return spark.createDataFrame([(dim, said[0])], "dimension int, warning string")


@query("v7_fuzzy_labels")
def v7(spark: SparkSession, d: str) -> DataFrame:
    rows, fit = clusters.fuzzy_labels(table(spark, d, "embeddings"), m=1.3)
    return rows.select("vec_id", "cluster", F.round("confidence", 5).alias("confidence"), "top3").withColumn("k", F.lit(fit["k"])).withColumn("collapsed", F.lit(bool(fit["collapsed"])))


@query("v9_kmeans_labels")
def v9(spark: SparkSession, d: str) -> DataFrame:
    rows, fit = clusters.kmeans_labels(table(spark, d, "embeddings"))
    return rows.withColumn("k", F.lit(fit["k"]))


@query("v11_graph_labels")
def v11(spark: SparkSession, d: str) -> DataFrame:
    return clusters.graph_labels(table(spark, d, "embeddings"), 5, "percentile", 90.0)
