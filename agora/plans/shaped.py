"""Queries over reshaped records: members, bills, topics, labels, orders by source, filters on nested terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions import shapes, text
from agora.operators import counts, order, search, select, vectors
from agora.plans.records import issues, query, table


def members(spark: SparkSession, d: str) -> DataFrame:
    """Customers as members: a name of two parts, a party by segment, one term."""
    c = table(spark, d, "customer")
    party = F.when(F.col("c_mktsegment") == "BUILDING", "Republican").when(F.col("c_mktsegment") == "MACHINERY", "Democratic").otherwise("Independent")
    term = F.struct(F.when(F.col("c_nationkey") < 12, "House of Representatives").otherwise("Senate").alias("chamber"), F.when(F.col("c_nationkey") % 2 == 0, F.lit(2020)).alias("endYear"))
    return c.select(F.struct(
        F.col("c_custkey").cast("string").alias("bioguideId"), F.concat(F.col("c_mktsegment"), F.lit(", "), F.col("c_custkey").cast("string")).alias("name"), party.alias("partyName"), F.col("c_nationkey").cast("string").alias("state"),
        F.lit(None).cast("string").alias("district"), F.lit(None).cast("string").alias("imageUrl"), F.array(term).alias("terms"),
    ).alias("m"))


@query("p3_member_metadata", """SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS last, CAST(c_custkey AS VARCHAR) AS first, CASE c_mktsegment WHEN 'BUILDING' THEN 'R' WHEN 'MACHINERY' THEN 'D' ELSE 'I' END AS code,
    CASE WHEN c_nationkey < 12 THEN 'https://' || lower(c_mktsegment) || '.house.gov' ELSE '' END AS url FROM customer""")
def p3(spark: SparkSession, d: str) -> DataFrame:
    m = members(spark, d).select(shapes.member_metadata(F.col("m")).alias("x"))
    return m.select(F.col("x.bioguideId").alias("id"), F.col("x.lastName").alias("last"), F.col("x.firstName").alias("first"), F.col("x.partyCode").alias("code"), F.col("x.profileUrl").alias("url"))


@query("w5_current_house_members", "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_nationkey < 12 AND c_nationkey % 2 = 1")
def w5(spark: SparkSession, d: str) -> DataFrame:
    return members(spark, d).where(shapes.current_house_member(F.col("m.terms"))).select(F.col("m.bioguideId").alias("id"))


@query("p17_member_labels", "SELECT c_custkey || ' (' || c_mktsegment || ', -) [' || c_custkey || ']' AS label FROM customer")
def p17_members(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(shapes.member_label(F.lit(""), F.col("c_mktsegment"), F.lit(None).cast("string"), F.col("c_custkey").cast("string")).alias("label"))


@query("f38_name_match", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '#00000001') OR contains('#00000001', lower(c_name))")
def f38(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(shapes.name_match(F.col("c_name"), "#00000001")).select("c_custkey")


@query("p10_topic_candidates", """WITH l AS (SELECT source AS member, quality, toxic FROM documents JOIN labels USING (doc_id)),
    i AS (SELECT member, 'quality' AS topic, CAST(sum(quality) AS BIGINT) AS evidence FROM l GROUP BY member UNION ALL SELECT member, 'toxic', CAST(sum(toxic) AS BIGINT) FROM l GROUP BY member)
    SELECT member, topic, topic || ' of ' || member AS text, evidence FROM i WHERE topic = 'quality'""")
def p10(spark: SparkSession, d: str) -> DataFrame:
    summary = F.when(F.col("topic") == "quality", F.concat("topic", F.lit(" of "), "member"))
    rows = issues(spark, d).select("member", shapes.topic_candidate(F.col("topic"), summary, F.col("evidence")).alias("c")).where("c is not null")
    return rows.select("member", "c.topic", "c.text", "c.evidence")


@query("p12_bill_search_text", "SELECT l_orderkey, trim(lower(string_agg(l_returnflag || ' ' || l_linestatus, ' ' ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice))) AS searched FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k <= 5 GROUP BY 1")
def p12(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    vote = F.struct(F.col("l_returnflag").alias("question"), F.col("l_linestatus").alias("result"), F.lit(None).cast("string").alias("chamber"))
    b = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), vote.alias("v")))).alias("x"))
    none = F.array().cast("array<struct<text: string>>")
    return b.select("l_orderkey", shapes.bill_search_text(F.lit(None).cast("string"), F.lit(None).cast("string"), none, F.transform("x", lambda r: r["v"])).alias("searched"))


@query("p18_hover_numbers", "SELECT c_custkey, printf('%.3f', c_acctbal) AS shown FROM customer")
def p18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", shapes.number_or_dash(F.col("c_acctbal")).alias("shown"))


@query("p21_styles", "SELECT s_suppkey, ['circle', 'square', 'cross'][1 + (s_suppkey % 3)] AS symbol, round((s_suppkey * 137.508) % 360, 3) AS hue FROM supplier")
def p21(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", shapes.style(F.col("s_suppkey"), ("circle", "square", "cross")).alias("x"))
    return s.select("s_suppkey", "x.symbol", F.round("x.hue", 3).alias("hue"))


@query("p19_top_memberships", "SELECT vec_id, CASE WHEN a <= b THEN printf('C0:%.3f, C1:%.3f', b / (a + b), a / (a + b)) ELSE printf('C1:%.3f, C0:%.3f', a / (a + b), b / (a + b)) END AS top FROM (SELECT vec_id, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: power(x - 0.1, 2))) AS a, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: power(x + 0.1, 2))) AS b FROM embeddings)")
def p19(spark: SparkSession, d: str) -> DataFrame:
    return vectors.membership_rows(table(spark, d, "embeddings"), [[0.1] * 64, [-0.1] * 64]).select("vec_id", vectors.top_memberships(F.col("memberships")).alias("top"))


@query("o3_release_order", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def o3(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("t"))
    return order.page(rows, order.release_order(F.col("t"), F.col("o_orderkey"), True), 1, 20).select("o_orderkey")


@query("o10_source_order", "SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY CASE source WHEN 'src9' THEN 0 WHEN 'src2' THEN 1 ELSE 2 END, source LIMIT 5")
def o10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source").distinct().orderBy(*order.source_order(F.col("source"), ("src9", "src2"))).limit(5)


@query("w4_amendments", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'")
def w4(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "P", "hamdt").otherwise("HR")
    return table(spark, d, "orders").where(~shapes.is_amendment(kind)).select("o_orderkey")


@query("w11_usable_text", "SELECT source, bool_or(length(trim(text)) > 300) AS usable FROM documents GROUP BY source")
def w11(spark: SparkSession, d: str) -> DataFrame:
    long = F.when(F.char_length(F.trim("text")) > 300, F.col("text")).otherwise(" ")
    return table(spark, d, "documents").select("source", long.alias("t")).groupBy("source").agg(F.coalesce(F.bool_or(text.text_or_empty("t") != ""), F.lit(False)).alias("usable"))


@query("w14_uncertain_points", "SELECT vec_id FROM (SELECT vec_id, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: power(x - 0.1, 2))) AS a, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: power(x + 0.1, 2))) AS b FROM embeddings) WHERE 1 - greatest(a, b) / (a + b) >= 0.45")
def w14(spark: SparkSession, d: str) -> DataFrame:
    u = vectors.membership_rows(table(spark, d, "embeddings"), [[0.1] * 64, [-0.1] * 64])
    return select.uncertain(u.withColumn("uncertainty", 1 - F.array_max("memberships")), 0.45).select("vec_id")


@query("a14_cluster_sizes", "SELECT label, vec_id % 7 AS member, count(*) AS n FROM embeddings GROUP BY ALL")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return counts.sizes(table(spark, d, "embeddings"), ["label", (F.col("vec_id") % 7).alias("member")])


@query("a17_versioned_bills", "SELECT count(*) FILTER (n > 1) AS versioned, count(*) AS bills FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return counts.versioned(table(spark, d, "lineitem"), "l_orderkey")


@query("a24_mean_pool", "SELECT label, p, round(sum(v) FILTER (vec_id % 3 <> 0) / greatest(count(*) FILTER (vec_id % 3 <> 0), 1e-9), 5) AS mean FROM (SELECT label, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(64)) AS p FROM embeddings) GROUP BY ALL")
def a24(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 3 != 0).alias("mask"), F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "v"))
    return counts.mean_pool(e, ["label"], "p", "v", "mask").select("label", F.col("p").cast("long").alias("p"), F.round("mean", 5).alias("mean"))


@query("sr3_bill_search")
def sr3(spark: SparkSession, d: str) -> DataFrame:
    rows = p12(spark, d).select("l_orderkey", F.col("l_orderkey").alias("position"), F.col("searched").alias("search_text"), F.array(F.lit("R")).alias("parties"))
    return search.search_bills(rows, [F.col("position")], "a f r", party="R").select("l_orderkey", F.round("score", 6).alias("score"))


@query("v6_fcm_scan")
def v6(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors.fcm_scan(table(spark, d, "embeddings"), m=1.3)
    return spark.createDataFrame([tuple(float(x) for x in r.values()) for r in rows], "k double, objective double, fpc double, mpc double, xie_beni double")
