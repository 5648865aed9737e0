"""Queries over text, keys and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions import fuzzy, keys, shapes, text
from agora.plans.records import query, table


@query("f1_strip_html", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\\s\\x0B\\x85\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS plain FROM pages")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.strip_html("html").alias("plain"))


@query("f2_tags_to_spaces", "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS plain FROM pages")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.tags_to_spaces("html").alias("plain"))


@query("f5_normalize_text", "SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS plain FROM documents")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.normalize("text").alias("plain"))


@query("f9_squeeze_html", "SELECT page_id, regexp_replace(regexp_replace(html, '^\\s+|\\s+$', '', 'g'), '>\\s+<', '><', 'g') AS html FROM pages")
def f9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.squeeze_html("html").alias("html"))


@query("f10_unescape")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha1(fuzzy.unescape_html(text.tags_to_spaces("html"))).alias("plain_sha1"))


@query("f11_page_title", "SELECT page_id, CASE WHEN regexp_matches(html, '<title>([^<]*)</title>') THEN trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) END AS title FROM pages")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.first_match("html", "<title>([^<]*)</title>").alias("title"))


@query("f13_date_parse", "SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS t FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 3")
def f13(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format(day, "MMMM d, yyyy")).when(k == 1, F.date_format(day, "d-MMM-yyyy")).when(k == 2, F.date_format(day, "yyyy-MM-dd")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", text.release_time(F.lit(" "), raw).cast("timestamp_ntz").alias("t"))


@query("f16_parse_bill_id", "SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey AS congress, 'HR' || l_returnflag AS type, CAST(l_linenumber AS VARCHAR) AS number FROM lineitem")
def f16(spark: SparkSession, d: str) -> DataFrame:
    key = keys.bill_key(F.col("l_orderkey"), F.concat(F.lit(" Hr"), "l_returnflag"), F.col("l_linenumber"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", keys.parse_bill_key(key).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("p.congress").cast("long").alias("congress"), "p.type", "p.number")


@query("f17_lenient_int", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, 7 AS bad FROM events")
def f17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.to_int(F.get_json_object("props", "$.k"), -1).alias("k"), text.to_int(F.lit("12.7"), 7).alias("bad"))


@query("f19_truncate", "SELECT doc_id, CASE WHEN length(text) > 240 THEN text[1:240] || '...' ELSE text END AS short FROM documents")
def f19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.truncated("text", 240).alias("short"))


@query("f20_outcome_labels", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') THEN 'Passed' ELSE 'Unknown' END AS outcome, CASE o_orderstatus WHEN 'O' THEN 'Not Passed' WHEN 'F' THEN 'Passed' ELSE 'Unknown' END AS strict FROM orders")
def f20(spark: SparkSession, d: str) -> DataFrame:
    r = F.when(F.col("o_orderstatus") == "O", "Not Passed").when(F.col("o_orderstatus") == "F", "Motion agreed to").otherwise("-")
    return table(spark, d, "orders").select("o_orderkey", text.vote_outcome(r).alias("outcome"), text.vote_outcome_strict(r).alias("strict"))


@query("f24_release_sha1", "SELECT doc_id, sha1(source || '||' || lang || '||' || doc_id) AS key FROM documents")
def f24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", keys.sha1_key(F.col("source"), F.col("lang"), F.col("doc_id")).alias("key"))


@query("f26_page_host", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages")
def f26(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.host("url").alias("host"))


@query("f28_preview", "SELECT doc_id, CASE WHEN length(text) > 280 THEN trim(regexp_replace(text, '\\s+', ' ', 'g'))[1:280] || '...' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g'))[1:280] END AS preview FROM documents")
def f28(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.preview("text").alias("preview"))


@query("p7_embedding_text", "SELECT o_orderkey, concat_ws(chr(10) || chr(10), 'Title: ' || o_orderpriority, CASE WHEN o_orderstatus <> 'O' THEN 'Summary: ' || o_orderstatus END, 'Topics: a, b', 'Vote: Yea') AS text FROM orders")
def p7(spark: SparkSession, d: str) -> DataFrame:
    summary = F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("<p>"), "o_orderstatus", F.lit("</p>")))
    return table(spark, d, "orders").select("o_orderkey", shapes.bill_text(F.col("o_orderpriority"), summary, F.array(F.lit("a"), F.lit("b")), F.lit("Yea")).alias("text"))


@query("p9_embedding_candidates", r"WITH t AS (SELECT doc_id, source, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n FROM documents) SELECT doc_id, CASE WHEN n BETWEEN 1 AND 24000 THEN 'bodyText' ELSE 'title_fallback' END AS text_source, CASE WHEN n BETWEEN 1 AND 24000 THEN n ELSE length(source) END AS n FROM t")
def p9(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", shapes.embedding_candidate(F.col("source"), F.col("text")).alias("c")).where("c is not null")
    return rows.select("doc_id", F.col("c.textSource").alias("text_source"), F.char_length("c.text").cast("long").alias("n"))


@query("p17_topic_labels", "SELECT p_partkey, 'Part ' || upper(p_type[1]) || lower(p_type[2:]) AS label FROM part WHERE NOT contains(p_type, ' ')")
def p17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(~F.contains("p_type", F.lit(" "))).select("p_partkey", text.topic_name(F.concat(F.lit("part_"), "p_type")).alias("label"))


@query("p23_last_name_slug", "SELECT c_custkey, nullif(regexp_replace(lower(split_part(c_mktsegment || ', x', ',', 1)), '[^a-z]', '', 'g'), '') AS slug FROM customer")
def p23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", text.last_name_slug(F.concat("c_mktsegment", F.lit(", x"))).alias("slug"))


@query("json_prop", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_prop(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
