"""Queries over records: votes, bills, members, facets and folds. Each has the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions import keys, shapes, text
from agora.operators import counts, fold, merge, order

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Events as votes.
SPELLED = {"view": "Yea", "click": "Nay", "purchase": "Present", "error": "Not Voting"}
VOTE = "CASE event_type WHEN 'view' THEN 'Yea' WHEN 'click' THEN 'Nay' WHEN 'purchase' THEN 'Present' WHEN 'error' THEN 'Not Voting' ELSE event_type END"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def votes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    spelled = F.col("event_type")
    for k, v in SPELLED.items():
        spelled = F.when(F.col("event_type") == k, v).otherwise(spelled)
    return e.select("event_id", "user_id", "ts", "value", "props", "event_type", spelled.alias("vote"))


@query("a1_vote_counts", f"""SELECT user_id, count(*) FILTER (v = 'Yea') AS yea, count(*) FILTER (v = 'Nay') AS nay, count(*) FILTER (v = 'Present') AS present,
    count(*) FILTER (v = 'Not Voting') AS "notVoting", count(*) FILTER (v NOT IN ('Yea', 'Nay', 'Present', 'Not Voting')) AS other
    FROM (SELECT user_id, {VOTE} AS v FROM events) GROUP BY user_id""")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return counts.vote_counts(votes(spark, d), ["user_id"], "vote")


@query("a2_state_vote_counts", f"""SELECT user_id, count(*) FILTER (v = 'Yea') AS yea, count(*) FILTER (v = 'Nay') AS nay, count(*) FILTER (v = 'Not Voting') AS "notVoting",
    0 AS absent, count(*) FILTER (v NOT IN ('Yea', 'Nay', 'Not Voting')) AS other FROM (SELECT user_id, {VOTE} AS v FROM events) GROUP BY user_id""")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return counts.vote_counts(votes(spark, d), ["user_id"], "vote", counts.STATE)


@query("a3_vote_summary", f"""SELECT user_id, count(*) FILTER (v = 'Yea') AS "Yea", count(*) FILTER (v = 'Nay') AS "Nay", 0 AS "Aye", 0 AS "No", count(*) FILTER (v = 'Present') AS "Present",
    count(*) FILTER (v = 'Not Voting') AS "Not_Voting", count(*) FILTER (v NOT IN ('Yea', 'Nay', 'Present', 'Not Voting')) AS "Other" FROM (SELECT user_id, {VOTE} AS v FROM events) GROUP BY user_id""")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return counts.vote_summary(votes(spark, d), ["user_id"], "vote")


@query("a4_vote_shares", f"""WITH c AS (SELECT user_id, CASE WHEN v IN ('Yea', 'Nay', 'Present') THEN lower(v) WHEN v = 'Not Voting' THEN 'notVoting' ELSE 'other' END AS bucket, count(*) AS n
    FROM (SELECT user_id, {VOTE} AS v FROM events) GROUP BY ALL) SELECT user_id, bucket, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM c""")
def a4(spark: SparkSession, d: str) -> DataFrame:
    names = [*counts.FEDERAL, "other"]
    return counts.shares(a1(spark, d), ["user_id"], names).withColumn("share", F.round("share", 6))


@query("a5_voting_profile", """SELECT l.l_suppkey AS member, count(*) AS total_votes, string_agg(CAST(l_orderkey AS VARCHAR) || ':' || l_returnflag, ',' ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey, l_extendedprice) AS votes,
    arg_min(l_linestatus, (l_orderkey, l_linenumber, l_shipdate, l_partkey, l_extendedprice)) AS first_status FROM lineitem AS l GROUP BY 1""")
def a5(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice")]
    vote = F.concat_ws(":", F.col("l_orderkey").cast("string"), "l_returnflag")
    lines = table(spark, d, "lineitem").withColumns({"member": F.col("l_suppkey"), "first_status": F.col("l_linestatus")})
    return counts.voting_profile(lines, "member", order, vote, ["first_status"]).withColumn("votes", F.array_join("votes", ","))


@query("a6_member_mode", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS k FROM c) SELECT user_id, min(event_type) AS event_type FROM r WHERE k = 1 GROUP BY 1")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return counts.mode(table(spark, d, "events"), ["user_id"], "event_type")


def bills(spark: SparkSession, d: str) -> DataFrame:
    """Lines as versions of a bill, in their total order; each version has one proposer and, but for returned goods, one vote."""
    at = F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(at))
    vote = keys.vote_key(F.col("l_orderkey"), F.col("l_linenumber"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("bill_key"), pos.alias("position"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("update_date"), F.when(F.col("l_quantity") > 10, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).otherwise("").alias("title"),
        F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("summary"), F.array(F.when(F.col("l_returnflag") == "N", "Unknown").otherwise(F.col("l_returnflag"))).alias("parties"), F.array("l_linestatus").alias("states"),
        F.when(F.col("l_returnflag") == "A", F.array().cast("array<string>")).otherwise(F.array(vote)).alias("votes"),
    )


BILLS = """WITH b AS (SELECT l_orderkey AS bill_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS position, strftime(l_shipdate, '%Y-%m-%d') AS update_date,
    CASE WHEN l_quantity > 10 THEN 'part ' || l_partkey ELSE '' END AS title, 'supplier ' || l_suppkey AS summary, CASE WHEN l_returnflag = 'N' THEN 'Unknown' ELSE l_returnflag END AS party, l_linestatus AS state,
    l_orderkey || '|' || l_linenumber AS vote, l_returnflag <> 'A' AS voted FROM lineitem)"""


@query("a7_merge_bills", BILLS + """ SELECT bill_key, arg_max(title, position) FILTER (title <> '') AS title, arg_max(summary, (update_date, -position)) AS summary, max(update_date) AS latest_update,
    coalesce(array_to_string(list_sort(list(DISTINCT party) FILTER (party <> 'Unknown')), ','), '') AS parties, array_to_string(list_sort(list(DISTINCT state)), ',') AS states, count(DISTINCT vote) AS vote_count, count(*) AS raw_votes, count(*) AS version_count
    FROM b WHERE voted GROUP BY bill_key""")
def a7(spark: SparkSession, d: str) -> DataFrame:
    m = merge.merge_bills(bills(spark, d))
    return m.withColumns({"parties": F.array_join("parties", ","), "states": F.array_join("states", ",")})


@query("a8_compact_totals", BILLS + " SELECT count(*) AS input_rows, count(*) FILTER (voted) AS voted_rows, count(*) FILTER (voted) AS raw_votes, count(DISTINCT bill_key) FILTER (voted) AS bills, count(DISTINCT vote) FILTER (voted) AS votes FROM b")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return merge.totals(bills(spark, d))


@query("a9_embedding_index", "SELECT label, count(*) AS total, 64 AS dimension FROM embeddings GROUP BY label")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return counts.embedding_index(table(spark, d, "embeddings"), "label", "embedding")


@query("a12_status_counts", "SELECT count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return counts.status_counts(table(spark, d, "orders"), "o_orderstatus", ("O", "F", "P"))


def issues(spark: SparkSession, d: str) -> DataFrame:
    """(member, topic, evidence): labels of a member's documents, in long form."""
    both = table(spark, d, "documents").select("doc_id", F.col("source").alias("member")).join(table(spark, d, "labels"), "doc_id")
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("topic"), F.col(t).cast("long").alias("n")) for t in ("quality", "toxic"))))
    return both.select("member", pairs.alias("p")).groupBy("member", "p.topic").agg(F.sum("p.n").alias("evidence"))


ISSUES = """WITH l AS (SELECT source AS member, quality, toxic FROM documents JOIN labels USING (doc_id)),
    i AS (SELECT member, 'quality' AS topic, CAST(sum(quality) AS BIGINT) AS evidence FROM l GROUP BY member UNION ALL SELECT member, 'toxic', CAST(sum(toxic) AS BIGINT) FROM l GROUP BY member)"""


@query("p14_issue_rows", ISSUES + " SELECT member, topic, evidence, upper(topic[1]) || topic[2:] AS label FROM i")
def p14(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d).withColumn("label", text.topic_name("topic"))


@query("a13_evidence_totals", ISSUES + " SELECT member, count(*) FILTER (evidence > 0) AS issues_with_evidence, CAST(sum(evidence) AS BIGINT) AS total_evidence FROM i GROUP BY member")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return counts.evidence_totals(issues(spark, d), ["member"])


@query("a22_evidence_regressions", ISSUES + " SELECT member, topic, evidence AS before, evidence - 1 AS after FROM i WHERE evidence > 5")
def a22(spark: SparkSession, d: str) -> DataFrame:
    old = issues(spark, d)
    return counts.evidence_regressions(old, old.withColumn("evidence", F.when(F.col("evidence") > 5, F.col("evidence") - 1).otherwise(F.col("evidence"))), ["member"])


@query("j11_side_by_side", ISSUES + " SELECT member, max(evidence) FILTER (topic = 'quality') AS quality_evidence, max(evidence) FILTER (topic = 'toxic') AS toxic_evidence FROM i GROUP BY member")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return merge.side_by_side(issues(spark, d), ["member"], "topic", "evidence", ("quality", "toxic"))


@query("a15_status_label", """SELECT o_custkey, CASE WHEN count(DISTINCT s) = 0 THEN 'Unknown' WHEN count(DISTINCT s) = 1 THEN min(s) ELSE 'Mixed' END AS status
    FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'Passed' WHEN 'F' THEN 'Not Passed' END AS s FROM orders) GROUP BY o_custkey""")
def a15(spark: SparkSession, d: str) -> DataFrame:
    r = F.when(F.col("o_orderstatus") == "O", "Agreed to").when(F.col("o_orderstatus") == "F", "Failed").otherwise("Pending")
    return counts.bill_status(table(spark, d, "orders").select("o_custkey", r.alias("result")), ["o_custkey"], "result")


@query("a16_facet_values", "SELECT 'o_orderstatus' AS facet, o_orderstatus AS value FROM orders UNION SELECT 'o_orderpriority', o_orderpriority FROM orders")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return counts.facet_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("a18_profile_means", "SELECT count(*) AS members, CAST(sum(n) AS BIGINT) AS votes, round(avg(n), 6) AS mean_votes FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return counts.profile_means(table(spark, d, "events"), "user_id").withColumn("mean_votes", F.round("mean_votes", 6))


@query("a20_latest_per_group", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def a20(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return counts.latest(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("a21_best_file", "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) = 1")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return counts.latest(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars"), F.col("doc_id")])


@query("j1_join_first", """SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) = 1) ON o_orderkey = l_orderkey""")
def j1(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity", "l_linenumber", "l_shipdate", "l_suppkey", "l_extendedprice")
    at = [F.col(c) for c in ("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]
    return merge.join_first(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", at).select("o_orderkey", "l_partkey", "l_quantity")


@query("j2_join_last_nested", """SELECT o_orderkey, coalesce(l_partkey, -1) AS l_partkey FROM orders LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1) ON o_orderkey = l_orderkey""")
def j2(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_extendedprice")
    at = [F.col(c) for c in ("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]
    return merge.join_last_nested(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", at, "line").select("o_orderkey", F.coalesce("line.l_partkey", F.lit(-1)).alias("l_partkey"))


@query("j3_member_votes", "SELECT o_orderkey, l_suppkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey = 7 AND o_orderstatus = 'F'")
def j3(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_suppkey = 7").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_linenumber")
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey").join(lines, "o_orderkey")


@query("j3_first_votes", """SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) = 1)
    ON o_orderkey = l_orderkey""")
def j3_first(spark: SparkSession, d: str) -> DataFrame:
    """Lines as votes, returned ones as a member's: the first in each order."""
    lines = table(spark, d, "lineitem").withColumn("o_orderkey", F.col("l_orderkey"))
    at = [F.col(c) for c in ("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]
    return merge.member_votes(table(spark, d, "orders").select("o_orderkey"), lines, ["o_orderkey"], F.col("l_returnflag") == "R", at).select("o_orderkey", "l_linenumber", "l_partkey")


@query("o6_deep_page", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey LIMIT 25 OFFSET (SELECT (count(*) * 9 // 10) // 25 * 25 FROM lineitem)")
def o6_deep(spark: SparkSession, d: str) -> DataFrame:
    """A page nine tenths down."""
    lines = table(spark, d, "lineitem")
    by = [F.desc("l_extendedprice"), *(F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"))]
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_suppkey")
    return order.page(rows, by, lines.count() * 9 // 10 // 25 + 1, 25).select("l_orderkey", "l_linenumber", "l_partkey")


@query("snk8_rewritten_documents", "SELECT o_orderkey, o_orderstatus, votes FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS votes FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def snk8(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(-1).alias("votes"), F.lit("x").alias("bills"))
    return merge.rewritten(docs, counts.sizes(table(spark, d, "lineitem"), ["l_orderkey"]).select(F.col("l_orderkey").alias("o_orderkey"), F.col("n").alias("votes")), "o_orderkey")


@query("a9_embedding_files", """WITH f AS (SELECT label, vec_id % 3 AS file, count(*) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY ALL)
    SELECT label, CAST(sum(n) AS BIGINT) AS total, 64 AS dimension, string_agg(file || ':' || n, ',' ORDER BY first_id) AS files, (SELECT 'v' || max(vec_id) FROM embeddings AS e WHERE e.label = f.label AND vec_id % 2 = 0) AS title FROM f GROUP BY label""")
def a9_files(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumns({"file": F.col("vec_id") % 3, "title": F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("v"), F.col("vec_id").cast("string"))).otherwise(" ")})
    out = counts.embedding_index(e, "label", "embedding", "file", [F.col("vec_id")], ["title"])
    return out.withColumn("files", F.array_join(F.transform("files", lambda x: F.concat_ws(":", x["file"].cast("string"), x["valid"].cast("string"))), ","))


@query("j4_member_metadata", "SELECT c_custkey, coalesce(s_name, 'Unknown') AS s_name, coalesce(s_acctbal, 0) AS s_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def j4(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "c_custkey")
    return merge.with_defaults(table(spark, d, "customer").select("c_custkey"), dim, "c_custkey", {"s_name": "Unknown", "s_acctbal": 0.0})


@query("j7_present_keys", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def j7(spark: SparkSession, d: str) -> DataFrame:
    return merge.present(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("j8_missing_keys", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j8(spark: SparkSession, d: str) -> DataFrame:
    return merge.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("j9_roll_call_people", "SELECT l_orderkey, l_linenumber, l_partkey, s_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey")
def j9(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return table(spark, d, "lineitem").join(merge.dimension(people), "l_suppkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "s_name")


@query("j10_merge_classify", """WITH a AS (SELECT doc_id, sha1(source || '||' || doc_id || '||' || trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS h FROM documents),
    b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE h END AS h FROM a WHERE doc_id % 7 <> 0 UNION ALL SELECT -doc_id - 1, h FROM a WHERE doc_id % 50 = 0)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'delete' WHEN a.h = b.h THEN 'reuse' ELSE 'embed' END AS action FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def j10(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select("doc_id", keys.sha1_key(F.col("source"), F.col("doc_id"), F.col("text")).alias("h"))
    b = a.where("doc_id % 7 <> 0").withColumn("h", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("h"))).union(a.where("doc_id % 50 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "h"))
    return merge.classify(a, b, ["doc_id"], "h")


#: Subjects in place of part types, keys in order.
MAPPING = [("Brand#11", "tax_reform"), ("1", "health_care"), ("3", "immigration"), ("Brand", "jobs")]


@query("j12_topic_subject_map", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'tax_reform' WHEN contains(lower(p_brand), 'brand#11') THEN 'tax_reform' WHEN contains(p_brand, '1') THEN 'health_care' WHEN contains(p_brand, '3') THEN 'immigration' ELSE 'jobs' END AS issue FROM part WHERE contains(p_brand, 'Brand')")
def j12(spark: SparkSession, d: str) -> DataFrame:
    return merge.subjects_to_issues(table(spark, d, "part").select("p_partkey", "p_brand"), MAPPING, "p_brand").select("p_partkey", "issue")


@query("o4_bill_sort_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def o4(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return order.page(rows, order.bill_order(F.col("o_totalprice"), F.col("o_orderkey"), True), 3, 25)


@query("o5_compact_sort_page", "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders ORDER BY CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderkey LIMIT 40")
def o5(spark: SparkSession, d: str) -> DataFrame:
    return order.page(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), order.compact_order(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderkey")), 1, 40)


@query("o6_last_page", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 30 OFFSET (SELECT greatest(0, (count(*) - 1) // 30 * 30) FROM documents)")
def o6(spark: SparkSession, d: str) -> DataFrame:
    return order.page(table(spark, d, "documents").select("doc_id"), [F.col("doc_id")], 10**6, 30)


@query("o7_first_votes", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events) WHERE rank <= 3")
def o7(spark: SparkSession, d: str) -> DataFrame:
    return order.top_per_group(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], 3).select("user_id", "event_id", "rank")


@query("o8_sample")
def o8(spark: SparkSession, d: str) -> DataFrame:
    return order.sample(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("o9_matched_first", "SELECT doc_id, row_number() OVER (ORDER BY contains(text, 'the') DESC, doc_id) AS position FROM documents")
def o9(spark: SparkSession, d: str) -> DataFrame:
    matched, rank = F.contains("text", F.lit("the")), F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", matched.alias("matched"))
    return order.positions(rows, order.matched_order(F.col("matched"), rank)).select("doc_id", "position")


@query("set1_union_total", "SELECT kind, id, count(*) OVER () AS total FROM (SELECT 'orders' AS kind, o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'parts', p_partkey FROM part WHERE p_size < 10)")
def set1(spark: SparkSession, d: str) -> DataFrame:
    from agora.operators.search import combined

    a = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return combined({"orders": a, "parts": table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("id"))})


@query("set2_difference", "SELECT DISTINCT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'error'")
def set2(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return merge.difference(e.where("event_type = 'view'"), e.where("event_type = 'error'"), "user_id")


@query("set3_union_of_sets", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT x)), ',') AS marks FROM (SELECT l_orderkey, unnest([l_returnflag, l_linestatus]) AS x FROM lineitem) GROUP BY 1")
def set3(spark: SparkSession, d: str) -> DataFrame:
    return merge.union_of_sets(table(spark, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"], "marks").withColumn("marks", F.array_join("marks", ","))


@query("set4_dedup_first", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) = 1")
def set4(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_suppkey", "l_extendedprice")
    return counts.earliest(rows, ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("set5_distinct_pairs", "SELECT DISTINCT lang, source FROM documents")
def set5(spark: SparkSession, d: str) -> DataFrame:
    return merge.pairs(table(spark, d, "documents"), "lang", "source")


@query("w1_window_lenient", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def w1(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderstatus") == "P", "0000-00-00").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").where(shapes.in_window(raw, "1995-01-01", "1996-12-31")).select("o_orderkey")


@query("w7_third_party", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def w7(spark: SparkSession, d: str) -> DataFrame:
    from agora.operators.search import party_filter

    party = F.when(F.col("c_mktsegment") == "BUILDING", "Republican Party").when(F.col("c_mktsegment") == "MACHINERY", "Democratic").otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").where(party_filter(party, "Third party")).select("c_custkey")


@query("w8_party_bucket", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Republican' WHEN 'MACHINERY' THEN 'Democrat' ELSE 'Third party' END AS bucket FROM customer")
def w8(spark: SparkSession, d: str) -> DataFrame:
    party = F.when(F.col("c_mktsegment") == "BUILDING", "The Republican  Party").when(F.col("c_mktsegment") == "MACHINERY", "Democratic").otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", text.party_bucket(party).alias("bucket"))


@query("w9_facet_filter", """SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') AND bool_or(l_linestatus = 'F')""")
def w9(spark: SparkSession, d: str) -> DataFrame:
    from agora.operators.search import facet_filter

    b = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("parties"), F.collect_set("l_linestatus").alias("states"))
    return facet_filter(b, party="R", state="F").select("l_orderkey")


@query("w10_member_substring", "SELECT c_custkey FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build')")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(F.contains(text.normalize(F.concat_ws(" ", "c_name", "c_mktsegment")), F.lit("build"))).select("c_custkey")


@query("w13_release_ceiling", "SELECT source AS member, count(*) AS releases, CASE WHEN source = 'src3' THEN 'completed' WHEN count(*) > 40 THEN 'over_limit' ELSE 'todo' END AS status FROM documents GROUP BY source")
def w13(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("member"), F.col("text").alias("body"))
    return fold.classify_candidates(docs, docs.where("member = 'src3'"), 40)


@query("st1_fold_by_member", "SELECT conv_id, turn, CAST(sum(CASE WHEN length(text) > 50 AND role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS evidence FROM conversations")
def st1(spark: SparkSession, d: str) -> DataFrame:
    return fold.running_evidence(table(spark, d, "conversations"), "conv_id", "turn", (F.char_length("text") > 50) & (F.col("role") == "user"))


TOPICS = ("the", "of", "de")


@query("st2_fold_with_model", """WITH w AS (SELECT conv_id, turn, string_split_regex(lower(trim(text)), '\\s+') AS w FROM conversations), t(topic) AS (VALUES ('the'), ('of'), ('de'))
    SELECT conv_id AS member, topic, count(*) FILTER (list_contains(w, topic)) AS evidence, count(*) AS next_index, count(*) AS total, 0 AS failed FROM w, t GROUP BY conv_id, topic""")
def st2(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "conversations").select(F.col("conv_id").alias("member"), F.col("turn").alias("position"), F.col("text").alias("body"))
    return fold.fold(docs, list(TOPICS))


@query("st7_merge_table", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE 'new' END AS origin FROM documents""")
def st7(spark: SparkSession, d: str) -> DataFrame:
    from agora.streaming.incremental import merge as merged

    a = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("h"), F.array(F.lit(1.0)).alias("embedding"))
    b = a.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("h")).otherwise("x").alias("h"), F.array(F.lit(2.0)).alias("embedding"))
    return merged(a, b, ["doc_id"], "h").select("doc_id", F.when(F.col("embedding")[0] == 2.0, "old").otherwise("new").alias("origin"))


@query("st8_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def st8(spark: SparkSession, d: str) -> DataFrame:
    from agora.streaming.incremental import windowed_counts

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed_counts(e, "ts", "event_type", "1 hour", "10 minutes")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 2)})
