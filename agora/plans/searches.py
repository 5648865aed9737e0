"""Queries that search, rank and analyse vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions import text
from agora.functions.fuzzy import subset_match
from agora.operators import clusters, counts, fuzzy_index, models, search, vectors
from agora.operators.folders import scratch, written
from agora.plans.records import query, table

#: Fixed query vectors come from the row of this id.
ASKED = 0
COSINE = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"


def asked(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where(F.col("vec_id") == ASKED).first()["embedding"]


@query("topk_cosine_filtered", f"SELECT e.vec_id, {COSINE} AS score FROM embeddings AS e, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS q WHERE label = 3 AND vec_id <> 0 AND {COSINE} >= 0 ORDER BY score DESC, vec_id LIMIT 10")
def topk_cosine_filtered(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k(table(spark, d, "embeddings"), asked(spark, d), 10, "vec_id", "embedding", 0.0, (F.col("label") == 3) & (F.col("vec_id") != ASKED))


@query("topk_cosine", f"SELECT e.vec_id, {COSINE} AS score FROM embeddings AS e, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS q ORDER BY score DESC, vec_id LIMIT 10")
def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k(table(spark, d, "embeddings"), asked(spark, d), 10, "vec_id", "embedding", None)


@query("sr7_search_union", f"""WITH s AS (SELECT e.vec_id, label, {COSINE} AS score FROM embeddings AS e, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS q WHERE {COSINE} >= 0),
    a AS (SELECT vec_id, score, 'bills' AS kind FROM s WHERE label < 5 ORDER BY score DESC, vec_id LIMIT 10), b AS (SELECT vec_id, score, 'releases' AS kind FROM s WHERE label >= 5 ORDER BY score DESC, vec_id LIMIT 5)
    SELECT *, count(*) OVER () AS total FROM (FROM a UNION ALL FROM b)""")
def sr7(spark: SparkSession, d: str) -> DataFrame:
    e, q = table(spark, d, "embeddings"), asked(spark, d)
    return search.combined({"bills": vectors.top_k(e, q, 10, "vec_id", "embedding", 0.0, F.col("label") < 5), "releases": vectors.top_k(e, q, 5, "vec_id", "embedding", 0.0, F.col("label") >= 5)})


K = 5
KNN = f"""WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x) AS e FROM embeddings),
    p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance FROM v AS a, v AS b WHERE a.vec_id <> b.vec_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM p QUALIFY rank <= {K})"""


@query("j13_knn_all_pairs", KNN + " SELECT src, dst, rank, distance FROM n")
def j13(spark: SparkSession, d: str) -> DataFrame:
    return vectors.neighbours(table(spark, d, "embeddings"), K)


@query("j14_knn_mutual_edges", KNN + " SELECT a.src AS a, a.dst AS b FROM n AS a JOIN n AS b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def j14(spark: SparkSession, d: str) -> DataFrame:
    return vectors.neighbour_edges(vectors.neighbours(table(spark, d, "embeddings"), K), mutual=True)


@query("a23_knn_quantile", KNN + " SELECT round(quantile_cont(distance, 0.9), 5) AS quantile FROM n")
def a23(spark: SparkSession, d: str) -> DataFrame:
    from agora.operators.counts import quantile

    return quantile(vectors.neighbours(table(spark, d, "embeddings"), K), "distance", 0.9).withColumn("quantile", F.round("quantile", 5))


@query("v10_knn_components")
def v10(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    edges = vectors.neighbour_edges(vectors.neighbours(e, K), mutual=True)
    return vectors.cluster_labels(vectors.components(e.select(F.col("vec_id").alias("id")), edges), 3)


CENTRES = [[1.0 if j % 2 == k else 0.0 for j in range(64)] for k in range(2)]
_D = [f"list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), {c}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))" for c in CENTRES]


@query("v4_fcm_membership", f"SELECT vec_id, round((1 / a) / (1 / a + 1 / b), 6) AS first, CASE WHEN a <= b THEN 0 ELSE 1 END AS cluster FROM (SELECT vec_id, {_D[0]} AS a, {_D[1]} AS b FROM embeddings)")
def v4(spark: SparkSession, d: str) -> DataFrame:
    u = vectors.membership_rows(table(spark, d, "embeddings"), CENTRES)
    return u.select("vec_id", F.round(F.col("memberships")[0], 6).alias("first"), F.when(F.col("memberships")[0] >= F.col("memberships")[1], 0).otherwise(1).alias("cluster"))


@query("v5_xie_beni", f"SELECT round(sum(power((1 / a) / (1 / a + 1 / b), 2) * a + power((1 / b) / (1 / a + 1 / b), 2) * b) / count(*) / 64, 6) AS xie_beni FROM (SELECT {_D[0]} AS a, {_D[1]} AS b FROM embeddings)")
def v5(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(vectors.xie_beni(table(spark, d, "embeddings"), CENTRES), 6),)], "xie_beni double")


@query("v3_fcm_fit")
def v3(spark: SparkSession, d: str) -> DataFrame:
    _, scores = vectors.fuzzy_c_means(table(spark, d, "embeddings"), 4, m=1.3)
    return spark.createDataFrame([(k, float(v)) for k, v in scores.items()], "score string, value double")


@query("v8_kmeans_scan")
def v8(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    rows = vectors.kmeans_scan(e, list(range(2, min(30, max(3, int(e.count() ** 0.5) + 8)) + 1)))
    return spark.createDataFrame([tuple(float(x) for x in r.values()) for r in rows], "k double, silhouette double, calinski_harabasz double, davies_bouldin double")


@query("v1_pca_project")
def v1(spark: SparkSession, d: str) -> DataFrame:
    return vectors.project(table(spark, d, "embeddings")).select("vec_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("v12_uncertainty_grid")
def v12(spark: SparkSession, d: str) -> DataFrame:
    """The plane of a fuzzy fit, of whose four clusters the last is hidden."""
    e, visible = table(spark, d, "embeddings"), [0, 1, 2]
    at, (labels, _) = vectors.project(e), clusters.fuzzy_labels(e, 4, m=1.3)
    seen = at.join(labels.where(F.col("cluster").isin(visible)).select("vec_id"), "vec_id")
    return vectors.uncertainty_grid(seen, vectors.projected_centres(at, labels, visible, 1.3), m=1.3)


@query("set6_stacked_vectors", "SELECT CASE WHEN label < 5 THEN 'bills' ELSE 'releases' END AS block, count(*) AS n FROM embeddings GROUP BY 1")
def set6(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return counts.sizes(vectors.stacked({"bills": e.where("label < 5"), "releases": e.where("label >= 5")}), ["block"])


@query("sr4_members", "SELECT doc_id FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS w FROM documents WHERE doc_id % 3 = 0 AND lang = 'en') WHERE list_contains(w, 'the')")
def sr4_members(spark: SparkSession, d: str) -> DataFrame:
    """Documents as profiles of members, every third a Democrat's; a query of one word scores 100 where a text has it."""
    rows = searched(spark, d).withColumn("party", F.when(F.col("doc_id") % 3 == 0, "Democratic").otherwise("Republican"))
    return search.search_members(rows, "the", "Democrat", "en").where("score = 100").select("doc_id")


@query("f34_unit_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 4) AS norm, 1.0 AS unit FROM embeddings")
def f34(spark: SparkSession, d: str) -> DataFrame:
    u = vectors.unit(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"), F.round(vectors.dot(u, u), 6).alias("unit"))


#: A table of so many rows or fewer may lie in one row group, and so in one task: it is dealt out before Python reads it.
SPREAD = 1_000_000


def searched(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    if docs.count() <= SPREAD:
        docs = docs.repartition(spark.sparkContext.defaultParallelism)
    return docs.select("doc_id", F.col("doc_id").alias("position"), F.col("source").alias("member"), F.col("lang").alias("state"), text.normalize("text").alias("search_text"), "text")


QUERY = "the of"


@query("sr1_fuzzy_subset", "SELECT doc_id FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS w FROM documents) WHERE list_contains(w, 'the') AND list_contains(w, 'of')")
def sr1_subset(spark: SparkSession, d: str) -> DataFrame:
    return searched(spark, d).where(subset_match(F.col("search_text"), QUERY)).select("doc_id")


@query("sr1_fuzzy_filter")
def sr1(spark: SparkSession, d: str) -> DataFrame:
    return search.fuzzy_filter(searched(spark, d).select("doc_id", "position", "search_text"), "thnt the ering", "search_text", "position").select("doc_id", F.round("score", 6).alias("score"))


@query("sr1_indexed_filter")
def sr1_indexed(spark: SparkSession, d: str) -> DataFrame:
    """sr1_fuzzy_filter through the token index."""
    # Written, as the index and the search read it three times.
    rows = written(searched(spark, d).select("doc_id", "position", "search_text"), scratch(spark, "searched"))
    index = fuzzy_index.build(rows, "doc_id", "search_text", scratch(spark, "tokens"))
    found = fuzzy_index.search(rows, index, "thnt the ering", "search_text").select("doc_id", "position", "score")
    # Written before it is sorted, as a sort reads its rows twice.
    return written(found, scratch(spark, "found")).orderBy(F.desc("score"), "position").select("doc_id", F.round("score", 6).alias("score"))


@query("sr2_release_search")
def sr2(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    searched_text = search.release_text(F.col("member"), none, F.col("doc_id").cast("string"), none, none, F.col("text"), none)
    rows = searched(spark, d).withColumns({"party": F.lit("Independent"), "time": F.timestamp_seconds("doc_id"), "search_text": searched_text})
    return search.search_releases(rows, "thnt the ering", party="Third party", state="en").select("doc_id", F.round("score", 6).alias("score"))


@query("sr4_stance_preview")
def sr4(spark: SparkSession, d: str) -> DataFrame:
    return search.search_stances(searched(spark, d), "thnt the ering", F.col("position"), 60).select("doc_id", F.round("score", 6).alias("score"))


@query("sr8_text_neighbours")
def sr8(spark: SparkSession, d: str) -> DataFrame:
    e = search.HashingEmbedder(64)
    rows = search.embed(table(spark, d, "documents").select("doc_id", "text"), "text", e)
    first = table(spark, d, "benchmark").orderBy("item_id").first()["text"]
    return search.semantic(rows, first, e, 10, "doc_id")


@query("u1_text_embeddings")
def u1(spark: SparkSession, d: str) -> DataFrame:
    """All documents through the batched path; its first way can't be made, the second is a stand-in."""
    out = models.embed_batches(table(spark, d, "documents").select("doc_id", "text"), "text", [_absent, models.stand_in], "waves-32")
    return out.select("doc_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"), "model")


def _absent():
    raise RuntimeError("no accelerator here")


@query("d20_contradictions", """WITH s AS (SELECT o_custkey AS member, o_orderpriority AS topic, o_orderkey AS statement_id, CASE WHEN o_orderstatus = 'O' THEN 'supports' ELSE 'opposes' END AS stance FROM orders),
    v AS (SELECT o_custkey AS member, o_orderpriority AS topic, o_orderkey AS bill_id, CASE WHEN o_totalprice > 200000 THEN 'supports' ELSE 'opposes' END AS direction FROM orders)
    SELECT statement_id, bill_id, 'weak' AS severity FROM s JOIN v USING (member, topic) WHERE stance <> direction""")
def d20(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("member"), F.col("o_orderpriority").alias("topic"), "o_orderkey", "o_orderstatus", "o_totalprice")
    s = o.select("member", "topic", F.col("o_orderkey").alias("statement_id"), F.when(F.col("o_orderstatus") == "O", "supports").otherwise("opposes").alias("stance"))
    v = o.select("member", "topic", F.col("o_orderkey").alias("bill_id"), F.when(F.col("o_totalprice") > 200000, "Aye").otherwise("No").alias("vote"))
    return search.contradictions(s, v).select("statement_id", "bill_id", "severity")
