"""A token index of a searched table, so that a fuzzy search reads the lists of its own words and not the texts.

Postings (token, id, words, chars) are sorted by token in each file, sizes (id, words, chars) by chars, as tasks have their rows: nothing
is shuffled, and a search prunes both by the statistics of their pages. words and chars are the distinct words of a text and their letters. Shared words and lengths bound the score of a row
(fuzzy.set_bounds, as expressions); rows that share no word can score at most by length, so that only a range of sizes is read. Only
rows whose bound reaches the cutoff meet their texts; of these a row whose words hold the query's, or the reverse, needs none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions.fuzzy import CUTOFF, token_set_score
from agora.operators.folders import bounded, written

#: Rows that may be broadcast to the table they are looked up in: 16 bytes each and a score.
BROADCAST_ROWS = 500_000


@dataclass
class TokenIndex:
    postings: DataFrame
    sizes: DataFrame
    id: str


def build(rows: DataFrame, id: str, searched: str, path: str) -> TokenIndex:
    """The index of rows under path; id names each row. Null and blank texts have no words, and are found by no query."""
    words = F.array_distinct(F.filter(F.split(F.coalesce(F.col(searched), F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    told = rows.select(F.col(id), words.alias("tokens")).where(F.size("tokens") > 0)
    told = told.select(id, "tokens", F.size("tokens").alias("words"), F.aggregate("tokens", F.lit(0), lambda n, w: n + F.char_length(w)).alias("chars"))
    postings = told.select(F.explode("tokens").alias("token"), id, "words", "chars")
    return TokenIndex(written(postings.sortWithinPartitions("token"), f"{path}/postings"), written(told.select(id, "words", "chars").sortWithinPartitions("chars"), f"{path}/sizes"), id)


def load(spark: SparkSession, id: str, path: str) -> TokenIndex:
    return TokenIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/sizes"), id)


def bounds(shared: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """fuzzy.set_bounds of columns."""
    ahead, less = F.when(shared > 0, shared + 1).otherwise(0), F.least(left, right)
    inside = (shared > 0) & (less == 0)
    least = F.when(inside, 100.0).when(shared > 0, F.lit(200.0) * shared / (2 * shared + 1 + less)).otherwise(0.0)
    return least, F.when(inside, 100.0).otherwise(F.greatest(least, F.lit(200.0) * (ahead + less) / (2 * ahead + left + right)))


def candidates(index: TokenIndex, query: str, cutoff: float = CUTOFF) -> DataFrame:
    """(id, least, most): the rows that can reach cutoff, and what lengths and shared words say of their score."""
    asked = sorted(set(query.lower().split()))
    own = len(" ".join(asked))
    shared = index.postings.where(F.col("token").isin(asked)).select(index.id, "words", "chars", F.lit(1).alias("n"), F.char_length("token").alias("s"))
    # Without a shared word at most 200 * less / (less + more): a text's joined length lies within this factor of the query's.
    reach = (200 - cutoff) / cutoff if cutoff else float("inf")
    joined = F.col("chars") + F.col("words") - 1
    alone = index.sizes.where((joined >= own / reach) & (joined <= own * reach)).select(index.id, "words", "chars", F.lit(0).alias("n"), F.lit(0).alias("s"))
    rows = shared.unionByName(alone).groupBy(index.id).agg(F.max("words").alias("words"), F.max("chars").alias("chars"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    both = F.when(F.col("n") > 0, F.col("s") + F.col("n") - 1).otherwise(0)
    rest = lambda whole: F.greatest(F.lit(0), whole - both - (F.col("n") > 0).cast("int"))
    least, most = bounds(both, rest(F.lit(own)), rest(joined))
    return rows.select(index.id, least.alias("least"), most.alias("most")).where(F.col("most") >= cutoff)


def search(rows: DataFrame, index: TokenIndex, query: str, searched: str, cutoff: float = CUTOFF) -> DataFrame:
    """rows with score, those under cutoff left out: as search.fuzzy_scores gives them. A blank query keeps all, without score."""
    q = " ".join(query.lower().split())
    if not q:
        return rows.withColumn("score", F.lit(None).cast("double"))
    bounded(rows.sparkSession)
    told = candidates(index, q, cutoff)
    told = F.broadcast(told) if told.count() <= BROADCAST_ROWS else told
    met = rows.join(told, index.id)
    known = F.col("most") <= F.col("least")
    # Rows that lengths decide send no text to Python.
    text = F.when(~known, F.col(searched))
    score = F.when(known, F.col("least")).otherwise(token_set_score(text, F.lit(q), cutoff))
    return met.withColumn("score", score).drop("least", "most").where(F.col("score") >= cutoff)
