"""The queries of this package over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm import centroids, decontaminate, licenses, lines, neardup, pieces, pii, quality, ranked, secrets, shards, simhash, warc
from agora.llm.shared import table

#: The vocabulary for op6; a parameter of the operator.
MODEL = os.environ.get("AGORA_PIECES", "file:/opt/tokenizers/piece_bpe_32k.model")


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes, components and kept rows of all documents; null and blank texts are linked with nothing, a null doc_id has no component."""
    return neardup.cluster(table(spark, sf_dir, "documents"), shingle=2, threshold=0.8)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, repeated rows and null ids each a row; null and empty texts hold none."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item; null and empty texts, on either side, and empty tables give no rows."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, read back from archives; null html is an empty payload, an empty table gives no rows."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, repeated rows and null ids each a row; null and empty texts hold none."""
    return pii.scan(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents as digests, and whether decoding gives the text again; null and empty texts have no tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(pieces.encode(docs, MODEL), MODEL)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated windows of three lines, as digests; null and empty texts have one empty line."""
    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in all documents; null and empty texts hold none, rows that share a doc_id are one document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents, a row each; null and empty texts have no words and fail."""
    return quality.assess(table(spark, sf_dir, "documents"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards; null and empty texts have 8 bytes, an empty table gives no rows."""
    return shards.assign(table(spark, sf_dir, "documents"), 24)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's ten best documents; null texts have no terms, on either side, and empty tables give no rows."""
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 clusters of all usable vectors after 3 rounds; null and malformed vectors are left out, an empty table gives no rows."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; null and blank texts have fingerprint zero, repeated rows a row each."""
    return simhash.cluster(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_neardup, op2_secret_scan, op3_decontamination, op4_warc_assembly, op5_pii_sanitisation, op6_sentencepiece, op7_line_dedup, op8_license_scan, op9_quality_rules, op10_kd_shards, op11_ranked_search, op12_centroid_clusters, op13_simhash_neardup)}

_GAP = r"[^\x20\x09-\x0D]+"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"



def _kmeans_sql(rounds: int) -> str:
    """The final centroids and assignments of whole-number k-means, a few tables for each round."""
    parts = [
        "v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS (SELECT r, unnest(e) AS x, unnest(range(64)) AS i FROM v)",
        "s AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS k FROM v QUALIFY k < 16)",
        "c0 AS (SELECT k, i, x AS c FROM s JOIN x ON x.r = s.r)",
    ]
    for t in range(rounds + 1):
        parts.append(f"d{t} AS (SELECT r, k, sum((x - c) * (x - c)) AS d FROM x JOIN c{t} ON c{t}.i = x.i GROUP BY r, k)")
        parts.append(f"a{t} AS (SELECT r, k, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if t < rounds:
            parts.append(f"m{t} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM a{t} JOIN x ON x.r = a{t}.r GROUP BY k, i)")
            parts.append(f"c{t + 1} AS (SELECT c.k, c.i, coalesce((m.s - (m.s % m.n + m.n) % m.n) // m.n, c.c) AS c FROM c{t} AS c LEFT JOIN m{t} AS m ON m.k = c.k AND m.i = c.i)")
    parts.append(f"g AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k)")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
        FROM a{rounds} AS a JOIN v ON v.r = a.r JOIN g ON g.k = a.k"""


ORACLES: dict[str, str] = {
    "op11_ranked_search": rf"""
        WITH t(kind, r, id, text) AS (SELECT 0, row_number() OVER (), doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
             w AS (SELECT kind, r, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS t FROM t),
             p AS (SELECT r, id, t, count(*) AS tf FROM w WHERE kind = 0 GROUP BY r, id, t),
             d AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY r),
             g AS (SELECT count(*) AS c, CAST(sum(n) AS BIGINT) AS l FROM d),
             f AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(c) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY t),
             s AS (SELECT q.r AS item, q.id AS item_id, p.r, p.id AS doc_id, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * c) // l)))) AS BIGINT) AS score
                   FROM w AS q JOIN p ON p.t = q.t JOIN f ON f.t = q.t JOIN d ON d.r = p.r, g WHERE q.kind = 1 GROUP BY q.r, q.id, p.r, p.id),
             k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM k WHERE rank <= 10""",
    "op12_centroid_clusters": _kmeans_sql(3),
    "op4_warc_assembly": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= {warc.LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= {warc.LEAST} AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op7_line_dedup": """
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
             x AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM s),
             w AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o AS k FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
             r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w WHERE k IS NOT NULL),
             c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, (VALUES (0), (1), (2)) AS t(j) WHERE n > 1),
             m AS (SELECT x.doc_id, x.i, x.line, c.i IS NOT NULL AS gone FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i),
             t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id)
        SELECT doc_id, n_lines, n_removed, length(text) AS n_chars, sha256(text) AS text_sha256 FROM t""",
    "op8_license_scan": f"""
        WITH t(license, text) AS (VALUES {', '.join("('" + k + "', '" + v + "')" for k, v in sorted(licenses.TEMPLATES.items()))}),
             tw AS (SELECT license, list_filter(regexp_split_to_array(lower(text), '{licenses.GAP}'), lambda x: x <> '') AS w FROM t),
             ts AS (SELECT DISTINCT license, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS h FROM tw, unnest(range(1, len(w) - 1)) AS u(i)),
             tn AS (SELECT license, count(*) AS n, CAST(power(2, ceil(log2(count(*))) + 1) AS BIGINT) AS scale FROM ts GROUP BY license),
             dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{licenses.GAP}'), lambda x: x <> '') AS w FROM documents),
             d1 AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS p FROM dw),
             d3 AS (SELECT doc_id, p, a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o AS h FROM d1 WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
             hit AS (SELECT d3.doc_id, p, ts.license, ts.h, n, scale FROM d3 JOIN ts ON d3.h = ts.h JOIN tn ON tn.license = ts.license),
             win AS (SELECT doc_id, license, h, n, p // (scale // 2) - j AS place FROM hit, (VALUES (0), (1)) AS v(j)),
             ok AS (SELECT doc_id, license FROM win GROUP BY doc_id, license, place, n HAVING count(DISTINCT h) >= {licenses.CONTAINMENT} * n),
             per AS (SELECT doc_id, count(DISTINCT license) AS c, array_to_string(list_sort(list(DISTINCT license)), ',') AS names FROM ok GROUP BY doc_id)
        SELECT d.doc_id, coalesce(c, 0) AS n_licenses, coalesce(names, '') AS licenses FROM documents AS d LEFT JOIN per ON d.doc_id = per.doc_id""",
    "op9_quality_rules": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             w AS (SELECT doc_id, unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{_GAP}') AS x FROM d)),
             l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS x FROM d)),
             a AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM l WHERE regexp_matches(line, '{_GAP}')),
             dup AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(array_to_string(regexp_extract_all(line, '{_GAP}'), ''))) AS chars_dup_lines FROM a WHERE k > 1 GROUP BY doc_id),
             n(n) AS (VALUES (3), {', '.join(f'({n})' for n in quality.LIMITS)}),
             g AS (SELECT doc_id, n, i, list(w) OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS r FROM w, n),
             h AS (SELECT doc_id, n, i, array_to_string(r[1:n], ' ') AS k FROM g WHERE len(r) >= n),
             again AS (SELECT doc_id, n, i FROM (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, k) AS c FROM h) WHERE c > 1),
             cover AS (SELECT DISTINCT doc_id, n, i + j AS i FROM again, unnest(range(n)) AS u(j)),
             rep AS (SELECT c.doc_id, count(*) FILTER (n = 3) AS n_repeat_words, {', '.join(f'sum(length(w)) FILTER (n = {n}) AS chars_rep_{n}' for n in quality.LIMITS)}
                     FROM cover AS c JOIN w ON w.doc_id = c.doc_id AND w.i = c.i GROUP BY c.doc_id),
             base AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY doc_id),
             al AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                           coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, {', '.join(f'CAST(coalesce(chars_rep_{n}, 0) AS BIGINT) AS chars_rep_{n}' for n in quality.LIMITS)}, CAST(coalesce(chars_dup_lines, 0) AS BIGINT) AS chars_dup_lines
                    FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id),
             f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM al)
        SELECT *, NOT base_failed AND 100 * chars_dup_lines <= {quality.LINE_LIMIT} * word_chars AND 100 * n_symbols <= {quality.SYMBOL_LIMIT} * n_words
               AND {' AND '.join(f'100 * chars_rep_{n} <= {most} * word_chars' for n, most in quality.LIMITS.items())} AS kept
        FROM f""",
}
