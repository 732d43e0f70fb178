"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, fixity, lm, mixing, near_dedup, packing, quality, simhash, token_counts, toxicity
from flowlens.llm.common import table


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' archive against a replica of it with known damage, as ``pages`` holds one copy only.

    In the replica, the first byte of pages whose id leaves 5 modulo 97 is wrong,
    and pages whose id leaves 7 modulo 211 are gone.
    """
    pages = table(spark, sf_dir, "pages")
    rotten = F.col("page_id") % 97 == 5
    replica = fixity.archive(pages, stored=lambda record: F.when(rotten, F.concat(F.lit("?"), F.substr(record, F.lit(2)))).otherwise(record))
    return fixity.audit(fixity.archive(pages), replica.where("page_id is null or page_id % 211 <> 7"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=1024)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), folds=7, out=2)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=85)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.similar_texts(table(spark, sf_dir, "documents"), radius=3, one_in=50)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), size=2048)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=13, one_in=20))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), seed=17, power=0.7, keep=0.8)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_merkle_fixity, op2_token_counts, op3_lm_scoring, op4_near_dedup, op5_simhash, op6_packing, op7_decontamination, op8_mixing, op9_quality, op10_toxicity)}


OP7_SQL = r"""
WITH doc_words AS (
    SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents
), item_words AS (
    SELECT item_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
    FROM item_words, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM item_windows), doc_windows AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM doc_words, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(i) WHERE len(w) >= n
), found AS (
    SELECT d.doc_id, d.i, d.n, p.item_id FROM doc_windows d JOIN item_windows p ON d.n = p.n AND d.win = p.win
), hit AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM found) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""


def _op1_sql(range_bytes: int = fixity.RANGE, fanout: int = fixity.FANOUT, levels: int = fixity.LEVELS, per_file: int = 512) -> str:
    """Both trees whole, in plain SQL: every record is compared, not only those below nodes that differ."""
    parts = [
        f"""records AS (
    SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
        || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS body FROM pages
), placed AS (
    SELECT page_id, body, page_id // {per_file} AS file_id, CAST(strlen(body) AS BIGINT) AS length,
        CAST(coalesce(sum(strlen(body)) OVER (PARTITION BY page_id // {per_file} ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM records
), leaf_a AS (SELECT file_id, "offset", length, sha256(body) AS digest FROM placed),
leaf_b AS (SELECT file_id, "offset", length, sha256(CASE WHEN page_id % 97 = 5 THEN '?' || substr(body, 2) ELSE body END) AS digest FROM placed WHERE page_id % 211 <> 7)"""
    ]
    at = lambda x: f"lpad(CAST({x} AS VARCHAR), 20, '0')"
    for side in "ab":
        item = f"{at(chr(34) + 'offset' + chr(34))} || ':' || length || ':' || digest"
        parts.append(f"{side}0 AS (SELECT file_id, \"offset\" // {range_bytes} AS node, sha256(string_agg({item}, ',' ORDER BY {item})) AS hash FROM leaf_{side} GROUP BY 1, 2)")
        item = f"{at('node')} || ':' || hash"
        for k in range(1, levels):
            parts.append(f"{side}{k} AS (SELECT file_id, node // {fanout} AS node, sha256(string_agg({item}, ',' ORDER BY {item})) AS hash FROM {side}{k - 1} GROUP BY 1, 2)")
        parts.append(f"{side}r AS (SELECT file_id, sha256(string_agg({item}, ',' ORDER BY {item})) AS hash FROM {side}{levels - 1} GROUP BY 1)")
    return f"""WITH {", ".join(parts)}
SELECT coalesce(x.file_id, y.file_id) AS file_id, CAST(NULL AS BIGINT) AS "offset", CAST(NULL AS BIGINT) AS length_a, CAST(NULL AS BIGINT) AS length_b, x.hash AS hash_a, y.hash AS hash_b,
    CASE WHEN y.hash IS NULL THEN 'missing' WHEN x.hash IS NULL THEN 'extra' WHEN x.hash = y.hash THEN 'intact' ELSE 'damaged' END AS status
FROM ar x FULL JOIN br y ON x.file_id = y.file_id
UNION ALL
SELECT coalesce(x.file_id, y.file_id), coalesce(x."offset", y."offset"), x.length, y.length, x.digest, y.digest, CASE WHEN y.digest IS NULL THEN 'missing' WHEN x.digest IS NULL THEN 'extra' ELSE 'corrupt' END
FROM leaf_a x FULL JOIN leaf_b y ON x.file_id = y.file_id AND x."offset" = y."offset" WHERE x.digest IS DISTINCT FROM y.digest
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_merkle_fixity": _op1_sql(), "op7_decontamination": OP7_SQL}
