"""The queries of the corpus operators: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, html_text, language, media, near_dup, packing, secrets, substrings, toxicity, vectors
from graphloom.session import table


def tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_digests(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = language.remainder(docs["doc_id"], 5) != 0
    model = toxicity.train_toxicity_model(docs, table(spark, sf_dir, "labels"), train)
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", (language.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train_language_model(docs, language.remainder(docs["doc_id"], 4) != 2)
    out = language.predict_languages(docs, model)
    return out.select("doc_id", (language.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"), *tokenizer("byte_bpe_50k.tiktoken"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *tokenizer("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


def _span_rows() -> str:
    """One select a rule: the places of matches from the pieces around them."""
    parts = []
    for n, rule in enumerate(secrets.RULES):
        regex = rule.regex.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {n} AS k, '{rule.kind}' AS kind, {'true' if rule.base else 'false'} AS base, e - strlen_ AS s, e FROM ("
            f"SELECT doc_id, length(hit) AS strlen_, length(part) AS n_part, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM ("
            f"SELECT doc_id, unnest(range(len(hits))) AS i, unnest(hits) AS hit, unnest(parts) AS part, unnest(gaps[1:len(hits)]) AS gap FROM ("
            f"SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{regex}', 0) AS hits, regexp_extract_all(coalesce(text, ''), '{regex}', {rule.group}) AS parts, "
            f"string_split_regex(coalesce(text, ''), '{regex}') AS gaps FROM documents))) WHERE n_part >= {rule.least}"
        )
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": f"""
WITH spans AS ({_span_rows()}),
marks AS (SELECT doc_id, k, base, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS mark FROM spans),
by_doc AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  string_agg(mark, ',' ORDER BY s, k) FILTER (WHERE base) AS base, string_agg(mark, ',' ORDER BY s, k) AS spans FROM marks GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN by_doc b ON d.doc_id = b.doc_id""",
        "op7_minhash_near_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept FROM w JOIN m ON w.doc_id = m.doc_id LEFT JOIN n ON w.doc_id = n.doc_id""",
        "op5_substring_dedup": """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS t FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i WHERE gone.i IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id LEFT JOIN n ON w.doc_id = n.doc_id"""
    }
