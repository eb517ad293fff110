"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lithoframe.llm import embedding_dedup, exact_dedup, html_extract, language_id, mixing, ngram_join, packing, ppm, quality, token_binary
from lithoframe.llm.common import documents, fold


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir), fold("doc_id", 5) == 1)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(documents(spark, sf_dir))


_REACH = """r AS (SELECT id AS x, id AS y FROM ids UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)"""

OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE i >= 0.8 * (x.n + y.n - i) - 1e-9),
ids AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT x AS doc_id, min(y) AS class_id, (SELECT count(*) FROM l WHERE l.a = x) AS n_links, min(y) = x AS kept FROM r GROUP BY x
"""


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_binary.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.identify(docs, fold("doc_id", 5) != 0)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op7_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.rate(documents(spark, sf_dir), labels, fold("doc_id", 4) != 2)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.tally(documents(spark, sf_dir)).withColumnRenamed("src", "source")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
ids AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT x AS vec_id, (SELECT count(*) FROM l WHERE l.a = x) AS n_links, min(y) AS component_id, min(y) = x AS kept FROM r GROUP BY x
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ppm_score": op1_ppm_score,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_html_extract": op3_html_extract,
        "op4_token_binary": op4_token_binary,
        "op5_language_id": op5_language_id,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_length_packing": op7_length_packing,
        "op8_quality_rank": op8_quality_rank,
        "op9_source_mix": op9_source_mix,
        "op10_embedding_dedup": op10_embedding_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op10_embedding_dedup": OP10_SQL}
