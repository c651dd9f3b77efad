"""The registered queries of this package and, where SQL can express them, the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import ann, bpe, divergence, html_text, langid, licenses, line_dedup, mips, mixing, ngram_join, packing, quality, spelling


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), shares=packing.TARGETS).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "source")


def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents"), long_words=line_dedup.LONG_WORDS).select("doc_id", "text", F.col("_removed").alias("removed"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    none = F.lit("(none)")
    return mixed.select("doc_id", F.col("_domain").alias("domain"), F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source"), F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(table(spark, sf_dir, "documents")).drop("spans")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"))


def queries() -> dict:
    own = [op1_multi_index, op2_ngram_join, op3_quality, op4_language, op5_packing, op6_top_products, op7_line_dedup, op8_mixing, op9_main_text, op10_licenses, op11_spelling, op12_divergence, op13_bpe]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_TOP_PRODUCTS = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": ngram_join.jaccard_sql(), "op6_top_products": _TOP_PRODUCTS, "op7_line_dedup": line_dedup.dedup_sql(), "op8_mixing": mixing.mix_sql(), "op11_spelling": spelling.variants_sql(), "op12_divergence": divergence.audit_sql()}
