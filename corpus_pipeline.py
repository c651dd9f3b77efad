"""A corpus pipeline of five stages, each an operator of granary.llm. Every stage reads what the one before it wrote; all
but the last return the columns of documents.

The quality classifier keeps what it takes for good; line dedup removes repeated chunks and runs of lines, and documents of which nothing
is left; the n-gram join keeps the first document of each class; mixing takes each leaf's part of the budget; packing
cuts the rest into sequences. Documents without text or id go through every stage by the operators' rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import line_dedup, mixing, ngram_join, packing, quality
from granary.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(docs.select(*COLUMNS), long_words=line_dedup.LONG_WORDS).where((F.col("_removed") == 0) | (F.trim("text") != ""))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def first_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select(*COLUMNS)).drop("ids")


STAGES = [("quality", good_text), ("line_dedup", without_repeats), ("ngram_join", first_of_class), ("mixing", mixed), ("packing", packed)]
#: The classifier is trained, so SQL can't express run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else stored(docs)
    return docs
