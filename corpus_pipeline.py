"""Pipeline over the documents: stages that each read what the one before kept.

Quality votes, line dedup, one document of each near-duplicate group, no
benchmark leaks, then the mix of the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstie.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_votes
from crosstie.llm.common import saved, table

#: near duplicates of the pipeline share this percentage of their five-word shingles
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: no source is read more often than this, and the mix has this share of the largest entropy where that allows it
MAX_REPEATS, ENTROPY_SHARE = 4.0, 0.95


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality votes accept."""
    model = quality_votes.fit(docs, table(spark, sf_dir, "labels"))
    return quality_votes.score(docs, model, keep=tuple(docs.columns)).where("predicted = 1").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks that another place holds first; ``n_chars``
    follows the text.  A text that was nothing but repetition goes with its
    document; texts that were empty before stay."""
    return line_dedup.dedup_rows(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, then text
    hash.  Each row is judged by its own text, so rows that repeat an id with
    unrelated texts all stay; rows without an id all stay."""
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if saved(repeated, "repeated-ids").isEmpty():
        return _smallest_of_each_group(docs, F.col("doc_id"))
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("hash"), F.length("text").alias("n")))
    without_id = docs.where("doc_id IS NULL")
    return _smallest_of_each_group(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]), key).union(without_id)


def _smallest_of_each_group(docs: DataFrame, key: Column) -> DataFrame:
    """The documents without those that are linked with a smaller key."""
    linked = saved(jaccard_join.link(docs.select(key.alias("doc_id"), "text"), size=NEAR_WORDS, percent=NEAR_PERCENT), "near-links")
    others = linked.where("component_id <> doc_id").select(F.col("doc_id").alias("__copy")).distinct()
    return docs.join(others, key == others["__copy"], "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Readings of the documents that give the sources their weights."""
    return mixing.mix(docs, entropy_share=ENTROPY_SHARE, max_repeats=MAX_REPEATS)


STAGES = [
    ("quality_votes", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("mixing", mix_sources),
]

#: the first stage is a trained model, which SQL cannot express; tests hold each stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each result being written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
