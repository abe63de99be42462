"""Token counts through a digest cache.

The cache is a Parquet table of (digest of the content, tokenizer version,
tokens).  Counting joins the digests of all documents with it, encodes each
distinct missing text once, appends the new counts and reads the counts of all
documents from the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_DDL = "digest binary, tokenizer string, n_tokens bigint"
#: texts handed to the tokenizer at a time
SLICE = 64


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an absent cache is an empty one."""
    try:
        return spark.read.schema(CACHE_DDL).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_DDL)


def _encoder(model: bytes):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        tokenizer = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            texts = batch["text"].tolist()
            counts: list[int] = []
            for i in range(0, len(texts), SLICE):
                counts.extend(len(ids) for ids in tokenizer.encode(texts[i:i + SLICE], num_threads=1))
            yield pd.DataFrame({"digest": batch["digest"], "tokenizer": batch["tokenizer"], "n_tokens": counts})

    return encode


def count_tokens(docs: DataFrame, model_path: str, cache_path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, each distinct text being encoded once.

    Returns one row per input row: the id, ``n_bytes``, ``n_tokens`` and
    ``over_limit`` (more than ``limit`` tokens).  A null text counts as the
    empty text, which is the only normalisation: anything else could change the
    count.  Repeated rows give repeated rows, null ids are kept, other columns
    of any name are not looked at, an empty table gives an empty result.

    The tokenizer file (half a megabyte, read once on the driver) goes to the
    tasks with the function.  Distinct texts are gathered by map-side and final
    aggregation on digest and text, so a text that fills a third of the rows is
    one row per map task.  Counts of a damaged or doubled cache entry agree, as
    both were made by the same model; the larger is used.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = f.read()
    version = hashlib.sha256(model).hexdigest()
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col), text.alias("text"))
    digest = F.unhex(F.sha2(F.col("text"), 256))

    stored = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    misses = (
        keyed.select(digest.alias("digest"), "text").distinct()
        .join(stored.select("digest"), "digest", "left_anti")
        .select("digest", F.lit(version).alias("tokenizer"), "text")
    )
    misses.mapInPandas(_encoder(model), CACHE_DDL).write.mode("append").parquet(cache_path)

    counts = (
        spark.read.schema(CACHE_DDL).parquet(cache_path).where(F.col("tokenizer") == version)
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )
    return (
        keyed.select(id_col, F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("digest"))
        .join(counts, "digest")
        .select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
