"""Benchmark decontamination by size-partitioned MinHash containment search.

Items fall into partitions by the size of their shingle set.  An item's sketch
is its smallest hashes, as many as its partition needs so that a document which
contains the item must hold at least one of them.  Documents probe the sketches
with the hashes below the largest sketch value, and every hit is verified by
exact containment of the item's shingles.

Everything is DataFrame expressions: no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstie.llm.common import BROADCAST_ROWS, let, saved

SHINGLE = 5
#: percent of an item's shingles that a document must hold
CONTAINMENT = 80
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _windows(ws: Column, make) -> Column:
    """One value per shingle; a shorter text is one shingle."""
    n = F.size(ws)
    whole = F.when(n > 0, F.array(make([F.array_join(ws, " ")]))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n < SHINGLE, whole).otherwise(
        F.transform(F.slice(ws, 1, F.greatest(n - SHINGLE + 1, F.lit(0))), lambda w, i: make([w, *(F.get(ws, i + k) for k in range(1, SHINGLE))])))


def _hashes(ws: Column) -> Column:
    return F.array_distinct(_windows(ws, lambda parts: F.xxhash64(*parts)))


def _shingles(ws: Column) -> Column:
    n = F.size(ws)
    return F.array_distinct(F.when(n < SHINGLE, F.when(n > 0, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>"))).otherwise(
        F.transform(F.slice(ws, 1, F.greatest(n - SHINGLE + 1, F.lit(0))), lambda w, i: F.array_join(F.slice(ws, i + 1, SHINGLE), " "))))


def sketches(items: DataFrame, percent: int = CONTAINMENT) -> DataFrame:
    """Sketch rows of the items: item_id, shingles, n_shingles, h.

    The partition of an item with m shingles is the power of two below m.  A
    document that holds ``percent`` of the shingles misses at most the rest, so
    one hash more than the largest rest in the partition cannot all be missing.
    """
    ws = items.select("item_id", F.inline(F.array(let(_words(F.col("text")), lambda w: F.struct(
        _hashes(w).alias("hashes"), _shingles(w).alias("shingles"), F.size(w).alias("n_words"))))))
    m = F.size("shingles")
    upper = F.pow(F.lit(2), F.floor(F.log2(m.cast("double"))) + 1) - 1
    k = F.floor(F.lit(100 - percent) * upper / 100).cast("int") + 1
    return (
        ws.where(m > 0).distinct()
        .select("item_id", "shingles", m.alias("n_shingles"), (F.col("n_words") < SHINGLE).alias("is_short"),
                F.explode(F.slice(F.sort_array("hashes"), 1, k)).alias("h"))
    )


def leaks(docs: DataFrame, items: DataFrame, percent: int = CONTAINMENT) -> DataFrame:
    """Pairs of document and benchmark item that the document contains.

    Returns doc_id, item_id, n_shingles (of the item) and n_found; a pair is
    returned if ``100 * n_found >= percent * n_shingles``.  Words are runs of
    letters, marks and digits in lower case.  An item of fewer than five words
    is one shingle and only matches a document of just those words.  Null and
    empty texts contain and are contained in nothing.  Repeated rows give one
    pair, with the larger count if texts differ; a null id is a value like any
    other; further columns of any name are not looked at.

    The sketches are broadcast up to a known number of rows: then the text goes
    no further than the row it stands in.  Beyond that number the hashes are
    dealt, and the candidates' texts are fetched for verification.
    """
    index = saved(sketches(items, percent), "benchmark-sketches")
    rows, most = index.agg(F.count(F.lit(1)), F.max("h")).first()
    base = docs.select("doc_id", F.inline(F.array(let(_words(F.col("text")), lambda w: F.struct(
        F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")).alias("norm"), F.size(w).alias("n_words"), _hashes(w).alias("hashes"))))))
    probes = F.explode(F.filter("hashes", lambda h: h <= F.lit(most if most is not None else 0)))
    if rows <= BROADCAST_ROWS:
        found = base.select("doc_id", "norm", "n_words", probes.alias("h")).join(F.broadcast(index), "h")
    else:
        pairs = base.select("doc_id", probes.alias("h")).join(index.select("h", "item_id"), "h").select(
            F.col("doc_id").alias("d"), F.col("item_id").alias("i")).distinct()
        whole = index.drop("h").dropDuplicates(["item_id", "shingles"])
        found = base.drop("hashes").join(pairs, F.col("doc_id").eqNullSafe(F.col("d"))).join(whole, F.col("i").eqNullSafe(F.col("item_id")))
    # norm is bounded by blanks on both sides, so a shingle between blanks is a shingle of the document
    held = F.size(F.filter("shingles", lambda s: F.col("norm").contains(F.concat(F.lit(" "), s, F.lit(" ")))))
    fits = ~F.col("is_short") | (F.col("norm") == F.concat(F.lit(" "), F.col("shingles")[0], F.lit(" ")))
    return (
        found.where(fits & (F.col("is_short") | (F.col("n_words") >= SHINGLE)))
        .select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), held.cast("long").alias("n_found"))
        .where(F.col("n_found") * 100 >= F.col("n_shingles") * percent)
        .groupBy("doc_id", "item_id").agg(F.max(F.struct("n_found", "n_shingles")).alias("m"))
        .select("doc_id", "item_id", "m.n_shingles", "m.n_found")
    )


def remove_leaks(docs: DataFrame, items: DataFrame, percent: int = CONTAINMENT) -> DataFrame:
    """The documents that contain no benchmark item, with all their columns.
    Each row is judged by its own text, also where an id is repeated or missing."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text"), F.length("text").alias("n"))
    bad = leaks(docs.select(key.alias("doc_id"), "text"), items, percent).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, key.eqNullSafe(bad["__bad"]), "left_anti")
