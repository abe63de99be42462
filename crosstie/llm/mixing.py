"""Mixing sources to target weights by temperature.

Each source's token total is raised to an exponent between 0 (all alike) and 1
(as they are).  Bisection finds the exponent that meets a target entropy or a
limit on repetition; the normalised weights become token budgets, and each
budget is filled with epochs over the blocks of the source, each epoch in a
permutation of its own, the last one cut where the budget ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstie.llm.common import saved, small

WORD = r"[^\x20\x09-\x0D]+"
#: about as many tokens form a block, the unit of permutation
BLOCK_TOKENS = 1 << 20
#: steps of the bisection, and how many of them one pass over the totals settles
STEPS, AT_ONCE = 24, 3
SEED = "mix"


def token_count(text: Column) -> Column:
    """Words of a text, which stand for its tokens (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _measures(totals: DataFrame, exponents: list[float], largest: int) -> list[tuple[float, float]]:
    """Entropy, and repetition of the most repeated source per unit of budget, at each exponent."""
    columns = []
    for k, e in enumerate(exponents):
        x = F.pow(F.col("tokens") / F.lit(float(largest)), F.lit(e))
        columns += [F.sum(x).alias(f"z{k}"), F.sum(x * F.log(x)).alias(f"l{k}"), F.max(x / F.col("tokens")).alias(f"r{k}")]
    row = totals.agg(*columns).first()
    return [(math.log(row[f"z{k}"]) - row[f"l{k}"] / row[f"z{k}"], row[f"r{k}"] / row[f"z{k}"]) for k in range(len(exponents))]


def _bisect(totals: DataFrame, largest: int, holds) -> float:
    """Largest exponent at which ``holds`` is true, if it holds at 0 and not at 1."""
    lo, hi = 0.0, 1.0
    for _ in range(STEPS // AT_ONCE):
        parts = 1 << AT_ONCE
        points = [lo + (hi - lo) * k / parts for k in range(1, parts)]
        met = [holds(m) for m in _measures(totals, points, largest)]
        a, b = -1, parts - 1  # the same halving steps, over the points of this pass
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if met[mid] else (a, mid)
        lo, hi = points[a] if a >= 0 else lo, points[b] if b < parts - 1 else hi
    return lo


def exponent(totals: DataFrame, budget: float, entropy_share: float | None = None, max_repeats: float | None = None) -> float:
    """Exponent for a target entropy, as a share of that of equal weights, or
    for a limit on how often a source may be repeated within the budget.

    With a target it is the largest exponent, so the mix stays as near to the
    sources as it can.  With a limit it is the smallest one that keeps it.  With
    both, the limit goes first.  An unreachable target gives 0, an unreachable
    limit 1.  ``totals`` has one row per source, with positive ``tokens``.
    """
    n, largest = totals.agg(F.count(F.lit(1)), F.max("tokens")).first()
    if not n:
        return 1.0
    found = 1.0
    ends = _measures(totals, [0.0, 1.0], largest)
    if entropy_share is not None:
        goal = entropy_share * math.log(n)
        if ends[1][0] < goal:
            found = 0.0 if ends[0][0] < goal else _bisect(totals, largest, lambda m: m[0] >= goal)
    elif max_repeats is not None:
        found = 0.0
    if max_repeats is not None and ends[0][1] * budget > max_repeats:
        if ends[1][1] * budget >= max_repeats:
            return 1.0
        least = _bisect(totals, largest, lambda m: m[1] * budget > max_repeats) + 2.0 ** -STEPS
        found = max(found, least)
    return found


def _rank_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def mix(docs: DataFrame, budget: int | None = None, entropy_share: float | None = None, max_repeats: float | None = None,
        block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Documents to read, by epoch and block, so that sources meet their weights.

    Returns one row for every time a row is to be read: the id, the source,
    ``n_tokens``, ``epoch`` (from 0), ``block`` and ``block_place`` (the block's
    place in the permutation of that source and epoch).  Each source gets the
    integer part of its weight times the budget (default: all tokens), short by
    less than one document: whole epochs, then whole blocks, then the first
    documents of one more block.

    A null source is a source of its own.  A null or empty text has no tokens
    and is never read, nor is a source without tokens.  Null ids and repeated
    rows count like any other row.  Other columns of any name are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), token_count(F.col(text_col)).alias("tok")).where("tok > 0")
    rows = saved(rows, "mix-rows")
    totals = saved(rows.groupBy("src").agg(F.sum("tok").alias("tokens")), "mix-totals")
    n, largest, everything = totals.agg(F.count(F.lit(1)), F.max("tokens"), F.sum("tokens")).first()
    budget = everything if budget is None else budget
    power = exponent(totals, budget or 0, entropy_share, max_repeats)
    scaled = F.pow(F.col("tokens") / F.lit(float(largest or 1)), F.lit(power))
    z = totals.agg(F.sum(scaled)).first()[0] or 1.0
    # a millionth of a token keeps whole budgets whole in floating point
    share = F.floor(scaled / F.lit(z) * F.lit(float(budget or 0)) + F.lit(1e-6)).cast("long")
    plan = (
        totals.withColumn("budget", share)
        .select("src", "tokens", F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("long").alias("n_blocks"),
                F.expr("budget div tokens").alias("full"), (F.col("budget") % F.col("tokens")).alias("rest"))
    )
    plan = plan.withColumnRenamed("src", "plan_src")
    block = F.pmod(F.conv(F.substring(_rank_key(F.col("id")), 1, 12), 16, 10).cast("long"), F.col("n_blocks"))
    placed = rows.join(small(plan, n), F.col("src").eqNullSafe(F.col("plan_src"))).select("id", "src", "tok", "full", "rest", block.alias("block"))
    sizes = saved(placed.groupBy("src", "block", "full", "rest").agg(F.sum("tok").alias("size")), "mix-blocks")

    # every epoch of a block, with the tokens of the blocks before it; one row per block and epoch
    epochs = sizes.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "full"))).withColumn("key", _rank_key(F.col("src"), F.col("epoch"), F.col("block")))
    w = Window.partitionBy("src", "epoch").orderBy("key", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.when(F.col("epoch") < F.col("full"), F.col("size")).otherwise(F.col("rest") - F.sum("size").over(w) + F.col("size"))
    ordered = epochs.select(F.col("src").alias("s"), F.col("block").alias("b"), "epoch", "size", F.row_number().over(w).alias("block_place"),
                            room.alias("room"))
    ordered = saved(ordered.where("room > 0"), "mix-epochs")
    read = placed.join(small(ordered, ordered.count()), F.col("src").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    whole = read.where("room >= size").select("id", "src", "tok", "epoch", "block", "block_place")
    # the one block of a source in which its budget ends
    last = read.where("room < size").withColumn("key", _rank_key(F.col("src"), F.col("epoch"), F.col("id")))
    upto = F.sum("tok").over(Window.partitionBy("src", "epoch", "block").orderBy("key", "id")
                             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = last.withColumn("upto", upto).where("upto <= room").select(*whole.columns)
    return whole.union(part).select(
        F.col("id").alias(id_col), F.col("src").alias(source_col), F.col("tok").alias("n_tokens"), "epoch", "block",
        F.col("block_place").cast("long").alias("block_place"))
