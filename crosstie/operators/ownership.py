"""Ownership graph: chains, tiers and control, one graph per return.

``keys`` are the columns that tell the graphs apart (return and year): equal
codes of two returns are two nodes, and what one return holds, a cycle even,
never touches another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.session import shared_dir

KEYS = ("return_id",)
#: walks are summed until no set of equal length adds more than this to any share
SHARE_ERROR = 1e-15


def _saved(df: DataFrame, root: str, name: str) -> DataFrame:
    df.write.parquet(f"{root}/{name}")
    return df.sparkSession.read.parquet(f"{root}/{name}")


def _steps(first: DataFrame, then: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of holdings one after the other: keys, owner, owned, and the columns of both."""
    a = first.select(*keys, "owner", F.col("owned").alias("mid"), *(F.col(c).alias(f"{c}_a") for c in first.columns if c not in (*keys, "owner", "owned")))
    b = then.select(*keys, F.col("owner").alias("mid"), "owned", *(F.col(c).alias(f"{c}_b") for c in then.columns if c not in (*keys, "owner", "owned")))
    return a.join(b, [*keys, "mid"])


def chains(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every direct and indirect holding: keys, owner, owned, first_tier, last_tier, share.

    ``edges`` holds the keys and (owner, owned, share).  A share is the product of
    the shares along a way down, summed over all ways.  Round n joins the holdings
    of 2^(n-1) steps with themselves and with all shorter ones, so the rounds are
    the logarithm of the tiers.  Cross-holdings need no special case: their ways
    are endless, but the shares of a round shrink with its steps, and rounds end
    when none adds more than ``SHARE_ERROR``.  Shares that hold each other
    completely have no limit and raise an error.  A pair whose ways pass a cycle
    has no ``last_tier``; what an entity holds in itself is left out.  Rows are one
    per pair, every round is written.
    """
    on = [*keys, "owner", "owned"]
    root = shared_dir(edges.sparkSession, "ownership")
    power = _saved(edges.where("share > 0").groupBy(*on).agg(F.sum("share").alias("share")), root, "steps=1")
    total = power.withColumn("first_tier", F.lit(1).cast("long")).withColumn("last_tier", F.lit(1).cast("long"))
    n = 1
    while not power.where(F.col("share") > SHARE_ERROR).isEmpty():
        if n > 2**20:
            raise ValueError("some entities hold each other completely")
        longer = _steps(power, total, keys).select(
            *on, (F.col("share_a") * F.col("share_b")).alias("share"), (F.col("first_tier_b") + n).alias("first_tier"), (F.col("last_tier_b") + n).alias("last_tier"))
        added = total.select(longer.columns).union(longer).groupBy(*on).agg(
            F.sum("share").alias("share"), F.min("first_tier").alias("first_tier"), F.max("last_tier").alias("last_tier"))
        total = _saved(added, root, f"total={2 * n}")
        squared = _steps(power, power, keys).select(*on, (F.col("share_a") * F.col("share_b")).alias("share"))
        power = _saved(squared.groupBy(*on).agg(F.sum("share").alias("share")), root, f"steps={2 * n}")
        n *= 2
    found = total.where("owner <> owned").select(*on, "first_tier", "last_tier", "share")
    turning = total.where("owner = owned").select(*keys, F.col("owner").alias("node"))
    if turning.isEmpty():
        return found
    into = total.join(turning.withColumnRenamed("node", "owned"), [*keys, "owned"]).select(*on)
    out_of = total.join(turning.withColumnRenamed("node", "owner"), [*keys, "owner"]).select(*on)
    through = _steps(into, out_of, keys).select(*on)
    endless = _saved(into.union(out_of).union(through).distinct().withColumn("endless", F.lit(True)), root, "endless")
    return found.join(endless, on, "left").select(
        *on, "first_tier", F.when(F.col("endless").isNull(), F.col("last_tier")).alias("last_tier"), "share")


def tiers(holdings: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Tier of each owned entity: the longest way down from an owner that nobody
    owns; null below a cycle."""
    owned = edges.select(*keys, F.col("owned").alias("owner")).distinct()
    tops = edges.select(*keys, "owner").distinct().join(owned, [*keys, "owner"], "left_anti")
    below = holdings.join(tops, [*keys, "owner"], "left_semi").groupBy(*keys, "owned")
    longest = F.when(F.count("last_tier") == F.count(F.lit(1)), F.max("last_tier"))
    return below.agg(longest.alias("tier"), F.count(F.lit(1)).alias("tops"))


def control(holdings: DataFrame, shareholders: DataFrame, keys: Sequence[str] = KEYS, least: float = 0.1, above: float = 0.5) -> DataFrame:
    """Whether shareholders of a country control each entity.

    ``shareholders`` holds the keys and (owner).  Only those with at least
    ``least`` of the entity count; together they control it above the share
    ``above``.
    """
    on = [*keys, "owned"]
    counted = holdings.join(shareholders.select(*keys, "owner").distinct(), [*keys, "owner"], "left_semi").where(F.col("share") >= least - 1e-9)
    held = counted.groupBy(*on).agg(F.sum("share").alias("held"), F.count(F.lit(1)).alias("holders"))
    return holdings.select(*on).distinct().join(held, on, "left").select(
        *on, F.coalesce("held", F.lit(0.0)).alias("held"), F.coalesce("holders", F.lit(0)).cast("long").alias("holders"),
        (F.coalesce("held", F.lit(0.0)) > above + 1e-9).alias("is_controlled"))
