"""Audit validators over stored facts: footing, negative assets, peer outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie.functions.scalar import safe_float
from crosstie.operators.matrix import first_instance
from crosstie.operators.pools import number
from crosstie.operators.reshape import ROW_KEYS, form_rows, value_map
from crosstie.session import salted_lookup

#: lines of Schedule H that lead from book income to current E&P
_NET, _PLUS, _LESS, _EP = (f"{D.SCH_H}_{t}" for t in (
    "ForeignCYNetIncomePerBooksAmt", "TotalNetAdditionsAmt", "TotalNetSubtractionsAmt", "CurrentEarningsAndProfitsAmt"))
#: the assets of the balance sheet stand before its total
ASSETS = D.BALANCE_PAIRS[:9]


def ep_footing(facts: DataFrame, year: int, tolerance: float = 1.0) -> DataFrame:
    """Net income plus additions less subtractions against current E&P.

    Missing amounts count as zero; an entity without current E&P is left out.
    """
    rows = value_map(form_rows(facts.where(F.col("tax_year") == year), D.SCH_H, [_NET, _PLUS, _LESS, _EP]), ROW_KEYS)

    def num(path: str) -> str:
        return number(f"m['{path}']")

    return (
        rows.selectExpr("return_id", "entity_code", f"coalesce({num(_NET)}, 0D) AS net_income",
                        f"coalesce({num(_PLUS)}, 0D) - coalesce({num(_LESS)}, 0D) AS adjustments", f"{num(_EP)} AS current_ep")
        .where("current_ep IS NOT NULL")
        .withColumn("difference", F.expr("net_income + adjustments - current_ep"))
        .withColumn("passes", F.abs("difference") <= tolerance)
    )


def negative_assets(facts: DataFrame, year: int) -> DataFrame:
    """Asset lines of Schedule F that end the year below zero."""
    lines = facts.sparkSession.createDataFrame(
        [(f"{D.SCH_F}_{D.end_tag(c)}", ln, d) for c, ln, d in ASSETS], "path string, line string, description string")
    rows = first_instance(facts.where((F.col("tax_year") == year) & (F.col("form") == D.SCH_F)
                                      & F.col("path").isin(*[f"{D.SCH_F}_{D.end_tag(c)}" for c, _, _ in ASSETS])))
    return (
        rows.join(F.broadcast(lines), "path").withColumn("amount", safe_float("value")).where("amount < 0")
        .select("return_id", "entity_code", "line", "description", "amount")
    )


def peer_outliers(facts: DataFrame, year: int, limit: float = 3.0) -> DataFrame:
    """Entities whose E&P lies far from that of their peers.

    Peers share the functional currency, over all returns.  ``distance`` is in
    standard deviations of the peer group; groups of fewer than three or without
    spread have none.  Statistics per currency are small aggregates, looked up
    with a salt as one currency may hold most entities.
    """
    ep, ccy = f"{D.SCH_H}_CurrEarnAndPrftInUSDollarsAmt", f"{D.MAIN}_FunctionalCurrencyCd"
    this = facts.where((F.col("tax_year") == year) & (F.col("instance") == 1))
    rows = value_map(this.where(F.col("form").isin(D.MAIN, D.SCH_H) & F.col("path").isin(ep, ccy, "FunctionalCurrencyCd")), ROW_KEYS)
    rows = rows.selectExpr("return_id", "entity_code", f"coalesce(m['{ccy}'], m['FunctionalCurrencyCd'], '') AS currency",
                           f"{number(f'''m['{ep}']''')} AS ep").where("ep IS NOT NULL")
    stats = rows.groupBy("currency").agg(F.count(F.lit(1)).alias("peers"), F.avg("ep").alias("mean"), F.stddev_samp("ep").alias("spread"))
    near = salted_lookup(rows, stats.where("peers >= 3 AND spread > 0"), ["currency"], "entity_code", how="inner")
    return near.withColumn("distance", F.round((F.col("ep") - F.col("mean")) / F.col("spread"), 4)).where(F.abs("distance") > limit).select(
        "return_id", "entity_code", "currency", "ep", "peers", "distance")
