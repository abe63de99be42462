"""Summaries, filters and rankings of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie.operators.review import entity_count
from crosstie.operators.reshape import extract_form
from crosstie.functions.scalar import to_numeric

RANK = "CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END"


def ranked(findings: DataFrame) -> DataFrame:
    """Severity first, then rule, then a fixed order inside the rule."""
    return findings.orderBy(F.expr(RANK), "check_id", "return_id", "entity_code", "sub_key")


def head(findings: DataFrame, n: int) -> DataFrame:
    """The first n findings of every return."""
    w = Window.partitionBy("return_id").orderBy(F.expr(RANK), "check_id", "entity_code", "sub_key")
    return findings.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def filter_findings(findings: DataFrame, severity: list[str] = (), category: list[str] = (),
                    entity: list[str] = ()) -> DataFrame:
    """Conjunction of multi-value filters; an empty list does not filter."""
    for column, values in (("severity", severity), ("category", category), ("entity_code", entity)):
        if values:
            findings = findings.where(F.col(column).isin(*values))
    return findings


def distinct_filters(findings: DataFrame) -> DataFrame:
    """Entity codes and categories that can be filtered on."""
    kinds = (findings.select(F.inline(F.array(
        F.struct(F.lit("entity").alias("kind"), F.col("entity_code").alias("value")),
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
    ))).distinct())
    return kinds.orderBy("kind", "value")


def summary(findings: DataFrame, counts: DataFrame) -> DataFrame:
    """Totals per return; ``counts`` holds (return_id, entity_count).

    ``clean_entities`` keeps the plain difference, in which a return-level
    finding counts as an entity; ``clean_entities_strict`` leaves it out.
    """
    per = findings.groupBy("return_id").agg(
        F.expr("count(*) AS total_findings"),
        *[F.expr(f"count_if(severity = '{s}') AS {s.lower()}") for s in ("HIGH", "MEDIUM", "LOW")],
        F.expr("count(DISTINCT entity_code) AS entities_with_findings"),
        F.expr("count(DISTINCT CASE WHEN entity_code <> 'ALL' THEN entity_code END) AS strict_entities"),
    )
    out = counts.join(per, "return_id", "left").na.fill(0)
    return out.selectExpr(
        "return_id", "entity_count", "total_findings", "high", "medium", "low", "entities_with_findings",
        "entity_count - entities_with_findings AS clean_entities",
        "entity_count - strict_entities AS clean_entities_strict",
        "round(try_divide(entity_count - entities_with_findings, entity_count), 4) AS clean_rate",
    )


def review_summary(findings: DataFrame, facts: DataFrame, cy: int) -> DataFrame:
    return summary(findings, entity_count(facts, cy))


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("return_id", "severity").agg(F.expr("count(*) AS findings"))


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("return_id", "category").agg(F.expr("count(*) AS findings"))


def by_check(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check_id", "severity").agg(F.expr("count(*) AS findings"))


def per_entity(entities: DataFrame, findings: DataFrame) -> DataFrame:
    """Number of findings and status of every (return_id, entity_code) row."""
    n = findings.groupBy("return_id", "entity_code").agg(F.expr("count(*) AS findings"))
    return (entities.join(n, ["return_id", "entity_code"], "left")
            .withColumn("findings", F.coalesce("findings", F.lit(0)))
            .withColumn("status", F.when(F.col("findings") == 0, "Clean").otherwise(F.concat("findings", F.lit(" issues")))))


def entity_overview(facts: DataFrame, findings: DataFrame, cy: int) -> DataFrame:
    """Schedule H key figures of each entity with its finding count."""
    tags = {"ep_usd": "CurrEarnAndPrftInUSDollarsAmt", "fx_rate": "ExchangeRt", "net_income_fc": "ForeignCYNetIncomePerBooksAmt"}
    h = extract_form(facts.where(F.col("tax_year") == cy), D.SCH_H, [f"{D.SCH_H}_{t}" for t in tags.values()])
    cols = {k: to_numeric(f"{D.SCH_H}_{t}") for k, t in tags.items()}
    rows = h.where("entity_code <> ''").select(
        "return_id", "entity_code", cols["ep_usd"].cast("bigint").alias("ep_usd"),
        F.round(cols["fx_rate"], 4).alias("fx_rate"), cols["net_income_fc"].cast("bigint").alias("net_income_fc"),
    )
    return per_entity(rows, findings)


def ep_ranking(facts: DataFrame, cy: int) -> DataFrame:
    """Entities with E&P, largest first, with the side of zero they are on."""
    path = f"{D.SCH_H}_CurrEarnAndPrftInUSDollarsAmt"
    h = extract_form(facts.where(F.col("tax_year") == cy), D.SCH_H, [path])
    ep = to_numeric(path).cast("bigint")
    return (h.where("entity_code <> ''").select("return_id", "entity_code", ep.alias("ep_usd"))
            .where("ep_usd IS NOT NULL")
            .withColumn("bucket", F.when(F.col("ep_usd") >= 0, "gain").otherwise("loss"))
            .orderBy(F.desc("ep_usd"), "return_id", "entity_code"))
