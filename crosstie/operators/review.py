"""Rule runs: one or two tax years of any number of returns at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie.functions.scalar import to_numeric
from crosstie.operators.matrix import (
    KEYS, Matrix, build_matrix, coded, entity_names, return_flags, text_matrix,
)
from crosstie.operators.rules import RULES
from crosstie.schema import FINDING_COLUMNS
from crosstie.session import salted_lookup

_BARE = [c for c in FINDING_COLUMNS if c != "entity_name"]


def _explode(rows: DataFrame, structs: list[str]) -> DataFrame:
    hits = f"inline(array_compact(array({', '.join(structs)})))"
    return rows.selectExpr(*KEYS, hits).select(*_BARE)


def cell_findings(facts: DataFrame, ids: list[str], cy: int, py: int | None) -> DataFrame:
    """Findings of the numeric rules: one aggregation for all of them."""
    matrix, structs = Matrix(), []
    for i in ids:
        structs += RULES[i].build(matrix)
    return _explode(build_matrix(facts, matrix, cy, py), structs)


def text_findings(facts: DataFrame, ids: list[str], cy: int, py: int) -> DataFrame:
    """Findings of the rules on identity texts and indicators."""
    fields = {"ROL-008": [t for t, _ in D.STATIC_RULE_FIELDS], "ROL-009": [t for t, _ in D.INDICATOR_RULE_FIELDS]}
    tags = [t for i in ids for t in fields[i]]
    rows = text_matrix(facts, tags, cy, py).where("has_py AND has_cy")
    flags = Matrix()
    known: list[str] = []
    if "ROL-009" in ids:
        # an indicator nobody in the return reports is not compared
        known = [
            flags.in_return("py", D.MAIN, t.removeprefix("IRS5471_")) + " AND "
            + flags.in_return("cy", D.MAIN, t.removeprefix("IRS5471_"))
            for t in fields["ROL-009"]
        ]
        rows = salted_lookup(rows, return_flags(facts, flags, cy, py), ["return_id"], "entity_code")
    structs, at = [], 0
    for i in ids:
        n = len(fields[i])
        pairs = [(f"py_{at + j}", f"cy_{at + j}") for j in range(n)]
        structs += RULES[i].build(pairs, known) if i == "ROL-009" else RULES[i].build(pairs)
        at += n
    return _explode(rows, structs)


def sign_census(facts: DataFrame, cy: int) -> DataFrame:
    """Per return: how many entities report E&P, and of which sign."""
    path = f"{D.SCH_H}_CurrEarnAndPrftInUSDollarsAmt"
    num = to_numeric("value")
    return (
        facts.where((F.col("tax_year") == cy) & (F.col("form") == D.SCH_H) & (F.col("path") == path)
                    & (F.col("instance") == 1))
        .groupBy("return_id")
        .agg(F.count(num).alias("n"), F.count_if(num > 0).alias("positive"), F.count_if(num < 0).alias("negative"))
    )


def return_findings(facts: DataFrame, cy: int) -> DataFrame:
    census = sign_census(facts, cy).withColumn("entity_code", F.lit("ALL"))
    return _explode(census, RULES["RSN-005"].build())


def run_rules(facts: DataFrame, ids: list[str], cy: int, py: int | None = None, names: bool = True) -> DataFrame:
    """Findings of the asked rules; rollover rules need a prior year."""
    ids = [i for i in ids if py is not None or not RULES[i].needs_prior]
    by_kind = {k: [i for i in ids if RULES[i].kind == k] for k in ("cells", "text", "return")}
    parts = []
    if by_kind["cells"]:
        parts.append(cell_findings(facts, by_kind["cells"], cy, py))
    if by_kind["text"]:
        parts.append(text_findings(facts, by_kind["text"], cy, py))
    found = reduce(DataFrame.unionByName, parts) if parts else None
    if names and found is not None:
        found = found.join(entity_names(facts, cy, py), KEYS, "left").withColumn(
            "entity_name", F.coalesce("entity_name", "entity_code"))
    elif found is not None:
        found = found.withColumn("entity_name", F.lit(None).cast("string"))
    if by_kind["return"]:
        whole = return_findings(facts, cy).withColumn("entity_name", F.lit("(all entities)"))
        found = whole if found is None else found.unionByName(whole)
    return found.select(*FINDING_COLUMNS)


def review_single(facts: DataFrame, cy: int) -> DataFrame:
    """Flow, completeness and reasonableness rules of one year."""
    return run_rules(facts, list(RULES), cy)


def review_full(facts: DataFrame, cy: int, py: int) -> DataFrame:
    """All rules, including the year-over-year ones."""
    return run_rules(facts, list(RULES), cy, py)


def entity_count(facts: DataFrame, cy: int) -> DataFrame:
    """Distinct entity codes per return, blanks not counted."""
    marks = facts.where((F.col("tax_year") == cy) & (F.col("form") == D.MAIN) & (F.col("path") == D.MAIN))
    return marks.groupBy("return_id").agg(
        F.count_distinct(F.nullif("entity_code", F.lit(""))).alias("entity_count"))


def blank_codes(facts: DataFrame, cy: int) -> DataFrame:
    """Entities filed without a code; the short-code rule never sees them."""
    return (facts.where((F.col("tax_year") == cy) & (F.col("path") == F.col("form"))
                        & (F.coalesce(F.trim("entity_code"), F.lit("")) == ""))
            .select("return_id", "sub_no", "entity_name").distinct())


__all__ = [
    "blank_codes", "cell_findings", "coded", "entity_count", "review_full", "review_single", "run_rules",
    "sign_census", "text_findings",
]
