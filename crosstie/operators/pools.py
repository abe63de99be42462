"""Accumulated E&P pools per entity and basket: rollover, analysis, import rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie.operators.reshape import quote
from crosstie.operators.rules import lit

_NUMBER = r"'^\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*$'"


def number(text: str) -> str:
    return f"CASE WHEN {text} RLIKE {_NUMBER} THEN try_cast(trim({text}) AS DOUBLE) END"


def pool_rows(facts: DataFrame, year: int, leaf: str, pools: list[str], unknown: bool = True) -> DataFrame:
    """One row per Schedule J with the basket and a map of pool balances."""
    paths = {p: f"{D.SCH_J}_{p}_{leaf}" for p in pools}
    rows = facts.where((F.col("tax_year") == year) & (F.col("form") == D.SCH_J)
                       & F.col("path").isin(D.SCH_J, f"{D.SCH_J}_SeparateCategoryCd", *paths.values()))
    basket = f"coalesce(nullif(basket, ''), nullif(m['{D.SCH_J}_SeparateCategoryCd'], ''), '{'UNKNOWN' if unknown else ''}')"
    return (
        rows.groupBy("return_id", "sub_no", "entity_code", "entity_name", "instance", "basket")
        .agg(F.expr("map_from_entries(collect_list(struct(path, value))) AS m"))
        .selectExpr("return_id", "sub_no", "entity_code", "entity_name", "instance", f"{basket} AS basket", "m")
    )


def basket_pairs(facts: DataFrame, py: int, cy: int, pools: list[str], unknown: bool = True) -> DataFrame:
    """Prior-year Schedules J with the first current-year one of the same
    entity and basket (NULL map ``c`` when the basket is missing).  Totals and
    entities without any current-year Schedule J are left out."""
    keys = ["return_id", "entity_code"]
    old = pool_rows(facts, py, D.J_EOY, pools, unknown).where("basket <> 'TOTAL'").withColumnRenamed("m", "p")
    first = pool_rows(facts, cy, D.J_BOY, pools, unknown).groupBy(*keys, "basket").agg(
        F.expr("min_by(m, struct(sub_no, instance)) AS c"))
    return (old.join(first.select(*keys).distinct(), keys, "left_semi").join(first, [*keys, "basket"], "left")
            .select("return_id", "entity_code", "entity_name", "sub_no", "instance", "basket", "p", "c"))


def _pool_cells(pairs: DataFrame, pools: list[tuple[str, str]]) -> DataFrame:
    cells = ", ".join(
        f"named_struct('pool', {lit(d)}, 'pool_grp', '{p}',"
        f" 'py', {number(f'''p['{D.SCH_J}_{p}_{D.J_EOY}']''')}, 'cy', {number(f'''c['{D.SCH_J}_{p}_{D.J_BOY}']''')})"
        for p, d in pools)
    return pairs.selectExpr("return_id", "entity_code", "entity_name", "sub_no", "instance", "basket",
                            "c IS NULL AS no_basket", f"inline(array({cells}))")


def schj_basket_rollover(facts: DataFrame, py: int, cy: int,
                         pools: list[tuple[str, str]] = D.BASKET_POOLS) -> DataFrame:
    """Closing pools against opening pools per entity and basket."""
    cells = _pool_cells(basket_pairs(facts, py, cy, [p for p, _ in pools]), pools)
    kept = cells.where("CASE WHEN no_basket THEN abs(py) >= 1 ELSE coalesce(py, cy) IS NOT NULL END")
    rows = kept.selectExpr("return_id", "entity_code", "entity_name", "sub_no", "instance", "basket", "pool", "pool_grp",
                           "coalesce(py, 0D) AS py_ending", "coalesce(cy, 0D) AS cy_beginning", "no_basket")
    rows = rows.withColumn("difference", F.col("cy_beginning") - F.col("py_ending"))
    status = F.when(~F.col("no_basket") & (F.abs("difference") < 10), "OK").otherwise("REVIEW")
    return rows.withColumn("status", status).drop("no_basket")


def schj_summary(rollover: DataFrame) -> DataFrame:
    return rollover.groupBy("return_id").agg(
        F.expr("count(DISTINCT entity_name) AS entities"), F.expr("count(*) AS checks"),
        F.expr("count_if(status = 'OK') AS ok"), F.expr("count_if(status = 'REVIEW') AS review"),
        F.expr("count(DISTINCT CASE WHEN status = 'REVIEW' THEN entity_name END) AS entities_with_issues"))


def schj_12_pools(facts: DataFrame, py: int, cy: int) -> DataFrame:
    """All twelve report pools, plus whether the closing total is their sum."""
    pools = [(p, f"{c} {d}") for p, c, d in D.REPORT_POOLS]
    return schj_basket_rollover(facts, py, cy, pools)


def schj_pool_footing(facts: DataFrame, year: int) -> DataFrame:
    """Total pool against the sum of the nine pools before it, per basket."""
    names = [p for p, _, _ in D.REPORT_POOLS]
    total = names.index("TotalSection964AEPGrp")

    def num(p: str) -> str:
        return f"coalesce({number(f'''m['{D.SCH_J}_{p}_{D.J_EOY}']''')}, 0D)"

    return pool_rows(facts, year, D.J_EOY, names).selectExpr(
        "return_id", "entity_code", "basket", f"{num(names[total])} AS total",
        f"{' + '.join(map(num, names[:total]))} AS parts",
    ).withColumn("difference", F.col("total") - F.col("parts")).withColumn(
        "status", F.when(F.abs("difference") < 10, "OK").otherwise("Review"))


# difference analysis ---------------------------------------------------------


def diff_analysis(facts: DataFrame, py: int, cy: int) -> DataFrame:
    """Differences of ten or more in the five movable pools, classed."""
    pools = D.ANALYSIS_POOLS
    cells = _pool_cells(basket_pairs(facts, py, cy, [p for p, _ in pools], unknown=False), pools).where("NOT no_basket")
    rows = cells.selectExpr("return_id", "entity_code", "entity_name", "sub_no", "instance", "basket", "pool",
                            "pool_grp", "coalesce(py, 0D) AS py_ending", "coalesce(cy, 0D) AS cy_beginning",
                            "coalesce(cy, 0D) - coalesce(py, 0D) AS diff").where("abs(diff) >= 10")
    return rows.withColumn("diff_class", F.expr(
        "CASE WHEN contains(pool, '951') AND py_ending = 0 THEN 'new PTEP'"
        f" WHEN pool = {lit(pools[0][1])} THEN 'pool a' WHEN pool = {lit(pools[3][1])} THEN 'pool i' ELSE 'other' END"))


def diff_by_category(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("diff_class").agg(
        F.expr("count(*) AS entries"), F.expr("count(DISTINCT struct(return_id, entity_code)) AS entities"),
        F.expr("sum(diff) AS total_diff"))


def net_by_entity(diffs: DataFrame) -> DataFrame:
    """Pool differences of each entity and the net of the reclassified ones."""
    letters = dict(zip("aceij", [p for p, _ in D.ANALYSIS_POOLS]))
    sums = [F.expr(f"coalesce(sum(CASE WHEN pool_grp = '{p}' THEN diff END), 0D) AS pool_{x}") for x, p in letters.items()]
    return (diffs.groupBy("return_id", "entity_code").agg(F.expr("min_by(entity_name, sub_no) AS entity_name"), *sums)
            .withColumn("net", F.expr("pool_a + pool_c + pool_e")))


def ptep_reclass_check(diffs: DataFrame) -> DataFrame:
    """Entities whose untaxed pool moved: does new previously-taxed E&P offset it?"""
    new = "diff_class = 'new PTEP' AND contains(pool, '{}')"

    def total(cond: str) -> str:
        return f"coalesce(sum(CASE WHEN {cond} THEN diff END), 0D)"

    a = f"pool = {lit(D.ANALYSIS_POOLS[0][1])}"
    rows = diffs.groupBy("return_id", "entity_code").agg(
        F.expr(f"count_if({a}) AS n_a"), F.expr(f"{total(a)} AS pool_a"),
        F.expr(f"{total(new.format('GILTI'))} AS new_c"), F.expr(f"{total(new.format('SubF'))} AS new_e"))
    return (rows.where("n_a > 0").drop("n_a").withColumn("net", F.expr("pool_a + new_c + new_e"))
            .withColumn("verdict", F.when(F.abs("net") < 100, "OK-reclass").otherwise("GAP")))


def genuine_gaps(diffs: DataFrame) -> DataFrame:
    """Entities whose differences a reclassification does not explain."""
    gap = "abs(net) >= 100 OR abs(pool_i) >= 10 OR abs(pool_j) >= 10"
    return net_by_entity(diffs).withColumn("is_gap", F.expr(gap))


# correcting import rows --------------------------------------------------------


def import_rows(rollover: DataFrame, year: int = 2024, basket: str = D.GENERAL_BASKET) -> DataFrame:
    """One template row per open difference of an importable pool, carrying the
    prior-year closing balance in the pool's column; other cells are blank."""
    column = " ".join(f"WHEN '{p}' THEN {lit(c)}" for p, c in D.POOL_IMPORT_COLUMN.items())
    rows = (rollover.where("status = 'REVIEW'").withColumn("target", F.expr(f"CASE pool_grp {column} END"))
            .where("target IS NOT NULL"))
    first, last = f"01/01/{year}", f"12/31/{year}"
    fixed = {
        "Entity Number": "entity_code", "Activity Type": lit(D.EP_ACTIVITY), "Basket Number": lit(basket.split("-")[0]),
        "Basket Name": lit(basket), "Tax Year": f"'{year}'", "Made in Tax Year": f"'{year}'",
        "Tax Year Begin": lit(first), "Tax Year End": lit(last), "Made in Year Begin": lit(first),
        "Made in Year End": lit(last),
    }
    amounts = set(D.POOL_IMPORT_COLUMN.values())

    def cell(c: str) -> str:
        if c in fixed:
            return fixed[c]
        if c in amounts:
            return f"CASE WHEN target = {lit(c)} THEN CAST(py_ending AS STRING) ELSE '' END"
        return "''"

    return rows.selectExpr("return_id", *[f"{cell(c)} AS {quote(c)}" for c in D.IMPORT_COLUMNS])
