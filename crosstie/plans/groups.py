"""Returns of filer groups with their ownership, made from the customers.

Customers of one run of ``SIZE`` keys form a group and file one return; equal
codes name entities of different groups.  In every fourth group the first entity
wholly owns a tree of the others; in the rest shares are 32nds, some entities
have two or three holders, and every fifth group has a cross-holding.  The
forms of the return itself are plain sums over the group, some of them off.
An entity without orders files its holders and zeros.

Expressions are SQL texts that Spark and other engines read alike, as in
``fixture``.  Amounts are those of all current years of a customer together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie.operators import attribution as A
from crosstie.plans import fixture as X
from crosstie.plans.fixture import every
from crosstie.plans.store import stored_table
from crosstie.schema import FACT_COLUMNS, FACT_PARTITIONS

SIZE = 32
YEAR = X.CY
_WHOLE = "(grp % 4 = 0)"

AMOUNTS = ["g_c", "r_c", "d_c", "t_c", "q_c"]
#: columns of an entity
ENTITY = {
    "grp": f"CAST(floor(k / {SIZE}) AS BIGINT)",
    "slot": f"k % {SIZE}",
    "tested": every(10, "-(g_c)", "g_c - r_c - d_c", rest=1),
    "tax": "CAST(floor(t_c / 2) AS BIGINT)",
    "paid": every(11, "t_c * 50", "t_c"),
}


def _code(slot: str) -> str:
    return f"concat('E', CAST(CAST({slot} AS BIGINT) AS STRING))"


def _thirty_seconds(n: str) -> str:
    return f"concat('0.', lpad(CAST(({n}) * 3125 AS STRING), 5, '0'))"


_UP = "floor((slot - 1) / 2)"
_FAR = "floor((slot - 1) / 4)"
#: instance, condition, holder, share, whether a shareholder of the country
HOLDERS = (
    (1, "slot > 0", _code(_UP), f"CASE WHEN {_WHOLE} THEN '1' ELSE {_thirty_seconds('16 + k % 5')} END", f"{_UP} = 0"),
    (2, f"slot > 2 AND NOT {_WHOLE} AND k % 3 > 0", _code(_FAR), _thirty_seconds("k % 3"), f"{_FAR} = 0"),
    (3, f"slot % 7 > 4 AND NOT {_WHOLE}", "'U2'", _thirty_seconds("CASE WHEN slot % 7 = 5 THEN 3 ELSE 6 END"), "slot >= 0"),
    (4, f"slot = 1 AND grp % 5 = 3 AND NOT {_WHOLE}", "'E3'", _thirty_seconds("4"), "slot < 0"),
)


def _facts_of_entity() -> list[tuple[str, int, str, str, str]]:
    """form, instance, basket, path, SQL text of the value."""
    out = [(D.SCH_G, i, "", p, f"CASE WHEN {cond} THEN {v} END") for i, cond, who, share, us in HOLDERS
           for p, v in ((A.OWNER, who), (A.OWNER_SHARE, share), (A.OWNER_US, f"CASE WHEN {us} THEN 'X' END"))]
    out.append((D.SCH_G, 1, "", A.IS_CFC, f"CASE WHEN slot > 0 THEN {every(13, 'CAST(NULL AS STRING)', chr(39) + 'X' + chr(39))} END"))
    filed = "slot > 0 AND k % 7 <> 0"
    out += [(D.SCH_I1, 1, "", p, f"CASE WHEN {filed} THEN CAST({v} AS STRING) END") for p, v in (
        (A.TESTED_INCOME, "tested"), (A.QBAI, "q_c * 100"), (f"{D.SCH_I1}_GrossIncomeLessTotIncmExclAmt", "g_c - r_c"))]
    out += [(D.SCH_E, i, b, A.TAX, f"CASE WHEN {cond} THEN CAST({v} AS STRING) END") for i, b, cond, v in (
        (1, "GEN", "slot > 0", "tax"), (2, "PAS", "slot > 0 AND k % 2 = 0", "CAST(floor(tax / 3) AS BIGINT)"))]
    out += [(D.SCH_P, 1, "", p, f"CAST({v} AS STRING)") for p, v in (
        (A.PTEP_OPENING, "t_c * 3"), (A.PTEP_PAID, "CASE WHEN slot > 0 THEN paid END"),
        (A.PTEP_RECEIVED, f"CASE WHEN below > 0 THEN below + {every(16, '40', rest=2)} END"))]
    return out


#: form of the return, basket, path, SQL text over the sums of a group (income, all_tested, elig, gen, pas, qb)
RETURN_FORMS = (
    (A.FORM_8992, "", f"{A.FORM_8992}_TestedIncomeAmt", "income + CASE WHEN grp % 8 = 4 THEN 500 ELSE 0 END"),
    (A.FORM_8992, "", f"{A.FORM_8992}_TestedForeignIncomeTaxesAmt", "gen + pas"),
    (A.FORM_8992, "", f"{A.FORM_8992}_QBAIAmt", "CASE WHEN grp % 12 <> 8 THEN qb END"),
    (A.FORM_8992, "", f"{A.FORM_8992}_GILTIAmt", "all_tested"),
    (A.FORM_8993, "", f"{A.FORM_8993}_ForeignDerivedDeductionEligibleIncomeAmt", "elig - CASE WHEN grp % 6 = 1 THEN 70 ELSE 0 END"),
    (A.FORM_1118, "GEN", f"{A.FORM_1118}_ForeignTaxesAmt", "gen"),
    (A.FORM_1118, "PAS", f"{A.FORM_1118}_ForeignTaxesAmt", "pas + CASE WHEN grp % 16 = 12 THEN 9 ELSE 0 END"),
    (A.FORM_1118, "", f"{A.FORM_1118}_DeemedPaidTaxesAmt", "gen + pas"),
)
_FILED = "slot > 0 AND k % 7 <> 0"
SUMS = {
    "income": f"sum(CASE WHEN {_FILED} AND tested > 0 THEN tested ELSE 0 END)",
    "all_tested": f"sum(CASE WHEN {_FILED} THEN tested ELSE 0 END)",
    "elig": f"sum(CASE WHEN {_FILED} THEN g_c - r_c ELSE 0 END)",
    "qb": f"sum(CASE WHEN {_FILED} THEN q_c * 100 ELSE 0 END)",
    "gen": "sum(CASE WHEN slot > 0 THEN tax ELSE 0 END)",
    "pas": "sum(CASE WHEN slot > 0 AND k % 2 = 0 THEN CAST(floor(tax / 3) AS BIGINT) ELSE 0 END)",
}


def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an entity without amounts still has holders
    amounts = X.customers(spark, sf_dir).where("n_c > 0").groupBy("k").agg(*(F.sum(a).alias(a) for a in AMOUNTS))
    base = X.table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS k").join(amounts, "k", "left").fillna(0, AMOUNTS)
    for name, text in ENTITY.items():
        base = base.withColumn(name, F.expr(text))
    # what flows into the holder of the first instance
    below = base.where("slot > 0").groupBy("grp", F.expr(f"CAST({_UP} AS BIGINT)").alias("slot")).agg(
        F.expr("CAST(sum(least(paid, t_c * 3)) AS BIGINT)").alias("below"))
    base = base.join(below, ["grp", "slot"], "left").withColumn("below", F.coalesce("below", F.lit(0)))

    def items(facts) -> str:
        return ", ".join(f"struct('{f}' AS form, {i} AS instance, '{b}' AS basket, '{p}' AS path, {n} AS ordinal, CAST({v} AS STRING) AS value)"
                         for n, (f, i, b, p, v) in enumerate(facts))

    own = base.selectExpr("grp", "k AS sub_no", f"{_code('slot')} AS entity_code", f"inline(array({items(_facts_of_entity())}))")
    sums = base.groupBy("grp").agg(*(F.expr(f"CAST({v} AS BIGINT)").alias(n) for n, v in SUMS.items()))
    forms = sums.selectExpr("grp", "CAST(0 AS BIGINT) AS sub_no", "'E0' AS entity_code", f"inline(array({items((f, 1, b, p, v) for f, b, p, v in RETURN_FORMS)}))")
    return own.union(forms).where("value IS NOT NULL").selectExpr(
        "concat('G', CAST(grp AS STRING)) AS return_id", f"{YEAR} AS tax_year", "sub_no", "entity_code", "entity_code AS entity_name",
        "form", "instance", "'' AS document_id", "basket", "path", "ordinal", "value", "value = '' AS is_blank").select(*FACT_COLUMNS)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_table(spark, sf_dir, "group_facts", lambda: build(spark, sf_dir), FACT_PARTITIONS).select(*FACT_COLUMNS)


def sql() -> str:
    """CTE list ending in ``gf`` (facts), ``e`` (holdings), ``h`` (all holdings), ``ctl`` (control)."""
    entity = ", ".join(f"{t} AS {n}" for n, t in ENTITY.items())

    def rows(facts, source: str, code: str) -> str:
        made = ", ".join(f"{{'form': '{f}', 'instance': {i}, 'basket': '{b}', 'path': '{p}', 'value': CAST({v} AS VARCHAR)}}" for f, i, b, p, v in facts)
        return f"SELECT grp, {code} AS code, unnest([{made}], recursive := true) FROM {source}"

    holders = " UNION ALL ".join(
        f"SELECT grp, {who} AS owner, {_code('slot')} AS owned, CAST({share} AS DOUBLE) AS share, {us} AS us FROM g0 WHERE {cond}"
        for _, cond, who, share, us in HOLDERS)
    return f"""{X.sql_customers()},
gk AS (SELECT c_custkey AS k, {', '.join(f'coalesce({a}, 0) AS {a}' for a in AMOUNTS)} FROM customer LEFT JOIN
  (SELECT k, {', '.join(f'CAST(sum({a}) AS BIGINT) AS {a}' for a in AMOUNTS)} FROM cust WHERE n_c > 0 GROUP BY k) ON k = c_custkey),
g00 AS (SELECT *, {entity} FROM gk),
below AS (SELECT grp, CAST({_UP} AS BIGINT) AS slot, CAST(sum(least(paid, t_c * 3)) AS BIGINT) AS below FROM g00 WHERE slot > 0 GROUP BY 1, 2),
g0 AS (SELECT g00.*, coalesce(below.below, 0) AS below FROM g00 LEFT JOIN below ON below.grp = g00.grp AND below.slot = g00.slot),
gs AS (SELECT grp, {', '.join(f'CAST({v} AS BIGINT) AS {n}' for n, v in SUMS.items())} FROM g0 GROUP BY grp),
gf AS (SELECT * FROM ({rows(_facts_of_entity(), 'g0', _code('slot'))} UNION ALL {rows(((f, 1, b, p, v) for f, b, p, v in RETURN_FORMS), 'gs', "'E0'")})
  WHERE value IS NOT NULL),
e AS (SELECT grp, owner, owned, sum(share) AS share, bool_or(us) AS us FROM ({holders}) GROUP BY ALL),
r AS (SELECT grp, owner, owned, share, 1 AS tier FROM e
  UNION ALL SELECT r.grp, r.owner, e.owned, r.share * e.share, tier + 1 FROM r JOIN e ON e.grp = r.grp AND e.owner = r.owned WHERE r.share * e.share > 1e-18),
turn AS (SELECT DISTINCT grp, owner AS code FROM r WHERE owner = owned),
pass AS (SELECT DISTINCT a.grp, a.owner, b.owned FROM (SELECT grp, owner, owned FROM r UNION SELECT grp, code, code FROM turn) a
  JOIN turn ON turn.grp = a.grp AND turn.code = a.owned JOIN (SELECT grp, owner, owned FROM r UNION SELECT grp, code, code FROM turn) b
  ON b.grp = a.grp AND b.owner = turn.code),
h AS (SELECT r.grp, r.owner, r.owned, min(tier) AS first_tier, CASE WHEN bool_or(pass.owner IS NULL) THEN max(tier) END AS last_tier, sum(share) AS share
  FROM r LEFT JOIN pass ON pass.grp = r.grp AND pass.owner = r.owner AND pass.owned = r.owned WHERE r.owner <> r.owned GROUP BY ALL),
us AS (SELECT DISTINCT grp, owner FROM e WHERE us),
ctl AS (SELECT o.grp, o.owned, coalesce(held, 0) AS held, coalesce(holders, 0) AS holders, coalesce(held, 0) > 0.5 + 1e-9 AS is_controlled
  FROM (SELECT DISTINCT grp, owned FROM h) o LEFT JOIN (SELECT h.grp, h.owned, sum(share) AS held, count(*) AS holders FROM h JOIN us ON us.grp = h.grp AND us.owner = h.owner
    WHERE share >= 0.1 - 1e-9 GROUP BY ALL) s ON s.grp = o.grp AND s.owned = o.owned)"""
