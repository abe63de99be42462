"""Queries of the review rules and the findings built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie.operators import findings as FI
from crosstie.operators import review as R
from crosstie.operators.matrix import Matrix, build_matrix, coded, entity_names
from crosstie.operators.rules import RULES, fx_band
from crosstie.operators.reshape import single_or_null
from crosstie.plans import fixture as X
from crosstie.plans.registry import query
from crosstie.plans.store import stored_table

PY, CY = X.PY, X.CY
_LOSS = "-CAST(floor(g_c / 2) AS BIGINT)"

#: entity-level values under short names; NULL where the schedule is not filed
ENTITY = f"""e AS (
SELECT *, n_c > 0 AS cyr, n_p > 0 AS pyr, n_c > 0 AND k % 31 <> 0 AS hc, n_p > 0 AND k % 31 <> 0 AS hp,
  n_c > 0 AND k % 7 <> 0 AS ic, n_p > 0 AND k % 7 <> 0 AS ip, n_c > 0 AND k % 9 <> 0 AS ec,
  CASE WHEN k % 41 = 0 THEN r_c WHEN k % 10 = 1 THEN {_LOSS} ELSE g_c - r_c - d_c END AS t0_c,
  CASE WHEN k % 41 = 0 THEN r_p ELSE g_p - r_p - d_p END AS t0_p,
  CAST(fx_c AS DOUBLE) AS rc_, CAST(fx_p AS DOUBLE) AS rp_,
  CASE WHEN k % 47 = 0 THEN t_c * 20 ELSE t_c END AS etax,
  CASE WHEN k % 44 = 0 THEN q_c * 100000 ELSE q_c * 100 END AS qbai,
  CASE WHEN k % 43 = 0 THEN g_c * 2 ELSE d_c END AS interest,
  CASE WHEN k % 61 = 0 THEN NULL WHEN k % 59 = 0 THEN -(g_c + q_c) ELSE g_c + q_c END AS eoy,
  CASE WHEN k % 61 = 0 THEN NULL WHEN k % 59 = 0 THEN -(g_p + q_p) ELSE g_p + q_p END AS peoy,
  CASE WHEN n_p > 0 THEN g_p + q_p + CASE WHEN k % 8 = 0 THEN 25000 ELSE 0 END ELSE 0 END AS boy,
  g_c + q_c + CASE WHEN k % 53 = 0 THEN 5 ELSE 0 END AS le
FROM cust),
i1 AS (SELECT *, CASE WHEN k % 46 = 0 THEN 0 ELSE t0_c END AS tu_c, CASE WHEN k % 46 = 0 THEN 0 ELSE t0_p END AS tu_p,
  t0_c AS ts FROM e)"""


def _hit(check: str, severity: str, cond: str, delta: str = "NULL", key: str = "''") -> str:
    return (f"SELECT seg AS return_id, '{check}' AS check_id, {severity if severity.startswith('CASE') else repr(severity)}"
            f" AS severity, code AS entity_code, {key} AS sub_key, CAST(round({delta}, 2) AS DOUBLE) AS delta"
            f" FROM i1 WHERE {cond}")


def _rol_001() -> str:
    def line(concept: str, end: str, begin: str) -> str:
        sev = "HIGH" if concept.startswith("Tot") else "MEDIUM"
        d = f"abs(COALESCE({begin}, 0) - COALESCE({end}, 0))"
        return _hit("ROL-001", sev, f"pyr AND cyr AND COALESCE({end}, {begin}) IS NOT NULL AND {d} > 10000"
                    f" AND {d} > greatest(1, abs(COALESCE({end}, 0)) * 0.001)", d, f"'{concept}'")

    half, shift = "CAST(floor(g_p / 2) AS BIGINT)", "CASE WHEN k % 8 = 0 THEN 25000 ELSE 0 END"
    rtn = "(g_p + q_p - d_p - t_p)"
    le = "(g_p + q_p + CASE WHEN k % 53 = 0 THEN 5 ELSE 0 END)"
    return " UNION ALL ".join([
        line("Cash", half, f"{half} + {shift}"), line("TotalAssets", "peoy", "boy"),
        line("RtnEarnings", rtn, f"{rtn} + {shift}"), line("TotLiabShrEqty", le, "(g_p + q_p)"),
    ])


def _rol_007() -> str:
    # only entities with a single basket have a readable balance; with several
    # baskets on both sides there is nothing to compare
    def pool(name: str, x: str) -> str:
        # a lost basket leaves two of three current rows: still several, still NULL
        d = f"abs(b{x}_c - e{x}_p)"
        return _hit("ROL-007", "HIGH", f"pyr AND cyr AND k % 2 <> 0 AND {d} > 100 AND {d} > greatest(1, abs(e{x}_p) * 0.001)",
                    d, f"'{name}'")

    return " UNION ALL ".join(pool(p, X.POOL_LETTER[p]) for p, _ in D.RULE_POOLS)


def _rol_008() -> str:
    def field(key: str, sev: str, a: str, b: str) -> str:
        return _hit("ROL-008", sev, f"pyr AND cyr AND {a} <> {b}", key=f"'{key}'")

    return " UNION ALL ".join([
        field("_entity_name", "MEDIUM", "upper(name_p)", "upper(name_c)"),
        field("IRS5471_CountryUnderWhoseLawsIncCd", "MEDIUM", "country", "CASE WHEN k % 79 = 0 THEN 'ZZ' ELSE country END"),
        field("IRS5471_FunctionalCurrencyCd", "HIGH", "ccy_p", "ccy_c"),
    ])


def _rol_009() -> str:
    def flip(key: str, cond: str) -> str:
        return _hit("ROL-009", "MEDIUM", f"pyr AND cyr AND {cond}", key=f"'{key}'")

    # FDII disappears where it was claimed; the return still reports it elsewhere
    some = "seg IN (SELECT seg FROM cust WHERE n_c > 0 AND k % 5 = 0 AND k % 74 <> 0)"
    return " UNION ALL ".join([
        flip("DisallowedInterestExpenseInd", "k % 73 = 0"), flip("BaseErosionPaymentBenefitInd", "k % 73 = 1"),
        flip("FDIIBenefitsClaimInd", f"k % 74 = 0 AND k % 5 = 0 AND {some}"),
    ])


_BANDS = " ".join(
    f"WHEN rc_ >= CAST({lo * 0.7!r} AS DOUBLE) AND rc_ <= CAST({hi * 1.3!r} AS DOUBLE) THEN"
    f" rc_ < CAST({lo * 0.85!r} AS DOUBLE) OR rc_ > CAST({hi * 1.15!r} AS DOUBLE)" for _, lo, hi in D.FX_BANDS)
_S3 = "(CASE WHEN tu_c <> 0 THEN tu_c WHEN k % 46 = 0 THEN t0_c ELSE tu_c END)"

RULE_SQL = {
    "FLO-001": _hit("FLO-001", "HIGH", "hc AND abs(ni_c - net_c) > greatest(1, abs(ni_c) * 0.001)", "abs(ni_c - net_c)"),
    "FLO-002": _hit("FLO-002", "MEDIUM", "hc AND rc_ > 0 AND abs(ep_c / rc_ - usd_c) > greatest(10, abs(usd_c) * 0.01)",
                    "abs(ep_c / rc_ - usd_c)"),
    "FLO-003": _hit("FLO-003", "HIGH", f"hc AND ic AND g_c <> 0 AND abs(g_c - ({_S3} + r_c + d_c)) > greatest(1000, abs(g_c) * 0.05)",
                    f"abs(g_c - ({_S3} + r_c + d_c))"),
    "FLO-004": _hit("FLO-004", "MEDIUM", "hc AND ec AND ni_c > 0 AND etax > ni_c * 0.45 AND etax > 10000", "etax - ni_c * 0.45"),
    "FLO-005": _hit("FLO-005", "HIGH", f"hc AND ic AND {_S3} < 0 AND t_c > 0"),
    "FLO-006": _hit("FLO-006", "HIGH", "hc AND abs((g_c - r_c - d_c) - net_c) > 1", "abs((g_c - r_c - d_c) - net_c)"),
    "FLO-007": _hit("FLO-007", "HIGH", "hc AND eoy < 0", key="'EOY'") + " UNION ALL "
    + _hit("FLO-007", "HIGH", "hc AND boy < 0", key="'BOY'"),
    "FLO-008": _hit("FLO-008", "HIGH", "hc AND abs(eoy - le) > 1", "abs(eoy - le)"),
    "CMP-001": _hit("CMP-001", "HIGH", "cyr AND NOT hc"),
    "CMP-002": _hit("CMP-002", "MEDIUM", "hc AND NOT ic"),
    "CMP-003": _hit("CMP-003", "MEDIUM", "ic AND NOT ec AND tu_c > 0"),
    "CMP-004": _hit("CMP-004", "HIGH", "cyr AND boy <> 0 AND COALESCE(eoy, 0) = 0"),
    "CMP-005": _hit("CMP-005", "MEDIUM", "hc AND COALESCE(rc_, 0) = 0"),
    "RSN-001": _hit("RSN-001", "LOW", "hc AND abs(usd_c) > 1000000000"),
    "RSN-002": _hit("RSN-002", "MEDIUM", f"hc AND rc_ > 0 AND (CASE {_BANDS} ELSE false END)"),
    "RSN-003": _hit("RSN-003", "MEDIUM", "hc AND ni_c <> 0 AND ((ni_c - ep_c) / ni_c > 0.50 OR (ni_c - ep_c) / ni_c < -0.10)"),
    "RSN-004": _hit("RSN-004", "LOW", "hc AND ic AND tu_c > 0 AND r_c > 0 AND abs(tu_c - r_c) < 1"),
    "RSN-006": _hit("RSN-006", "HIGH", "hc AND ic AND qbai > eoy AND qbai > 0", "qbai - eoy"),
    "RSN-007": _hit("RSN-007", "MEDIUM", "hc AND ic AND interest > 0 AND g_c > 0 AND interest > g_c"),
    "ROL-001": _rol_001(),
    "ROL-002": _hit("ROL-002", "MEDIUM", "pyr AND NOT cyr"),
    "ROL-003": _hit("ROL-003", "MEDIUM", "cyr AND NOT pyr"),
    "ROL-004": _hit("ROL-004", "MEDIUM", "hc AND hp AND ((usd_c > 50000 AND usd_p < -50000) OR (usd_c < -50000 AND usd_p > 50000))"),
    "ROL-005": _hit("ROL-005", "LOW", "hc AND hp AND rp_ > 0 AND rc_ > 0 AND abs(rc_ - rp_) / rp_ > 0.25"),
    "ROL-006": _hit("ROL-006", "HIGH", "hc AND hp AND abs(usd_p) > 100000 AND usd_c = 0", "abs(usd_p)"),
    "ROL-007": _rol_007(),
    "ROL-008": _rol_008(),
    "ROL-009": _rol_009(),
    "ROL-010": _hit("ROL-010", "MEDIUM", "ic AND ip AND tu_p > 10000 AND tu_c < -10000") + " UNION ALL "
    + _hit("ROL-010", "LOW", "ic AND ip AND tu_p < -10000 AND tu_c > 10000"),
    "ROL-011": _hit("ROL-011", "HIGH", "hc AND k % 2 <> 0 AND abs(jcy_c - usd_c) > greatest(100, abs(usd_c) * 0.01)"
                    " AND abs(jcy_c - usd_c) > 1000", "abs(jcy_c - usd_c)", "'tie'") + " UNION ALL "
    + _hit("ROL-011", "MEDIUM", "hc AND k % 2 <> 0 AND ea_c > ba_c + jcy_c + greatest(1000, abs(ba_c + jcy_c) * 0.05)",
           "ea_c - (ba_c + jcy_c)", "'growth'"),
}
_CENSUS = ("SELECT seg, count(*) AS n, sum(CASE WHEN usd_c > 0 THEN 1 ELSE 0 END) AS p,"
           " sum(CASE WHEN usd_c < 0 THEN 1 ELSE 0 END) AS m FROM e WHERE hc {} GROUP BY seg")
RULE_SQL["RSN-005"] = ("SELECT seg AS return_id, 'RSN-005' AS check_id, 'LOW' AS severity, 'ALL' AS entity_code, '' AS sub_key,"
                       " CAST(NULL AS DOUBLE) AS delta FROM (" + _CENSUS.format("") + ") WHERE n >= 5 AND (p = 0 OR m = 0)")
SHORT = ["return_id", "check_id", "severity", "entity_code", "sub_key"]


def short(findings: DataFrame) -> DataFrame:
    return findings.select(*SHORT, F.round("delta", 2).alias("delta"))


def _read_by(rule_id: str) -> tuple[set[int], set[str]]:
    """Years and forms that a rule reads: those of its cells, or the main form of both years for texts."""
    rule = RULES[rule_id]
    if rule.kind == "text":
        return {PY, CY}, {D.MAIN}
    if rule.kind == "return":
        return {CY}, {D.SCH_H}
    m = Matrix()
    rule.build(m)
    cells = [*m.cells, *m.flags]
    return {CY if side == "cy" else PY for side, _, _ in cells}, {form for _, form, _ in cells}


def _single_rule(rule_id: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        years, forms = _read_by(rule_id)
        return short(R.run_rules(X.facts(spark, sf_dir, *years, forms=forms), [rule_id], CY, PY, names=False))

    return run


for _id, _sql in RULE_SQL.items():
    if _id != "RSN-005":
        query(_id.lower().replace("-", "_"), _sql, ctes=ENTITY)(_single_rule(_id))


@query("cmp_006", "SELECT DISTINCT seg AS return_id, 'CMP-006' AS check_id, 'HIGH' AS severity, concat('c', CAST(k % 100 AS STRING))"
       " AS entity_code, '' AS sub_key, CAST(NULL AS DOUBLE) AS delta FROM cust WHERE n_c > 0 AND k % 17 = 0 AND k % 100 < 10")
def _cmp_006(spark, sf_dir):
    # some entities are filed under a short code
    f = X.facts(spark, sf_dir).withColumn("entity_code", F.expr(
        "CASE WHEN sub_no % 17 = 0 THEN concat('c', CAST(sub_no % 100 AS STRING)) ELSE entity_code END"))
    return short(R.run_rules(f, ["CMP-006"], CY, names=False))


@query("rsn_005", "SELECT seg AS return_id, 'RSN-005' AS check_id, 'LOW' AS severity, 'ALL' AS entity_code, '' AS sub_key,"
       " CAST(NULL AS DOUBLE) AS delta, concat('All ', CAST(n AS STRING), ' entities report positive E&P') AS description FROM ("
       + _CENSUS.format("AND usd_c > 0") + ") WHERE n >= 5", ctes=ENTITY)
def _rsn_005(spark, sf_dir):
    # entities that report a loss are left out, so every return is one-signed
    f = X.facts(spark, sf_dir, CY)
    path = f"{D.SCH_H}_CurrEarnAndPrftInUSDollarsAmt"
    f = f.where((F.col("path") != path) | (F.expr("try_cast(value AS DOUBLE)") > 0))
    out = R.run_rules(f, ["RSN-005"], CY)
    return out.select(*SHORT, F.round("delta", 2).alias("delta"), "description")


_ALL = " UNION ALL ".join(RULE_SQL[i] for i in RULES if i in RULE_SQL)
_ONE_YEAR = " UNION ALL ".join(RULE_SQL[i] for i in RULES if i in RULE_SQL and not i.startswith("ROL"))
FOUND = ENTITY + f",\nfound AS ({_ALL}), cat AS (SELECT *, CASE left(check_id, 3) WHEN 'FLO' THEN 'flow' WHEN 'CMP' THEN" \
    " 'completeness' WHEN 'RSN' THEN 'reasonableness' ELSE 'rollover' END AS category FROM found)"
_NAMED = "COALESCE((SELECT CASE WHEN n_c > 0 THEN name_c ELSE name_p END FROM cust WHERE seg = return_id AND code = entity_code), '(all entities)')"


def _review_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the forms that some rule reads, and of the main form, which names the entities."""
    return X.facts(spark, sf_dir, forms={D.MAIN}.union(*(_read_by(i)[1] for i in RULES)))


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of a full review as its sink stores them."""
    return stored_table(spark, sf_dir, "findings", lambda: R.review_full(_review_facts(spark, sf_dir), CY, PY), ["severity"])


@query("review_single", _ONE_YEAR, ctes=ENTITY)
def _review_single(spark, sf_dir):
    return short(R.review_single(X.facts(spark, sf_dir, CY), CY))


@query("review_full", f"SELECT cat.*, {_NAMED} AS entity_name FROM cat", ctes=FOUND)
def _review_full(spark, sf_dir):
    found = R.review_full(_review_facts(spark, sf_dir), CY, PY)
    return found.select(*SHORT, F.round("delta", 2).alias("delta"), "category", "entity_name")


_RANK = "CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END"


@query("ranked_findings", f"SELECT check_id, severity, entity_code, sub_key, return_id FROM cat ORDER BY {_RANK}, check_id, return_id, entity_code,"
       " sub_key", ctes=FOUND)
def _ranked(spark, sf_dir):
    return FI.ranked(full(spark, sf_dir)).select("check_id", "severity", "entity_code", "sub_key", "return_id")


@query("head_findings", "SELECT return_id, check_id, severity, entity_code, sub_key FROM cat QUALIFY row_number() OVER (PARTITION BY return_id"
       f" ORDER BY {_RANK}, check_id, entity_code, sub_key) <= 30", ctes=FOUND)
def _head(spark, sf_dir):
    return FI.head(full(spark, sf_dir), 30).select("return_id", "check_id", "severity", "entity_code", "sub_key")


@query("filter_findings", "SELECT return_id, check_id, entity_code, sub_key FROM cat WHERE severity IN ('HIGH', 'MEDIUM')"
       " AND category IN ('flow')", ctes=FOUND)
def _filter(spark, sf_dir):
    return FI.filter_findings(full(spark, sf_dir), ["HIGH", "MEDIUM"], ["flow"]).select(
        "return_id", "check_id", "entity_code", "sub_key")


@query("high_findings", "SELECT return_id, check_id, entity_code, sub_key FROM cat WHERE severity = 'HIGH'", ctes=FOUND)
def _high(spark, sf_dir):
    return FI.filter_findings(full(spark, sf_dir), severity=["HIGH"]).select("return_id", "check_id", "entity_code", "sub_key")


@query("distinct_filters", "SELECT 'entity' AS kind, entity_code AS value FROM cat UNION SELECT 'category', category FROM cat",
       ctes=FOUND)
def _distinct(spark, sf_dir):
    return FI.distinct_filters(full(spark, sf_dir))


@query("findings_union", "SELECT category, count(*) AS findings, count(DISTINCT entity_code) AS entities FROM cat GROUP BY category",
       ctes=FOUND)
def _union(spark, sf_dir):
    return full(spark, sf_dir).groupBy("category").agg(F.expr("count(*) AS findings"), F.expr("count(DISTINCT entity_code) AS entities"))


_COUNTS = "SELECT seg AS return_id, count(*) AS entity_count FROM cust WHERE n_c > 0 GROUP BY seg"


@query("entity_count", _COUNTS)
def _entity_count(spark, sf_dir):
    return R.entity_count(X.facts(spark, sf_dir, CY, forms=[D.MAIN]), CY)


_PER = ("SELECT return_id, count(*) AS total_findings, count(*) FILTER (severity = 'HIGH') AS high,"
        " count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low,"
        " count(DISTINCT entity_code) AS entities_with_findings,"
        " count(DISTINCT CASE WHEN entity_code <> 'ALL' THEN entity_code END) AS s FROM cat GROUP BY return_id")


@query("findings_summary", "SELECT c.return_id, entity_count, total_findings, high, medium, low, entities_with_findings,"
       " entity_count - entities_with_findings AS clean_entities, entity_count - s AS clean_entities_strict"
       f" FROM ({_COUNTS}) c JOIN ({_PER}) p ON c.return_id = p.return_id", ctes=FOUND)
def _summary(spark, sf_dir):
    return FI.review_summary(full(spark, sf_dir), X.facts(spark, sf_dir, CY, forms=[D.MAIN]), CY).drop("clean_rate")


@query("clean_rate", "SELECT c.return_id, round((entity_count - entities_with_findings) / entity_count, 4) AS clean_rate"
       f" FROM ({_COUNTS}) c JOIN ({_PER}) p ON c.return_id = p.return_id", ctes=FOUND)
def _clean_rate(spark, sf_dir):
    return FI.review_summary(full(spark, sf_dir), X.facts(spark, sf_dir, CY, forms=[D.MAIN]), CY).select("return_id", "clean_rate")


@query("severity_breakdown", "SELECT return_id, severity, count(*) AS findings FROM cat GROUP BY ALL", ctes=FOUND)
def _by_severity(spark, sf_dir):
    return FI.by_severity(full(spark, sf_dir))


@query("category_breakdown", "SELECT return_id, category, count(*) AS findings FROM cat GROUP BY ALL", ctes=FOUND)
def _by_category(spark, sf_dir):
    return FI.by_category(full(spark, sf_dir))


@query("findings_by_check", "SELECT check_id, severity, count(*) AS findings FROM cat GROUP BY ALL", ctes=FOUND)
def _by_check(spark, sf_dir):
    return FI.by_check(full(spark, sf_dir))


_FPE = "(SELECT return_id, entity_code, count(*) AS n FROM cat GROUP BY ALL) f"
_STATUS = "CASE WHEN n IS NULL THEN 'Clean' ELSE concat(CAST(n AS STRING), ' issues') END AS status"


@query("findings_per_entity", f"SELECT seg AS return_id, code AS entity_code, COALESCE(n, 0) AS findings, {_STATUS} FROM cust"
       f" LEFT JOIN {_FPE} ON f.return_id = seg AND f.entity_code = code WHERE n_c > 0", ctes=FOUND)
def _per_entity(spark, sf_dir):
    f = X.facts(spark, sf_dir, CY, forms=[D.MAIN])
    marks = f.where((F.col("form") == D.MAIN) & (F.col("path") == D.MAIN)).select("return_id", "entity_code").distinct()
    return FI.per_entity(marks, full(spark, sf_dir))


@query("entity_overview", "SELECT seg AS return_id, code AS entity_code, usd_c AS ep_usd, round(CAST(fx_c AS DOUBLE), 4) AS fx_rate,"
       f" ni_c AS net_income_fc, COALESCE(n, 0) AS findings, {_STATUS} FROM cust LEFT JOIN {_FPE}"
       " ON f.return_id = seg AND f.entity_code = code WHERE n_c > 0 AND k % 31 <> 0", ctes=FOUND)
def _overview(spark, sf_dir):
    return FI.entity_overview(X.facts(spark, sf_dir), full(spark, sf_dir), CY)


@query("sign_census", _CENSUS.format("").replace("seg,", "seg AS return_id,", 1).replace("AS p,", "AS positive,").replace("AS m ", "AS negative ")
       .replace("sum(", "CAST(sum(").replace(" END) AS", " END) AS BIGINT) AS"), ctes=ENTITY)
def _sign_census(spark, sf_dir):
    return R.sign_census(X.facts(spark, sf_dir, CY, forms=[D.SCH_H]), CY)


@query("ep_ranking", "SELECT seg AS return_id, code AS entity_code, usd_c AS ep_usd, CASE WHEN usd_c >= 0 THEN 'gain' ELSE 'loss' END"
       " AS bucket FROM e WHERE hc", ctes=ENTITY)
def _ep_ranking(spark, sf_dir):
    return FI.ep_ranking(X.facts(spark, sf_dir, CY, forms=[D.SCH_H]), CY)


# joins of the rule engine --------------------------------------------------------------


def _marks(spark, sf_dir, year: int, form: str = D.MAIN) -> DataFrame:
    f = coded(X.facts(spark, sf_dir, year, forms=[form]))
    return f.where((F.col("form") == form) & (F.col("path") == form)).select("return_id", "entity_code").distinct()


@query("join_common_entities", "SELECT seg AS return_id, code AS entity_code, usd_p AS py_ep, usd_c AS cy_ep FROM e WHERE hc AND hp",
       ctes=ENTITY)
def _common(spark, sf_dir):
    m = Matrix()
    names = [m.num(s, D.SCH_H, "CurrEarnAndPrftInUSDollarsAmt") for s in ("py", "cy")]
    both = f"{m.has('py', D.SCH_H)} AND {m.has('cy', D.SCH_H)}"
    rows = build_matrix(X.facts(spark, sf_dir, forms=[D.SCH_H]), m, CY, PY).where(both)
    return rows.selectExpr("return_id", "entity_code", *[f"CAST({n} AS BIGINT) AS {a}" for n, a in zip(names, ("py_ep", "cy_ep"))])


@query("anti_added", "SELECT seg AS return_id, code AS entity_code FROM cust WHERE n_c > 0 AND n_p = 0")
def _anti_added(spark, sf_dir):
    return _marks(spark, sf_dir, CY).join(_marks(spark, sf_dir, PY), ["return_id", "entity_code"], "left_anti")


@query("anti_removed", "SELECT seg AS return_id, code AS entity_code FROM cust WHERE n_p > 0 AND n_c = 0")
def _anti_removed(spark, sf_dir):
    return _marks(spark, sf_dir, PY).join(_marks(spark, sf_dir, CY), ["return_id", "entity_code"], "left_anti")


@query("entities_intersect", "SELECT seg AS return_id, code AS entity_code FROM cust WHERE n_p > 0 AND n_c > 0")
def _intersect(spark, sf_dir):
    return _marks(spark, sf_dir, PY).intersect(_marks(spark, sf_dir, CY))


@query("entities_except", "SELECT seg AS return_id, code AS entity_code FROM cust WHERE n_p > 0 AND n_c = 0")
def _except(spark, sf_dir):
    return _marks(spark, sf_dir, PY).subtract(_marks(spark, sf_dir, CY))


@query("semi_presence", "SELECT seg AS return_id, code AS entity_code, hc AS has_h, ic AS has_i1, ec AS has_e, cyr AS has_f FROM e WHERE cyr",
       ctes=ENTITY)
def _presence(spark, sf_dir):
    forms = {"has_h": D.SCH_H, "has_i1": D.SCH_I1, "has_e": D.SCH_E, "has_f": D.SCH_F}
    f = coded(X.facts(spark, sf_dir, CY, forms=[D.MAIN, *forms.values()])).where(F.col("form").isin(D.MAIN, *forms.values()) & (F.col("path") == F.col("form")))
    return f.groupBy("return_id", "entity_code").agg(*[F.expr(f"max(form = '{x}') AS {n}") for n, x in forms.items()])


@query("range_join_fx", "SELECT seg AS return_id, code AS entity_code, fx_c AS rate, CASE "
       + " ".join(f"WHEN rc_ >= CAST({lo * 0.7!r} AS DOUBLE) AND rc_ <= CAST({hi * 1.3!r} AS DOUBLE) THEN '{c}'" for c, lo, hi in D.FX_BANDS)
       + " END AS currency FROM e WHERE hc AND rc_ > 0", ctes=ENTITY)
def _range_join(spark, sf_dir):
    rate = f"{D.SCH_H}_ExchangeRt"
    f = X.facts(spark, sf_dir, CY, forms=[D.SCH_H]).where((F.col("form") == D.SCH_H) & (F.col("path") == rate))
    f = f.withColumn("fx", F.expr("try_cast(value AS DOUBLE)")).where("fx > 0")
    return f.selectExpr("return_id", "entity_code", "value AS rate", f"({fx_band('fx')}).currency AS currency")


@query("entity_name_lookup", "SELECT seg AS return_id, code AS entity_code, CASE WHEN n_c > 0 THEN name_c ELSE name_p END AS entity_name FROM cust")
def _names(spark, sf_dir):
    return entity_names(X.facts(spark, sf_dir, forms=[D.MAIN]), CY, PY)


@query("dup_key_guard", "SELECT seg AS return_id, code AS entity_code, CASE WHEN k % 2 <> 0 THEN 1 WHEN k % 24 = 0 THEN 2 ELSE 3 END AS n_rows,"
       " CASE WHEN k % 2 <> 0 THEN CAST(ba_c AS STRING) END AS value FROM cust WHERE n_c > 0")
def _dup_guard(spark, sf_dir):
    path = f"{D.SCH_J}_Post2017EPNotPrevTaxedGrp_{D.J_BOY}"
    f = X.facts(spark, sf_dir, CY, forms=[D.SCH_J]).where((F.col("form") == D.SCH_J) & (F.col("path") == path))
    out = single_or_null(f.select("return_id", "entity_code", "value"), ["return_id", "entity_code"], "value")
    return out.select("return_id", "entity_code", F.col("n_rows").cast("int").alias("n_rows"), "value")


@query("blank_codes", "SELECT seg AS return_id, k AS sub_no, name_c AS entity_name FROM cust WHERE n_c > 0 AND k % 83 = 0")
def _blank_codes(spark, sf_dir):
    f = X.facts(spark, sf_dir, CY).withColumn("entity_code", F.expr("CASE WHEN sub_no % 83 = 0 THEN ' ' ELSE entity_code END"))
    return R.blank_codes(f, CY)


