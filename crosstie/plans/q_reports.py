"""Queries of comparisons, rollover reports, pools and form comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie.operators import compare as CP
from crosstie.operators import forms as FV
from crosstie.operators import pools as P
from crosstie.operators import reshape as RS
from crosstie.operators import rollover as RO
from crosstie.plans import fixture as X
from crosstie.plans.q_sources import amount_sql
from crosstie.plans.registry import query

PY, CY = X.PY, X.CY


def _facts(spark, sf_dir, *forms: str):
    return X.facts(spark, sf_dir, forms=forms or None)


# comparison by name ---------------------------------------------------------------------

# entities renamed in the current year have no partner of the same name
_CMP = f"""v AS (SELECT seg, name, side, path, value FROM facts WHERE path <> form AND instance = 1),
nm AS (SELECT DISTINCT seg, name, side FROM facts),
j AS (SELECT COALESCE(a.seg, b.seg) AS seg, COALESCE(a.name, b.name) AS name, COALESCE(a.path, b.path) AS path,
  COALESCE(a.value, 'nan') AS o, COALESCE(b.value, 'nan') AS n FROM (SELECT * FROM v WHERE side = 'p') a
  FULL JOIN (SELECT * FROM v WHERE side = 'c') b ON a.seg = b.seg AND a.name = b.name AND a.path = b.path),
ch0 AS (SELECT j.*, CASE WHEN o IN ('', 'nan') THEN 0 ELSE TRY_CAST(o AS DOUBLE) END AS o_num,
  CASE WHEN n IN ('', 'nan') THEN 0 ELSE TRY_CAST(n AS DOUBLE) END AS n_num FROM j
  JOIN nm a ON a.seg = j.seg AND a.name = j.name AND a.side = 'p' JOIN nm b ON b.seg = j.seg AND b.name = j.name AND b.side = 'c'
  WHERE o <> n AND NOT (o IN ('', 'nan') AND n IN ('', 'nan'))),
ch AS (SELECT seg AS return_id, name AS entity_name, path AS field, o AS old_value, n AS new_value, CAST(n_num - o_num AS DOUBLE) AS numeric_diff,
  COALESCE(abs(n_num - o_num) > 1000, false) AS material FROM ch0),
added AS (SELECT seg, name FROM nm WHERE side = 'c' EXCEPT SELECT seg, name FROM nm WHERE side = 'p'),
removed AS (SELECT seg, name FROM nm WHERE side = 'p' EXCEPT SELECT seg, name FROM nm WHERE side = 'c'),
tbl AS (SELECT * FROM ch UNION ALL SELECT seg, name, '(entity added)', '', 'NEW', NULL, true FROM added
  UNION ALL SELECT seg, name, '(entity removed)', 'REMOVED', '', NULL, true FROM removed)"""
_CMP_FORMS = [D.MAIN, D.SCH_H, D.SCH_I1, D.SCH_E, D.SCH_J]


@query("compare_returns", "SELECT * FROM ch", facts=_CMP_FORMS, ctes=_CMP)
def _compare(spark, sf_dir):
    return CP.compare_returns(_facts(spark, sf_dir), PY, CY)


def _table(spark, sf_dir):
    return CP.compare_table(_facts(spark, sf_dir), PY, CY)


@query("compare_table", "SELECT * FROM tbl", facts=_CMP_FORMS, ctes=_CMP)
def _compare_table(spark, sf_dir):
    return _table(spark, sf_dir)


_NOT = "field NOT IN ('(entity added)', '(entity removed)')"


@query("compare_summary", "SELECT return_id, count(*) FILTER (field = '(entity added)') AS entities_added, count(*) FILTER (field = '(entity removed)')"
       f" AS entities_removed, count(DISTINCT CASE WHEN {_NOT} THEN entity_name END) AS entities_modified, count(*) FILTER ({_NOT}) AS field_changes,"
       f" count(*) FILTER ({_NOT} AND material) AS material_changes FROM tbl GROUP BY return_id", facts=_CMP_FORMS, ctes=_CMP)
def _compare_summary(spark, sf_dir):
    return CP.compare_summary(_table(spark, sf_dir))


@query("topk_material", "SELECT * FROM ch WHERE material QUALIFY row_number() OVER (PARTITION BY return_id ORDER BY entity_name, field) <= 50", facts=_CMP_FORMS, ctes=_CMP)
def _topk_material(spark, sf_dir):
    return CP.top_material(CP.compare_returns(_facts(spark, sf_dir), PY, CY), 50)


_H_DIM = "(VALUES " + ", ".join(f"('{D.SCH_H}_{f.name}', '{f.line}', '{f.description}', '{f.type}', '{f.sign or ''}')" for f in D.fields_of(D.SCH_H)) \
    + ") d(field, line, description, type, sign)"


def _shown(v: str) -> str:
    return (f"CASE WHEN {v} IN ('', 'nan') THEN '—' WHEN type = 'rate' THEN format('{{:.7f}}', CAST({v} AS DOUBLE)) WHEN type = 'amount' THEN "
            f"CASE WHEN sign <> '' THEN {amount_sql(f'TRY_CAST({v} AS BIGINT)', 'x')} ELSE {amount_sql(f'TRY_CAST({v} AS BIGINT)', None)} END ELSE {v} END").replace(
                f"TRY_CAST({v} AS BIGINT) = ''", "false")


_SGN = "(numeric_diff * CASE WHEN sign <> '' THEN -1 ELSE 1 END)"


@query("compare_display", f"SELECT return_id, left(entity_name, 25) AS entity, c.field, COALESCE(line, '?') AS line, left(COALESCE(description, replace(c.field, '{D.SCH_H}_', '')), 30)"
       f" AS description, {_shown('old_value')} AS prior, {_shown('new_value')} AS \"current\", (CASE WHEN {_SGN} >= 0 THEN '+' ELSE '' END) || CASE WHEN abs({_SGN}) >= 1000000 THEN"
       f" format('{{:,.2f}}', {_SGN} / 1000000) || 'M' ELSE format('{{:,.1f}}', {_SGN} / 1000) || 'K' END AS change FROM (SELECT * FROM ch WHERE material"
       f" QUALIFY row_number() OVER (PARTITION BY return_id ORDER BY entity_name, field) <= 50) c LEFT JOIN {_H_DIM} ON d.field = c.field", facts=[D.SCH_H], ctes=_CMP)
def _display(spark, sf_dir):
    changes = CP.compare_returns(_facts(spark, sf_dir), PY, CY, forms=(D.SCH_H,))
    return CP.compare_display(changes, FV.field_dim(spark))


# reports -----------------------------------------------------------------------------------

#: matched pairs: the code decides, and every customer keeps its code
_PAIR = "n_p > 0 AND n_c > 0"


def _items(report: str, rows: list[tuple[str, str, str, str]], limit: str | None, changed: bool = False) -> str:
    """Report lines (description, line, prior text, current text) of matched pairs."""
    cells = ", ".join(f"{{'description': '{d}', 'line': '{ln}', 'py_value': COALESCE({p}, ''), 'cy_value': COALESCE({c}, '')}}" for d, ln, p, c in rows)
    diff = "(CASE WHEN cy_value = '' THEN 0 ELSE CAST(cy_value AS DOUBLE) END - CASE WHEN py_value = '' THEN 0 ELSE CAST(py_value AS DOUBLE) END)"
    numeric = limit is not None
    passes = {None: "upper(trim(py_value)) = upper(trim(cy_value))", "": "true"}.get(limit, f"abs({diff}) < {limit}")
    if changed:
        passes = "false"
    keep = "py_value <> cy_value" if changed else "py_value <> '' OR cy_value <> ''"
    dash = "CASE WHEN {0} = '' THEN '—' ELSE {0} END AS {0}" if changed else "{0}"
    return (f"SELECT return_id, '{report}' AS report, entity_name, entity_code, description, line, {dash.format('py_value')}, {dash.format('cy_value')},"
            f" CAST({diff if numeric else '0'} AS DOUBLE) AS difference, {passes} AS passes FROM (SELECT seg AS return_id, name_p AS entity_name,"
            f" code AS entity_code, unnest([{cells}], recursive := true) FROM cust WHERE {_PAIR}) WHERE {keep}")


def _value(form: str, path: str, side: str, instance: int | None = None, cast: str = "VARCHAR") -> str:
    hits = [f for f in X.FACT_SPECS if f.form == form and f.path == path and (instance is None or f.instance == instance)]
    if not hits or getattr(hits[-1], side) is None:
        return "CAST(NULL AS VARCHAR)"
    return f"CAST({getattr(hits[-1], side)} AS {cast})"


def _f_value(concept_tag: str, side: str) -> str:
    child, inline = _value(D.SCH_F, concept_tag, side), _value(D.MAIN, f"{D.SCH_F}_{concept_tag}", side)
    return f"COALESCE({child}, {inline})"


_F_ROWS = [(d, "", _f_value(D.end_tag(c), "p"), _f_value(D.begin_tag(c), "c")) for c, _, d in D.BALANCE_PAIRS]
_J_ROWS = [  # the last basket filed: the total where there are several
    (d, "J", *[f"CASE WHEN k % 2 = 0 THEN {_value(D.SCH_J, f'{p}_{leaf}', s, 3)} ELSE {_value(D.SCH_J, f'{p}_{leaf}', s, 1)} END"
               for s, leaf in (("p", D.J_EOY), ("c", D.J_BOY))]) for p, d in D.RULE_POOLS]
_P1_ROWS = [(d, ln, _value(D.MAIN, f, "p"), _value(D.MAIN, f, "c")) for f, d, ln in D.PAGE1_FIELDS]
_H_ROWS = [(d, ln, _value(D.SCH_H, f, "p"), _value(D.SCH_H, f, "c")) for f, d, ln in D.EP_MOVEMENT_FIELDS]
_I1_ROWS = [(d, ln, _value(D.SCH_I1, f, "p"), _value(D.SCH_I1, f, "c")) for f, d, ln in D.GILTI_FIELDS]
_G_ROWS = [(d, ln, _value(D.MAIN, f"{D.SCH_G}_{f}", "p"), _value(D.MAIN, f"{D.SCH_G}_{f}", "c")) for f, d, ln in D.INDICATOR_REPORT_FIELDS]
_CHANGES = ("SELECT seg AS return_id, 'Entity Changes' AS report, name_c AS entity_name, code AS entity_code, 'NEW ENTITY (not in prior year)' AS description,"
            " '—' AS line, '' AS py_value, concat(CASE WHEN k % 79 = 0 THEN 'ZZ' ELSE country END, ' | ', ccy_c) AS cy_value, CAST(0 AS DOUBLE) AS difference, false AS passes"
            " FROM cust WHERE n_p = 0 AND n_c > 0 UNION ALL SELECT seg, 'Entity Changes', name_p, code, 'REMOVED (final return or liquidated)', '—',"
            " concat(country, ' | ', ccy_p), '', 0, false FROM cust WHERE n_p > 0 AND n_c = 0")
REPORT_SQL = {
    "schf_rollover": _items(D.REPORTS[0], _F_ROWS, "1"), "schj_rollover": _items(D.REPORTS[1], _J_ROWS, "1"),
    "page1_rollover": _items(D.REPORTS[2], _P1_ROWS, None), "ep_movement": _items(D.REPORTS[3], _H_ROWS, ""),
    "gilti_comparison": _items(D.REPORTS[4], _I1_ROWS, ""), "entity_changes": _CHANGES,
    "schg_changes": _items(D.REPORTS[6], _G_ROWS, None, changed=True),
}
for _name, _fn, *_more in (("schf_rollover", RO.schf_rollover, D.SCH_F), ("schj_rollover", RO.schj_rollover, D.SCH_J), ("page1_rollover", RO.page1_rollover),
                           ("ep_movement", RO.ep_movement, D.SCH_H), ("gilti_comparison", RO.gilti_comparison, D.SCH_I1), ("entity_changes", RO.entity_changes),
                           ("schg_changes", RO.schg_changes)):
    query(_name, REPORT_SQL[_name])(lambda spark, sf_dir, fn=_fn, more=_more: fn(_facts(spark, sf_dir, D.MAIN, *more), PY, CY))

_FULL = "items AS (" + " UNION ALL ".join(f"({q})" for q in REPORT_SQL.values()) + ")"


def items(spark, sf_dir):
    """Lines of the seven-report package; who reads them once makes them on the way and stores none."""
    return RO.full_review(_facts(spark, sf_dir, *RO.review_forms()), PY, CY)


@query("full_review", "SELECT * FROM items", ctes=_FULL)
def _full(spark, sf_dir):
    return items(spark, sf_dir)


_AGG = ("count(*) AS checks, count(*) FILTER (passes) AS passed, count(*) FILTER (NOT passes) AS failed,"
        " count(DISTINCT CASE WHEN NOT passes THEN concat(return_id, '|', entity_name) END) AS entities_with_issues")
_SUMMARY = f"(SELECT report, {_AGG} FROM items GROUP BY report UNION ALL SELECT 'TOTAL', {_AGG} FROM items)"


@query("rollover_summary", "SELECT *, CASE WHEN failed = 0 THEN 'CLEAN' ELSE concat(CAST(failed AS STRING), ' issues') END AS status,"
       f" round(100 * passed / greatest(checks, 1), 1) AS pass_rate FROM {_SUMMARY}", ctes=_FULL)
def _rollover_summary(spark, sf_dir):
    return RO.rollover_summary(items(spark, sf_dir))


@query("pass_rate", f"SELECT report, round(100 * passed / greatest(checks, 1), 1) AS pass_rate FROM {_SUMMARY}", ctes=_FULL)
def _pass_rate(spark, sf_dir):
    return RO.rollover_summary(items(spark, sf_dir)).select("report", "pass_rate")


_F_DIFF = f"(SELECT *, difference AS dd FROM ({REPORT_SQL['schf_rollover']}))"


@query("schf_rollover_banded", "SELECT return_id, entity_name, entity_code, description, CASE WHEN py_value = '' THEN 0 ELSE CAST(py_value AS DOUBLE) END AS py_ending,"
       " CASE WHEN cy_value = '' THEN 0 ELSE CAST(cy_value AS DOUBLE) END AS cy_beginning, difference, CASE WHEN difference = 0 THEN 'PASS' ELSE 'FAIL' END AS status,"
       " CASE WHEN abs(difference) < 10 THEN 'OK' ELSE 'Review' END AS review, CASE WHEN difference = 0 THEN '' WHEN abs(difference) < 10 THEN 'immaterial'"
       f" ELSE 'material' END AS severity FROM {_F_DIFF}")
def _banded(spark, sf_dir):
    return RO.schf_rollover_banded(_facts(spark, sf_dir, D.MAIN, D.SCH_F), PY, CY)


_FOOT = {c: f"COALESCE(TRY_CAST({_value(D.SCH_F, D.end_tag(c), 'c')} AS DOUBLE), 0)" for c, _, _ in D.BALANCE_PAIRS}
_ORDER = [c for c, _, _ in D.BALANCE_PAIRS]


@query("schf_footing", "SELECT *, total - parts AS difference, CASE WHEN abs(total - parts) < 1 THEN 'OK' ELSE 'Review' END AS status FROM ("
       "SELECT seg AS return_id, code AS entity_code, unnest([" + ", ".join(
           f"{{'check': '{n}', 'total': {t}, 'parts': {p}}}" for n, t, p in (
               ("assets", _FOOT["TotalAssets"], " + ".join(_FOOT[c] for c in _ORDER[:8])),
               ("liabilities and equity", _FOOT["TotLiabShrEqty"], " + ".join(_FOOT[c] for c in _ORDER[9:15])),
               ("balance", _FOOT["TotalAssets"], _FOOT["TotLiabShrEqty"]))) + "], recursive := true) FROM cust WHERE n_c > 0)")
def _footing(spark, sf_dir):
    return RO.schf_footing(_facts(spark, sf_dir, D.MAIN, D.SCH_F), CY)


@query("page1_14", _items(D.REPORTS[2], [(d, ln, _value(D.MAIN, f, "p"), _value(D.MAIN, f, "c")) for f, d, ln in D.PAGE1_FORM_ORDER], None))
def _page1_14(spark, sf_dir):
    return RO.page1_rollover(_facts(spark, sf_dir, D.MAIN), PY, CY, D.PAGE1_FORM_ORDER)


_EXACT_ROWS = ", ".join(
    f"{{'line': '{ln}', 'description': '{d}', 'py_value': COALESCE({_value(D.SCH_F, D.end_tag(c), 'p')}, ''), 'cy_value': COALESCE({_value(D.SCH_F, D.begin_tag(c), 'c')}, '')}}"
    for c, ln, d in D.BALANCE_PAIRS)
_EXACT = (f"exact AS (SELECT *, CASE WHEN abs(COALESCE(TRY_CAST(py_value AS DOUBLE), 0) - COALESCE(TRY_CAST(cy_value AS DOUBLE), 0)) < 0.01 THEN 'PASS' ELSE 'FAIL' END AS status"
          f" FROM (SELECT seg AS return_id, code AS entity_code, unnest([{_EXACT_ROWS}], recursive := true) FROM cust WHERE {_PAIR}))")


@query("rollover_exact", "SELECT * FROM exact", ctes=_EXACT)
def _exact(spark, sf_dir):
    return RO.rollover_exact(_facts(spark, sf_dir, D.MAIN, D.SCH_F), PY, CY)


@query("rollover_mismatches", "SELECT return_id, entity_code, m AS mismatches, CASE WHEN m = 0 THEN 'ALL LINES MATCH' ELSE concat(CAST(m AS STRING), ' MISMATCH(ES)') END AS result"
       " FROM (SELECT return_id, entity_code, count(*) FILTER (status = 'FAIL') AS m FROM exact GROUP BY ALL)", ctes=_EXACT)
def _mismatches(spark, sf_dir):
    return RO.mismatch_count(RO.rollover_exact(_facts(spark, sf_dir, D.MAIN, D.SCH_F), PY, CY))


@query("join_entity_fallback", "SELECT p.seg AS return_id, p.code AS entity_code, COALESCE(r.code, n.code) AS matched_code FROM (SELECT * FROM cust WHERE n_p > 0) p"
       " LEFT JOIN (SELECT seg, CASE WHEN k % 5 = 0 THEN concat(code, 'X') ELSE code END AS code, name_c FROM cust WHERE n_c > 0) r ON r.seg = p.seg AND r.code = p.code"
       " LEFT JOIN (SELECT seg, CASE WHEN k % 5 = 0 THEN concat(code, 'X') ELSE code END AS code, name_c FROM cust WHERE n_c > 0) n ON n.seg = p.seg AND lower(n.name_c) = lower(p.name_p)"
       " WHERE COALESCE(r.code, n.code) IS NOT NULL")
def _fallback(spark, sf_dir):
    # some entities get another code in the current year and are found by name
    f = _facts(spark, sf_dir, D.MAIN)
    new = f.withColumn("entity_code", F.expr("CASE WHEN sub_no % 5 = 0 THEN concat(entity_code, 'X') ELSE entity_code END"))
    pairs = RO.match_entities(RO.entity_rows(f, PY, {}), RO.entity_rows(new, CY, {}).withColumn("m", F.expr("map('code', entity_code)")))
    return pairs.selectExpr("return_id", "entity_code", "c['code'] AS matched_code")


# pools -----------------------------------------------------------------------------------------


def _pool_cells(pools: list[tuple[str, str]], keep_missing: bool) -> str:
    parts = []
    for basket in ("GEN", "PAS"):
        i = 1 if basket == "GEN" else 2
        lost = "false" if basket == "GEN" else "k % 24 = 0"
        cond = "true" if basket == "GEN" else "k % 2 = 0"
        cells = ", ".join(
            f"{{'pool': '{d}', 'pool_grp': '{p}', 'py': {_value(D.SCH_J, f'{p}_{D.J_EOY}', 'p', i)}, 'cy': {_value(D.SCH_J, f'{p}_{D.J_BOY}', 'c', i)}}}" for p, d in pools)
        parts.append(f"SELECT seg AS return_id, code AS entity_code, name_p AS entity_name, k AS sub_no, {i} AS instance, '{basket}' AS basket, {lost} AS lost,"
                     f" unnest([{cells}], recursive := true) FROM cust WHERE {_PAIR} AND {cond}" + ("" if keep_missing else f" AND NOT {lost}"))
    return " UNION ALL ".join(parts)


def _basket_sql(pools: list[tuple[str, str]]) -> str:
    return ("SELECT return_id, entity_code, entity_name, sub_no, instance, basket, pool, pool_grp, COALESCE(py_, 0) AS py_ending, COALESCE(cy_, 0) AS cy_beginning,"
            " COALESCE(cy_, 0) - COALESCE(py_, 0) AS difference, CASE WHEN NOT lost AND abs(COALESCE(cy_, 0) - COALESCE(py_, 0)) < 10 THEN 'OK' ELSE 'REVIEW' END AS status"
            " FROM (SELECT *, TRY_CAST(py AS DOUBLE) AS py_, CASE WHEN NOT lost THEN TRY_CAST(cy AS DOUBLE) END AS cy_ FROM (" + _pool_cells(pools, True)
            + ")) WHERE CASE WHEN lost THEN abs(py_) >= 1 ELSE COALESCE(py_, cy_) IS NOT NULL END")


_BASKET = f"rolled AS ({_basket_sql(D.BASKET_POOLS)})"


def _rolled(spark, sf_dir):
    return P.schj_basket_rollover(_facts(spark, sf_dir, D.SCH_J), PY, CY)


@query("schj_basket_rollover", "SELECT * FROM rolled", ctes=_BASKET)
def _basket(spark, sf_dir):
    return _rolled(spark, sf_dir)


@query("join_entity_basket", "SELECT return_id, entity_code, basket, count(*) AS pools FROM rolled GROUP BY ALL", ctes=_BASKET)
def _join_basket(spark, sf_dir):
    return _rolled(spark, sf_dir).groupBy("return_id", "entity_code", "basket").agg(F.expr("count(*) AS pools"))


@query("left_missing", "SELECT return_id, entity_code, basket, pool_grp, py_ending FROM rolled WHERE basket = 'PAS' AND sub_no % 24 = 0", ctes=_BASKET)
def _left_missing(spark, sf_dir):
    pairs = P.basket_pairs(_facts(spark, sf_dir, D.SCH_J), PY, CY, [p for p, _ in D.BASKET_POOLS]).where("c IS NULL")
    cells = ", ".join(f"struct('{p}' AS pool_grp, {P.number(f'''p['{D.SCH_J}_{p}_{D.J_EOY}']''')} AS py_ending)" for p, _ in D.BASKET_POOLS)
    return pairs.selectExpr("return_id", "entity_code", "basket", f"inline(array({cells}))").where("abs(py_ending) >= 1")


@query("schj_summary", "SELECT return_id, count(DISTINCT entity_name) AS entities, count(*) AS checks, count(*) FILTER (status = 'OK') AS ok,"
       " count(*) FILTER (status = 'REVIEW') AS review, count(DISTINCT CASE WHEN status = 'REVIEW' THEN entity_name END) AS entities_with_issues FROM rolled GROUP BY 1", ctes=_BASKET)
def _schj_summary(spark, sf_dir):
    return P.schj_summary(_rolled(spark, sf_dir))


@query("schj_12_pools", _basket_sql([(p, f"{c} {d}") for p, c, d in D.REPORT_POOLS]))
def _twelve(spark, sf_dir):
    return P.schj_12_pools(_facts(spark, sf_dir, D.SCH_J), PY, CY)


_NAMES = [p for p, _, _ in D.REPORT_POOLS]


def _foot(i: int, p: str) -> str:
    return f"COALESCE(TRY_CAST({_value(D.SCH_J, f'{p}_{D.J_EOY}', 'p', i)} AS DOUBLE), 0)"


@query("schj_pool_footing", "SELECT *, total - parts AS difference, CASE WHEN abs(total - parts) < 10 THEN 'OK' ELSE 'Review' END AS status FROM (" + " UNION ALL ".join(
    f"SELECT seg AS return_id, code AS entity_code, '{b}' AS basket, {_foot(i, _NAMES[9])} AS total, {' + '.join(_foot(i, p) for p in _NAMES[:9])} AS parts"
    f" FROM cust WHERE n_p > 0 AND {cond}" for i, b, cond in ((1, "GEN", "true"), (2, "PAS", "k % 2 = 0"), (3, "TOTAL", "k % 2 = 0"))) + ")")
def _pool_footing(spark, sf_dir):
    return P.schj_pool_footing(_facts(spark, sf_dir, D.SCH_J), PY)


_DIFFS = f"""diffs AS (SELECT *, CASE WHEN contains(pool, '951') AND py_ending = 0 THEN 'new PTEP' WHEN pool_grp = 'Post2017EPNotPrevTaxedGrp' THEN 'pool a'
 WHEN pool_grp = 'Post1986UndistributedEarnGrp' THEN 'pool i' ELSE 'other' END AS diff_class FROM (
 SELECT return_id, entity_code, entity_name, sub_no, instance, basket, pool, pool_grp, COALESCE(TRY_CAST(py AS DOUBLE), 0) AS py_ending, COALESCE(TRY_CAST(cy AS DOUBLE), 0) AS cy_beginning,
 COALESCE(TRY_CAST(cy AS DOUBLE), 0) - COALESCE(TRY_CAST(py AS DOUBLE), 0) AS diff FROM ({_pool_cells(D.ANALYSIS_POOLS, False)})) WHERE abs(diff) >= 10),
nets AS (SELECT return_id, entity_code, arg_min(entity_name, sub_no) AS entity_name, {', '.join(
    f"CAST(COALESCE(sum(CASE WHEN pool_grp = '{p}' THEN diff END), 0) AS DOUBLE) AS pool_{x}" for x, (p, _) in zip('aceij', D.ANALYSIS_POOLS))} FROM diffs GROUP BY 1, 2)"""


def _diffs(spark, sf_dir):
    return P.diff_analysis(_facts(spark, sf_dir, D.SCH_J), PY, CY)


@query("schj_diff_analysis", "SELECT * FROM diffs", ctes=_DIFFS)
def _diff_analysis(spark, sf_dir):
    return _diffs(spark, sf_dir)


@query("sort_abs_diff", "SELECT return_id, entity_code, basket, pool_grp, diff FROM diffs ORDER BY abs(diff) DESC, return_id, entity_code, basket, pool_grp", ctes=_DIFFS)
def _sort_abs(spark, sf_dir):
    order = [F.abs("diff").desc(), "return_id", "entity_code", "basket", "pool_grp"]
    return _diffs(spark, sf_dir).select("return_id", "entity_code", "basket", "pool_grp", "diff").orderBy(*order)


@query("diff_by_category", "SELECT diff_class, count(*) AS entries, count(DISTINCT return_id || entity_code) AS entities, CAST(sum(diff) AS DOUBLE) AS total_diff FROM diffs GROUP BY 1", ctes=_DIFFS)
def _diff_cat(spark, sf_dir):
    return P.diff_by_category(_diffs(spark, sf_dir))


@query("net_by_entity", "SELECT *, pool_a + pool_c + pool_e AS net FROM nets", ctes=_DIFFS)
def _net(spark, sf_dir):
    return P.net_by_entity(_diffs(spark, sf_dir))


@query("ptep_reclass_check", "SELECT *, pool_a + new_c + new_e AS net, CASE WHEN abs(pool_a + new_c + new_e) < 100 THEN 'OK-reclass' ELSE 'GAP' END AS verdict FROM ("
       "SELECT return_id, entity_code, CAST(sum(CASE WHEN pool_grp = 'Post2017EPNotPrevTaxedGrp' THEN diff END) AS DOUBLE) AS pool_a,"
       " CAST(COALESCE(sum(CASE WHEN diff_class = 'new PTEP' AND contains(pool, 'GILTI') THEN diff END), 0) AS DOUBLE) AS new_c,"
       " CAST(COALESCE(sum(CASE WHEN diff_class = 'new PTEP' AND contains(pool, 'SubF') THEN diff END), 0) AS DOUBLE) AS new_e FROM diffs GROUP BY 1, 2) WHERE pool_a IS NOT NULL", ctes=_DIFFS)
def _ptep(spark, sf_dir):
    return P.ptep_reclass_check(_diffs(spark, sf_dir))


@query("genuine_gaps", "SELECT *, pool_a + pool_c + pool_e AS net, abs(pool_a + pool_c + pool_e) >= 100 OR abs(pool_i) >= 10 OR abs(pool_j) >= 10 AS is_gap FROM nets", ctes=_DIFFS)
def _gaps(spark, sf_dir):
    return P.genuine_gaps(_diffs(spark, sf_dir))


_TARGET = "CASE pool_grp " + " ".join(f"WHEN '{p}' THEN '{c}'" for p, c in D.POOL_IMPORT_COLUMN.items()) + " END"
_FIXED = {"Entity Number": "entity_code", "Activity Type": f"'{D.EP_ACTIVITY}'", "Basket Number": "'21'", "Basket Name": f"'{D.GENERAL_BASKET}'", "Tax Year": "'2024'",
          "Made in Tax Year": "'2024'", "Tax Year Begin": "'01/01/2024'", "Tax Year End": "'12/31/2024'", "Made in Year Begin": "'01/01/2024'", "Made in Year End": "'12/31/2024'"}


def _import_sql() -> str:
    cols = []
    for c in D.IMPORT_COLUMNS:
        v = _FIXED.get(c, f"CASE WHEN target = '{c}' THEN CAST(CAST(py_ending AS BIGINT) AS VARCHAR) ELSE '' END" if c in D.POOL_IMPORT_COLUMN.values() else "''")
        cols.append(f"{v} AS \"{c}\"")
    return f"SELECT return_id, {', '.join(cols)} FROM (SELECT *, {_TARGET} AS target FROM rolled WHERE status = 'REVIEW') WHERE target IS NOT NULL"


IMPORT_SQL, BASKET_CTE = _import_sql(), _BASKET
_AMOUNT_COLUMNS = list(D.POOL_IMPORT_COLUMN.values())


def whole_amounts(rows):
    """Amounts of the template as whole numbers, to compare them as text."""
    return rows.selectExpr(*[
        f"CASE WHEN {RS.quote(c)} IS NULL OR {RS.quote(c)} = '' THEN '' ELSE CAST(CAST({RS.quote(c)} AS DOUBLE) AS BIGINT) || '' END AS {RS.quote(c)}"
        if c in _AMOUNT_COLUMNS else f"coalesce({RS.quote(c)}, '') AS {RS.quote(c)}" for c in rows.columns])


@query("pool_correction_rows", IMPORT_SQL, ctes=_BASKET)
def _import_rows(spark, sf_dir):
    return whole_amounts(P.import_rows(_rolled(spark, sf_dir)))


# form comparison --------------------------------------------------------------------------------------


def _comparison_sql(form: str) -> str:
    inline = form == D.SCH_G
    rows = []
    for i, f in enumerate(D.fields_of(form), 1):
        p, c = ((_value(D.MAIN, f"{form}_{f.name}", s) if inline else _value(form, f.name, s)) for s in "pc")
        if f.type == "amount":
            show = [amount_sql(f"nullif({v}, '')", f.sign) for v in (p, c)]
            sg = -1 if f.sign else 1
            d = f"((COALESCE(TRY_CAST({c} AS DOUBLE), 0) - COALESCE(TRY_CAST({p} AS DOUBLE), 0)) * {sg})"
            plus = f"(CASE WHEN {d} >= 0 THEN '+' ELSE '' END)"
            diff = (f"CASE WHEN {d} = 0 THEN '—' WHEN abs({d}) >= 1000000 THEN {plus} || format('{{:,.2f}}', {d} / 1000000) || 'M'"
                    f" WHEN abs({d}) >= 1000 THEN {plus} || format('{{:,.1f}}', {d} / 1000) || 'K' ELSE {plus} || format('{{:,.0f}}', {d}) END")
        elif f.type == "indicator":
            show = [f"CASE WHEN COALESCE({v}, '') = '' THEN '—' WHEN {v} IN ('X', '1', 'true', 'Y') THEN 'Yes' WHEN {v} IN ('0', 'false', 'N') THEN 'No' ELSE {v} END" for v in (p, c)]
            diff = f"CASE WHEN ({show[0]}) <> ({show[1]}) THEN 'CHANGED' ELSE '—' END"
        elif f.type == "rate":
            show = [f"CASE WHEN {v} IS NULL THEN '—' ELSE format('{{:.7f}}', CAST({v} AS DOUBLE)) END" for v in (p, c)]
            diff = "'—'"
        else:
            show, diff = [f"COALESCE(nullif({v}, ''), '—')" for v in (p, c)], "'—'"
        rows.append(f"{{'line_no': {i}, 'line': '{f.line}', 'description': '{f.description}', 'py_value': {show[0]}, 'cy_value': {show[1]}, 'diff': {diff}}}")
    filed = {D.SCH_H: "k % 31 <> 0", D.SCH_I1: "k % 7 <> 0", D.SCH_E: "k % 9 <> 0", D.SCH_I: "k % 12 <> 0"}.get(form, "true")
    return f"SELECT seg AS return_id, code AS entity_code, unnest([{', '.join(rows)}], recursive := true) FROM cust WHERE {_PAIR} AND {filed}"


for _key, _form in (("h", D.SCH_H), ("c", D.SCH_C), ("f", D.SCH_F), ("i1", D.SCH_I1), ("e", D.SCH_E), ("g", D.SCH_G), ("i", D.SCH_I)):
    query(f"form_comparison_{_key}", _comparison_sql(_form))(
        lambda spark, sf_dir, form=_form: FV.form_comparison(_facts(spark, sf_dir, D.MAIN, D.MAIN if form == D.SCH_G else form), form, PY, CY))
