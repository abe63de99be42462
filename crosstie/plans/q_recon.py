"""Queries of reconciliations, corrections, sinks and the stream run."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie import workbook_dims as W
from crosstie.operators import corrections as C
from crosstie.operators import pools as P
from crosstie.operators import reconcile as RC
from crosstie.operators.reshape import quote
from crosstie.plans import fixture as X
from crosstie.plans import inputs as I
from crosstie.plans import q_reports as QR
from crosstie.plans import q_rules as QU
from crosstie.plans.q_sources import _LISTED, EXPORT, TARGETS
from crosstie.plans.registry import query
from crosstie.plans.store import stored_table
from crosstie.session import shared_dir
from crosstie.sinks import tables as S
from crosstie.sources import grid
from crosstie.streaming.single_year import current, stream_single_year

PY, CY = X.PY, X.CY


def _wb_facts(spark, sf_dir):
    """Workbook matrix cells as facts; the book name starts with the return."""
    def build():
        rows = grid.matrix_schedules(I.grid_cells(spark, sf_dir), list(D.RECON_SCHEDULES))
        return rows.selectExpr("split(workbook_id, '-')[0] AS return_id", "schedule", "entity_code", "field", "value")

    return stored_table(spark, sf_dir, "wb_facts", build)


def _field_lines() -> dict[str, str]:
    out: dict[str, str] = {}
    for f in D.FIELDS:
        out.setdefault(f.name, f.line)
    return out


def _xml_fields(schedule: str) -> dict[str, str]:
    """Current-year SQL value of every field a schedule can be compared on."""
    form, prefix = D.RECON_SCHEDULES[schedule]
    inner = prefix[len(form) + 1:]
    return {f.path[len(inner):]: f.c for f in X.FACT_SPECS
            if f.form == form and f.path.startswith(inner) and f.path and f.c is not None}


_FILED = {"sch_h_fc": "k % 31 <> 0", "sch_i1_fc": "k % 7 <> 0", "sch_i": "k % 12 <> 0", "sch_c_fc": "true", "sch_f_usd": "true", "sch_e": "k % 9 <> 0"}


def _recon_sql() -> str:
    parts = []
    for s in D.RECON_SCHEDULES:
        xml = _xml_fields(s)
        fields = [f for _, _, f in W.MATRIX_LAYOUTS[s].lines if f in xml]
        cells = ", ".join(
            f"{{'field_name': '{f}', 'line': '{_field_lines().get(f, '')}', 'wb_value': CAST(COALESCE({I.WB_CELLS[s].get(f, 'NULL')}, '0') AS VARCHAR),"
            f" 'xml_value': CASE WHEN n_c > 0 AND {_FILED[s]} THEN CAST({xml[f]} AS VARCHAR) END}}" for f in fields)
        parts.append(f"SELECT seg AS return_id, code AS entity_code, '{s}' AS schedule, n_c > 0 AND {_FILED[s]} AS filed, unnest([{cells}], recursive := true) FROM {_LISTED}")
    return ("recon0 AS (SELECT *, TRY_CAST(wb_value AS DOUBLE) AS w, TRY_CAST(xml_value AS DOUBLE) AS x FROM (" + " UNION ALL ".join(parts) + ")),\n"
            "recon AS (SELECT return_id, entity_code, schedule, field_name, line, wb_value, xml_value, CASE WHEN filed AND w IS NOT NULL AND (xml_value IS NOT NULL OR w <> 0)"
            " AND (xml_value IS NULL OR x IS NOT NULL) THEN abs(w - COALESCE(x, 0)) END AS delta, CASE WHEN NOT filed THEN 'XML_MISSING' WHEN xml_value IS NULL AND w = 0 THEN 'DORMANT_OK'"
            " WHEN w IS NULL OR (xml_value IS NOT NULL AND x IS NULL) THEN CASE WHEN trim(wb_value) = trim(COALESCE(xml_value, 'nan')) THEN 'PASS' ELSE 'TYPE_MISMATCH' END"
            " WHEN abs(w - COALESCE(x, 0)) <= 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM recon0)")


_RECON = _recon_sql()


def _recon_facts(spark, sf_dir):
    return X.facts(spark, sf_dir, CY, forms={form for form, _ in D.RECON_SCHEDULES.values()})


def _results(spark, sf_dir):
    return stored_table(spark, sf_dir, "recon_results", lambda: RC.reconcile(_wb_facts(spark, sf_dir), _recon_facts(spark, sf_dir), CY))


@query("reconcile", "SELECT * REPLACE (round(delta, 2) AS delta) FROM recon", ctes=_RECON)
def _reconcile(spark, sf_dir):
    return RC.reconcile(_wb_facts(spark, sf_dir), _recon_facts(spark, sf_dir), CY).withColumn("delta", F.round("delta", 2))


_RS = ("count(*) AS total, count(*) FILTER (status = 'PASS') AS pass_count, count(*) FILTER (status = 'FAIL') AS fail_count,"
       " count(*) FILTER (status = 'DORMANT_OK') AS dormant_ok, count(*) FILTER (status = 'XML_MISSING') AS xml_missing")
_RECON_SUM = f"SELECT *, round(COALESCE((pass_count + dormant_ok) / nullif(total - xml_missing, 0), 0), 4) AS pass_rate FROM (SELECT schedule, {_RS} FROM recon GROUP BY 1" \
             f" UNION ALL SELECT 'ALL', {_RS} FROM recon)"


@query("recon_summary", _RECON_SUM, ctes=_RECON)
def _recon_summary(spark, sf_dir):
    return RC.recon_summary(_results(spark, sf_dir))


@query("topk_failures", "SELECT return_id, entity_code, schedule, field_name, status FROM recon WHERE status = 'FAIL' QUALIFY row_number() OVER (PARTITION BY return_id ORDER BY schedule, entity_code, field_name) <= 15", ctes=_RECON)
def _topk_failures(spark, sf_dir):
    return RC.top_failures(_results(spark, sf_dir), 15).select("schedule", "return_id", "entity_code", "field_name", "status")


@query("reconcile_wb_missing", "SELECT c.seg AS return_id, s.schedule, c.code AS entity_code, 'WB_MISSING' AS status FROM cust c, (VALUES "
       + ", ".join(f"('{s}')" for s in D.RECON_SCHEDULES) + f") s(schedule) WHERE c.n_c > 0 AND (c.seg, c.k) NOT IN (SELECT (seg, k) FROM {_LISTED}) AND CASE s.schedule "
       + " ".join(f"WHEN '{s}' THEN {c}" for s, c in _FILED.items()) + " END")
def _wb_missing(spark, sf_dir):
    return RC.workbook_missing(_wb_facts(spark, sf_dir), _recon_facts(spark, sf_dir), CY)


# line compares ------------------------------------------------------------------------


def _lines_sql(schedule: str) -> str:
    form = D.SCH_C if schedule == "C" else D.SCH_F
    by_path = {f.path: f.c for f in X.FACT_SPECS if f.form == D.MAIN}
    rows = [(sl, ln, d, by_path[f"{form}_{t}"]) for _, t, sl, ln, d in D.line_columns(schedule) if f"{form}_{t}" in by_path]
    cells = ", ".join(f"{{'line': '{ln}', 'slice': '{sl}', 'description': '{d}', 'xml_value': CAST({v} AS DOUBLE)}}" for sl, ln, d, v in rows)
    shift = "CASE WHEN k % 6 = 1 THEN 3 ELSE 0 END"
    return (f"SELECT return_id, entity_name, entity_code, line, slice, description, xml_value, xml_value + {shift} AS wb_value, CAST(-({shift}) AS DOUBLE) AS difference, 'DIFF' AS status"
            f" FROM (SELECT seg AS return_id, name_c AS entity_name, code AS entity_code, k, unnest([{cells}], recursive := true) FROM cust WHERE n_c > 0 AND k % 10 <> 3)"
            f" WHERE k % 6 = 1 AND xml_value IS NOT NULL UNION ALL SELECT seg, name_c, code, 'ALL', '', 'Entity in XML but NOT in workbook', NULL, NULL, NULL, 'MISSING_WB'"
            " FROM cust WHERE n_c > 0 AND k % 10 = 3")


def _compare_lines(spark, sf_dir, schedule):
    return RC.line_compare(X.facts(spark, sf_dir, CY, forms=[D.MAIN]), I.wb_lines(spark, sf_dir, schedule), CY, schedule)


@query("schc_compare", _lines_sql("C"))
def _schc(spark, sf_dir):
    return _compare_lines(spark, sf_dir, "C")


@query("schf_compare", _lines_sql("F"))
def _schf(spark, sf_dir):
    return _compare_lines(spark, sf_dir, "F")


@query("schcf_summary", "SELECT schedule, count(*) FILTER (status = 'DIFF') AS diffs, count(*) FILTER (status = 'MISSING_WB') AS missing_wb FROM ("
       f"SELECT 'C' AS schedule, status FROM ({_lines_sql('C')}) UNION ALL SELECT 'F', status FROM ({_lines_sql('F')})) GROUP BY 1")
def _schcf(spark, sf_dir):
    return RC.line_compare_summary(_compare_lines(spark, sf_dir, "C"), _compare_lines(spark, sf_dir, "F"))


@query("ep_to_schj_tieout", "SELECT seg AS return_id, code AS entity_code, name_c AS entity_name, ccy_c AS currency, CAST(l3 AS DOUBLE) AS xml_line3, CAST(fc AS DOUBLE) AS wb_ep_fc,"
       " CAST(l3 + fc AS DOUBLE) AS difference, CASE WHEN abs(l3 + fc) < 500 THEN 'OK' ELSE 'DIFF' END AS status FROM (SELECT *, -ep_c + CASE WHEN k % 25 = 0 THEN 700 ELSE 0 END AS l3,"
       " ep_c + CASE WHEN k % 28 = 0 THEN 600 ELSE 0 END AS fc FROM cust WHERE n_c > 0 AND k % 2 = 0 AND k % 26 <> 0 AND k % 40 <> 0 AND k % 45 <> 0)")
def _tieout(spark, sf_dir):
    return RC.ep_tieout(X.facts(spark, sf_dir, CY, forms=[D.SCH_J]), I.ep_summary(spark, sf_dir), CY)


# corrections ----------------------------------------------------------------------------

_COL = {c: f"a{i}" for i, c in enumerate(D.BALANCE_COLUMNS)}
_POOL_SUM = {p: " + ".join(_COL[c] for c in cols) for p, cols in D.POOL_BALANCE_COLUMNS.items()}
_TOTALS = "totals AS (" + " UNION ALL ".join(
    f"SELECT seg, k, code, basket_name, '{p}' AS pool, sum({x}) AS total FROM export GROUP BY 1, 2, 3, 4" for p, x in _POOL_SUM.items()) + ")"
_OLD = "old AS (" + " UNION ALL ".join(
    f"SELECT seg, k, basket_name, '{p}' AS pool, {_COL[D.POOL_IMPORT_COLUMN[p]]} AS old_value FROM export WHERE kind IN ('new', 'passive')" for p in D.POOL_IMPORT_COLUMN) + ")"
# names that resolve: same name on both sides; the others have no similar partner
_WANTED = "wanted AS (SELECT t.* FROM targets t WHERE k % 33 <> 0 AND k % 13 <> 0)"
_LOG = ("adj AS (SELECT w.seg AS return_id, w.k, w.code AS entity_number, w.xml_name AS name, w.basket_name, w.pool, CASE w.pool "
        + " ".join(f"WHEN '{p}' THEN '{c}'" for p, c in D.POOL_IMPORT_COLUMN.items())
        + " END AS column_adjusted, COALESCE(o.old_value, 0) AS old_value, w.target - COALESCE(t.total, 0) AS delta, COALESCE(o.old_value, 0) + w.target - COALESCE(t.total, 0) AS new_value, w.target"
          " FROM wanted w LEFT JOIN totals t ON t.seg = w.seg AND t.k = w.k AND t.basket_name = w.basket_name AND t.pool = w.pool"
          " LEFT JOIN old o ON o.seg = w.seg AND o.k = w.k AND o.basket_name = w.basket_name AND o.pool = w.pool WHERE abs(w.target - COALESCE(t.total, 0)) >= 0.5)")
_ADJ = ",\n".join([EXPORT, TARGETS, _TOTALS, _OLD, _WANTED, _LOG])


def _balances(spark, sf_dir):
    return C.ending_balances(I.export_rows(spark, sf_dir))


def _wanted(spark, sf_dir):
    return C.entity_targets(_balances(spark, sf_dir), C.name_map(I.name_rows(spark, sf_dir)), C.pool_targets(X.facts(spark, sf_dir, PY, forms=[D.SCH_J]), PY))


def _stored_wanted(spark, sf_dir):
    return stored_table(spark, sf_dir, "entity_targets", lambda: _wanted(spark, sf_dir))


@query("pool_totals", "SELECT seg AS return_id, code AS entity_number, basket_name, pool, total FROM totals", ctes=_ADJ)
def _pool_totals(spark, sf_dir):
    return C.pool_totals(_balances(spark, sf_dir))


@query("entity_targets", "SELECT seg AS return_id, code AS entity_number, xml_name AS name, basket_name, pool, target FROM wanted", ctes=_ADJ)
def _entity_targets(spark, sf_dir):
    return _wanted(spark, sf_dir)


@query("baskets_union", "SELECT seg AS return_id, code AS entity_number, basket_name FROM export UNION SELECT seg, code, basket_name FROM wanted", ctes=_ADJ)
def _baskets(spark, sf_dir):
    keys = C.LAYER_KEYS
    return _balances(spark, sf_dir).select(*keys).unionByName(_stored_wanted(spark, sf_dir).select(*keys)).distinct()


@query("latest_layer", "SELECT seg AS return_id, code AS entity_number, basket_name, CASE WHEN basket_name = '3-Passive Income' THEN '1996/EarningsProfitTaxes'"
       " WHEN k % 7 = 0 THEN '1996/Other' WHEN k % 12 = 0 THEN '1995/EarningsProfitTaxes' ELSE '1996/EarningsProfitTaxes' END AS layer FROM (SELECT DISTINCT seg, code, k, basket_name FROM export)", ctes=EXPORT)
def _latest(spark, sf_dir):
    from crosstie.operators.reshape import last_per_key

    rows = _balances(spark, sf_dir).selectExpr(*C.LAYER_KEYS, "concat(tax_year, '/', activity_type) AS layer", "row_no")
    return last_per_key(rows, C.LAYER_KEYS, ["row_no"]).drop("row_no")


@query("adjustment_log", "SELECT return_id, entity_number, name, basket_name, pool, column_adjusted, old_value, delta, new_value, target FROM adj", ctes=_ADJ)
def _log(spark, sf_dir):
    return C.adjustment_log(_balances(spark, sf_dir), _stored_wanted(spark, sf_dir), I.LAYER_YEAR)


_LAYER_COLS = "entity_number, basket_name, tax_year, activity_type"
_NEW_LAYER = ("(SELECT DISTINCT w.seg AS return_id, w.k, w.code AS entity_number, w.basket_name, 1996 AS tax_year, 'EarningsProfitTaxes' AS activity_type FROM wanted w"
              " WHERE NOT EXISTS (SELECT 1 FROM export e WHERE e.seg = w.seg AND e.k = w.k AND e.basket_name = w.basket_name AND e.kind IN ('new', 'passive')))")


@query("create_missing_layer", f"SELECT return_id, {_LAYER_COLS}, CASE WHEN basket_name = '3-Passive Income' THEN '3' ELSE '21' END AS basket_number, '01/01/1996' AS tax_year_begin,"
       f" '' AS adjustment_description, CAST(0 AS DOUBLE) AS amounts FROM {_NEW_LAYER}", ctes=_ADJ)
def _missing_layer(spark, sf_dir):
    rows = C.create_missing_layer(_balances(spark, sf_dir), _stored_wanted(spark, sf_dir), I.LAYER_YEAR)
    total = " + ".join(quote(c) for c in D.BALANCE_COLUMNS)
    return rows.selectExpr("return_id", "entity_number", "basket_name", "tax_year", "activity_type", "basket_number", "tax_year_begin",
                           "adjustment_description", f"{total} AS amounts")


def _adjusted_sql() -> str:
    sums = {p: _COL[D.POOL_IMPORT_COLUMN[p]] for p in D.POOL_IMPORT_COLUMN}
    def deltas(g: str) -> str:
        return ", ".join(f"COALESCE((SELECT sum(delta) FROM adj WHERE adj.return_id = e.{g} AND adj.k = e.k AND adj.basket_name = e.basket_name AND adj.pool = '{p}'), 0) AS d_{i}" for i, p in enumerate(sums))
    kept = ", ".join(f"{c} + CASE WHEN kind IN ('new', 'passive') THEN d_{i} ELSE 0 END AS {c}" for i, c in enumerate(sums.values()))
    made = ", ".join(f"d_{i} AS {c}" for i, c in enumerate(sums.values()))
    return (f"SELECT seg AS return_id, code AS entity_number, basket_name, tax_year, activity_type, {kept} FROM (SELECT e.*, {deltas('seg')} FROM export e)"
            f" UNION ALL SELECT return_id, entity_number, basket_name, tax_year, activity_type, {made} FROM (SELECT e.*, {deltas('return_id')} FROM {_NEW_LAYER} e)")


@query("beginning_balance_adjust", _adjusted_sql(), ctes=_ADJ)
def _adjust(spark, sf_dir):
    rows = C.adjust_balances(_balances(spark, sf_dir), _stored_wanted(spark, sf_dir), I.LAYER_YEAR)
    return rows.selectExpr("return_id", "entity_number", "basket_name", "tax_year", "activity_type",
                           *[f"{quote(c)} AS {_COL[c]}" for c in D.POOL_IMPORT_COLUMN.values()])


@query("verify_adjustment", "SELECT seg AS return_id, code AS entity_number, basket_name, pool, target AS total, target, 'PASS' AS status FROM wanted", ctes=_ADJ)
def _verify(spark, sf_dir):
    wanted = _stored_wanted(spark, sf_dir)
    return C.verify_adjustment(C.adjust_balances(_balances(spark, sf_dir), wanted, I.LAYER_YEAR), wanted)


_FUZZY = ("WITH n AS (SELECT c_custkey AS k, c_mktsegment AS return_id, upper(md5(CAST(c_custkey AS VARCHAR))) AS name FROM customer),"
          " l AS (SELECT k, return_id, CASE WHEN k % 7 = 0 THEN reverse(name) ELSE left(name, 10) || substr(name, 12) END AS short, name FROM n)")


def _fuzzy(spark, sf_dir, ratio):
    left, right = I.similar_names(spark, sf_dir)
    return C.match_names(left, right, ratio=ratio).withColumn("ratio", F.round("ratio", 4))


@query("fuzzy_name_match")
def _fuzzy_match(spark, sf_dir):
    return _fuzzy(spark, sf_dir, "matching")


@query("fuzzy_name_match_levenshtein")
def _fuzzy_lev(spark, sf_dir):
    return _fuzzy(spark, sf_dir, "levenshtein")


from crosstie.plans.registry import ORACLES  # noqa: E402

# a dropped letter leaves 31 of 32 characters matching; reversed names match nothing
ORACLES["fuzzy_name_match"] = _FUZZY + " SELECT return_id, short AS name, name AS matched, round(62.0 / 63, 4)::DOUBLE AS ratio FROM l WHERE k % 7 <> 0"
ORACLES["fuzzy_name_match_levenshtein"] = (
    _FUZZY + " SELECT return_id, short AS name, name AS matched, round(1 - levenshtein(short, name) / greatest(length(short), length(name)), 4)::DOUBLE AS ratio FROM l WHERE k % 7 <> 0")


@query("best_match", "SELECT seg AS return_id, code AS entity_number, xml_name AS matched FROM wanted GROUP BY ALL", ctes=_ADJ)
def _best(spark, sf_dir):
    names = C.name_map(I.name_rows(spark, sf_dir))
    targets = C.pool_targets(X.facts(spark, sf_dir, PY, forms=[D.SCH_J]), PY)
    codes = _balances(spark, sf_dir).select("return_id", "entity_number").distinct()
    names = names.join(codes, ["return_id", "entity_number"], "left_semi")
    match = C.match_names(names.select("return_id", F.col("entity_name").alias("name")), targets.select("return_id", F.col("xml_name").alias("name")))
    return names.join(match.withColumnRenamed("name", "entity_name"), ["return_id", "entity_name"]).select("return_id", "entity_number", "matched")


# sinks ---------------------------------------------------------------------------------------


@query("sink_csv", "SELECT report, return_id, entity_code, line, description, passes AS ok FROM items", ctes=QR._FULL)
def _sink_csv(spark, sf_dir):
    path = shared_dir(spark, "csv")
    S.write_csv_reports(QR.items(spark, sf_dir), path)
    back = spark.read.option("header", True).csv(path)
    return back.selectExpr("report", "return_id", "entity_code", "coalesce(line, '') AS line", "description", "status = 'PASS' AS ok")


@query("sink_report_tables", "SELECT report, count(*) AS n, count(*) FILTER (passes) AS passed, count(nullif(difference, 0)) AS with_difference FROM items"
       " WHERE NOT passes OR contains(report, 'Movement') OR contains(report, 'Comparison') GROUP BY 1", ctes=QR._FULL)
def _sink_tables(spark, sf_dir):
    path = shared_dir(spark, "tables")
    S.write_report_tables(QR.items(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("report").agg(
        F.expr("count(*) AS n"), F.expr("count_if(status = 'PASS') AS passed"), F.expr("count(difference) AS with_difference"))


@query("sink_findings", "SELECT 'all' AS part, check_id, count(*) AS n FROM cat GROUP BY ALL UNION ALL SELECT 'high', check_id, count(*) FROM cat WHERE severity = 'HIGH' GROUP BY ALL", ctes=QU.FOUND)
def _sink_findings(spark, sf_dir):
    path = shared_dir(spark, "findings")
    S.write_findings(QU.full(spark, sf_dir), path)

    def part(name, rows):
        return rows.groupBy("check_id").agg(F.expr("count(*) AS n")).withColumn("part", F.lit(name))

    back = spark.read.parquet(path)
    return part("all", back).unionByName(part("high", back.where("severity = 'HIGH'")))


@query("sink_recon", _RECON_SUM, ctes=_RECON)
def _sink_recon(spark, sf_dir):
    path = shared_dir(spark, "recon")
    S.write_recon(_results(spark, sf_dir), path)
    return spark.read.parquet(f"{path}/summary")


@query("sink_forms", "SELECT form, count(*) AS n, count(DISTINCT code) AS entities FROM facts"
       " WHERE path <> form AND side = 'c' GROUP BY 1", facts=[])
def _sink_forms(spark, sf_dir):
    path = shared_dir(spark, "forms")
    S.write_forms(X.facts(spark, sf_dir, CY), path)
    return spark.read.parquet(path).groupBy("form").agg(F.expr("count(*) AS n"), F.expr("count(DISTINCT entity_code) AS entities"))


@query("sink_import", QR.IMPORT_SQL.replace("SELECT return_id, ", "SELECT ", 1), ctes=QR.BASKET_CTE)
def _sink_import(spark, sf_dir):
    path = shared_dir(spark, "import")
    S.write_import(P.schj_basket_rollover(X.facts(spark, sf_dir, forms=[D.SCH_J]), PY, CY), path)
    return QR.whole_amounts(spark.read.option("header", True).csv(path).drop("return_id"))


_MD_DIFF = "CASE WHEN numeric_diff IS NULL OR numeric_diff = 0 THEN '' ELSE (CASE WHEN numeric_diff >= 0 THEN '+' ELSE '' END) || format('{:,.0f}', numeric_diff) END"


@query("sink_markdown", "SELECT CASE WHEN field = '(entity added)' THEN '- ' || entity_name ELSE '| ' || left(entity_name, 30) || ' | ' || left(field, 50) || ' | ' || left(old_value, 15)"
       f" || ' | ' || left(new_value, 15) || ' | ' || {_MD_DIFF} || ' |' END AS value FROM tbl WHERE material AND field <> '(entity removed)'", facts=QR._CMP_FORMS, ctes=QR._CMP)
def _sink_markdown(spark, sf_dir):
    path = shared_dir(spark, "markdown")
    S.write_markdown(QR._table(spark, sf_dir), path)
    return spark.read.text(path)


# stream -----------------------------------------------------------------------------------------

_BY_DOC = QU.ENTITY.replace("FROM cust)", f"FROM (SELECT * REPLACE (concat(seg, '-', CAST({I.BUCKET} AS STRING)) AS seg) FROM cust))", 1)


@query("stream_single_year", QU._ONE_YEAR, ctes=_BY_DOC)
def _stream(spark, sf_dir):
    path, out = I.document_path(spark, sf_dir), shared_dir(spark, "stream")
    schema = I.document_schema(spark, sf_dir)
    run = stream_single_year(spark, path, schema, CY, out, f"{out}-state")
    run.awaitTermination()
    return QU.short(current(spark, out, CY))
