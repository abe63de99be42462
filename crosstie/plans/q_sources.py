"""Queries of the sources and of the projections of facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie import workbook_dims as W
from crosstie.operators import attribution as A
from crosstie.operators import corrections as C
from crosstie.operators import forms as FV
from crosstie.operators import reshape as RS
from crosstie.operators.reconcile import line_lookup
from crosstie.plans import fixture as X
from crosstie.plans import inputs as I
from crosstie.plans.registry import query
from crosstie.sources import grid, xml

PY, CY = X.PY, X.CY
_DOC = f"concat(seg, '-', CAST({I.BUCKET} AS STRING))"
_SIDES = "(SELECT *, 'p' AS side, 1996 AS y, name_p AS nm, ccy_p AS ccy FROM cust WHERE n_p > 0 UNION ALL" \
         " SELECT *, 'c', 1997, name_c, ccy_c FROM cust WHERE n_c > 0)"


# XML -------------------------------------------------------------------------------


@query("scan_returns", f"SELECT {_DOC} AS filer_ein, CAST(y AS STRING) AS tax_year, count(*) AS returns, count(*) AS with_data"
       f" FROM {_SIDES} GROUP BY 1, 2")
def _scan(spark, sf_dir):
    docs = I.documents(spark, sf_dir)
    per_file = docs.records.groupBy("source_path").agg(F.expr("count(*) AS returns"), F.expr("count_if(has_return_data) AS with_data"))
    return per_file.join(docs.headers, "source_path").select("filer_ein", "tax_year", "returns", "with_data")


@query("return_header", f"SELECT {_DOC} AS filer_ein, concat(seg, ' GROUP') AS filer_name, '1120' AS return_type, CAST(y AS STRING) AS tax_year,"
       " '' AS period_begin, concat(CAST(y AS STRING), '-12-31') AS period_end, '' AS software_id, '' AS software_version,"
       f" CAST(count(*) AS INT) AS subsidiary_count, concat(CAST(y + 1 AS STRING), '-10-15') AS return_ts FROM {_SIDES} GROUP BY seg, {_DOC}, y")
def _header(spark, sf_dir):
    return xml.return_header(spark, I.document_path(spark, sf_dir)).drop("source_path")


_EIN = "CASE WHEN k % 6 = 0 THEN concat('00-', CAST(k AS STRING)) ELSE lpad(CAST(k AS STRING), 9, '0') END AS ein"
_LIST = f"{_DOC} AS filer_ein, y AS tax_year, nm AS entity_name, {_EIN}, code AS entity_code," \
        " CASE WHEN k % 3 = 0 AND side = 'c' AND k % 79 = 0 THEN 'ZZ' ELSE country END AS country_code," \
        " ccy AS functional_currency, k % 30 = 0 AS dormant"


def _with_filer(rows, headers):
    from crosstie.session import salted_lookup

    heads = headers.selectExpr("source_path", "filer_ein", "CAST(tax_year AS INT) AS tax_year")
    return salted_lookup(rows, heads, ["source_path"], "sub_no").drop("source_path", "sub_no")


@query("list_entities", f"SELECT {_LIST} FROM {_SIDES}")
def _list(spark, sf_dir):
    docs = I.documents(spark, sf_dir)
    return _with_filer(xml.listed(docs.records), docs.headers)


_CATS = "concat_ws(',', CASE WHEN k % 2 = 0 THEN '1a,1b,1c' END, '4', CASE WHEN k % 3 = 0 THEN '5a,5b,5c' END) AS categories"


@query("entity_info", f"SELECT {_LIST}, '1990-01-01' AS incorporation_date, CASE WHEN k % 4 = 0 THEN '0.75' ELSE '1' END AS voting_stock_pct,"
       f" {_CATS}, concat('City ', CAST(nat AS STRING)) AS city, true AS has_return_data FROM {_SIDES} WHERE NOT (side = 'c' AND k % 77 = 0)"
       f" UNION ALL SELECT {_LIST}, '', CASE WHEN k % 4 = 0 THEN '0.75' ELSE '1' END, {_CATS}, concat('City ', CAST(nat AS STRING)), true"
       f" FROM {_SIDES} WHERE side = 'c' AND k % 77 = 0")
def _info(spark, sf_dir):
    docs = I.documents(spark, sf_dir)
    rows = docs.records.withColumn("categories", F.array_join("category_filers", ",")).withColumn("city", F.col("address.city"))
    return _with_filer(rows.drop("category_filers", "address", "facts", "is_corrupt", "unknown"), docs.headers)


@query("flatten_facts", f"SELECT {_DOC} AS return_id, CASE side WHEN 'p' THEN 1996 ELSE 1997 END AS tax_year, code AS entity_code, form, basket,"
       " path, value, value = '' AS is_blank FROM facts WHERE path <> form", facts=[])
def _flatten(spark, sf_dir):
    rows = I.documents(spark, sf_dir).facts().where("path <> form")
    return rows.select("return_id", "tax_year", "entity_code", "form", "basket", "path", "value", "is_blank")


def _own_forms_sql() -> str:
    """Forms of the returns themselves: filer, y, form, instance, basket, path, value; and the sums they are made from."""
    sums = " UNION ALL ".join(
        f"SELECT {_DOC} AS filer, {y} AS y, {I.BUCKET} AS bucket, " + ", ".join(f"CAST(sum({v}) AS BIGINT) AS {n}" for n, v in I.form_amounts(s).items())
        + f" FROM cust WHERE n_{s} > 0 GROUP BY ALL" for s, y in X.SIDES.items())
    items = ", ".join(f"{{'form': '{f}', 'instance': {i}, 'basket': '{b}', 'path': '{f}_{t}', 'value': CAST({v} AS VARCHAR)}}" for f, i, b, t, v in I.RETURN_FORMS)
    return f"doc_sums AS ({sums}), own AS (SELECT filer, y, unnest([{items}], recursive := true) FROM doc_sums)"


OWN_FORMS = _own_forms_sql()


@query("return_forms", "SELECT filer AS return_id, y AS tax_year, form, instance, basket, path, value FROM own", ctes=OWN_FORMS)
def _return_forms(spark, sf_dir):
    rows = I.documents(spark, sf_dir).return_facts().where("path <> form AND NOT endswith(path, '_SeparateCategoryCd')")
    return rows.select("return_id", "tax_year", "form", "instance", "basket", "path", "value")


#: check -> sum of the entities
_OWN_SUM = {"8992 tested income": "income", "8993 eligible income": "elig", "1118 taxes by basket": "tax", "951A inclusion": "all_tested"}


@query("document_form_totals", "SELECT return_id, tax_year, \"check\", basket, entities, reported, reported - entities AS difference, abs(reported - entities) <= 1 AS passes FROM ("
       + " UNION ALL ".join(
           f"SELECT filer AS return_id, own.y AS tax_year, '{c}' AS \"check\", basket, CASE WHEN basket = '' THEN CAST({_OWN_SUM[c]} AS DOUBLE) ELSE 0 END AS entities,"
           f" CAST(value AS DOUBLE) AS reported FROM own JOIN doc_sums USING (filer, y) WHERE y = {CY} AND path = '{r}'" for c, _, _, r, _ in A.TOTALS) + ")", ctes=OWN_FORMS)
def _document_totals(spark, sf_dir):
    docs = I.documents(spark, sf_dir)
    return A.cross_form_totals(docs.facts().unionByName(docs.return_facts()), CY)


_DAMAGED = f"(SELECT *, {I.BUCKET} AS bucket FROM {_SIDES})"


@query("bad_files", f"SELECT {_DOC} AS filer, y AS tax_year, CASE WHEN {I.CUT} THEN 'corrupt' ELSE 'count' END AS reason, CASE WHEN {I.CUT} THEN NULL"
       f" ELSE CAST(concat('1', CAST(count(*) AS VARCHAR)) AS INT) END AS stated, CASE WHEN NOT {I.CUT} THEN count(*) END AS found FROM {_DAMAGED} WHERE {I.CUT} OR {I.MISCOUNTED}"
       f" GROUP BY seg, bucket, y, {_DOC}")
def _bad_files(spark, sf_dir):
    place = "regexp_extract(source_path, '/ty=([0-9]+)/doc=([^/]+)/', {})"
    cut = "reason = 'corrupt'"  # how much of a broken file is found is the parser's affair
    return I.damaged_documents(spark, sf_dir).bad_files.selectExpr(
        f"{place.format(2)} AS filer", f"CAST({place.format(1)} AS INT) AS tax_year", "reason", f"CASE WHEN NOT {cut} THEN stated END AS stated",
        f"CASE WHEN NOT {cut} THEN found END AS found")


@query("schema_gaps", "SELECT parent, count(*) AS n_records, count(*) AS n_elements FROM ("
       f"SELECT unnest(CASE WHEN k % 31 <> 0 THEN ['ReturnData', 'ReturnData_{D.MAIN}'] ELSE ['ReturnData_{D.MAIN}'] END) AS parent FROM {_DAMAGED} WHERE NOT ({I.CUT} OR {I.MISCOUNTED})) GROUP BY parent")
def _schema_gaps(spark, sf_dir):
    return I.damaged_documents(spark, sf_dir).schema_gaps


@query("facts_layout", "SELECT seg AS return_id, code AS entity_code, path, count(*) AS n, min(value) AS value FROM ("
       " SELECT seg, code, replace(path, 'IRS5471_IRS', 'IRS') AS path, value FROM facts WHERE form = 'IRS5471' AND side = 'c'"
       " AND path LIKE 'IRS5471\\_IRS5471ScheduleF\\_%' ESCAPE '\\') GROUP BY ALL", facts=["IRS5471"])
def _layout(spark, sf_dir):
    rows = xml.with_layout(X.facts(spark, sf_dir, CY), "inline").where((F.col("form") == D.SCH_F) & (F.col("path") != D.SCH_F))
    return rows.groupBy("return_id", "entity_code", "path").agg(F.expr("count(*) AS n"), F.expr("min(value) AS value"))


# workbook ---------------------------------------------------------------------------

_LISTED = (f"(SELECT c.* FROM (SELECT *, {I.BUCKET} AS bucket, {I.SLOT} AS slot FROM cust) c LEFT JOIN (SELECT seg AS s_seg, {I.BUCKET} AS s_bucket"
           f" FROM cust WHERE {I.STOP} AND k % 26 <> 0) s ON s_seg = seg AND s_bucket = bucket"
           " WHERE k % 26 <> 0 AND (s_seg IS NULL OR slot < 150))")


def _layout_sql(schedules: list[str], extra: str = "") -> str:
    parts = []
    for s in schedules:
        items = ", ".join(
            f"{{'schedule': '{s}', 'field': '{f}', 'line': '{ln}', 'value': COALESCE({I.WB_CELLS[s].get(f, 'NULL')}, '0')}}"
            for _, ln, f in W.MATRIX_LAYOUTS[s].lines)
        parts.append(f"SELECT {I.BOOK} AS workbook_id, code AS entity_code, unnest([{items}], recursive := true){extra} FROM {_LISTED}")
    return " UNION ALL ".join(parts)


@query("workbook_layout_a", _layout_sql(list(W.MATRIX_LAYOUTS)))
def _layout_a(spark, sf_dir):
    return grid.matrix_schedules(I.grid_cells(spark, sf_dir)).drop("num")




@query("workbook_gilti", f"SELECT {I.BOOK} AS workbook_id, code AS entity_code, ccy_c AS functional_currency, cname AS entity_name, CAST(ni_c AS STRING) AS book_income,"
       " CAST(g_c - r_c - d_c AS STRING) AS tested_income_fc, CAST(q_c * 100 AS STRING) AS qbai, CASE WHEN k % 7 = 0 THEN '0' ELSE CAST(d_c AS STRING) END"
       " AS interest_expense, CAST(t_c AS STRING) AS foreign_taxes, CASE WHEN k % 3 <> 0 AND g_c - r_c <> 0 THEN CAST(g_c - r_c AS STRING) WHEN g_c <> 0"
       " THEN CAST(g_c AS STRING) END AS tested_income_usd FROM cust WHERE k % 26 <> 0")
def _gilti(spark, sf_dir):
    return grid.gilti_rows(I.grid_cells(spark, sf_dir)).select(
        "workbook_id", "entity_code", "functional_currency", "entity_name", "book_income", "tested_income_fc", "qbai",
        "interest_expense", "foreign_taxes", "tested_income_usd")


@query("workbook_subf", f"SELECT {I.BOOK} AS workbook_id, code AS entity_code, cname AS entity_name, CAST(r_c AS STRING) AS pre_tax_subpart_f,"
       " CAST(t_c AS STRING) AS tax_on_subf, CAST(NULL AS STRING) AS etr_on_subf, CASE WHEN k % 2 = 0 THEN 'Yes' ELSE 'No' END AS eligible_high_tax,"
       " CAST(r_c - t_c AS STRING) AS net_subpart_f FROM cust WHERE k % 26 <> 0")
def _subf(spark, sf_dir):
    return grid.positional_rows(I.grid_cells(spark, sf_dir), "subf_summary").drop("row")


@query("workbook_deminimis", f"SELECT {I.BOOK} AS workbook_id, code AS entity_code, cname AS entity_name, CAST(d_c AS STRING) AS interest_income,"
       " CAST(NULL AS STRING) AS dividend_income, CAST(q_c AS STRING) AS fx_gain_loss, CAST(NULL AS STRING) AS passive_fphci,"
       " CAST(NULL AS STRING) AS fphci_ic_interest, CAST(t_c AS STRING) AS us_source_fphci FROM cust WHERE k % 26 <> 0")
def _deminimis(spark, sf_dir):
    return grid.positional_rows(I.grid_cells(spark, sf_dir), "de_minimis").drop("row")


@query("workbook_entity_listing", f"SELECT {I.BOOK} AS workbook_id, code AS entity_code, cname AS name, '5471' AS form_type, concat('LE', CAST(k AS STRING)) AS le_id,"
       " code AS ein_or_ref, ccy_c AS functional_currency, country AS country_code, k % 10 = 0 AS final_return, k % 30 = 0 AS dormant,"
       " '1997-01-01' AS tax_period_begin, '1997-12-31' AS tax_period_end FROM cust WHERE k % 26 <> 0")
def _listing(spark, sf_dir):
    return grid.entity_listing(I.grid_cells(spark, sf_dir))


_FS = {"net_income_usd": "CAST(net_c AS STRING)", "total_ep": "CAST(usd_c AS STRING)", "subpart_f": "CAST(r_c AS STRING)",
       "tested_income_after_hte": "CASE WHEN k % 3 = 0 THEN '0' ELSE CAST(g_c - r_c AS STRING) END"}
_FS_ITEMS = [("foreign_summary", f, _FS.get(f, "'0'")) for f in W.FOREIGN_SUMMARY_ROWS.values()] + [
    ("sch_h_fc", "CurrEarnAndPrftInUSDollarsAmt", _FS["total_ep"]),
    ("sch_i1_fc", "TestedIncomeLossGrp_USDollarAmt", _FS["tested_income_after_hte"])]


@query("workbook_foreign_summary", f"SELECT concat('FS-', {I.BOOK}) AS workbook_id, concat('FC', CAST(k AS STRING)) AS entity_code, cname AS entity_name,"
       " ccy_c AS functional_currency, unnest([" + ", ".join(f"{{'schedule': '{s}', 'field': '{f}', 'value': {v}}}" for s, f, v in _FS_ITEMS)
       + "], recursive := true) FROM cust")
def _foreign(spark, sf_dir):
    return grid.foreign_summary(I.grid_cells(spark, sf_dir))


@query("workbook_profile", f"SELECT DISTINCT {I.BOOK} AS workbook_id, 'engagement' AS profile FROM cust UNION ALL"
       f" SELECT DISTINCT concat('FS-', {I.BOOK}), 'ep_gilti' FROM cust")
def _profile(spark, sf_dir):
    return grid.workbook_profile(I.grid_cells(spark, sf_dir))


@query("workbook_metadata", f"SELECT DISTINCT {I.BOOK} AS workbook_id, concat(seg, ' GROUP') AS client_name, CASE WHEN {I.BUCKET} % 3 = 0 THEN '98'"
       f" WHEN {I.BUCKET} % 2 = 0 THEN '1997' ELSE '2097' END AS tax_year FROM cust UNION ALL SELECT DISTINCT concat('FS-', {I.BOOK}), concat(seg, ' FOREIGN'),"
       f" CASE WHEN {I.BUCKET} % 3 = 0 THEN '' ELSE '2097' END FROM cust")
def _metadata(spark, sf_dir):
    return grid.workbook_metadata(I.grid_cells(spark, sf_dir))


@query("ep_adjustment_summary", f"SELECT {I.BOOK} AS workbook_id, CASE WHEN k % 40 = 0 THEN concat('SS', CAST(k AS STRING)) ELSE code END AS entity_code,"
       " ccy_c AS currency, CASE WHEN k % 45 <> 0 THEN CAST(ep_c + CASE WHEN k % 28 = 0 THEN 600 ELSE 0 END AS DOUBLE) END AS ep_fc, CAST(usd_c AS DOUBLE) AS ep_usd"
       " FROM cust WHERE k % 26 <> 0 OR k % 40 = 0")
def _ep_summary(spark, sf_dir):
    return grid.ep_adjustment_summary(I.grid_cells(spark, sf_dir))


@query("workbook_summary", f"SELECT {I.BOOK} AS workbook_id, s.schedule, count(DISTINCT code) AS entities, max(s.n) AS fields FROM {_LISTED}, (VALUES "
       + ", ".join(f"('{s}', {len(m.lines)})" for s, m in W.MATRIX_LAYOUTS.items()) + ") s(schedule, n) GROUP BY 1, 2")
def _wb_summary(spark, sf_dir):
    rows = grid.workbook_summary(grid.matrix_schedules(I.grid_cells(spark, sf_dir)))
    return rows.select("workbook_id", "schedule", "entities", F.col("fields").cast("int").alias("fields"))


# exports -------------------------------------------------------------------------------


def _amount(kind: str, c: str) -> str:
    x = I.export_amounts()[kind].get(c, "0")
    return f"COALESCE(TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE), 0)"


_EXPORT_PARTS = [("old", "true", D.GENERAL_BASKET, 1995, D.EP_ACTIVITY), ("new", "k % 12 <> 0", D.GENERAL_BASKET, 1996, D.EP_ACTIVITY),
                 ("other", "k % 7 = 0", D.GENERAL_BASKET, 1996, "Other"), ("passive", "k % 4 = 0", D.PASSIVE_BASKET, 1996, D.EP_ACTIVITY)]
#: cleaned export rows, amounts numbered a0, a1, ... in template order
EXPORT = "export AS (" + " UNION ALL ".join(
    f"SELECT seg, k, code, '{kind}' AS kind, '{b}' AS basket_name, {y} AS tax_year, '{act}' AS activity_type, "
    + ", ".join(f"{_amount(kind, c)} AS a{i}" for i, c in enumerate(D.BALANCE_COLUMNS))
    + f" FROM cust WHERE n_p > 0 AND k % 33 <> 0 AND {cond}" for kind, cond, b, y, act in _EXPORT_PARTS) + ")"


@query("ending_balance_export", "SELECT seg AS return_id, code AS entity_number, basket_name, tax_year, activity_type, "
       + ", ".join(f"a{i}" for i in range(len(D.BALANCE_COLUMNS))) + " FROM export", ctes=EXPORT)
def _export(spark, sf_dir):
    rows = C.ending_balances(I.export_rows(spark, sf_dir))
    return rows.selectExpr("return_id", "entity_number", "basket_name", "tax_year", "activity_type",
                           *[f"{RS.quote(c)} AS a{i}" for i, c in enumerate(D.BALANCE_COLUMNS)])


@query("name_map", "SELECT seg AS return_id, code AS entity_number, upper(CASE WHEN k % 13 = 0 THEN concat('Unrelated ', md5(CAST(k AS STRING)))"
       " ELSE cname END) AS entity_name FROM cust")
def _name_map(spark, sf_dir):
    return C.name_map(I.name_rows(spark, sf_dir))


_TARGETS = " UNION ALL ".join(
    f"SELECT seg, k, code, upper(cname) AS xml_name, '{b}' AS basket_name, '{p}' AS pool, CAST({v} AS DOUBLE) AS target FROM cust WHERE n_p > 0 AND {cond}"
    for p in D.POOL_IMPORT_COLUMN for x in [X.POOL_LETTER[p]]
    for b, v, cond in ((D.GENERAL_BASKET, f"e{x}_p", "true"), (D.PASSIVE_BASKET, X._half(f"e{x}_p"), "k % 2 = 0")))
TARGETS = f"targets AS ({_TARGETS})"


@query("schj_targets", "SELECT seg AS return_id, xml_name, basket_name, pool, target FROM targets", ctes=TARGETS)
def _targets(spark, sf_dir):
    return C.pool_targets(X.facts(spark, sf_dir, PY, forms=[D.SCH_J]), PY)


# projections ------------------------------------------------------------------------------


def _pivot(form: str, tags: list[str]) -> str:
    return ", ".join(f"max(CASE WHEN path = '{form}_{t}' THEN value END) AS \"{form}_{t}\"" for t in tags)


_H_TAGS = ["ForeignCYNetIncomePerBooksAmt", "CurrEarnAndPrftInUSDollarsAmt", "ExchangeRt"]
_J_TAGS = ["SeparateCategoryCd", f"Post2017EPNotPrevTaxedGrp_{D.J_BOY}", f"Post2017EPNotPrevTaxedGrp_{D.J_CYDEF}"]
_FILED = "SELECT seg AS return_id, CASE side WHEN 'p' THEN 1996 ELSE 1997 END AS tax_year, code AS entity_code, name AS entity_name"


@query("extract_form", f"{_FILED}, {_pivot(D.SCH_H, _H_TAGS)} FROM facts GROUP BY seg, side, code, name", facts=[D.SCH_H])
def _extract(spark, sf_dir):
    return RS.extract_form(X.facts(spark, sf_dir, forms=[D.SCH_H]), D.SCH_H, [f"{D.SCH_H}_{t}" for t in _H_TAGS]).drop("sub_no", "instance", "basket")


@query("extract_form_baskets", f"{_FILED}, instance, basket, {_pivot(D.SCH_J, _J_TAGS)} FROM facts GROUP BY seg, side, code, name, instance, basket",
       facts=[D.SCH_J])
def _extract_j(spark, sf_dir):
    return RS.extract_form(X.facts(spark, sf_dir, forms=[D.SCH_J]), D.SCH_J, [f"{D.SCH_J}_{t}" for t in _J_TAGS]).drop("sub_no")


_WIDE = [f"{D.MAIN}_FunctionalCurrencyCd", f"{D.SCH_H}_ExchangeRt", f"{D.SCH_I1}_GrossIncomeAmt", f"{D.SCH_J}_SeparateCategoryCd",
         f"{D.SCH_J}_HoveringDeficitDedSspndTaxGrp_{D.J_BOY}"]


@query("wide_entities", f"{_FILED}, " + ", ".join(f"max(CASE WHEN path = '{p}' THEN value END) AS \"{p}\"" for p in _WIDE)
       + " FROM facts WHERE instance = 1 GROUP BY seg, side, code, name", facts=[D.MAIN, D.SCH_H, D.SCH_I1, D.SCH_J])
def _wide(spark, sf_dir):
    return RS.wide_entities(X.facts(spark, sf_dir), _WIDE).drop("sub_no")


@query("wide_by_basket", f"{_FILED}, basket, path, value FROM facts WHERE path <> form", facts=[D.SCH_J])
def _by_basket(spark, sf_dir):
    return RS.wide_by_basket(X.facts(spark, sf_dir, forms=D.MULTI_INSTANCE_FORMS)).drop("sub_no")


@query("get_field", f"{_FILED}, value FROM facts WHERE path = 'IRS5471_FunctionalCurrencyCd' AND contains(lower(name), '#00000013')"
       " QUALIFY row_number() OVER (PARTITION BY seg, side ORDER BY k) = 1", facts=[D.MAIN])
def _get_field(spark, sf_dir):
    f = X.facts(spark, sf_dir)
    hit = RS.get_field(f, "#00000013", "IRS5471_FunctionalCurrencyCd")
    names = f.where("path = 'IRS5471'").select("return_id", "tax_year", "entity_code", "entity_name")
    return hit.join(names, ["return_id", "tax_year", "entity_code"])


def _entities_sql() -> str:
    return f"SELECT seg AS return_id, y AS tax_year, code AS entity_code, nm AS entity_name, {_EIN}, ccy AS functional_currency, k FROM {_SIDES}"


for _by, _text, _cond in (("name", "00012", "contains(lower(entity_name), '00012')"), ("ein", "000000123", "ein = '000000123'"),
                          ("ref", "C000124", "entity_code = 'C000124'")):
    @query(f"find_entity_{_by}", f"SELECT return_id, tax_year, entity_code, entity_name, ein, functional_currency FROM ({_entities_sql()})"
           f" WHERE {_cond} QUALIFY row_number() OVER (PARTITION BY return_id, tax_year ORDER BY k) = 1")
    def _find(spark, sf_dir, by=_by, text=_text):
        return RS.find_entity(RS.entity_info(X.facts(spark, sf_dir, forms=[D.MAIN])), by, text).select(
            "return_id", "tax_year", "entity_code", "entity_name", "ein", "functional_currency")


@query("filter_entity", f"SELECT return_id, tax_year, entity_code, entity_name FROM ({_entities_sql()}) WHERE regexp_matches(entity_name, '(?i)holdings$')"
       " OR regexp_matches(entity_code, '(?i)c0001[0-4]')")
def _filter_entity(spark, sf_dir):
    marks = X.facts(spark, sf_dir, forms=[D.MAIN]).where("path = 'IRS5471'").select("return_id", "tax_year", "entity_code", "entity_name")
    return RS.filter_entity(marks, "(holdings$|c0001[0-4])")


def _line_frame_sql(schedule: str) -> str:
    prefix = f"{D.MAIN}_{D.SCH_C if schedule == 'C' else D.SCH_F}_"
    cols = ", ".join(f"max(CASE WHEN path = '{prefix}{t}' THEN CAST(value AS DOUBLE) END) AS \"{c}\"" for c, t, *_ in D.line_columns(schedule))
    return (f"{_FILED}, max(CASE WHEN path = 'IRS5471_FunctionalCurrencyCd' THEN value END) AS functional_currency, "
            + cols.replace("CAST(value", "TRY_CAST(value") + " FROM facts GROUP BY seg, side, code, name")


@query("schc_extract", _line_frame_sql("C"), facts=[D.MAIN])
def _schc(spark, sf_dir):
    return RS.line_frame(X.facts(spark, sf_dir, forms=[D.MAIN]), "C").drop("sub_no")


@query("schf_extract", _line_frame_sql("F"), facts=[D.MAIN])
def _schf(spark, sf_dir):
    return RS.line_frame(X.facts(spark, sf_dir, forms=[D.MAIN]), "F").drop("sub_no")


@query("coverage_count", "SELECT seg AS return_id, count(*) AS covered, count(*) AS entities FROM cust WHERE n_c > 0 GROUP BY seg")
def _coverage(spark, sf_dir):
    rows = RS.line_frame(X.facts(spark, sf_dir, CY, forms=[D.MAIN]), "C")
    return RS.coverage_count(rows, [c for c, *_ in D.line_columns("C") if c.startswith("FC_L")])


_AMT = ("CASE WHEN {v} IS NULL OR {v} = '' THEN '—' WHEN abs({n}) >= 1000000 THEN '$' || format('{{:,.2f}}', {n} / 1000000) || 'M'"
        " WHEN abs({n}) >= 1000 THEN '$' || format('{{:,.1f}}', {n} / 1000) || 'K' ELSE '$' || format('{{:,.0f}}', {n}) END")


def amount_sql(value: str, sign: str | None) -> str:
    n = f"(CAST({value} AS DOUBLE) * {-1 if sign else 1})"
    return _AMT.format(v=value, n=n)


def _catalogue(form: str) -> list[tuple[int, D.Field]]:
    return list(enumerate(D.fields_of(form), 1))


def _view_sql(form: str) -> str:
    def shown(f: D.Field) -> str:
        v = f"m['{form}_{f.name}']"
        if f.type == "rate":
            return f"CASE WHEN {v} IS NULL THEN '—' ELSE format('{{:.7f}}', CAST({v} AS DOUBLE)) END"
        return amount_sql(v, f.sign)

    items = ", ".join(f"{{'line_no': {i}, 'line': '{f.line}', 'description': '{f.description}', 'amount': {shown(f)}}}" for i, f in _catalogue(form))
    return (f"SELECT return_id, tax_year, entity_code, unnest([{items}], recursive := true) FROM ("
            f"{_FILED}, map_from_entries(list(row(path, nullif(value, '')))) AS m FROM facts WHERE path <> form GROUP BY seg, side, code, name)")


@query("form_view_h", _view_sql(D.SCH_H), facts=[D.SCH_H])
def _view_h(spark, sf_dir):
    return FV.form_view(X.facts(spark, sf_dir, forms=[D.SCH_H]), D.SCH_H)


@query("form_view_c", _view_sql(D.SCH_C), facts=[D.SCH_C])
def _view_c(spark, sf_dir):
    return FV.form_view(X.facts(spark, sf_dir, forms=[D.SCH_C]), D.SCH_C)


def _balance_view_sql() -> str:
    def shown(tag: str) -> str:
        return amount_sql(f"m['{D.SCH_F}_{tag}']", None)

    items = ", ".join(f"{{'line_no': {ln}, 'description': '{d}', 'beginning': {shown(D.begin_tag(c))}, 'ending': {shown(D.end_tag(c))}}}"
                      for c, ln, d in D.BALANCE_PAIRS)
    return (f"SELECT return_id, tax_year, entity_code, unnest([{items}], recursive := true) FROM ("
            f"{_FILED}, map_from_entries(list(row(path, value))) AS m FROM facts WHERE path <> form GROUP BY seg, side, code, name)")


@query("form_view_f", _balance_view_sql(), facts=[D.SCH_F])
def _view_f(spark, sf_dir):
    return FV.balance_view(X.facts(spark, sf_dir, forms=[D.SCH_F]))


def _lookup_sql(which: str) -> str:
    rows = ", ".join(f"('{f.form}', '{f.name}', '{f.line}', '{f.description}', '{f.type}', {i})" for i, f in enumerate(D.FIELDS))
    return f"(VALUES {rows}) {which}(form, field, line, description, type, pos)"


@query("field_info", "SELECT f.form, f.path, COALESCE(d.line, '?') AS line, COALESCE(d.description, replace(f.path, f.form || '_', '')) AS description,"
       " COALESCE(d.type, 'unknown') AS type, count(*) AS n FROM facts f LEFT JOIN " + _lookup_sql("d")
       + " ON d.form = f.form AND d.field = replace(f.path, f.form || '_', '') WHERE f.path <> f.form GROUP BY ALL", facts=[])
def _field_info(spark, sf_dir):
    rows = X.facts(spark, sf_dir).where("path <> form").groupBy("form", "path").agg(F.expr("count(*) AS n"))
    return FV.field_info(rows).select("form", "path", "line", "description", "type", "n")


@query("line_lookup", "SELECT field, COALESCE((SELECT arg_min(line, pos) FROM " + _lookup_sql("d") + " WHERE d.field = x.field), '') AS line, n FROM ("
       "SELECT replace(path, form || '_', '') AS field, count(*) AS n FROM facts WHERE path <> form GROUP BY 1) x", facts=[])
def _line_lookup(spark, sf_dir):
    short = F.replace(F.col("path"), F.concat("form", F.lit("_")), F.lit(""))
    rows = X.facts(spark, sf_dir).where("path <> form").groupBy(short.alias("field")).agg(F.expr("count(*) AS n"))
    return line_lookup(rows).select("field", "line", "n")


@query("dim_join", "SELECT f.seg AS return_id, f.code AS entity_code, d.line, d.description, f.value FROM facts f JOIN " + _lookup_sql("d")
       + " ON d.form = f.form AND f.path = f.form || '_' || d.field WHERE f.side = 'c'", facts=[D.SCH_H, D.SCH_I1])
def _dim_join(spark, sf_dir):
    dim = FV.field_dim(spark).withColumn("path", F.concat("form", F.lit("_"), "field")).select("form", "path", "line", "description")
    rows = X.facts(spark, sf_dir, CY).where(F.col("form").isin(D.SCH_H, D.SCH_I1))
    return rows.join(F.broadcast(dim), ["form", "path"]).select("return_id", "entity_code", "line", "description", "value")


@query("topk_ep", "SELECT seg AS return_id, name_c AS entity_name, code AS entity_code, CAST(-usd_c AS DOUBLE) AS ep_usd, CAST(-ni_c AS DOUBLE) AS net_income"
       " FROM cust WHERE n_c > 0 AND k % 31 <> 0 QUALIFY row_number() OVER (PARTITION BY seg ORDER BY abs(usd_c) DESC NULLS LAST, code) <= 10")
def _topk_ep(spark, sf_dir):
    return RS.top_ep(X.facts(spark, sf_dir, CY), CY)


@query("first_per_key", "SELECT seg AS return_id, ccy_c AS functional_currency, arg_min(code, k) AS entity_code, min(k) AS sub_no FROM cust WHERE n_c > 0 GROUP BY ALL")
def _first(spark, sf_dir):
    rows = RS.entity_info(X.facts(spark, sf_dir, CY, forms=[D.MAIN])).select("return_id", "functional_currency", "entity_code", "sub_no")
    return RS.first_per_key(rows, ["return_id", "functional_currency"], ["sub_no"])


@query("last_per_key", "SELECT seg AS return_id, code AS entity_code, path, arg_max(value, instance) AS value FROM facts WHERE side = 'c' AND path <> form GROUP BY ALL",
       facts=[D.SCH_J])
def _last(spark, sf_dir):
    rows = X.facts(spark, sf_dir, CY).where((F.col("form") == D.SCH_J) & (F.col("path") != D.SCH_J))
    return RS.last_per_key(rows.select("return_id", "entity_code", "path", "instance", "value"), ["return_id", "entity_code", "path"], ["instance"]).drop("instance")


@query("columns_union", "SELECT path AS field, bool_or(side = 'p') AS in_prior, bool_or(side = 'c') AS in_current FROM facts WHERE path <> form GROUP BY 1", facts=[])
def _columns_union(spark, sf_dir):
    f = X.facts(spark, sf_dir).where("path <> form")
    old, new = (f.where(F.col("tax_year") == y).select(F.col("path").alias("field")).distinct().withColumn(n, F.lit(True))
                for y, n in ((PY, "in_prior"), (CY, "in_current")))
    return old.join(new, "field", "full_outer").na.fill(False)


