"""Workbook sheets as cells: ``(workbook_id, sheet, row, col, value)`` with rows
and columns counted from 1 and blank cells absent or NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie import workbook_dims as W
from crosstie.functions.scalar import year_token
from crosstie.operators.pools import number
from crosstie.operators.rules import lit
from crosstie.session import salted_lookup

SHEET_KEYS = ["workbook_id", "sheet"]


def schedule_sheets(cells: DataFrame, schedules: list[str]) -> DataFrame:
    """(workbook_id, schedule, sheet): the first candidate sheet a workbook has."""
    spark = cells.sparkSession
    dim = spark.createDataFrame(
        [(s, sheet, i) for s in schedules for i, sheet in enumerate(W.SHEET_CANDIDATES[s])],
        "schedule string, sheet string, pref int")
    return (cells.where(F.col("sheet").isin(*{x for s in schedules for x in W.SHEET_CANDIDATES[s]}))
            .select(*SHEET_KEYS).distinct().join(F.broadcast(dim), "sheet")
            .groupBy("workbook_id", "schedule").agg(F.min_by("sheet", "pref").alias("sheet")))


def _text(x: str) -> str:
    return f"trim(coalesce({x}, ''))"


def matrix_schedules(cells: DataFrame, schedules: list[str] | None = None) -> DataFrame:
    """Matrix sheets as (workbook_id, schedule, entity_code, field, line, value, num)."""
    return matrix_positions(cells, schedules).drop("sheet", "row", "col")


def matrix_positions(cells: DataFrame, schedules: list[str] | None = None) -> DataFrame:
    """Matrix sheets as (workbook_id, schedule, entity_code, sheet, row, col, field, line, value, num).

    Header cells that start with ``C`` name the entities; the first other text
    ends them; blanks are skipped.  Every entity gets every field of the
    schedule, a blank cell counting as zero.  Sheet columns are the unit of
    work: one shuffle on (workbook, sheet, column).
    """
    schedules = schedules or list(W.MATRIX_LAYOUTS)
    where = " OR ".join(
        f"(sheet IN ({', '.join(lit(x) for x in W.SHEET_CANDIDATES[s])}) AND col >= {m.first_col} AND (row = {m.header_row}"
        f" OR row IN ({', '.join(str(m.first_row + o) for o, _, _ in m.lines)})))"
        for s, m in W.MATRIX_LAYOUTS.items() if s in schedules)
    columns = (cells.where(where).where("value IS NOT NULL").groupBy(*SHEET_KEYS, "col")
               .agg(F.expr("map_from_entries(collect_list(struct(row, value))) AS m")))
    # one row per sheet, looked up salted: a workbook may hold most of all columns
    named = salted_lookup(columns, _sheet_schedules(cells, schedules), SHEET_KEYS, "col", how="inner")
    head = "CASE schedule " + " ".join(f"WHEN '{s}' THEN {W.MATRIX_LAYOUTS[s].header_row}" for s in schedules) + " END"
    first = "CASE schedule " + " ".join(f"WHEN '{s}' THEN {W.MATRIX_LAYOUTS[s].first_row}" for s in schedules) + " END"
    named = named.withColumn("code", F.expr(_text(f"m[{head}]"))).where("code <> ''")
    stop = (named.where("NOT startswith(code, 'C')").groupBy("workbook_id", "schedule").agg(F.min("col").alias("stop")))
    kept = salted_lookup(named.where("startswith(code, 'C')"), stop, ["workbook_id", "schedule"], "col")
    kept = kept.where("stop IS NULL OR col < stop")
    lines = "CASE schedule " + " ".join(
        f"WHEN '{s}' THEN array(" + ", ".join(
            f"struct({o} AS o, '{ln}' AS line, '{f}' AS field)" for o, ln, f in W.MATRIX_LAYOUTS[s].lines) + ")"
        for s in schedules) + " END"
    # of several columns with one code the last one counts
    per_code = kept.groupBy("workbook_id", "schedule", F.col("code").alias("entity_code")).agg(
        F.expr("max_by(struct(m, sheet, col), col) AS x"))
    out = per_code.selectExpr("workbook_id", "schedule", "entity_code", "x.*", f"{first} AS first_row", f"inline({lines})")
    return out.selectExpr("workbook_id", "schedule", "entity_code", "sheet", "first_row + o AS row", "col", "field", "line",
                          "coalesce(m[first_row + o], '0') AS value").withColumn("num", F.expr(number("value")))


def _sheet_schedules(cells: DataFrame, schedules: list[str]) -> DataFrame:
    return schedule_sheets(cells, schedules).select(*SHEET_KEYS, "schedule")


def _row_maps(cells: DataFrame, schedule: str, first_row: int) -> DataFrame:
    """One row per sheet row with a column -> value map."""
    sheets = W.SHEET_CANDIDATES.get(schedule, [schedule])
    rows = cells.where(F.col("sheet").isin(*sheets) & (F.col("row") >= first_row) & F.col("value").isNotNull())
    rows = rows.groupBy("workbook_id", "sheet", "row").agg(
        F.expr("map_from_entries(collect_list(struct(col, value))) AS m"))
    if schedule in W.SHEET_CANDIDATES and len(sheets) > 1:
        chosen = _sheet_schedules(cells, [schedule]).drop("schedule")
        rows = salted_lookup(rows, chosen, SHEET_KEYS, "row", how="inner")
    return rows


def positional_rows(cells: DataFrame, schedule: str) -> DataFrame:
    """Row sheets read by column position; rows whose code starts with ``C``."""
    first, code_col, columns = W.ROW_LAYOUTS[schedule]
    code = _text(f"m[{code_col}]")
    return (_row_maps(cells, schedule, first)
            .selectExpr("workbook_id", "row", f"{code} AS entity_code",
                        *[f"coalesce(m[{c}], '') AS {f}" if text else f"m[{c}] AS {f}" for c, f, text in columns])
            .where("startswith(entity_code, 'C')"))


def gilti_rows(cells: DataFrame) -> DataFrame:
    """Tested-income sheet read by its header texts.

    The header is one row of a sheet, so it is gathered into one small map per
    workbook; the data rows look it up salted."""
    sheet = _row_maps(cells, "gilti_calc", W.GILTI_HEADER_ROW)
    head = sheet.where(F.col("row") == W.GILTI_HEADER_ROW).selectExpr(
        "workbook_id", "map_entries(transform_values(m, (k, v) -> trim(v))) AS h")
    head = head.selectExpr(
        "workbook_id", "array_sort(h) AS h",
        "coalesce(array_min(transform(filter(h, e -> contains(lower(e.value), 'entity number')"
        " OR contains(lower(e.value), 'entity code')), e -> e.key)), 3) AS code_col")
    rows = salted_lookup(sheet.where(F.col("row") > W.GILTI_HEADER_ROW), head, ["workbook_id"], "row", how="inner")
    cols = []
    for text, name in W.GILTI_COLUMNS.items():
        at = f"array_max(transform(filter(h, e -> e.value = {lit(text)}), e -> e.key))"
        cols.append(f"CASE WHEN {at} IS NOT NULL THEN coalesce(m[{at}], '0') END AS {name}")
    usd = ("get(filter(transform(filter(h, e -> contains(lower(e.value), 'tested income')"
           " AND contains(lower(e.value), 'usd')), e -> m[e.key]), v -> v IS NOT NULL AND v NOT IN ('', '0')), 0)")
    return (rows.withColumn("entity_code", F.expr(_text("m[code_col]"))).where("startswith(entity_code, 'C')")
            .selectExpr("workbook_id", "row", "entity_code", *cols, f"{usd} AS tested_income_usd"))


def entity_listing(cells: DataFrame) -> DataFrame:
    """Registry rows; the last row of an id counts."""
    col = {f: c for c, f in W.ENTITY_LISTING_COLUMNS.items()}

    def raw(f: str) -> str:
        return f"coalesce(m[{col[f]}], '')"

    rows = _row_maps(cells, "entity_listing", W.ENTITY_LISTING_ROW).selectExpr(
        "workbook_id", "row", f"trim({raw('entity_code')}) AS entity_code", f"trim({raw('name')}) AS name",
        *[f"{raw(f)} AS {f}" for f in ("form_type", "le_id", "ein_or_ref", "functional_currency", "country_code")],
        *[f"lower({raw(f)}) = 'yes' AS {f}" for f in ("final_return", "dormant")],
        *[f"left({raw(f)}, 10) AS {f}" for f in ("tax_period_begin", "tax_period_end")],
    ).where("entity_code <> '' AND name <> ''")
    body = ", ".join(c for c in rows.columns if c not in ("workbook_id", "entity_code", "row"))
    return rows.groupBy("workbook_id", "entity_code").agg(F.expr(f"max_by(struct({body}), row) AS x")).select(
        "workbook_id", "entity_code", "x.*")


def foreign_summary(cells: DataFrame) -> DataFrame:
    """Alternate profile as (workbook_id, schedule, entity_code, field, value),
    including the two schedules derived from single rows."""
    rows = [W.FOREIGN_SUMMARY_CODES, W.FOREIGN_SUMMARY_NAMES, W.FOREIGN_SUMMARY_CURRENCY, *W.FOREIGN_SUMMARY_ROWS]
    per_col = (cells.where((F.col("sheet") == W.FOREIGN_SUMMARY_SHEET) & F.col("row").isin(*rows) & F.col("value").isNotNull())
               .groupBy("workbook_id", "col").agg(F.expr("map_from_entries(collect_list(struct(row, value))) AS m")))
    code = _text(f"m[{W.FOREIGN_SUMMARY_CODES}]")
    coded = per_col.withColumn("entity_code", F.expr(code)).where("contains(upper(entity_code), 'FC')")
    per_code = coded.groupBy("workbook_id", "entity_code").agg(F.expr("max_by(m, col) AS m"))
    cellsx = [("foreign_summary", f, r) for r, f in W.FOREIGN_SUMMARY_ROWS.items()]
    cellsx += [(s, f, r) for s, (r, f) in W.FOREIGN_SUMMARY_DERIVED.items()]
    items = ", ".join(f"struct('{s}' AS schedule, '{f}' AS field, coalesce(m[{r}], '0') AS value)" for s, f, r in cellsx)
    return per_code.selectExpr(
        "workbook_id", "entity_code", f"coalesce(m[{W.FOREIGN_SUMMARY_NAMES}], '') AS entity_name",
        f"coalesce(m[{W.FOREIGN_SUMMARY_CURRENCY}], '') AS functional_currency", f"inline(array({items}))")


def workbook_profile(cells: DataFrame) -> DataFrame:
    """Kind of workbook told by its sheet names."""
    return (cells.groupBy("workbook_id").agg(F.collect_set("sheet").alias("sheets")).selectExpr(
        "workbook_id",
        "CASE WHEN array_contains(sheets, 'Entity Listing') AND exists(sheets, s -> contains(s, '5471 Sch'))"
        " THEN 'engagement'"
        " WHEN array_contains(sheets, 'Foreign Summary') AND array_contains(sheets, '951A Summary') THEN 'ep_gilti'"
        " WHEN array_contains(sheets, '5471 Sch M') THEN 'sch_m'"
        " WHEN array_contains(sheets, 'Distributions') AND exists(sheets, s -> contains(s, 'Sec. 986(c)')) THEN 'dividends'"
        " ELSE 'unknown' END AS profile"))


def workbook_metadata(cells: DataFrame) -> DataFrame:
    """Client from the first cell of the first known sheet, year from the lines below.

    A workbook with a foreign summary is read from that sheet: its client is the
    first cell, its year the first word of the second line that is a year of this
    century.  A book with none of the known sheets, or with nothing in their first
    lines, has blanks."""
    known = ["sch_h_fc", "sch_i1_fc", "entity_listing"]
    order = {W.FOREIGN_SUMMARY_SHEET: -1} | {x: i * 10 + j for i, s in enumerate(known) for j, x in enumerate(W.SHEET_CANDIDATES[s])}
    pref = "CASE sheet " + " ".join(f"WHEN {lit(x)} THEN {i}" for x, i in order.items()) + " END"
    first = F.col("sheet").isin(*order)
    # one row per sheet, its first lines or nothing
    line = [F.max(F.when(first & (F.col("col") == 1) & (F.col("row") == i), F.col("value"))).alias(f"r{i}") for i in (1, 2, 3)]
    sheets = cells.groupBy("workbook_id", "sheet").agg(*line)
    filled = f"CASE WHEN sheet = {lit(W.FOREIGN_SUMMARY_SHEET)} OR r1 IS NOT NULL OR r2 IS NOT NULL OR r3 IS NOT NULL THEN {pref} END"
    m = sheets.groupBy("workbook_id").agg(F.expr(f"min_by(struct(sheet, r1, r2, r3), {filled}) AS x"))

    def year(c: str):
        told = F.contains(F.upper(c), F.lit("FY")) | F.contains(c, F.lit("20"))
        return F.when(told, year_token(c))

    century = F.get(F.filter(F.split("x.r2", r"\s+"), lambda w: w.startswith("20") & (F.length(w) == 4)), 0)
    # a year in the third row overwrites one in the second
    told = F.when(F.col("x.sheet") == W.FOREIGN_SUMMARY_SHEET, century).otherwise(F.coalesce(year("x.r3"), year("x.r2")))
    return m.select("workbook_id", F.coalesce("x.r1", F.lit("")).alias("client_name"), F.coalesce(told, F.lit("")).alias("tax_year"))


def ep_adjustment_summary(cells: DataFrame) -> DataFrame:
    """E&P per code in FC and USD; non-numbers drop out; the last row counts."""
    rows = _row_maps(cells, W.EP_SUMMARY_SHEET, W.EP_SUMMARY_ROW).selectExpr(
        "workbook_id", "row", f"{_text(f'm[{W.EP_SUMMARY_CODE}]')} AS entity_code",
        f"{_text(f'm[{W.EP_SUMMARY_CURRENCY}]')} AS currency",
        f"{number(f'm[{W.EP_SUMMARY_FC}]')} AS ep_fc", f"{number(f'm[{W.EP_SUMMARY_USD}]')} AS ep_usd",
    ).where("startswith(entity_code, 'C') OR startswith(entity_code, 'SS')")
    return rows.groupBy("workbook_id", "entity_code").agg(
        F.expr("max_by(currency, row) AS currency"),
        F.expr("max_by(ep_fc, CASE WHEN ep_fc IS NOT NULL THEN row END) AS ep_fc"),
        F.expr("max_by(ep_usd, CASE WHEN ep_usd IS NOT NULL THEN row END) AS ep_usd"))


def workbook_summary(wb_facts: DataFrame) -> DataFrame:
    """Entities and fields per schedule of each workbook."""
    return wb_facts.groupBy("workbook_id", "schedule").agg(
        F.expr("count(DISTINCT entity_code) AS entities"), F.expr("count(DISTINCT field) AS fields"))
