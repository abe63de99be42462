"""Queries of the workbook audit and of page 1 of the branches' form."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie import workbook_dims as W
from crosstie.operators import book_audit as B
from crosstie.operators import rollover as RO
from crosstie.plans import fixture as X
from crosstie.plans import inputs as I
from crosstie.plans import q_reports as QR
from crosstie.plans.fixture import every
from crosstie.plans.q_sources import _LISTED
from crosstie.plans.registry import plain, query
from crosstie.plans.store import stored_table
from crosstie.schema import FACT_COLUMNS, FACT_PARTITIONS
from crosstie.sources import grid

PY, CY = X.PY, X.CY

# signs: two columns of three carry the expenses of Schedule C as negatives ----------------

_C = W.MATRIX_LAYOUTS["sch_c_fc"]
_ROW = {f: _C.first_row + o for o, _, f in _C.lines}
_EXPENSES = ("ForeignReturnsAndAllowancesAmt", "ForeignTaxesAmt", "ForeignTotalDeductionsAmt")


def _signed_cells(spark, sf_dir):
    flip = F.col("sheet").isin(*W.SHEET_CANDIDATES["sch_c_fc"]) & F.col("row").isin(*(_ROW[f] for f in _EXPENSES)) & (F.col("col") % 3 != 0)
    return I.grid_cells(spark, sf_dir).withColumn("value", F.when(flip, F.concat(F.lit("-"), "value")).otherwise(F.col("value")))


def _sign_sql() -> str:
    parts = []
    for s, field, expected, family in B.sign_families():
        if field not in I.WB_CELLS[s]:
            continue
        m = W.MATRIX_LAYOUTS[s]
        line, row = next((ln, m.first_row + o) for o, ln, f in m.lines if f == field)
        col = f"CAST({m.first_col} + slot AS INT)"
        value = f"TRY_CAST({I.WB_CELLS[s][field]} AS DOUBLE)"
        if s == "sch_c_fc" and field in _EXPENSES:
            value = f"{value} * CASE WHEN {col} % 3 <> 0 THEN -1 ELSE 1 END"
        parts.append(f"SELECT {I.BOOK} AS workbook_id, {I.sheet_of(s)} AS sheet, {row} AS row, {col} AS col, code AS entity_code, '{line}' AS line,"
                     f" '{family}' AS family, {value} AS amount, {expected} AS expected FROM {_LISTED}")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE amount * expected < 0"


@query("sign_convention", _sign_sql())
def _signs(spark, sf_dir):
    return B.sign_convention(_signed_cells(spark, sf_dir))


# look-ups: pseudo codes of a group of 32 customers lead down to a code, an elimination or nothing

_RETURN = "concat('B', CAST(CAST(floor(k / 32) AS BIGINT) AS STRING))"
_CODE = "concat('C', lpad(CAST(k AS STRING), 6, '0'))"
_TARGET = (f"CASE WHEN k % 7 = 0 THEN {_CODE} WHEN k % 7 = 1 THEN concat('ELIM', CAST(k AS STRING)) WHEN k % 7 = 2 THEN concat('X', CAST(k AS STRING))"
           " WHEN k % 49 = 3 THEN concat('P', CAST(k + 1 AS STRING)) ELSE concat('P', CAST(k - 1 AS STRING)) END")


@plain("pseudo_entities", f"""WITH RECURSIVE c AS (SELECT c_custkey AS k FROM customer),
reg AS (SELECT {_RETURN} AS return_id, {_CODE} AS code FROM c WHERE k % 3 <> 0),
l AS (SELECT {_RETURN} AS return_id, concat('P', CAST(k AS STRING)) AS code, {_TARGET} AS target FROM c),
w AS (SELECT return_id, code, target AS dest, 1 AS steps FROM l UNION ALL
  SELECT w.return_id, w.code, l.target, steps + 1 FROM w JOIN l ON l.return_id = w.return_id AND l.code = w.dest WHERE steps < 40),
e AS (SELECT w.return_id, w.code, arg_max(dest, steps) AS dest, max(steps) AS steps FROM w GROUP BY ALL)
SELECT e.return_id, e.code AS entity_code, CASE WHEN steps < 40 THEN dest END AS resolved, CASE WHEN steps < 40 THEN steps END AS steps,
  CASE WHEN steps >= 40 THEN 'loop' WHEN reg.code IS NOT NULL THEN 'registered' WHEN starts_with(dest, 'ELIM') THEN 'elimination' ELSE 'pseudo' END AS status
FROM e LEFT JOIN reg ON reg.return_id = e.return_id AND reg.code = dest""")
def _pseudo(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS k")
    lookups = c.selectExpr(f"{_RETURN} AS return_id", "concat('P', CAST(k AS STRING)) AS entity_code", f"{_TARGET} AS target")
    return B.pseudo_entities(lookups, c.where("k % 3 <> 0").selectExpr(f"{_RETURN} AS return_id", f"{_CODE} AS entity_code"))


# workbook amounts against an export of the filed ones with the other sign -----------------

_FIELDS = ("ForeignGrossReceiptsOrSalesAmt", "ForeignReturnsAndAllowancesAmt", "ForeignTotalIncomeAmt", "ForeignTaxesAmt",
           "ForeignTotalDeductionsAmt", "ForeignCYNetIncomePerBookAmt", "ForeignCYNetIncomePerBooksAmt")
_ROUNDS = 5


def _crosscheck_sql() -> str:
    filed = {f.path.removeprefix(f"{D.SCH_C}_"): f.c for f in X.FACT_SPECS if f.form == D.MAIN and f.path.startswith(f"{D.SCH_C}_")}
    left = ", ".join(f"{{'ref': '{f}', 'v': TRY_CAST({I.WB_CELLS['sch_c_fc'][f]} AS DOUBLE)}}" for f in _FIELDS if f in I.WB_CELLS["sch_c_fc"])
    right = ", ".join(f"{{'ref': '{f}', 'v': TRY_CAST({filed[f]} AS DOUBLE)}}" for f in _FIELDS)
    num = "row_number() OVER (PARTITION BY return_id, code, v ORDER BY ref) AS n"
    ctes = [f"l AS (SELECT *, {num} FROM (SELECT seg AS return_id, code, unnest([{left}], recursive := true) FROM {_LISTED}) WHERE v <> 0)",
            f"r AS (SELECT *, {num} FROM (SELECT seg AS return_id, code, unnest([{right}], recursive := true) FROM cust WHERE n_c > 0) WHERE v <> 0)",
            "a0 AS (SELECT return_id, code, v, count(*) AS n, 0 AS used FROM l GROUP BY ALL)", "b0 AS (SELECT return_id, code, v, count(*) AS n, 0 AS used FROM r GROUP BY ALL)"]
    for i in range(_ROUNDS):
        ctes.append(f"m{i} AS MATERIALIZED (SELECT return_id, code, a, b, ua, ub, q FROM (SELECT a.return_id, a.code, a.v AS a, b.v AS b, a.used AS ua, b.used AS ub, least(a.n, b.n) AS q,"
                    " row_number() OVER (PARTITION BY a.return_id, a.code, a.v ORDER BY abs(a.v - b.v), b.v) AS pa,"
                    " row_number() OVER (PARTITION BY a.return_id, a.code, b.v ORDER BY abs(a.v - b.v), a.v) AS pb"
                    f" FROM a{i} a JOIN b{i} b ON a.return_id = b.return_id AND a.code = b.code AND abs(a.v - b.v) <= 1 + 1e-9) WHERE pa = 1 AND pb = 1)")
        for k in "ab":
            ctes.append(f"{k}{i + 1} AS MATERIALIZED (SELECT x.return_id, x.code, x.v, x.n - coalesce(q, 0) AS n, x.used + coalesce(q, 0) AS used FROM {k}{i} x LEFT JOIN m{i} m"
                        f" ON m.return_id = x.return_id AND m.code = x.code AND m.{k} = x.v WHERE x.n > coalesce(q, 0))")
    found = " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(_ROUNDS))
    return f"""WITH {X.sql_customers()}, {', '.join(ctes)}, m AS ({found})
SELECT m.return_id, m.code AS entity_code, l.ref, m.a AS amount, r.ref AS other_ref, -m.b AS other_amount, CASE WHEN abs(a - b) < 1e-9 THEN 'exact' ELSE 'near' END AS status
FROM m JOIN l ON l.return_id = m.return_id AND l.code = m.code AND l.v = m.a AND l.n > ua AND l.n <= ua + q
  JOIN r ON r.return_id = m.return_id AND r.code = m.code AND r.v = m.b AND r.n - ub = l.n - ua
UNION ALL SELECT l.return_id, l.code, l.ref, l.v, NULL, NULL, 'left_only' FROM l JOIN a{_ROUNDS} a ON a.return_id = l.return_id AND a.code = l.code AND a.v = l.v WHERE l.n > a.used
UNION ALL SELECT r.return_id, r.code, NULL, NULL, r.ref, -r.v, 'right_only' FROM r JOIN b{_ROUNDS} b ON b.return_id = r.return_id AND b.code = r.code AND b.v = r.v WHERE r.n > b.used"""


@plain("oit_crosscheck", _crosscheck_sql())
def _oit(spark, sf_dir):
    book = grid.matrix_schedules(I.grid_cells(spark, sf_dir), ["sch_c_fc"]).where(F.col("field").isin(*_FIELDS)).select(
        F.expr("split(workbook_id, '-')[0]").alias("return_id"), "entity_code", F.col("field").alias("ref"), F.col("value").try_cast("double").alias("amount"))
    prefix = f"{D.MAIN}_{D.SCH_C}_"
    export = X.facts(spark, sf_dir, CY, forms=[D.MAIN]).where((F.col("form") == D.MAIN) & F.col("path").isin(*(prefix + f for f in _FIELDS))).select(
        "return_id", "entity_code", F.substring("path", F.lit(len(prefix) + 1), F.length("path")).alias("ref"), (-F.col("value").try_cast("double")).alias("amount"))
    return B.crosscheck(book, export, ["return_id", "entity_code"])


# branches: page 1 of both years --------------------------------------------------------------

#: tag -> SQL texts of the prior and the current year
_BRANCH: dict[str, tuple[str, str]] = {
    "BusinessNameLine1Txt": ("concat('Branch ', CAST(k AS STRING))", every(9, "concat('BRANCH ', CAST(k AS STRING), ' ')", "concat('Branch ', CAST(k AS STRING))")),
    "CityNm": ("concat('City ', CAST(nat AS STRING))", every(11, "''", "concat('City ', CAST(nat AS STRING))")),
    "CountryCd": ("country", "country"),
    "EIN": (every(5, "'FOREIGNUS'", "lpad(CAST(k AS STRING), 9, '0')"), every(5, "'FOREIGNUS'", "lpad(CAST(k AS STRING), 9, '0')")),
    "ReferenceIdNum": ("code", "code"),
    "OrganizationCountryCd": ("country", every(7, "'ZZ'", "country")),
    "OrganizationDt": ("'1990-01-01'", "'1990-01-01'"),
    "EffectiveDt": (every(4, "'1991-01-01'", "CAST(NULL AS STRING)"), every(8, "'1992-01-01'", every(4, "'1991-01-01'", "CAST(NULL AS STRING)"))),
    "BusinessActivityCd": ("'522110'", every(10, "'523900'", "'522110'")),
    "FunctionalCurrencyCd": ("ccy_p", "ccy_c"),
    "TaxOwnerName": ("name_p", "name_c"),
    "TaxOwnerCountryCd": ("'US'", "'US'"),
    "TaxOwnerFunctionalCurrencyCd": (every(6, "'EUR'", "'USD'"), every(6, every(12, "'USD'", "'EUR'"), "'USD'")),
}


def _branch_facts(spark, sf_dir):
    def build():
        out = None
        for i, (side, year) in enumerate(X.SIDES.items()):
            items = ", ".join(f"struct('{D.BRANCH}{'_' + t if t else ''}' AS path, {n} AS ordinal, {v} AS value)"
                              for n, (t, v) in enumerate([("", "''"), *((t, v[i]) for t, v in _BRANCH.items())]))
            part = X.customers(spark, sf_dir).where(f"n_{side} > 0 AND k % 3 = 1").selectExpr(
                "seg AS return_id", f"{year} AS tax_year", "k AS sub_no", "code AS entity_code", f"name_{side} AS entity_name", f"'{D.BRANCH}' AS form", "1 AS instance",
                "'' AS document_id", "'' AS basket", f"inline(array({items}))").withColumn("is_blank", F.col("value") == "")
            out = part if out is None else out.unionByName(part)
        return out.where("value IS NOT NULL").select(*FACT_COLUMNS)

    return stored_table(spark, sf_dir, "branch_facts", build, FACT_PARTITIONS).select(*FACT_COLUMNS)


_BRANCH_ROWS = [(d, ln, *(f"CAST({v} AS VARCHAR)" for v in _BRANCH.get(t, ("CAST(NULL AS VARCHAR)",) * 2))) for t, d, ln in D.PAGE1_BRANCH_FIELDS]


@query("page1_8858", QR._items(D.REPORTS[2], _BRANCH_ROWS, None).replace(f"FROM cust WHERE {QR._PAIR})", f"FROM cust WHERE {QR._PAIR} AND k % 3 = 1)"))
def _page1_branch(spark, sf_dir):
    return RO.page1_rollover(_branch_facts(spark, sf_dir), PY, CY, D.PAGE1_BRANCH_FIELDS, D.BRANCH)
