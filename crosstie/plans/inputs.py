"""Further inputs made from the given tables: workbook cells, documents, exports.

All of them grow with the customers that have orders; see ``fixture`` for the
amounts.  ``k`` is the customer, ``bucket`` and ``slot`` place it in a workbook
or document of at most 200 entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosstie import dims as D
from crosstie import workbook_dims as W
from crosstie.operators import attribution as A
from crosstie.operators.reshape import quote
from crosstie.plans import fixture as X
from crosstie.plans.fixture import every
from crosstie.plans.store import stored_path, stored_table
from crosstie.session import listing
from crosstie.sources.xml import Ingested, discover_schemas, ingest, ingested

SLOTS = 200
#: entities whose XML one task makes
ENTITIES_PER_TASK = 10_000
BUCKET, SLOT = f"CAST(floor(k / {SLOTS}) AS INT)", f"CAST(k % {SLOTS} AS INT)"
BOOK = f"concat(seg, '-', CAST({BUCKET} AS STRING))"


def noisy(x: str) -> str:
    """Workbook text of an amount: off by 0.4 for some entities, by 5 for others."""
    shift = f"CAST({every(4, '0.4', '0.0', 1)} + {every(6, '5.0', '0.0', 1)} AS DECIMAL(20,1))"
    return f"CAST(CAST({x} AS DECIMAL(20,1)) + {shift} AS STRING)"


#: schedule -> field -> SQL text of the cell (NULL leaves it blank)
WB_CELLS: dict[str, dict[str, str]] = {
    "sch_h_fc": {
        "ForeignCYNetIncomePerBooksAmt": every(50, "'n/a'", noisy("ni_c")),
        "TotalNetAdditionsAmt": noisy("q_c"),
        "CurrentEarningsAndProfitsAmt": noisy("ep_c"),
        "CurrEarnAndPrftInUSDollarsAmt": noisy("usd_c"),
    },
    "sch_i1_fc": {"GrossIncomeAmt": noisy("g_c"), "QBAIAmt": noisy(every(44, "q_c * 100000", "q_c * 100"))},
    "sch_i": {"SubpartFPHCIncomeAmt": noisy("r_c")},
    "sch_c_fc": {
        "ForeignGrossReceiptsOrSalesAmt": noisy("g_c"),
        "ForeignReturnsAndAllowancesAmt": noisy("r_c"),
        "ForeignTotalIncomeAmt": noisy("g_c - r_c"),
        "ForeignTaxesAmt": every(8, "CAST(NULL AS STRING)", noisy("t_c")),
        "ForeignTotalDeductionsAmt": noisy("d_c"),
        "ForeignCYNetIncomePerBookAmt": noisy("net_c"),
    },
    "sch_c_usd": {"ForeignTotalIncomeAmt": noisy("g_c - r_c")},
    "sch_f_usd": {
        "EndAcctPrdCashAmt": noisy(X._half("g_c")),
        "EndAcctPrdTotalAssetsAmt": noisy("g_c + q_c"),
        "EndAcctPrdTotLiabShrEqtyAmt": noisy("g_c + q_c"),
    },
    "sch_e": {"SchECountryCodeTxt": "country", "TotalTaxInFunctionalCurAmt": noisy("t_c")},
    "sch_g": {"BaseErosionPaymentBenefitInd": "'No'"},
}
#: header cell of an entity column: some are blank, some end the entity columns
STOP = f"({BUCKET} % 5 = 4 AND {SLOT} = 150)"
HEADER_CELL = f"CASE WHEN k % 26 = 0 THEN '  ' WHEN {STOP} THEN 'TOTAL' ELSE code END"
ROW_CODE = "CASE WHEN k % 26 = 0 THEN concat('X', code) ELSE code END"


def sheet_of(schedule: str) -> str:
    names = W.SHEET_CANDIDATES[schedule]
    if schedule == "sch_h_fc":
        return f"(CASE WHEN {BUCKET} % 2 = 1 THEN '{names[1]}' ELSE '{names[0]}' END)"
    return f"'{names[0]}'"


_GILTI_HEADERS = ["FC", "Entity Name", "Entity Number", "Book Income", "Tested Income", "Tested Income (USD)",
                  "Tested Income USD adj", "QBAI", "Interest Expense", "Foreign Taxes"]
_GILTI_CELLS = ["ccy_c", "cname", ROW_CODE, "CAST(ni_c AS STRING)", "CAST(g_c - r_c - d_c AS STRING)",
                every(3, "'0'", "CAST(g_c - r_c AS STRING)"), "CAST(g_c AS STRING)", "CAST(q_c * 100 AS STRING)",
                every(7, "CAST(NULL AS STRING)", "CAST(d_c AS STRING)"), "CAST(t_c AS STRING)"]


def _cells(base: DataFrame, book: str, sheet: str, cells: list[tuple[str, str, str]]) -> DataFrame:
    body = ", ".join(f"struct(CAST({r} AS INT) AS row, CAST({c} AS INT) AS col, {v} AS value)" for r, c, v in cells)
    return base.selectExpr(f"{book} AS workbook_id", f"{sheet} AS sheet", f"inline(array({body}))")


def build_cells(base: DataFrame) -> DataFrame:
    parts = []
    for s, m in W.MATRIX_LAYOUTS.items():
        at = {f: m.first_row + o for o, _, f in m.lines}
        col = f"{m.first_col} + {SLOT}"
        cells = [(str(m.header_row), col, HEADER_CELL)] + [(str(at[f]), col, v) for f, v in WB_CELLS[s].items()]
        parts.append(_cells(base, BOOK, sheet_of(s), cells))
    parts.append(_cells(base, BOOK, "'2025 GILTI'", [
        (f"{W.GILTI_HEADER_ROW + 1} + {SLOT}", str(i), v) for i, v in enumerate(_GILTI_CELLS, 1)]))
    parts.append(_cells(base, BOOK, "'Subpart F - Summary'", [
        (f"7 + {SLOT}", str(c), v) for c, v in (
            (2, ROW_CODE), (3, "cname"), (4, "CAST(r_c AS STRING)"), (5, "CAST(t_c AS STRING)"),
            (7, every(2, "'Yes'", "'No'")), (8, "CAST(r_c - t_c AS STRING)"))]))
    parts.append(_cells(base, BOOK, "'De Minimis - Analysis'", [
        (f"8 + {SLOT}", str(c), v) for c, v in (
            (1, ROW_CODE), (2, "cname"), (3, "CAST(d_c AS STRING)"), (5, "CAST(q_c AS STRING)"),
            (8, "CAST(t_c AS STRING)"))]))
    parts.append(_cells(base, BOOK, "'Entity Listing'", [
        (f"3 + {SLOT}", str(c), v) for c, v in (
            (2, "concat('LE', CAST(k AS STRING))"), (3, every(26, "''", "concat(' ', code, ' ')")), (4, "cname"),
            (5, "'5471'"), (6, every(10, "'YES'", "'No'")), (7, every(30, "'Yes'", "CAST(NULL AS STRING)")),
            (8, "code"), (9, "ccy_c"), (10, "country"), (11, "'1997-01-01 00:00:00'"), (12, "'1997-12-31 00:00:00'"))]))
    parts.append(_cells(base, BOOK, f"'{W.EP_SUMMARY_SHEET}'", [
        (f"{W.EP_SUMMARY_ROW} + {SLOT}", str(c), v) for c, v in (
            (1, every(40, "concat('SS', CAST(k AS STRING))", ROW_CODE)), (4, "ccy_c"),
            (13, every(45, "'n/a'", f"CAST(ep_c + {every(28, '600')} AS STRING)")), (14, "CAST(usd_c AS STRING)"))]))
    parts.append(_cells(base, f"concat('FS-', {BOOK})", f"'{W.FOREIGN_SUMMARY_SHEET}'", [
        (str(r), f"3 + {SLOT}", v) for r, v in (
            (5, "concat('FC', CAST(k AS STRING))"), (6, "cname"), (8, "ccy_c"), (15, "CAST(net_c AS STRING)"),
            (73, "CAST(usd_c AS STRING)"), (80, "CAST(r_c AS STRING)"), (100, every(3, "CAST(NULL AS STRING)", "CAST(g_c - r_c AS STRING)")))]))
    books = base.selectExpr("seg", f"{BUCKET} AS bucket").distinct()
    book = "concat(seg, '-', CAST(bucket AS STRING))"
    h_sheet = "(CASE WHEN bucket % 2 = 1 THEN '5471 Sch H' ELSE '5471 Sch H - FC' END)"
    parts.append(_cells(books, book, "'2025 GILTI'", [
        (str(W.GILTI_HEADER_ROW), str(i), f"'{h}'") for i, h in enumerate(_GILTI_HEADERS, 1)]))
    parts.append(_cells(books, book, h_sheet, [
        ("1", "1", "concat(seg, ' GROUP')"),
        ("2", "1", "(CASE WHEN bucket % 2 = 0 THEN 'FY1997 Compliance' ELSE 'Year ended 2097 draft' END)"),
        ("3", "1", "(CASE WHEN bucket % 3 = 0 THEN 'Revised FY98 copy' ELSE 'Forms 5471' END)")]))
    parts.append(_cells(books, f"concat('FS-', {book})", "'951A Summary'", [("1", "1", "'951A'")]))
    parts.append(_cells(books, f"concat('FS-', {book})", f"'{W.FOREIGN_SUMMARY_SHEET}'", [
        ("1", "1", "concat(seg, ' FOREIGN')"), ("2", "1", "(CASE WHEN bucket % 3 = 0 THEN 'Summary FY98' ELSE 'Summary for 2097 and 2098' END)")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("value IS NOT NULL")


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_table(spark, sf_dir, "grid_cells", lambda: build_cells(X.customers(spark, sf_dir)), ["sheet"]).select(
        "workbook_id", "sheet", "row", "col", "value")


def wb_lines(spark: SparkSession, sf_dir: str, schedule: str) -> DataFrame:
    """Workbook side of the line compares: the inline lines, three off for some
    entities, with some entities left out."""
    prefix = f"{D.MAIN}_{D.SCH_C if schedule == 'C' else D.SCH_F}_"
    column = {prefix + t: col for col, t, *_ in D.line_columns(schedule)}
    arms = " ".join(f"WHEN '{p}' THEN '{c}'" for p, c in column.items())
    rows = X.facts(spark, sf_dir, X.CY, forms=[D.MAIN]).where((F.col("form") == D.MAIN) & F.col("path").isin(*column))
    return rows.where("sub_no % 10 <> 3").selectExpr(
        "return_id", "entity_code", f"CASE path {arms} END AS column",
        "CAST(value AS DOUBLE) + CASE WHEN sub_no % 6 = 1 THEN 3D ELSE 0D END AS value")


def ep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crosstie.sources.grid import ep_adjustment_summary

    return ep_adjustment_summary(grid_cells(spark, sf_dir)).withColumn(
        "return_id", F.expr("split(workbook_id, '-')[0]"))


# --- ending-balance export --------------------------------------------------------

LAYER_YEAR = 1996
_POOL_COLUMN = [(D.POOL_IMPORT_COLUMN[p], X.POOL_LETTER[p]) for p in D.POOL_IMPORT_COLUMN]
_US_SOURCE = "959(c)(3) U.S. Source E&P (FC)"


def _export_row(i: int, cond: str, basket: str, year: int, activity: str, amounts: dict[str, str]) -> str:
    number, name = basket.split("-")[0], basket
    cols = ", ".join(f"CAST({amounts.get(c, '0')} AS STRING) AS {quote(c)}" for c in D.BALANCE_COLUMNS)
    row = (f"struct(CAST(k * 10 + {i} AS BIGINT) AS row_no, '{activity}' AS activity_type, '{number}' AS basket_number,"
           f" '{name}' AS basket_name, {year} AS tax_year, {year} AS made_in_tax_year, '01/01/{year}' AS tax_year_begin,"
           f" '12/31/{year}' AS tax_year_end, '01/01/{year}' AS made_in_year_begin, '12/31/{year}' AS made_in_year_end,"
           f" 'layer {year}' AS adjustment_description, {cols})")
    return f"CASE WHEN {cond} THEN {row} END"


def export_amounts() -> dict[str, dict[str, str]]:
    """SQL amounts of the export rows by kind of row."""
    old = {c: X._half(f"e{x}_p") for c, x in _POOL_COLUMN}
    new = {c: f"e{x}_p - {X._half(f'e{x}_p')} + {every(5, '1000', rest=1)}" for c, x in _POOL_COLUMN}
    passive = {c: X._part(f"e{x}_p", 3) for c, x in _POOL_COLUMN}
    return {"old": {**old, _US_SOURCE: every(11, "'n/a'", every(9, "'10'", "'0'"))}, "new": new, "passive": passive,
            "other": {_POOL_COLUMN[0][0]: "5"}}


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw export: text amounts, two layers per entity, some rows of no entity."""
    a = export_amounts()
    rows = [
        _export_row(1, "true", D.GENERAL_BASKET, LAYER_YEAR - 1, D.EP_ACTIVITY, a["old"]),
        _export_row(2, "k % 12 <> 0", D.GENERAL_BASKET, LAYER_YEAR, D.EP_ACTIVITY, a["new"]),
        _export_row(3, "k % 7 = 0", D.GENERAL_BASKET, LAYER_YEAR, "Other", a["other"]),
        _export_row(4, "k % 4 = 0", D.PASSIVE_BASKET, LAYER_YEAR, D.EP_ACTIVITY, a["passive"]),
    ]
    return X.customers(spark, sf_dir).where("n_p > 0").selectExpr(
        "seg AS return_id", f"{every(33, 'CAST(k AS STRING)', 'code')} AS entity_number",
        f"inline(array_compact(array({', '.join(rows)})))")


def name_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code to name list with a repeated code here and there."""
    name = every(13, "concat('Unrelated ', md5(CAST(k AS STRING)))", "cname")
    return X.customers(spark, sf_dir).selectExpr(
        "seg AS return_id",
        f"inline(array_compact(array(struct(concat(code, ' ') AS company_number, {name} AS entity_name, k * 2 AS row_no),"
        f" {every(10, 'struct(code AS company_number, cname AS entity_name, k * 2 + 1 AS row_no)', 'NULL')})))")


def similar_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names with a letter dropped, and the names they come from."""
    c = X.table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_mktsegment AS return_id",
                                                       "upper(md5(CAST(c_custkey AS STRING))) AS name")
    left = c.selectExpr("return_id", f"{every(7, 'reverse(name)', 'concat(substring(name, 1, 10), substring(name, 12, 40))')} AS name")
    return left, c.select("return_id", "name")


# --- documents -----------------------------------------------------------------------


def _tree(specs: list[X.FactSpec], shape: list[X.FactSpec], side: str) -> dict:
    """Nested tags of a form; every occurrence gets the tags of the fullest one."""
    mine = {f.path: getattr(f, side) for f in specs}
    root: dict = {}
    for f in shape:
        if not f.path or getattr(f, side) is None:
            continue
        text = mine.get(f.path, "CAST(NULL AS STRING)")
        node = root
        *parents, leaf = f.path.split("_")
        for p in parents:
            node = node.setdefault(p, {})
        node[leaf] = text
    return root


def _struct(node: dict | str, doc: str | None = None) -> str:
    if isinstance(node, str):
        return node
    parts = [f"'_documentId', {doc}"] if doc else []
    parts += [f"'{name}', {_struct(child)}" for name, child in node.items()]
    return f"named_struct({', '.join(parts)})"


def _subsidiary_xml(side: str) -> str:
    forms = []
    for form in dict.fromkeys(f.form for f in X.FACT_SPECS):
        mine = [f for f in X.FACT_SPECS if f.form == form]
        shape = max(([f for f in mine if f.instance == i] for i in {f.instance for f in mine}), key=len)
        filed = []
        for i in sorted({f.instance for f in mine}):
            specs = [f for f in mine if f.instance == i]
            mark = getattr(next(f for f in specs if not f.path), side)
            filed.append(f"CASE WHEN ({mark}) IS NOT NULL THEN {_struct(_tree(specs, shape, side), mark)} END")
        value = f"array_compact(array({', '.join(filed)}))" if form in D.MULTI_INSTANCE_FORMS else filed[0]
        forms.append(f"'{form}', {value}")
    head = (f"named_struct('SubsidiaryCorpGrp', named_struct('BusinessName', named_struct('BusinessNameLine1Txt', name_{side}),"
            " 'ForeignAddress', named_struct('CityNm', concat('City ', CAST(nat AS STRING)),"
            f" 'CountryCd', {every(3, 'CAST(NULL AS STRING)', 'country')})))")
    return f"to_xml(named_struct('ReturnHeader', {head}, 'ReturnData', named_struct({', '.join(forms)})), map('rowTag', 'SubsidiaryReturn'))"


def _filed(path: str, side: str) -> str:
    """Whole amount that an entity files under a path, zero where it files none."""
    text = next(getattr(f, side) for f in X.FACT_SPECS if f.full_path == path and f.instance == 1)
    return f"COALESCE(CAST({text} AS BIGINT), 0)"


def form_amounts(side: str) -> dict[str, str]:
    """SQL amounts of an entity whose sums over a document its own forms report."""
    tested = _filed(A.TESTED_INCOME, side)
    return {"income": f"greatest({tested}, 0)", "all_tested": tested, "qb": _filed(A.QBAI, side), "tax": _filed(A.TAX, side),
            "elig": _filed(f"{D.SCH_I1}_GrossIncomeLessTotIncmExclAmt", side)}


#: form of the return, instance, basket, tag, SQL text over the sums of a document and its bucket; some are off
RETURN_FORMS = (
    (A.FORM_8992, 1, "", "TestedIncomeAmt", "income + CASE WHEN bucket % 4 = 1 THEN 500 ELSE 0 END"),
    (A.FORM_8992, 1, "", "QBAIAmt", "qb"),
    (A.FORM_8992, 1, "", "GILTIAmt", "all_tested"),
    (A.FORM_8993, 1, "", "ForeignDerivedDeductionEligibleIncomeAmt", "elig - CASE WHEN bucket % 6 = 0 THEN 70 ELSE 0 END"),
    (A.FORM_1118, 1, "", "ForeignTaxesAmt", "tax"),
    (A.FORM_1118, 2, "PAS", "ForeignTaxesAmt", "CASE WHEN bucket % 2 = 0 THEN 9 ELSE 0 END"),
)


def _own_forms_xml() -> str:
    parts = []
    for form, i in dict.fromkeys((f, i) for f, i, *_ in RETURN_FORMS):
        mine = [x for x in RETURN_FORMS if x[:2] == (form, i)]
        basket = f"<SeparateCategoryCd>{mine[0][2]}</SeparateCategoryCd>" if mine[0][2] else ""
        tags = ", ".join(f"'<{t}>', {v}, '</{t}>'" for *_, t, v in mine)
        parts.append(f"'<{form}>{basket}', {tags}, '</{form}>'")
    return f"concat({', '.join(parts)})"


#: names that a folder of partitions carries as they are
PLAIN_NAME = "^[A-Za-z0-9_.-]+$"


def _stored_files(docs: DataFrame, path: str) -> None:
    """Stores texts (ty, doc, value) as one packed file per document.

    On a local or mounted folder the tasks write the files themselves: without Hadoop's
    native library its local file system starts a process for every file and folder.
    Elsewhere, and for names that need care, Spark's writer does it."""
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
        root = where.toUri().getPath()
        plain = F.coalesce(F.col("doc").rlike(PLAIN_NAME) & F.col("ty").isNotNull(), F.lit(False))
        done = docs.where(plain & F.col("value").isNotNull()).select("ty", "doc", F.col("value").cast("binary").alias("value"))
        done.mapInArrow(_file_writer(root), "n long").agg(F.sum("n")).collect()
        docs = docs.where(~plain | F.col("value").isNull())
    # tasks put their files in place themselves, not the driver one by one
    (docs.write.mode("append").option("compression", "gzip").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
     .partitionBy("ty", "doc").text(path))


def _file_writer(root: str):
    def write(batches):
        import os
        import uuid
        import zlib

        import pyarrow as pa

        for batch in batches:
            for ty, doc, value in zip(*(c.to_pylist() for c in batch.columns)):
                folder = f"{root}/ty={ty}/doc={doc}"
                os.makedirs(folder, exist_ok=True)
                packed = zlib.compressobj(wbits=31)
                # a task that runs again puts the same file in the same place
                part = f"{folder}/.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(packed.compress(value + b"\n"))
                    f.write(packed.flush())
                os.replace(part, f"{folder}/part-0.txt.gz")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return write


def write_documents(base: DataFrame, path: str) -> None:
    """One XML file per return of at most 200 entities, with the forms of the return itself.

    Rows meet by document before their text is made, so the short rows are shuffled and not the XML."""
    tasks = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), base.count() // ENTITIES_PER_TASK)
    docs = None
    for side, year in X.SIDES.items():
        rows = base.where(f"n_{side} > 0").withColumn("bucket", F.expr(BUCKET)).repartition(tasks, "seg", "bucket").selectExpr(
            f"{year} AS ty", f"{BOOK} AS doc", "seg", "bucket", "k", f"{_subsidiary_xml(side)} AS xml",
            *(f"{v} AS {n}" for n, v in form_amounts(side).items()))
        mine = rows.groupBy("seg", "bucket", "ty", "doc").agg(
            F.expr("array_sort(collect_list(struct(k, xml))) AS subs"), *(F.sum(n).alias(n) for n in form_amounts("p")))
        docs = mine if docs is None else docs.unionByName(mine)
    text = ("concat('<?xml version=\"1.0\"?>\n<Return xmlns=\"http://www.irs.gov/efile\"><ReturnHeader subsidiaryReturnCount=\"', size(subs),"
            " '\"><ReturnTs>', ty + 1, '-10-15</ReturnTs><TaxPeriodEndDt>', ty, '-12-31</TaxPeriodEndDt><ReturnTypeCd>1120</ReturnTypeCd>"
            "<Filer><EIN>', doc, '</EIN><BusinessName><BusinessNameLine1Txt>', seg, ' GROUP</BusinessNameLine1Txt></BusinessName></Filer>"
            f"<TaxYr>', ty, '</TaxYr></ReturnHeader><ReturnData>', {_own_forms_xml()}, array_join(transform(subs, s -> s.xml), '\n'), '</ReturnData></Return>') AS value")
    _stored_files(docs.selectExpr("ty", "doc", text), path)


def document_path(spark: SparkSession, sf_dir: str) -> str:
    return stored_path(spark, sf_dir, "documents", lambda p: write_documents(X.customers(spark, sf_dir), p))


_SCHEMAS: dict[str, tuple[T.StructType, T.StructType]] = {}


def document_schemas(spark: SparkSession, sf_dir: str) -> tuple[T.StructType, T.StructType]:
    """Schemas of the documents and of the forms of the returns themselves, discovered once per application."""
    path = document_path(spark, sf_dir)
    if path not in _SCHEMAS:
        _SCHEMAS[path] = discover_schemas(spark, path, (A.FORM_8992, A.FORM_8993, A.FORM_1118))
    return _SCHEMAS[path]


def document_schema(spark: SparkSession, sf_dir: str) -> T.StructType:
    return document_schemas(spark, sf_dir)[0]


def return_form_schema(spark: SparkSession, sf_dir: str) -> T.StructType:
    return document_schemas(spark, sf_dir)[1]


def documents(spark: SparkSession, sf_dir: str) -> Ingested:
    """The documents' records, read in one pass and stored once per application."""
    path, schema, forms = document_path(spark, sf_dir), document_schema(spark, sf_dir), return_form_schema(spark, sf_dir)
    return ingested(spark, stored_path(spark, sf_dir, "ingested", lambda out: ingest(spark, path, schema, out, forms)))


#: elements that the narrow schema of the damaged documents leaves out
LEFT_OUT = {"ReturnData": D.SCH_H, f"ReturnData_{D.MAIN}": "IncorporationDt"}
#: by bucket: cut off at the end, or with another count in the header
CUT, MISCOUNTED = "bucket % 7 = 3", "bucket % 5 = 1"


def damaged_documents(spark: SparkSession, sf_dir: str) -> Ingested:
    """The documents again, some cut off, some miscounted, read with a schema that lacks some elements."""

    def write(path: str) -> None:
        root = document_path(spark, sf_dir)
        with listing(spark):
            docs = spark.read.text(root, wholetext=True)
        docs = docs.withColumn("bucket", F.expr("CAST(split(doc, '-')[1] AS INT)"))
        text = f"""CASE WHEN {CUT} THEN substring(value, 1, length(value) - 40)
          WHEN {MISCOUNTED} THEN replace(value, 'subsidiaryReturnCount=\"', 'subsidiaryReturnCount=\"1') ELSE value END AS value"""
        _stored_files(docs.selectExpr("ty", "doc", text), path)

    def narrow(t: T.DataType, path: str) -> T.DataType:
        if isinstance(t, T.ArrayType):
            return T.ArrayType(narrow(t.elementType, path))
        if not isinstance(t, T.StructType):
            return t
        return T.StructType([T.StructField(f.name, narrow(f.dataType, f"{path}_{f.name}" if path else f.name)) for f in t.fields if LEFT_OUT.get(path) != f.name])

    path = stored_path(spark, sf_dir, "damaged", write)
    schema = narrow(document_schema(spark, sf_dir), "")
    return ingested(spark, stored_path(spark, sf_dir, "damaged-ingested", lambda out: ingest(spark, path, schema, out)))
