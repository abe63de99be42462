"""What the registered queries read, write and compile, so that they hold on larger tables."""

import io
import re
import shutil
from contextlib import redirect_stdout

import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry
from crosstie import dims as D
from crosstie.operators import compare as CP
from crosstie.operators import rollover as RO
from crosstie.plans import fixture as X
from crosstie.plans import inputs as I
from crosstie.plans import store
from crosstie.sinks import tables as S
from crosstie.sources import xml

SF = "/root/testdata/sf0.001"
#: the JVM compiles no method of more bytes
HUGE_METHOD = 8000


@pytest.mark.parametrize("name, years, forms", [
    ("wide_by_basket", (X.PY, X.CY), [D.SCH_J]), ("schf_rollover_banded", (X.PY, X.CY), [D.MAIN, D.SCH_F]), ("sink_import", (X.PY, X.CY), [D.SCH_J]),
    ("rollover_mismatches", (X.PY, X.CY), [D.MAIN, D.SCH_F]), ("oit_crosscheck", (X.CY,), [D.MAIN]), ("diff_by_category", (X.PY, X.CY), [D.SCH_J])])
def test_only_the_forms_that_are_read_are_made(spark, tmp_path, name, years, forms):
    sf_dir = shutil.copytree(SF, tmp_path / name).as_posix()
    got = entry.queries()[name](spark, sf_dir)
    assert {n for _, at, n in store._PATHS if at == sf_dir and n.startswith("facts/")} == {f"facts/tax_year={y}/form={f}" for y in years for f in forms}
    want = entry.queries()[name](spark, SF)
    assert got.count() > 0 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_facts_are_made_by_methods_that_the_jvm_compiles(spark):
    base = X.customers(spark, SF)
    for side in X.SIDES:
        for form in X.FORMS:
            out = io.StringIO()
            with redirect_stdout(out):
                X.build_facts(base, side, form).explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
            assert sizes and max(sizes) < HUGE_METHOD


def test_documents_are_stored_alike_by_tasks_and_by_the_writer(spark, tmp_path, monkeypatch):
    """One packed file per document, without a check file beside it; names that need care and missing texts as before."""
    rows = [(1996, "A_1992-0", "<a>é</a>\n<b/>"), (1997, "A_1992-0", "<a/>"), (1996, "B C/1-1", "<c/>"), (1997, None, None), (1997, "D-2", None), (1997, "D-3", "")]
    docs = spark.createDataFrame(rows, "ty int, doc string, value string")

    def stored(name):
        path = (tmp_path / name).as_posix()
        I._stored_files(docs, path)
        files = [p for p in (tmp_path / name).rglob("*") if p.is_file() and "=" in p.parent.name]
        back = spark.read.text(path, wholetext=True)
        return {p.parent.relative_to(tmp_path / name).as_posix() for p in files}, sorted(map(repr, back.collect())), [p for p in files if p.name.endswith(".crc")]

    folders, texts, checks = stored("tasks")
    monkeypatch.setattr(I, "PLAIN_NAME", "^$")
    assert (folders, texts) == stored("writer")[:2]
    assert len(folders) == len(rows) and not [p for p in checks if "A_1992-0" in p.parent.name or "D-3" in p.parent.name]


def test_facts_of_single_forms_are_compiled(spark):
    """Only forms that repeat are read below a lambda, and absent facts are left out in a step of its own."""
    schema = T.StructType.fromDDL(f"ReturnData struct<{D.MAIN}: struct<_documentId: string, EIN: string, A: array<string>>,"
                                  f" {D.SCH_J}: array<struct<SeparateCategoryCd: string, X: string>>>")
    text = xml.fact_array(schema)
    assert f"array(ReturnData.`{D.MAIN}`)" not in text and f"transform(ReturnData.`{D.SCH_J}`, (e, i)" in text and not text.startswith("filter(")
    data = [(((None, None, ["1", None]), [("GEN", "5"), ("PAS", None)]),), ((None, None),), (None,)]
    got = spark.createDataFrame(data, schema).selectExpr(f"{text} AS _all").selectExpr(f"{xml._FILLED} AS facts").collect()
    short = [[(f.form, f.instance, f.basket, f.path, f.value) for f in r.facts] for r in got]
    j = D.SCH_J
    assert short == [[(D.MAIN, 1, "", D.MAIN, ""), (D.MAIN, 1, "", f"{D.MAIN}_A", "1"), (j, 1, "GEN", j, ""), (j, 1, "GEN", f"{j}_SeparateCategoryCd", "GEN"), (j, 1, "GEN", f"{j}_X", "5"),
                      (j, 2, "PAS", j, ""), (j, 2, "PAS", f"{j}_SeparateCategoryCd", "PAS")], [], []]


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_comparison_sorts_once_and_reads_the_first_entity_of_a_name(make_facts):
    h = D.SCH_H
    facts = make_facts([
        (1, 5, "C5", "Acme", {h: {"A": "5", "B": "1"}}), (1, 7, "C7", "Acme", {h: {"A": "9", "Z": "9"}}), (1, 1, "C1", "Old", {h: {"A": "1"}}),
        (2, 6, "C6", "Acme", {h: {"A": "6", "C": "2000"}}), (2, 8, "C8", "Acme", {h: {"B": "9"}}), (2, 2, "C2", "New", {h: {"A": "1"}})])
    noname = make_facts([(1, 1, "C1", None, {h: {"A": "1"}}), (2, 1, "C1", None, {h: {"A": "2"}})])
    changes = CP.compare_returns(facts.union(noname), 1, 2)
    text = plan(changes)
    assert "SortMergeJoin" not in text and len(re.findall(r"^\(\d+\) Sort( |$)", text, re.MULTILINE)) == 1
    assert {(r.entity_name, r.field, r.old_value, r.new_value, r.material) for r in changes.collect()} == {
        ("Acme", f"{h}_A", "5", "6", False), ("Acme", f"{h}_B", "1", "nan", False), ("Acme", f"{h}_C", "nan", "2000", True)}


def test_match_moves_keys_and_keeps_rows_apart_that_share_a_number(spark):
    side = "return_id string, sub_no bigint, entity_code string, entity_name string, m map<string, string>"
    py = spark.createDataFrame([("R", 1, "C1", "Acme", {"v": "a"}), ("R", 1, "C2", "Beta", {"v": "b"}), ("R", 3, None, "Gamma", {"v": "c"}), ("R", 4, "C4", "Gone", {"v": "d"})], side)
    cy = spark.createDataFrame([("R", 2, "C1", "Acme", {"v": "x"}), ("R", 2, "C2", "Beta", {"v": "y"}), ("R", 5, "", "GAMMA", {"v": "z"}), ("Q", 4, "C4", "Gone", {"v": "w"})], side)
    pairs = RO.match_entities(py, cy)
    assert {(r.entity_name, r.py_sub, r.cy_sub, r.p["v"], r.c["v"]) for r in pairs.collect()} == {
        ("Acme", 1, 2, "a", "x"), ("Beta", 1, 2, "b", "y"), ("Gamma", 3, 5, "c", "z")}
    assert not re.search(r"max_by\([^)]*m#", plan(pairs))


def test_report_texts_and_stored_tables_are_packed(spark, make_facts, tmp_path):
    facts = make_facts([(y, 1, "C1", "A", {D.SCH_H: {D.EP_MOVEMENT_FIELDS[0][0]: str(y * 5000)}}) for y in (1, 2)])
    csv, md = (tmp_path / "csv").as_posix(), (tmp_path / "md").as_posix()
    S.write_csv_reports(RO.ep_movement(facts, 1, 2), csv)
    S.write_markdown(CP.compare_table(facts, 1, 2), md)
    parts = [p.name for p in tmp_path.rglob("part-*")]
    assert any(p.endswith(".csv.gz") for p in parts) and all(p.endswith(".gz") for p in parts)
    back = spark.read.option("header", True).csv(csv)
    assert (back.count(), back.first().status, back.first().report) == (1, "PASS", D.REPORTS[3])
    assert [r.value[:5] for r in spark.read.text(md).collect()] == ["| A |"]
    X.customers(spark, SF)
    at = next(p for (app, d, n), p in store._PATHS.items() if d == SF and n == "customers" and app == spark.sparkContext.applicationId)
    assert any(p.endswith(".zstd.parquet") for p in spark.read.parquet(at).inputFiles())


@pytest.mark.parametrize("name", ["compare_summary", "rollover_summary", "pass_rate"])
def test_summaries_store_no_rows_that_they_read_once(spark, tmp_path, name):
    sf_dir = shutil.copytree(SF, tmp_path / name).as_posix()
    assert entry.queries()[name](spark, sf_dir).count() > 0
    assert not {n for _, at, n in store._PATHS if at == sf_dir} & {"changes", "report_items"}
