"""Reports on hand-made pairs: matching, baskets, comparison, reconciliation."""

from crosstie import dims as D
from crosstie.operators import compare as CP
from crosstie.operators import pools as P
from crosstie.operators import reconcile as RC
from crosstie.operators import rollover as RO

PY, CY = 1, 2
POOL = "Post2017EPNotPrevTaxedGrp"


def test_match_by_code_then_name_and_last_wins(make_facts):
    tag = D.end_tag("Cash"), D.begin_tag("Cash")
    facts = make_facts([
        (PY, 1, "C1", "Acme", {D.SCH_F: {tag[0]: "10"}}), (PY, 2, "", "Beta", {D.SCH_F: {tag[0]: "20"}}), (PY, 3, "C3", "Gone", {D.SCH_F: {tag[0]: "1"}}),
        (CY, 1, "C1", "Other name", {D.SCH_F: {tag[1]: "99"}}), (CY, 2, "C1", "Acme", {D.SCH_F: {tag[1]: "10.5"}}), (CY, 3, "C9", "BETA", {D.SCH_F: {tag[1]: "x"}})])
    rows = {r.entity_name: (r.py_value, r.cy_value, r.difference, r.passes) for r in RO.schf_rollover(facts, PY, CY).collect()}
    assert rows == {"Acme": ("10", "10.5", 0.5, True), "Beta": ("20", "x", 0.0, False)}
    changes = {(r.entity_name, r.description[:3]) for r in RO.entity_changes(facts, PY, CY).collect()}
    assert changes == {("Gone", "REM"), ("Beta", "REM"), ("BETA", "NEW")}


def test_last_basket_and_basket_rollover(make_facts):
    boy, eoy = f"{POOL}_{D.J_BOY}", f"{POOL}_{D.J_EOY}"

    def j(tag, *values):
        return {D.SCH_J: [{"SeparateCategoryCd": b, tag: v} for b, v in values]}

    facts = make_facts([(PY, 1, "C1", "A", j(eoy, ("GEN", "100"), ("PAS", "7"), ("TOTAL", "107"))),
                        (CY, 1, "C1", "A", j(boy, ("GEN", "100"), ("GEN", "5"), ("TOTAL", "200")))])
    last = RO.schj_rollover(facts, PY, CY).first()
    assert (last.py_value, last.cy_value, last.passes) == ("107", "200", False)
    got = {(r.basket, r.py_ending, r.cy_beginning, r.status) for r in P.schj_basket_rollover(facts, PY, CY).collect()}
    assert got == {("GEN", 100.0, 100.0, "OK"), ("PAS", 7.0, 0.0, "REVIEW")}
    rows = P.import_rows(P.schj_basket_rollover(facts, PY, CY), 2024).collect()
    assert len(rows) == 1 and rows[0]["959(c)(3) Foreign Source E&P (FC)"] == "7.0" and len(rows[0]) == 66


def test_compare_same_file_is_empty(make_facts):
    forms = {D.SCH_H: {"ExchangeRt": "1", "OtherAmt": ""}}
    facts = make_facts([(y, 1, "C1", "A", forms) for y in (PY, CY)])
    assert CP.compare_table(facts, PY, CY).count() == 0
    more = make_facts([(PY, 1, "C1", "A", {D.SCH_H: {"ExchangeRt": "5"}}), (CY, 1, "C1", "A", {D.SCH_H: {"ExchangeRt": "2005", "New": "x"}})])
    got = {(r.field, r.old_value, r.new_value, r.numeric_diff, r.material) for r in CP.compare_table(more, PY, CY).collect()}
    assert got == {(f"{D.SCH_H}_ExchangeRt", "5", "2005", 2000.0, True), (f"{D.SCH_H}_New", "nan", "x", None, False)}


def test_reconcile_statuses(spark, make_facts):
    tags = ["DepletionAmt", "InventoryAdjustmentsAmt", "TaxesNetAddnAmt", "TotalNetAdditionsAmt"]
    facts = make_facts([(CY, 1, "C1", "A", {D.SCH_H: dict(zip(tags, ["10", "", "abc", "5"]))}), (CY, 2, "C2", "B", {D.SCH_H: {}})])
    wb = [("C1", tags[0], "11"), ("C1", tags[1], "0"), ("C1", tags[2], " abc "), ("C1", tags[3], "7"), ("C2", tags[0], "0"), ("C2", tags[3], "3"),
          ("C9", tags[0], "1"), ("C1", "CapitalGainsOrLossesAmt", "1")]
    rows = spark.createDataFrame([("R", "sch_h_fc", c, f, v) for c, f, v in wb], "return_id string, schedule string, entity_code string, field string, value string")
    got = {(r.entity_code, r.field_name): (r.status, r.delta, r.line) for r in RC.reconcile(rows, facts, CY).collect()}
    assert got == {
        ("C1", tags[0]): ("PASS", 1.0, "2c"), ("C1", tags[1]): ("TYPE_MISMATCH", None, "2f"), ("C1", tags[2]): ("PASS", None, "2g"),
        ("C1", tags[3]): ("FAIL", 2.0, "3"), ("C2", tags[0]): ("DORMANT_OK", None, "2c"), ("C2", tags[3]): ("FAIL", 3.0, "3"), ("C9", tags[0]): ("XML_MISSING", None, "2c")}
    again = make_facts([(CY, 1, "C1", "A", {D.SCH_H: {tags[0]: "10"}}), (CY, 2, "C1", "A2", {D.SCH_H: {tags[0]: "99"}})])
    assert [r.status for r in RC.reconcile(rows.where("entity_code = 'C1' AND field = 'DepletionAmt'"), again, CY).collect()] == ["PASS"]


def test_entities_of_one_name_do_not_mix(make_facts):
    """The first entity of a name stands for it; a second one's change is not its."""
    from crosstie import dims as D
    from crosstie.operators import compare as CP

    ep = "CurrEarnAndPrftInUSDollarsAmt"
    facts = make_facts([
        (1996, 1, "C1", "Acme", {D.SCH_H: {ep: "5"}}), (1996, 2, "C2", "Acme", {D.SCH_H: {ep: "7", "ForeignCYNetIncomePerBooksAmt": "1"}}),
        (1997, 3, "C1", "Acme", {D.SCH_H: {ep: "5"}}), (1997, 4, "C2", "Acme", {D.SCH_H: {ep: "9000", "ForeignCYNetIncomePerBooksAmt": "8000"}}),
    ])
    assert CP.compare_returns(facts, 1996, 1997, forms=(D.SCH_H,)).count() == 0


def test_lists_are_cut_within_each_return(make_facts):
    from crosstie import dims as D
    from crosstie.operators import reshape as RS

    ep = "CurrEarnAndPrftInUSDollarsAmt"
    facts = None
    for r in ("R1", "R2"):
        part = make_facts([(1997, i, f"C{i}", f"N{i}", {D.SCH_H: {ep: str(i)}}) for i in range(5)], return_id=r)
        facts = part if facts is None else facts.union(part)
    assert {r.return_id: r["count"] for r in RS.top_ep(facts, 1997, 3).groupBy("return_id").count().collect()} == {"R1": 3, "R2": 3}


def test_full_review_is_the_seven_reports_in_one_match(make_facts):
    end, begin = D.end_tag("Cash"), D.begin_tag("Cash")
    pool = D.RULE_POOLS[0][0]
    g = f"{D.SCH_G}_{D.INDICATOR_REPORT_FIELDS[0][0]}"
    facts = make_facts([
        (PY, 1, "C1", "Acme", {D.MAIN: {"FunctionalCurrencyCd": "EUR", "EIN": "1", g: "X", f"{D.SCH_F}_{end}": "7"}, D.SCH_F: {end: "10"}, D.SCH_H: {"TotalNetAdditionsAmt": "5"},
                               D.SCH_J: [{f"{pool}_{D.J_EOY}": "3"}, {f"{pool}_{D.J_EOY}": "4"}], D.SCH_I1: {D.GILTI_FIELDS[0][0]: "9"}}),
        (PY, 2, "", "Beta", {D.SCH_F: {end: "20"}}), (PY, 3, "C3", "Gone", {D.SCH_F: {end: "1"}}),
        (CY, 1, "C1", "Old row", {D.SCH_F: {begin: "0"}}),
        (CY, 2, "C1", "Acme", {D.MAIN: {"FunctionalCurrencyCd": "usd ", "EIN": " 1"}, D.SCH_F: {begin: "10.5"}, D.SCH_H: {"TotalNetAdditionsAmt": "8"},
                               D.SCH_J: {f"{pool}_{D.J_BOY}": "4"}, D.SCH_I1: {D.GILTI_FIELDS[0][0]: ""}}),
        (CY, 3, "C9", "BETA", {D.SCH_F: {begin: "x"}})])
    parts = [f(facts, PY, CY) for f in (RO.schf_rollover, RO.schj_rollover, RO.page1_rollover, RO.ep_movement, RO.gilti_comparison, RO.entity_changes, RO.schg_changes)]
    expected = sorted(str(r) for p in parts for r in p.collect())
    whole = RO.full_review(facts, PY, CY)
    assert sorted(str(r) for r in whole.collect()) == expected and len({r.report for r in whole.collect()}) == 7
    plan = RO.full_review(facts, PY, CY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6


def test_metadata_of_both_kinds_of_books(spark):
    from crosstie import workbook_dims as W
    from crosstie.sources import grid

    cells = [("A", "5471 Sch H", 1, 1, "Client A"), ("A", "5471 Sch H", 2, 1, "FY2024 x"), ("F", W.FOREIGN_SUMMARY_SHEET, 1, 1, "Client F"),
             ("F", W.FOREIGN_SUMMARY_SHEET, 2, 1, "For the years 2023 and 2024"), ("G", W.FOREIGN_SUMMARY_SHEET, 5, 1, "FC1"), ("Z", "Other", 1, 1, "q")]
    got = {r.workbook_id: (r.client_name, r.tax_year) for r in grid.workbook_metadata(
        spark.createDataFrame(cells, "workbook_id string, sheet string, row int, col int, value string")).collect()}
    assert got["A"][0] == "Client A" and got["F"] == ("Client F", "2023") and got["G"] == ("", "") and got["Z"] == ("", "")
