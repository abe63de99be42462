"""Checks along the ownership graph on small returns."""

import pytest

from crosstie import dims as D
from crosstie.operators import attribution as A
from tests.conftest import FACT_DDL

YEAR = 2024


def rows(code, form, values, instance=1, basket="", return_id="R"):
    return [(return_id, YEAR, 1, code, code, form, instance, "", basket, p, i, str(v), False) for i, (p, v) in enumerate(values.items())]


def held(code, *holders, cfc="X", return_id="R"):
    out = rows(code, D.SCH_G, {A.IS_CFC: cfc}, return_id=return_id) if cfc else []
    for i, (owner, share) in enumerate(holders, 1):
        us = {A.OWNER_US: "X"} if owner.startswith("US") else {}
        out += rows(code, D.SCH_G, {A.OWNER: owner, A.OWNER_SHARE: share} | us, i, return_id=return_id)
    return out


@pytest.fixture
def facts(spark):
    return lambda *parts: spark.createDataFrame([r for p in parts for r in p], FACT_DDL)


def test_roll_up_counts_every_way_down_once(facts):
    # a diamond over three tiers: US holds B and C, both hold D, D holds E
    tree = [held("B", ("US", 0.8)), held("C", ("US", 0.6)), held("D", ("B", 0.5), ("C", 0.5)), held("E", ("D", 1.0))]
    income = [rows(c, D.SCH_I1, {A.TESTED_INCOME: v, A.QBAI: 10}) for c, v in (("B", 100), ("C", -50), ("D", 200), ("E", 1000))]
    # the same codes in another return, wholly owned, must not mix in
    other = [held("B", ("US", 1), return_id="S"), rows("B", D.SCH_I1, {A.TESTED_INCOME: 7}, return_id="S"), rows("US", A.FORM_8992, {f"{A.FORM_8992}_TestedIncomeAmt": 7}, return_id="S")]
    form = rows("US", A.FORM_8992, {f"{A.FORM_8992}_TestedIncomeAmt": 920, f"{A.FORM_8992}_QBAIAmt": 100})
    f = facts(*tree, *income, *other, form)
    got = {r.return_id: r for r in A.roll_up(f, YEAR, A.ROLL_UPS["AGG-001"]).collect()}
    assert got["R"].expected == pytest.approx(0.8 * 100 + 0.7 * 200 + 0.7 * 1000) and got["R"].passes
    assert got["S"].expected == 7 and got["S"].passes
    qbai = {r.return_id: r for r in A.roll_up(f, YEAR, A.ROLL_UPS["AGG-005"]).collect()}
    assert qbai["R"].expected == pytest.approx(28) and qbai["R"].difference == 72 and not qbai["R"].passes
    assert qbai["S"].expected == 0 and qbai["S"].reported is None and qbai["S"].passes


def test_control_findings(facts):
    f = facts(held("B", ("US", 0.51), cfc=None), held("C", ("US", 0.3), ("US2", 0.09), ("X", 0.61)), rows("C", D.SCH_I1, {A.TESTED_INCOME: 1}),
              held("D", ("US", 0.9)), rows("D", D.SCH_I1, {A.TESTED_INCOME: 1}), rows("Z", D.SCH_I1, {A.TESTED_INCOME: 1}))
    got = sorted((r.entity_code, r.check_id, r.held) for r in A.cfc_findings(f, YEAR).collect())
    assert got == [("B", "AGG-003", 0.51), ("C", "AGG-004", 0.3), ("Z", "AGG-004", 0.0)]


def ptep(code, opening, paid, received=None):
    return rows(code, D.SCH_P, {A.PTEP_OPENING: opening, A.PTEP_PAID: paid} | ({A.PTEP_RECEIVED: received} if received is not None else {}))


def test_distributions_carry_from_tier_to_tier_and_broken_links_show(facts):
    tree = [held("B", ("US", 1)), held("C", ("B", 0.5)), held("D", ("C", 1))]
    f = facts(*tree, ptep("D", 100, 150), ptep("C", 0, 100, 100), ptep("B", 0, 50, 40), ptep("US", 0, 0, 50))
    got = {r.entity_code: r for r in A.ptep_flow(f, YEAR).collect()}
    # D has 100 and pays 150: only 100 go up; C passes them on, half to B, which reports 40
    assert got["C"].expected == 100 and got["C"].passes
    assert got["B"].expected == 50 and got["B"].difference == -10 and not got["B"].passes
    assert got["US"].expected == 50 and got["US"].passes and "D" not in got
    broken = facts(*tree, ptep("D", 0, 80), ptep("C", 0, 80, 0), ptep("B", 0, 0, 0))
    got = {r.entity_code: r for r in A.ptep_flow(broken, YEAR).collect()}
    assert got["C"].expected == 0 and got["C"].overdrawn == 80 and not got["C"].passes and got["B"].expected == 0


def test_nothing_is_expected_above_a_cycle(facts):
    f = facts(held("B", ("US", 0.5), ("C", 0.5)), held("C", ("B", 1)), held("D", ("C", 1)), held("E", ("US", 1)),
              ptep("D", 10, 10), ptep("C", 0, 0, 10), ptep("E", 5, 5), ptep("US", 0, 0, 5))
    got = {r.entity_code: (r.level, r.expected, r.passes) for r in A.ptep_flow(f, YEAR).collect()}
    assert got == {c: (None, None, None) for c in ("B", "C", "US")}


def test_allocated_cents_add_up(facts):
    thirds = [held("B", ("US", 1 / 3), ("US2", 1 / 3), ("X", 1 / 3)), held("C", ("B", 0.5), ("US", 0.25))]
    f = facts(*thirds, rows("B", D.SCH_E, {A.TAX: "1.00"}), rows("C", D.SCH_E, {A.TAX: "0.05"}))
    of = A.graph(f, YEAR)
    amounts = A._amounts(f, YEAR, tax=A.TAX).selectExpr(*A.KEYS, "code", "CAST(round(tax * 100) AS BIGINT) AS cents")
    got = {(r.owned, r.owner): r.cents for r in A.allocate_up(of, amounts).collect()}
    # 5 cents of C: 2.5, 1.25 and 1.25 outside, the cent left goes to the largest remainder
    assert (got["C", "B"], got["C", "US"], got["C", A.OUTSIDE]) == (3, 1, 1)
    assert sorted(v for (d, _), v in got.items() if d == "B") == [34, 34, 35] and sum(v for (d, _), v in got.items() if d == "B") == 103
    claims = rows("US", A.FORM_1118, {f"{A.FORM_1118}_DeemedPaidTaxesAmt": "0.36"})
    checked = {r.owner: r for r in A.deemed_paid(facts(*thirds, rows("B", D.SCH_E, {A.TAX: "1.00"}), rows("C", D.SCH_E, {A.TAX: "0.05"}), claims), YEAR).collect()}
    assert checked["US"].allocated == got["B", "US"] + 1 and checked["US"].passes and checked["US2"].reported is None


def test_totals_without_a_graph(facts):
    f = facts(rows("B", D.SCH_I1, {A.TESTED_INCOME: 100}), rows("C", D.SCH_I1, {A.TESTED_INCOME: -30}), rows("B", D.SCH_E, {A.TAX: 5}, 1, "GEN"),
              rows("US", A.FORM_8992, {f"{A.FORM_8992}_TestedIncomeAmt": 100, f"{A.FORM_8992}_GILTIAmt": 100}), rows("US", A.FORM_1118, {f"{A.FORM_1118}_ForeignTaxesAmt": 5}, 1, "PAS"))
    got = {(r.check, r.basket): (r.entities, r.reported, r.passes) for r in A.cross_form_totals(f, YEAR).collect()}
    assert got == {("8992 tested income", ""): (100, 100, True), ("951A inclusion", ""): (70, 100, False),
                   ("1118 taxes by basket", "GEN"): (5, 0, False), ("1118 taxes by basket", "PAS"): (0, 5, False)}
