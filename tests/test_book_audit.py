"""Signs, look-ups and the cross-check of amounts on small tables."""

import random

from crosstie import workbook_dims as W
from crosstie.operators import book_audit as B


def test_signs_are_inherited_from_the_next_total():
    families = {(s, f): (e, h) for s, f, e, h in B.sign_families()}
    assert families["sch_c_fc", "ForeignInterestExpenseAmt"] == (-1, "ForeignTotalDeductionsAmt")
    assert families["sch_c_fc", "ForeignDividendIncomeAmt"] == (1, "ForeignTotalIncomeAmt")
    assert families["sch_c_fc", "ForeignReturnsAndAllowancesAmt"] == (-1, "ForeignReturnsAndAllowancesAmt")
    # lines below the last total with a rule have none
    assert ("sch_c_fc", "ForeignNetIncomeBeforeTaxAmt") not in families and ("sch_c_fc", "ForeignCurrencyTranslationAmt") not in families


def test_sign_findings_stand_beside_their_cells(spark):
    m = W.MATRIX_LAYOUTS["sch_c_fc"]
    row = {f: m.first_row + o for o, _, f in m.lines}
    sheet, c = W.SHEET_CANDIDATES["sch_c_fc"][1], m.first_col
    cells = [("W", sheet, m.header_row, c, "C1"), ("W", sheet, m.header_row, c + 1, "C2"), ("W", sheet, m.header_row, c + 2, "TOTAL"), ("W", sheet, m.header_row, c + 3, "C3"),
             ("W", sheet, row["ForeignInterestExpenseAmt"], c, "5"), ("W", sheet, row["ForeignInterestExpenseAmt"], c + 1, "-5"),
             ("W", sheet, row["ForeignInterestExpenseAmt"], c + 3, "5"), ("W", sheet, row["ForeignTotalIncomeAmt"], c + 1, "-1"),
             ("W", sheet, row["ForeignTotalIncomeAmt"], c, "n/a"), ("W", sheet, row["ForeignTaxesAmt"], c, "0")]
    got = B.sign_convention(spark.createDataFrame(cells, "workbook_id string, sheet string, row int, col int, value string")).collect()
    assert sorted((r.entity_code, r.sheet, r.row, r.col, r.family, r.amount) for r in got) == [
        ("C1", sheet, row["ForeignInterestExpenseAmt"], c, "ForeignTotalDeductionsAmt", 5.0), ("C2", sheet, row["ForeignTotalIncomeAmt"], c + 1, "ForeignTotalIncomeAmt", -1.0)]


def test_lookups_are_followed_to_their_end(spark):
    rows = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "R"), ("E", "ELIM9"), ("F", "nowhere"), ("G", "H"), ("H", "G"), ("I", "G"), ("S", "S"), ("R", "X"), ("T", " "), ("T", None)]
    lookups = spark.createDataFrame([("1", *r) for r in rows] + [("2", "A", "R")], "return_id string, entity_code string, target string")
    registry = spark.createDataFrame([("1", "R"), ("1", "R"), ("1", "")], "return_id string, entity_code string")
    got = {(r.return_id, r.entity_code): (r.resolved, r.steps, r.status) for r in B.pseudo_entities(lookups, registry).collect()}
    assert got["1", "A"] == ("R", 4, "registered") and got["1", "D"] == ("R", 1, "registered") and got["1", "R"] == ("R", 0, "registered")
    assert got["1", "E"] == ("ELIM9", 1, "elimination") and got["1", "F"] == ("nowhere", 1, "pseudo") and got["1", "T"] == ("T", 0, "pseudo")
    assert all(got["1", c] == (None, None, "loop") for c in "GHIS") and got["2", "A"] == ("R", 1, "pseudo")
    assert B.pseudo_entities(lookups.where("false"), registry).collect() == []


def pairs(spark, left, right, tolerance=1.0):
    a = spark.createDataFrame([("k", r, v) for r, v in left], "key string, ref string, amount double")
    b = spark.createDataFrame([("k", r, v) for r, v in right], "key string, ref string, amount double")
    return [(r.ref, r.other_ref, r.status) for r in B.crosscheck(a, b, ["key"], tolerance).collect()]


def test_amounts_pair_one_to_one_under_the_other_sign(spark):
    got = pairs(spark, [("a", 100.0), ("b", 100.0), ("c", 100.6), ("d", 50.0), ("z", 0.0), ("n", None), ("e", -7.0)],
                [("x", -100.0), ("y", -100.4), ("w", -101.2), ("v", 50.0), ("u", 7.5)])
    # x is exact for one of a and b; y is nearer to c than to the other one of them; w is left to none
    assert sorted(got, key=str) == sorted([("a", "x", "exact"), ("c", "y", "near"), ("b", None, "left_only"), ("d", None, "left_only"), (None, "v", "right_only"),
                                           (None, "w", "right_only"), ("e", "u", "near")], key=str)


def test_second_rounds_and_repeated_amounts(spark):
    # 2 goes to 2.1 first, then 1.2 is free for 1.3 only in a later round
    got = pairs(spark, [("a", 2.0), ("b", 1.0)], [("x", -2.1), ("y", -1.6)])
    assert sorted(got) == [("a", "x", "near"), ("b", "y", "near")]
    many = pairs(spark, [(f"l{i:04}", 5.0) for i in range(300)] + [("m", 5.5)], [(f"r{i:04}", -5.0) for i in range(200)] + [(f"s{i:04}", -5.25) for i in range(50)])
    assert sum(s == "exact" for *_, s in many) == 200 and sum(s == "near" for *_, s in many) == 50 and sum(s == "left_only" for *_, s in many) == 51
    used = [o for _, o, _ in many if o]
    assert len(used) == len(set(used))


def test_every_left_pair_is_within_the_tolerance_and_nothing_pairable_is_left(spark):
    rng = random.Random(8)
    left = [(f"l{i}", round(rng.uniform(1, 30), 2)) for i in range(60)]
    right = [(f"r{i}", -round(rng.uniform(1, 30), 2)) for i in range(60)]
    got = pairs(spark, left, right, 0.4)
    a, b = dict(left), dict(right)
    assert all(abs(a[x] + b[y]) <= 0.4 + 1e-9 for x, y, _ in got if x and y)
    lone_a, lone_b = [x for x, y, _ in got if y is None], [y for x, y, _ in got if x is None]
    assert not any(abs(a[x] + b[y]) <= 0.4 for x in lone_a for y in lone_b)
    assert len(got) == 120 - sum(1 for x, y, _ in got if x and y)
