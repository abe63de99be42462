"""Histories of entities and their trends."""

from crosstie.operators import history as H

SCHEMA = "return_id string, tax_year int, entity_code string, entity_name string, amount double"


def filed(spark, *rows):
    return spark.createDataFrame([("R", *r) if isinstance(r[0], int) else r for r in rows], SCHEMA)


def linked(df):
    return {(r.return_id, r.entity_code): r.history_id for r in H.histories(df).collect()}


def test_renamed_and_renumbered_twice_stays_one_history(spark):
    df = filed(spark, (2018, "A1", "Alpha", 10.0), (2019, "A1", "Alpha Two", 20.0), (2020, "A2", "alpha two ", 30.0), (2021, "A2", "Alpha Three", 40.0),
               (2022, "A3", "Alpha Three", 50.0), (2022, "B", "Alpha Two", 1.0), ("S", 2022, "A3", "Alpha", 1.0))
    # B begins under a name that A2 no longer has: a history of its own
    assert linked(df) == {("R", "A1"): "A1", ("R", "A2"): "A1", ("R", "A3"): "A1", ("R", "B"): "B", ("S", "A3"): "A3"}
    got = H.trends(df, H.histories(df)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.history_id, r.first_year, r.last_year, r.n_years, r.missing, r.n_codes, r.n_names) == ("A1", 2018, 2022, 5, 0, 3, 3)
    assert r.slope == 10.0 and r.breaks == 1 and r.turns == 0 and r.trend == "rising"  # 10 to 20 is a break, 20 to 30 is not above half


def test_ties_blanks_and_shared_names(spark):
    df = filed(spark, (2018, "A", "Same", 1.0), (2018, "B", "Same", 1.0), (2020, "C", "Same", 1.0), (2020, "D", "Same", 1.0), (2021, "E", "Same", 1.0),
               (2018, "F", "", 1.0), (2019, "G", "", 1.0), (2019, "", "Same", 1.0), (2018, "H", None, 1.0), (2019, "I", None, 1.0))
    got = linked(df)
    # C takes up A; what ended before 2021 under the name is C and D of 2020, and the smaller is C
    assert got["R", "C"] == "A" and got["R", "D"] == "D" and got["R", "B"] == "B" and got["R", "E"] == "A"
    assert all(got["R", c] == c for c in "FGHI") and ("R", "") not in got
    assert H.histories(df.where("false")).collect() == []


def test_gaps_breaks_and_turns(spark):
    df = filed(spark, (2015, "A", "x", 100.0), (2016, "A", "x", None), (2018, "A", "x", 250.0), (2019, "A", "x", -10.0), (2020, "A", "x", -20.0),
               (2019, "B", "y", 1.0), (2020, "B", "y", 2.0), (2018, "C", "z", 5.0), (2019, "C", "z", 4.0), (2020, "C", "z", 3.0))
    got = {r.history_id: r for r in H.trends(df, H.histories(df)).collect()}
    assert set(got) == {"A", "C"}
    a = got["A"]
    # 50 a year over the gap is no more than half of 100; then the fall below zero and the doubled loss
    assert (a.n_years, a.missing, a.breaks, a.turns, a.trend) == (4, 2, 2, 1, "falling")
    assert (got["C"].trend, got["C"].slope, got["C"].breaks) == ("falling", -1.0, 0)
