"""The registered inputs cover all order years."""

from pyspark.sql import functions as F

from crosstie.plans import fixture as X

SF = "/root/testdata/sf0.001"


def test_pairs_hold_every_line_of_both_years(spark):
    orders = X.table(spark, SF, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    lines = X.table(spark, SF, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(orders, "o_orderkey")
    per_year = {r.y: r["count"] for r in lines.groupBy("y").count().collect()}
    got = {r.pair: (r.p, r.c) for r in X.customers(spark, SF).groupBy("pair").agg(F.sum("n_p").alias("p"), F.sum("n_c").alias("c")).collect()}
    assert len(got) > 1
    assert got == {y: (n, per_year[y + 1]) for y, n in per_year.items() if y + 1 in per_year}


def test_a_year_without_its_neighbours_makes_no_pair(spark):
    years = spark.createDataFrame([(1990,), (1991,), (1992,), (1995,)], "y int")
    rows = {(r.pair, r.y, r.side) for r in X._year_sides(years).collect()}
    assert rows == {(1990, 1990, "p"), (1990, 1991, "c"), (1991, 1991, "p"), (1991, 1992, "c")}
    assert X._year_sides(years.where("y = 1995")).count() == 0


def test_facts_of_an_entity_in_several_pairs_stay_apart(spark):
    marks = X.facts(spark, SF).where("path = 'IRS5471'")
    assert marks.count() == marks.select("return_id", "tax_year", "entity_code").distinct().count()
    assert marks.groupBy("entity_code").agg(F.countDistinct("return_id").alias("n")).agg(F.max("n")).first()[0] > 1


def test_a_query_makes_only_the_facts_it_reads(spark, tmp_path):
    """One narrow write per year and form, and none that nobody asked for."""
    import shutil

    from crosstie import dims as D
    from crosstie.plans import store

    sf_dir = shutil.copytree(SF, tmp_path / "tables").as_posix()
    some = X.facts(spark, sf_dir, X.CY, forms=[D.SCH_C])

    def made():
        return {name for _, at, name in store._PATHS if at == sf_dir and name.startswith("facts/")}

    assert made() == {f"facts/tax_year={X.CY}/form={D.SCH_C}"}
    whole = X.facts(spark, sf_dir)
    assert made() == {f"facts/tax_year={y}/form={f}" for y in (X.PY, X.CY) for f in X.FORMS}
    assert some.columns == whole.columns and some.schema == whole.schema
    same = whole.where((F.col("tax_year") == X.CY) & (F.col("form") == D.SCH_C))
    assert some.count() > 0 and some.exceptAll(same).count() == same.exceptAll(some).count() == 0


def test_facts_are_written_without_a_sort(spark):
    base = X.customers(spark, SF)
    for side in X.SIDES:
        for form in X.FORMS:
            plan = X.build_facts(base, side, form)._jdf.queryExecution().executedPlan().toString()
            assert "Sort [" not in plan and "Exchange hashpartitioning" not in plan


def test_rules_ask_for_all_that_they_read(spark):
    from crosstie.operators import review as R
    from crosstie.operators.rules import RULES
    from crosstie.plans import q_rules

    whole = X.facts(spark, SF)
    for rule_id in ("FLO-002", "ROL-008", "ROL-009", "ROL-001"):
        assert rule_id in RULES
        years, forms = q_rules._read_by(rule_id)
        got = R.run_rules(X.facts(spark, SF, *years, forms=forms), [rule_id], X.CY, X.PY, names=False)
        want = R.run_rules(whole, [rule_id], X.CY, X.PY, names=False)
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
