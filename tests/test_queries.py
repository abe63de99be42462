"""Registered queries against their SQL on the smallest tables, and plan shapes."""

import io
from collections import Counter
from contextlib import redirect_stdout

import duckdb
import pytest

import __spark_entry__ as entry
from crosstie.operators import review as R
from crosstie.plans import catalog
from crosstie.plans import fixture as X

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()
SAMPLE = ["flo_002", "rol_001", "rol_007", "rol_009", "rsn_005", "findings_summary", "flatten_facts", "entity_info", "workbook_layout_a",
          "compare_table", "full_review", "schj_basket_rollover", "genuine_gaps", "reconcile", "schf_compare", "verify_adjustment",
          "beginning_balance_adjust", "form_comparison_h", "sink_import", "stream_single_year", "fuzzy_name_match"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(r[c] for c in cols) for r in df.collect())
    res = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == Counter(tuple(r[i] for i in at) for r in res.fetchall())


def test_every_query_has_a_check():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_review_prunes_scans_and_never_pairs_everything(spark):
    text = plan(R.run_rules(X.facts(spark, SF), ["FLO-001", "ROL-004"], X.CY, X.PY, names=False))
    assert "PartitionFilters: [tax_year" in text and "PushedFilters: [" in text
    assert "In(path" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:4] == ["return_id", "check_id", "severity", "category"]
