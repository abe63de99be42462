"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.  The inputs derived
from them (facts, workbook cells, documents) are built first and reported on
their own; every query is then timed over its full result.

The registered queries read all pairs of order years; timing keeps to one pair,
the amount of data that earlier figures and the published ones (two years) are for.
``BENCH_ALL_YEARS=1`` times all pairs.
"""

from __future__ import annotations

import json
import os
import time

from crosstie.plans import catalog, fixture, inputs
from crosstie.session import local_session

HEADLINE = [
    "review_full", "review_single", "rol_001", "rol_007", "flatten_facts", "list_entities", "compare_table",
    "full_review", "schj_basket_rollover", "workbook_layout_a", "reconcile", "schf_compare", "ep_to_schj_tieout",
    "entity_targets", "beginning_balance_adjust", "fuzzy_name_match", "form_comparison_f", "schc_extract",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    if os.environ.get("BENCH_ALL_YEARS") != "1":
        fixture.FIRST_YEARS = (fixture.PY,)
    spark = local_session(cpus, "crosstie-bench")
    inputs_sec = {}
    for name, build in (("facts", fixture.facts), ("grid_cells", inputs.grid_cells), ("documents", inputs.document_path),
                        ("document_schema", inputs.document_schema), ("return_form_schema", inputs.return_form_schema)):
        start = time.perf_counter()
        build(spark, sf_dir)
        inputs_sec[name] = round(time.perf_counter() - start, 3)
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "inputs": inputs_sec, "first_years": fixture.FIRST_YEARS, "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
