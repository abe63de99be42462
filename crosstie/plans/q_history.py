"""Trends over all order years: one customer is one entity, filing each year in
which it has orders.  Some are renumbered, some renamed, some both at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie.operators import history as H
from crosstie.plans import fixture as X
from crosstie.plans.registry import plain
from crosstie.plans.store import stored_table
from crosstie.schema import FACT_COLUMNS, FACT_PARTITIONS

PATH = f"{D.SCH_H}_CurrEarnAndPrftInUSDollarsAmt"

#: SQL texts over k, y (year), n (orders), g (whole amount) that both engines read
_CODE = ("CASE WHEN (k % 5 = 0 AND y >= 1994 + k % 3) OR (k % 11 = 0 AND y >= 1996) THEN concat('D', lpad(CAST(k AS STRING), 6, '0'))"
         " ELSE concat('C', lpad(CAST(k AS STRING), 6, '0')) END")
_NAME = ("CASE WHEN k % 11 = 0 AND y >= 1996 THEN concat('Successor ', CAST(k AS STRING)) WHEN k % 7 = 0 AND y >= 1997 THEN concat('Renamed ', CAST(k AS STRING), ' LTD')"
         " WHEN k % 7 = 0 AND y >= 1993 THEN concat('Renamed ', CAST(k AS STRING)) ELSE cname END")
_AMOUNT = "CASE WHEN k % 17 = y % 17 THEN 'n/a' WHEN k % 13 = y % 13 THEN CAST(-g AS STRING) ELSE CAST(g AS STRING) END"


def build(spark, sf_dir):
    orders = X.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("k"), F.year("o_orderdate").alias("y"))
    lines = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    per_year = lines.join(orders, "o_orderkey").groupBy("k", "y").agg(F.floor(F.sum("cents") / 100).cast("long").alias("g"))
    names = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_name").alias("cname"), F.col("c_mktsegment").alias("seg"))
    return per_year.join(names, "k").selectExpr(
        "seg AS return_id", "y AS tax_year", "k AS sub_no", f"{_CODE} AS entity_code", f"{_NAME} AS entity_name", f"'{D.SCH_H}' AS form", "1 AS instance",
        "'' AS document_id", "'' AS basket", f"'{PATH}' AS path", "0 AS ordinal", f"{_AMOUNT} AS value", "false AS is_blank").select(*FACT_COLUMNS)


def facts(spark, sf_dir):
    return stored_table(spark, sf_dir, "history_facts", lambda: build(spark, sf_dir), FACT_PARTITIONS).select(*FACT_COLUMNS)


_FILED = f"""f AS (SELECT seg AS return_id, y AS tax_year, {_CODE} AS code, upper(trim({_NAME})) AS name, TRY_CAST({_AMOUNT} AS DOUBLE) AS amount FROM (
  SELECT c_custkey AS k, CAST(EXTRACT(year FROM o_orderdate) AS INT) AS y, any_value(c_name) AS cname, any_value(c_mktsegment) AS seg,
    CAST(floor(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100) AS BIGINT) AS g
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL)),
run AS (SELECT return_id, code, min(tax_year) AS y1, max(tax_year) AS y2, min_by(name, tax_year) AS n1, max_by(name, tax_year) AS n2 FROM f GROUP BY ALL),
met AS (SELECT b.return_id, b.code, b.y1, a.code AS before, a.y2 FROM run b JOIN run a ON a.return_id = b.return_id AND a.n2 = b.n1 AND a.y2 < b.y1 AND a.code <> b.code),
pick AS (SELECT return_id, code, y1, arg_max(before, y2) AS before FROM met GROUP BY ALL),
up AS (SELECT return_id, before, arg_min(code, y1) AS code FROM pick GROUP BY ALL),
link AS (SELECT run.return_id, run.code, coalesce(up.before, run.code) AS h FROM run LEFT JOIN up ON up.return_id = run.return_id AND up.code = run.code)"""


@plain("entity_histories", f"WITH {_FILED} SELECT return_id, code AS entity_code, h AS history_id FROM link")
def _histories(spark, sf_dir):
    return H.histories(facts(spark, sf_dir).select("return_id", "tax_year", "entity_code", "entity_name"))


@plain("trend_3y", f"""WITH {_FILED},
p AS (SELECT f.return_id, h, tax_year, sum(amount) AS amount, min(f.code) AS code, min(name) AS name FROM f JOIN link ON link.return_id = f.return_id AND link.code = f.code
  GROUP BY ALL HAVING sum(amount) IS NOT NULL),
s AS (SELECT *, lag(amount) OVER w AS last, tax_year - lag(tax_year) OVER w AS gap, count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead
  FROM p WINDOW w AS (PARTITION BY return_id, h ORDER BY tax_year))
SELECT return_id, h AS history_id, min(tax_year) AS first_year, max(tax_year) AS last_year, count(*) AS n_years, max(tax_year) - min(tax_year) + 1 - count(*) AS missing,
  count(DISTINCT code) AS n_codes, count(DISTINCT name) AS n_names, round(regr_slope(amount, tax_year), 4) AS slope,
  count(*) FILTER (abs((amount - last) / gap) > {H.BREAK} * abs(last)) AS breaks, count(*) FILTER (sign(amount) * sign(last) < 0) AS turns,
  CASE WHEN count(*) FILTER (ahead < 2 AND gap = 1 AND amount > last) = 2 THEN 'rising' WHEN count(*) FILTER (ahead < 2 AND gap = 1 AND amount < last) = 2
    THEN 'falling' ELSE 'mixed' END AS trend
FROM s GROUP BY return_id, h HAVING count(*) >= 3""")
def _trend(spark, sf_dir):
    filed = H.filings_of(facts(spark, sf_dir), PATH)
    return H.trends(filed, H.histories(filed))
