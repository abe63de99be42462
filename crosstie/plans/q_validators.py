"""Queries of the audit validators."""

from __future__ import annotations

from crosstie import dims as D
from crosstie.operators import validators as V
from crosstie.plans import fixture as X
from crosstie.plans.registry import query

CY = X.CY

_H = ("SELECT seg, code, k, CAST(max(CASE WHEN path = '{h}_ForeignCYNetIncomePerBooksAmt' THEN value END) AS DOUBLE) AS ni,"
      " COALESCE(max(CASE WHEN path = '{h}_TotalNetAdditionsAmt' THEN TRY_CAST(value AS DOUBLE) END), 0)"
      " - COALESCE(max(CASE WHEN path = '{h}_TotalNetSubtractionsAmt' THEN TRY_CAST(value AS DOUBLE) END), 0) AS adj,"
      " CAST(max(CASE WHEN path = '{h}_CurrentEarningsAndProfitsAmt' THEN value END) AS DOUBLE) AS ep"
      " FROM facts WHERE side = 'c' AND form = '{h}' AND instance = 1 GROUP BY 1, 2, 3").format(h=D.SCH_H)


@query("ep_footing", "SELECT seg AS return_id, code AS entity_code, COALESCE(ni, 0) AS net_income, adj AS adjustments, ep AS current_ep,"
       f" COALESCE(ni, 0) + adj - ep AS difference, abs(COALESCE(ni, 0) + adj - ep) <= 1 AS passes FROM ({_H}) WHERE ep IS NOT NULL", facts=[D.SCH_H])
def _ep_footing(spark, sf_dir):
    return V.ep_footing(X.facts(spark, sf_dir), CY)


_LINES = ", ".join(f"('{D.SCH_F}_{D.end_tag(c)}', '{ln}', '{d}')" for c, ln, d in V.ASSETS)


@query("neg_assets", "SELECT seg AS return_id, code AS entity_code, line, description, TRY_CAST(value AS DOUBLE) AS amount FROM facts"
       f" JOIN (VALUES {_LINES}) l(p, line, description) ON p = path WHERE side = 'c' AND instance = 1 AND TRY_CAST(value AS DOUBLE) < 0", facts=[D.SCH_F])
def _neg_assets(spark, sf_dir):
    return V.negative_assets(X.facts(spark, sf_dir), CY)


@query("peer_outliers", "SELECT seg AS return_id, code AS entity_code, ccy_c AS currency, ep, peers, round((ep - mean) / spread, 4) AS distance FROM ("
       "SELECT *, count(*) OVER w AS peers, avg(ep) OVER w AS mean, stddev_samp(ep) OVER w AS spread FROM (SELECT seg, code, COALESCE(ccy_c, '') AS ccy_c,"
       " CAST(usd_c AS DOUBLE) AS ep FROM cust WHERE n_c > 0 AND k % 31 <> 0 AND usd_c IS NOT NULL) WINDOW w AS (PARTITION BY ccy_c))"
       " WHERE peers >= 3 AND spread > 0 AND abs(round((ep - mean) / spread, 4)) > 3")
def _peer_outliers(spark, sf_dir):
    return V.peer_outliers(X.facts(spark, sf_dir), CY)
