"""Queries of the scalar functions, over texts made from orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstie.functions import scalar as S
from crosstie.plans import fixture as X
from crosstie.plans.q_sources import amount_sql
from crosstie.plans.registry import plain

_KEY = "o_orderkey AS k"
# text of a number in several spellings, some of them not numbers
_RAW = ("CASE o_orderkey % 9 WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN concat('-', CAST(o_orderkey AS STRING), '.5') WHEN 2 THEN '1_000'"
        " WHEN 3 THEN '12d' WHEN 4 THEN '' WHEN 5 THEN 'nan' WHEN 6 THEN concat(' ', CAST(o_orderkey AS STRING), ' ') WHEN 7 THEN '1e3' ELSE 'n/a' END")
_AMOUNT = "CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'text' ELSE CAST((o_orderkey % 4001 - 2000) * (CASE WHEN o_orderkey % 3 = 0 THEN 977 ELSE 3 END) AS STRING) END"


def _orders(spark, sf_dir, *exprs: str):
    return X.table(spark, sf_dir, "orders").selectExpr(_KEY, *exprs)


def _of(*exprs: str) -> str:
    return f"SELECT {_KEY}, {', '.join(exprs)} FROM orders"


def _from(inner: str, outer: str) -> str:
    return f"SELECT k, {outer} FROM (SELECT {_KEY}, {inner} FROM orders)"


@plain("safe_float", _from(f"{_RAW} AS raw", "TRY_CAST(replace(CASE WHEN regexp_full_match(trim(raw), '[0-9_.eE+-]+') THEN trim(raw) END, '_', '') AS DOUBLE) AS num"))
def _safe_float(spark, sf_dir):
    return _orders(spark, sf_dir, f"{_RAW} AS raw").select("k", S.safe_float("raw").alias("num"))


@plain("to_numeric", _from(f"{_RAW} AS raw", "COALESCE(TRY_CAST(CASE WHEN regexp_full_match(trim(raw), '[0-9.eE+-]+') THEN trim(raw) END AS DOUBLE), 0) AS num"))
def _to_numeric(spark, sf_dir):
    return _orders(spark, sf_dir, f"{_RAW} AS raw").select("k", S.to_numeric("raw", null_as_zero=True).alias("num"))


@plain("zero_or_null_fallback", _of("CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN o_orderkey ELSE -1 END AS x"))
def _fallback(spark, sf_dir):
    rows = _orders(spark, sf_dir, "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey END AS a", "CAST(-1 AS BIGINT) AS b")
    return rows.select("k", S.zero_or_null_fallback(F.col("a"), F.col("b")).alias("x"))


@plain("norm_text", _of("upper(o_orderpriority) AS x"))
def _norm(spark, sf_dir):
    return _orders(spark, sf_dir, "concat('  ', lower(o_orderpriority), ' ') AS t").select("k", S.norm_text("t").alias("x"))


_TOKEN = "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN 'None' WHEN 3 THEN 'none' END"


@plain("blank_tokens", _of("o_orderkey % 5 <> 3 AS x"))
def _blank(spark, sf_dir):
    return _orders(spark, sf_dir, f"{_TOKEN} AS t").select("k", S.is_blank_token("t").alias("x"))


def _amount_case(sign: str | None) -> str:
    return f"CASE WHEN a = 'text' THEN 'text' ELSE {amount_sql('TRY_CAST(a AS BIGINT)', sign)} END".replace("TRY_CAST(a AS BIGINT) = ''", "false")


@plain("fmt_amount", _from(f"{_AMOUNT} AS a", f"{_amount_case(None)} AS shown, {_amount_case('x')} AS flipped"))
def _fmt_amount(spark, sf_dir):
    return _orders(spark, sf_dir, f"{_AMOUNT} AS a").select(
        "k", S.fmt_amount("a").alias("shown"), S.fmt_amount("a", F.lit("negative_is_income")).alias("flipped"))


_IND = "CASE o_orderkey % 8 WHEN 0 THEN 'X' WHEN 1 THEN '1' WHEN 2 THEN 'true' WHEN 3 THEN 'No' WHEN 4 THEN '0' WHEN 5 THEN '' WHEN 6 THEN 'maybe' END"


@plain("fmt_indicator", _from(f"{_IND} AS t", "CASE WHEN COALESCE(t, '') = '' THEN '—' WHEN t IN ('X', '1', 'true') THEN 'Yes' WHEN t IN ('No', '0') THEN 'No' ELSE t END AS x"))
def _fmt_indicator(spark, sf_dir):
    return _orders(spark, sf_dir, f"{_IND} AS t").select("k", S.fmt_indicator("t").alias("x"))


_SHARE = "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('0.', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')) END"


@plain("fmt_percent", _from(f"{_SHARE} AS t", "CASE WHEN t = '' THEN '—' ELSE concat(CAST(CAST(round(CAST(t AS DECIMAL(10,4)) * 100, 2) AS DECIMAL(10,2)) AS STRING), '%') END AS x"))
def _fmt_percent(spark, sf_dir):
    return _orders(spark, sf_dir, f"{_SHARE} AS t").select("k", S.fmt_percent("t").alias("x"))


@plain("fmt_rate", _from(f"{_SHARE} AS t", "CASE WHEN t = '' THEN '—' ELSE concat(t, '000') END AS x"))
def _fmt_rate(spark, sf_dir):
    return _orders(spark, sf_dir, f"{_SHARE} AS t").select("k", S.fmt_rate("t").alias("x"))


_D = "CAST((o_orderkey % 4001 - 2000) * (CASE WHEN o_orderkey % 3 = 0 THEN 977 ELSE 3 END) AS DOUBLE)"
_PLUS = "(CASE WHEN d >= 0 THEN '+' ELSE '' END)"


@plain("fmt_diff", _from(f"{_D} AS d", f"CASE WHEN d = 0 THEN '—' WHEN abs(d) >= 1000000 THEN {_PLUS} || format('{{:,.2f}}', d / 1000000) || 'M' WHEN abs(d) >= 1000 THEN"
       f" {_PLUS} || format('{{:,.1f}}', d / 1000) || 'K' ELSE {_PLUS} || format('{{:,.0f}}', d) END AS x"))
def _fmt_diff(spark, sf_dir):
    return _orders(spark, sf_dir, f"{_D} AS d").select("k", S.fmt_diff(F.col("d")).alias("x"))


@plain("sign_flip", _from(f"{_D} AS d, o_orderkey % 2 = 0 AS flip", "CASE WHEN flip THEN -d ELSE d END AS x"))
def _sign_flip(spark, sf_dir):
    rows = _orders(spark, sf_dir, f"{_D} AS d", "CASE WHEN o_orderkey % 2 = 0 THEN 'negative_is_income' ELSE '' END AS sign")
    return rows.select("k", S.sign_flip(F.col("d"), F.col("sign")).alias("x"))


@plain("name_clean", _of("concat('Acme ', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 3 = 1 THEN ' Ltd' ELSE '' END) AS x"))
def _name_clean(spark, sf_dir):
    return _orders(spark, sf_dir, "concat('Acme ', CAST(o_orderkey AS STRING), CASE o_orderkey % 3 WHEN 0 THEN ' (FKA Old Co.)' WHEN 1 THEN ' Ltd..' ELSE '.' END) AS t").select(
        "k", S.name_clean("t").alias("x"))


@plain("similarity", _of("round(1 - 2.0 / (2 * length(CAST(o_orderkey AS STRING)) + 12), 6)::DOUBLE AS x"))
def _similarity(spark, sf_dir):
    # one letter replaced in the middle of otherwise equal texts
    rows = _orders(spark, sf_dir, "concat('LMN', CAST(o_orderkey AS STRING), 'ABC') AS a", "concat('LMN', CAST(o_orderkey AS STRING), 'XBC') AS b")
    return rows.select("k", F.round(S.similarity("a", "b"), 6).alias("x"))


@plain("contains_ci", "SELECT doc_id, contains(lower(text), lower('The')) AS x FROM documents")
def _contains(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", S.contains_ci("text", "The").alias("x"))


@plain("code_prefix", _from("CASE o_orderkey % 4 WHEN 0 THEN 'C01' WHEN 1 THEN 'SS2' WHEN 2 THEN 'c03' END AS t", "COALESCE(starts_with(t, 'C'), false) AS c, COALESCE(starts_with(t, 'C') OR starts_with(t, 'SS'), false) AS c_or_ss"))
def _code_prefix(spark, sf_dir):
    return _orders(spark, sf_dir, "CASE o_orderkey % 4 WHEN 0 THEN 'C01' WHEN 1 THEN 'SS2' WHEN 2 THEN 'c03' END AS t").select(
        "k", S.code_prefix("t").alias("c"), S.code_prefix("t", "C", "SS").alias("c_or_ss"))


@plain("year_token", _from("CAST(year(o_orderdate) + 10 AS STRING) AS y, o_orderkey % 4 AS w", "CASE w WHEN 0 THEN y WHEN 1 THEN y WHEN 2 THEN y END AS x"))
def _year_token(spark, sf_dir):
    y = "CAST(year(o_orderdate) + 10 AS STRING)"
    return _orders(spark, sf_dir, f"CASE o_orderkey % 4 WHEN 0 THEN concat('FY', {y}, ' Compliance') WHEN 1 THEN concat('Tax year ', {y}) WHEN 2 THEN concat('v201 FY', {y}, ' 2001') ELSE 'draft 20' END AS t").select(
        "k", S.year_token("t").alias("x"))


@plain("basket_label", _of("CASE WHEN o_orderkey % 3 = 0 THEN '21-General Limitation Income' ELSE '3-Passive Income' END AS label, CASE WHEN o_orderkey % 3 = 0 THEN '21' ELSE '3' END AS number"))
def _basket(spark, sf_dir):
    rows = _orders(spark, sf_dir, "CASE o_orderkey % 3 WHEN 0 THEN 'GEN' WHEN 1 THEN 'PAS' ELSE 'XYZ' END AS b").select("k", S.basket_label("b").alias("label"))
    return rows.withColumn("number", S.basket_number("label"))


@plain("text_sanitize", _of("concat('a - \"', CAST(o_orderkey AS STRING), '\" -> <= b...x') AS x"))
def _sanitize(spark, sf_dir):
    return _orders(spark, sf_dir, "concat('a — “', CAST(o_orderkey AS STRING), '” → ≤ b…×') AS t").select("k", S.text_sanitize("t").alias("x"))


@plain("short_form_name", _of("concat('5471Sch', CASE o_orderkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'I1' ELSE 'VeryLongNameOfAFormThatI' END) AS x"))
def _short(spark, sf_dir):
    return _orders(spark, sf_dir, "concat('IRS5471Schedule', CASE o_orderkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'I1' ELSE 'VeryLongNameOfAFormThatIsCut' END) AS t").select(
        "k", S.short_form_name("t").alias("x"))


@plain("tolerance", _from(f"{_D} AS d", "greatest(1, abs(d) * 0.001) AS x"))
def _tolerance(spark, sf_dir):
    return _orders(spark, sf_dir, f"{_D} AS d").select("k", S.tolerance(1, F.col("d"), 0.001).alias("x"))


@plain("display_cut", "SELECT doc_id, left(text, 80) AS x FROM documents")
def _cut(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", S.display_cut("text", 80).alias("x"))


@plain("field_fallback", _of("CASE WHEN o_orderkey % 2 = 0 THEN 'first' WHEN o_orderkey % 3 = 0 THEN 'second' ELSE '' END AS x"))
def _field_fallback(spark, sf_dir):
    rows = _orders(spark, sf_dir, "CASE WHEN o_orderkey % 2 = 0 THEN 'first' WHEN o_orderkey % 5 = 0 THEN '' END AS a", "CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE '' END AS b")
    return rows.select("k", S.field_fallback("a", "b").alias("x"))


@plain("ref_or_name", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS x FROM customer")
def _ref_or_name(spark, sf_dir):
    rows = X.table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey AS STRING) END AS ref", "c_name")
    return rows.select("k", S.ref_or_name("ref", "c_name").alias("x"))
