"""Scalar expressions against their plain Python meaning."""

from pyspark.sql import functions as F

from crosstie.functions import scalar as S


def run(spark, values, column):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, x string").orderBy("i").select(column).collect()]


def test_safe_float(spark):
    values = ["1_000", "12d", " 7.5 ", "", "abc", "1e3", None, "-.5", "5.", "1__0", "0x1", "+3"]

    def py(v):
        try:
            return None if v is None else float(v)
        except ValueError:
            return None

    assert run(spark, values, S.safe_float("x")) == [py(v) for v in values]


def test_amount_text(spark):
    values = ["1234567", "-1234567", "999.5", "2.5", "3.5", "1000", "999999", "0", "", "nan", "n/a", "1250"]

    def py(v):
        if v in ("", "nan", "None"):
            return "—"
        try:
            n = float(v)
        except ValueError:
            return v
        if abs(n) >= 1e6:
            return f"${n / 1e6:,.2f}M"
        return f"${n / 1e3:,.1f}K" if abs(n) >= 1000 else f"${n:,.0f}"

    assert run(spark, values, S.fmt_amount("x")) == [py(v) for v in values]


def test_other_texts(spark):
    assert run(spark, ["0.12345", ""], S.fmt_percent("x")) == ["12.35%" if f"{12.345:.2f}" == "12.35" else "12.34%", "—"]
    assert run(spark, ["0.8"], S.fmt_rate("x")) == ["0.8000000"]
    assert run(spark, ["Acme (FKA Old)..", "Co. .."], S.name_clean("x")) == ["Acme", "Co. "]
    assert run(spark, ["FY2025 Compliance", "year 2024", "none"], S.year_token("x")) == ["2025", "2024", None]
    assert run(spark, ["a—b→c"], S.text_sanitize("x")) == ["a-b->c"]
    assert run(spark, ["0"], S.fmt_diff(F.col("x").cast("double"))) == ["—"]
