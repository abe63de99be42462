"""Form views: catalogue lines with formatted values of one or two years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie.functions.scalar import DASH, fmt_amount, fmt_diff, fmt_value, safe_float, value_number
from crosstie.operators.reshape import form_rows, value_map
from crosstie.operators.rollover import matched
from crosstie.operators.rules import lit

_KEYS = ["return_id", "tax_year", "sub_no", "entity_code", "entity_name"]


def field_dim(spark: SparkSession) -> DataFrame:
    """The field catalogue with the place of each line on its form."""
    seen: dict[str, int] = {}
    rows = []
    for f in D.FIELDS:
        seen[f.form] = seen.get(f.form, 0) + 1
        rows.append((f.form, f.name, f.line, f.description, f.type, f.sign, f.group, f.period, seen[f.form]))
    return spark.createDataFrame(
        rows, "form string, field string, line string, description string, type string, sign string,"
              " grp string, period string, line_no int")


def field_info(rows: DataFrame) -> DataFrame:
    """Line, description and type of (form, path); unknown fields keep a mark."""
    short = F.replace(F.col("path"), F.concat("form", F.lit("_")), F.lit(""))
    dim = field_dim(rows.sparkSession).select("form", "field", "line", "description", "type", "sign")
    out = rows.withColumn("field", short).join(F.broadcast(dim), ["form", "field"], "left")
    return (out.withColumn("line", F.coalesce("line", F.lit("?")))
            .withColumn("description", F.coalesce("description", "field"))
            .withColumn("type", F.coalesce("type", F.lit("unknown"))))


def _lines(form: str) -> list[D.Field]:
    return D.fields_of(form)


def _field_structs(form: str, fields: list[D.Field]) -> str:
    return ", ".join(
        f"named_struct('line_no', {i}, 'line', {lit(f.line)}, 'description', {lit(f.description)},"
        f" 'type', '{f.type}', 'sign', {lit(f.sign or '')}, 'path', '{form}_{f.name}')"
        for i, f in enumerate(fields, 1))


def form_view(facts: DataFrame, form: str) -> DataFrame:
    """Ordered lines of one schedule with formatted amounts (C and H)."""
    fields = _lines(form)
    rows = value_map(form_rows(facts, form, [f"{form}_{f.name}" for f in fields]), _KEYS)
    long = rows.selectExpr(*_KEYS, "m", f"inline(array({_field_structs(form, fields)}))")
    long = long.withColumn("raw", F.coalesce(F.expr("m[path]"), F.lit(""))).withColumn("num", value_number("raw", F.col("sign")))
    return long.select("return_id", "tax_year", "entity_code", "line_no", "line", "description",
                       fmt_value("raw", F.col("type"), F.col("sign"), F.col("num")).alias("amount"))


def balance_view(facts: DataFrame) -> DataFrame:
    """Balance sheet lines with beginning and end amounts side by side."""
    paths = [f"{D.SCH_F}_{t(c)}" for c, _, _ in D.BALANCE_PAIRS for t in (D.begin_tag, D.end_tag)]
    rows = value_map(form_rows(facts, D.SCH_F, paths), _KEYS)
    cells = ", ".join(
        f"named_struct('line_no', {ln}, 'description', {lit(d)}, 'b_path', '{D.SCH_F}_{D.begin_tag(c)}',"
        f" 'e_path', '{D.SCH_F}_{D.end_tag(c)}')" for c, ln, d in D.BALANCE_PAIRS)
    long = rows.selectExpr(*_KEYS, "m", f"inline(array({cells}))").withColumns(
        {n: F.expr(f"coalesce(m[{n}_path], '')") for n in "be"})
    long = long.withColumns({f"{n}_num": safe_float(n) for n in "be"})
    return long.select(
        "return_id", "tax_year", "entity_code", "line_no", "description",
        fmt_amount("b", num=F.col("b_num")).alias("beginning"), fmt_amount("e", num=F.col("e_num")).alias("ending"))


def form_comparison(facts: DataFrame, form: str, py: int, cy: int) -> DataFrame:
    """Prior and current value of every catalogue line of a schedule."""
    fields = _lines(form)
    inline = form == D.SCH_G  # indicators are filed inside the main form
    source = D.MAIN if inline else form
    prefix = f"{D.MAIN}_{form}" if inline else form
    tags = [f"{form}_{f.name}" if inline else f.name for f in fields]
    pairs = matched(facts, py, cy, {source: tags}, instance="first")
    both = pairs.where(F.expr(f"p['{source}'] IS NOT NULL AND c['{source}'] IS NOT NULL"))
    long = both.selectExpr("return_id", "entity_code", "p", "c", f"inline(array({_field_structs(prefix, fields)}))")
    long = long.withColumns({f"{n}_raw": F.coalesce(F.expr(f"{n}[path]"), F.lit("")) for n in "pc"})
    long = long.withColumns({f"{n}_num": value_number(f"{n}_raw", F.col("sign")) for n in "pc"})
    long = long.withColumn("delta", F.expr("coalesce(c_num, 0D) - coalesce(p_num, 0D)"))
    shown = {n: fmt_value(f"{n}_raw", F.col("type"), F.col("sign"), F.col(f"{n}_num")) for n in "pc"}
    diff = (
        F.when(F.col("type") == "amount", fmt_diff(F.col("delta")))
        .when((F.col("type") == "indicator") & (F.col("py_value") != F.col("cy_value")), "CHANGED")
        .otherwise(DASH)
    )
    return (long.withColumns({"py_value": shown["p"], "cy_value": shown["c"]})
            .select("return_id", "entity_code", "line_no", "line", "description", "py_value", "cy_value", diff.alias("diff")))
