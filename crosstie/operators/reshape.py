"""Projections of the facts table: per-form frames, wide frames, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie.functions.scalar import to_numeric
from crosstie.operators.matrix import first_instance

ROW_KEYS = ["return_id", "tax_year", "sub_no", "entity_code", "entity_name"]


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def value_map(rows: DataFrame, keys: list[str], name: str = "m") -> DataFrame:
    """One row per key with a path -> value map of its (unique) paths.

    One object-hash aggregate whatever the number of columns read from it, and
    bounded by the fields of one form instance."""
    return rows.groupBy(*keys).agg(F.expr(f"map_from_entries(collect_list(struct(path, value))) AS {name}"))


def form_rows(facts: DataFrame, form: str, paths: list[str] | None = None) -> DataFrame:
    """Facts of one form, first occurrence unless it is filed per basket."""
    rows = first_instance(facts.where(F.col("form") == form))
    if paths is not None:
        rows = rows.where(F.col("path").isin(form, *paths))
    return rows


def extract_form(facts: DataFrame, form: str, columns: list[str]) -> DataFrame:
    """One row per entity (and basket) with the asked paths as columns."""
    keys = [*ROW_KEYS, "instance", "basket"]
    wide = value_map(form_rows(facts, form, columns), keys)
    return wide.selectExpr(*keys, *[f"m['{c}'] AS {quote(c)}" for c in columns])


def wide_entities(facts: DataFrame, columns: list[str], forms: tuple[str, ...] = D.DEFAULT_FORMS) -> DataFrame:
    """One row per entity over several forms, first occurrence of each form."""
    rows = facts.where(F.col("form").isin(*forms) & (F.col("instance") == 1)
                       & (F.col("path").isin(*columns) | (F.col("path") == F.col("form"))))
    return value_map(rows, ROW_KEYS).selectExpr(*ROW_KEYS, *[f"m['{c}'] AS {quote(c)}" for c in columns])


def wide_by_basket(facts: DataFrame, forms: tuple[str, ...] = D.MULTI_INSTANCE_FORMS) -> DataFrame:
    """Forms filed per basket merged per (entity, basket); later forms and
    occurrences overwrite earlier ones.  Long: one row per surviving path."""
    rank = F.array_position(F.array(*[F.lit(f) for f in forms]), F.col("form"))
    return (
        facts.where(F.col("form").isin(*forms) & (F.col("path") != F.col("form")))
        .groupBy(*ROW_KEYS, "basket", "path")
        .agg(F.max_by("value", F.struct(rank, "instance", "ordinal")).alias("value"))
    )


def get_field(facts: DataFrame, name_part: str, path: str) -> DataFrame:
    """A field of the first entity per return whose name contains a text."""
    form = path.split("_")[0]
    rows = facts.where(F.contains(F.lower("entity_name"), F.lit(name_part.lower()))
                       & F.col("form").isin(D.MAIN, form) & (F.col("instance") == 1)
                       & F.col("path").isin(D.MAIN, path))
    per_entity = value_map(rows, ROW_KEYS)
    first = F.min_by(F.struct("entity_code", F.col("m")[path].alias("value")), "sub_no")
    return per_entity.groupBy("return_id", "tax_year").agg(first.alias("x")).select("return_id", "tax_year", "x.*")


def _category_filers(m: str) -> str:
    """Filer categories by indicator.  The specific tag decides when present,
    else the tag of the category digit.  Fixed values: tag spellings."""
    tags = {"1a": "11a", "1b": "11b", "1c": "1c", "2": "2", "3": "3", "4": "4", "5a": "51a", "5b": "51b", "5c": "5c"}

    def value(t: str) -> str:
        return f"{m}['{D.MAIN}_CategoryOfFiler{t}Ind']"

    arms = [f"CASE WHEN coalesce({value(t)}, {value(c[0])}) = 'X' THEN '{c}' END" for c, t in tags.items()]
    return f"array_compact(array({', '.join(arms)}))"


def entity_info(facts: DataFrame) -> DataFrame:
    """Identity block of every entity as read from its main form."""
    rows = first_instance(facts.where((F.col("form") == D.MAIN) & ~F.contains(F.col("path"), F.lit("Schedule"))))

    def text(tag: str) -> str:
        return f"coalesce(m['{D.MAIN}_{tag}'], '')"

    return value_map(rows, ROW_KEYS).selectExpr(
        *ROW_KEYS,
        f"coalesce(nullif({text('EIN')}, ''), {text('EmployerEIN')}) AS ein",
        f"{text('CountryUnderWhoseLawsIncCd')} AS country_code",
        f"{text('FunctionalCurrencyCd')} AS functional_currency",
        f"{text('IncorporationDt')} AS incorporation_date",
        f"{text('VotingStockOwnedPct')} AS voting_stock_pct",
        f"{text('dormantForeignCorporationCd')} = 'Y' AS dormant",
        f"{_category_filers('m')} AS category_filers",
    )


def find_entity(entities: DataFrame, by: str, text: str) -> DataFrame:
    """First entity per return by name part, EIN or reference id."""
    test: Column = {
        "name": F.contains(F.lower("entity_name"), F.lit(text.lower())),
        "ein": F.col("ein") == text,
        "ref": F.col("entity_code") == text,
    }[by]
    row = F.struct(*[c for c in entities.columns if c not in ("return_id", "tax_year")])
    return (entities.where(test).groupBy("return_id", "tax_year").agg(F.min_by(row, "sub_no").alias("x"))
            .select("return_id", "tax_year", "x.*"))


def filter_entity(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows whose name or reference id matches a pattern, case ignored."""
    p = "(?i)" + pattern
    hit = F.coalesce(F.col("entity_name").rlike(p), F.lit(False)) | F.coalesce(F.col("entity_code").rlike(p), F.lit(False))
    return rows.where(hit)


def line_frame(facts: DataFrame, schedule: str) -> DataFrame:
    """Numeric line columns of an inline income statement (C) or balance sheet (F)."""
    prefix = f"{D.MAIN}_{D.SCH_C if schedule == 'C' else D.SCH_F}_"
    columns = D.line_columns(schedule)
    ccy = f"{D.MAIN}_FunctionalCurrencyCd"
    wide = value_map(form_rows(facts, D.MAIN, [ccy, *[prefix + t for _, t, *_ in columns]]), ROW_KEYS)
    number = "try_cast(CASE WHEN {v} RLIKE '^\\\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\\\s*$' THEN trim({v}) END AS DOUBLE)"
    return wide.selectExpr(
        *ROW_KEYS, f"coalesce(m['{ccy}'], '') AS functional_currency",
        *[f"{number.format(v=f'''m['{prefix}{tag}']''')} AS {quote(col)}" for col, tag, *_ in columns],
    )


def coverage_count(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per return that carry any of the line columns."""
    any_line = "coalesce(" + ", ".join(quote(c) for c in columns) + ") IS NOT NULL"
    return lines.groupBy("return_id").agg(F.expr(f"count_if({any_line}) AS covered"), F.expr("count(*) AS entities"))


def top_ep(facts: DataFrame, cy: int, n: int = 10) -> DataFrame:
    """The n entities of each return with the largest E&P by size, shown with the sign turned."""
    ep, ni = (f"{D.SCH_H}_{t}" for t in ("CurrEarnAndPrftInUSDollarsAmt", "ForeignCYNetIncomePerBooksAmt"))
    h = extract_form(facts.where(F.col("tax_year") == cy), D.SCH_H, [ep, ni])
    num = to_numeric(ep)
    w = Window.partitionBy("return_id").orderBy(F.abs("ep_usd").desc_nulls_last(), "entity_code")
    return (
        h.select("return_id", "entity_name", "entity_code", (-num).alias("ep_usd"), (-to_numeric(ni)).alias("net_income"))
        .withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("place")
    )


# duplicates and picks ------------------------------------------------------


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key: a partial aggregate, so a hot key is pre-reduced."""
    return _pick(rows, keys, "min_by", order)


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of each key."""
    return _pick(rows, keys, "max_by", order)


def _pick(rows: DataFrame, keys: list[str], how: str, order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    body = ", ".join(quote(c) for c in rest)
    by = ", ".join(quote(c) for c in order)
    return (rows.groupBy(*keys).agg(F.expr(f"{how}(struct({body}), struct({by})) AS x")).select(*keys, "x.*"))


def single_or_null(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Value of keys that occur once; keys with several rows read as NULL."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.expr(f"CASE WHEN count(*) = 1 THEN min({quote(value)}) END AS {quote(value)}"),
    )
