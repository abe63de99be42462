"""Scalar expressions.  All of them stay JVM-side except ``similarity``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DASH = "—"
# fixed values: texts read as "no value", as Yes, as No, as Yes in rule texts
BLANK_TOKENS = ("", "nan", "None")
YES_TOKENS = ("X", "1", "true", "True", "Y", "Yes")
NO_TOKENS = ("0", "false", "False", "N", "No")
RULE_YES_TOKENS = ("1", "TRUE", "Y", "YES")

_DIGITS = r"\d+(_\d+)*"
_FLOAT = rf"^\s*[+-]?(({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?|(?i:inf|infinity))\s*$"
_PLAIN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_float(x: Column | str) -> Column:
    """Number or NULL.  Accepts digit grouping by underscores; rejects suffixes
    such as ``12d`` that a plain cast would take."""
    x = _c(x)
    return F.when(x.rlike(_FLOAT), F.regexp_replace(x, r"[\s_]", "").try_cast("double"))


def to_numeric(x: Column | str, null_as_zero: bool = False) -> Column:
    """Number or NULL without digit grouping; optionally NULL becomes 0."""
    x = _c(x)
    num = F.when(x.rlike(_PLAIN), F.regexp_replace(x, r"\s", "").try_cast("double"))
    return F.coalesce(num, F.lit(0.0)) if null_as_zero else num


def zero_or_null_fallback(a: Column, *rest: Column) -> Column:
    """First operand that is neither NULL nor 0; the last one as it is."""
    if not rest:
        return a
    return F.coalesce(F.nullif(a, F.lit(0)), zero_or_null_fallback(*rest))


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(_c(x), F.lit(""))


def field_fallback(*xs: Column | str) -> Column:
    """First non-blank text, else blank."""
    return F.coalesce(*[blank_to_null(x) for x in xs], F.lit(""))


def ref_or_name(ref: Column | str, name: Column | str) -> Column:
    return F.coalesce(blank_to_null(ref), _c(name))


def norm_text(x: Column | str) -> Column:
    return F.upper(F.trim(_c(x)))


def is_blank_token(x: Column | str) -> Column:
    x = _c(x)
    return x.isNull() | x.isin(*BLANK_TOKENS)


def contains_ci(text: Column | str, part: Column | str) -> Column:
    part = F.lit(part) if isinstance(part, str) else part
    return F.contains(F.lower(_c(text)), F.lower(part))


def code_prefix(x: Column | str, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes or ("C",):
        out = out | F.startswith(_c(x), F.lit(p))
    return F.coalesce(out, F.lit(False))


# --- numbers as text -------------------------------------------------------


def _scaled(num: Column, signed: bool) -> Column:
    def show(x: Column, d: int) -> Column:
        t = F.format_number(x, d)
        return F.when(num >= 0, F.concat(F.lit("+"), t)).otherwise(t) if signed else t

    return (
        F.when(F.abs(num) >= 1e6, F.concat(show(num / 1e6, 2), F.lit("M")))
        .when(F.abs(num) >= 1000, F.concat(show(num / 1e3, 1), F.lit("K")))
        .otherwise(show(num, 0))
    )


def sign_flip(num: Column, sign: Column) -> Column:
    """Amounts of fields that show income as negative are turned around."""
    return F.when(sign == "negative_is_income", -num).otherwise(num)


def fmt_amount(x: Column | str, sign: Column | None = None, num: Column | None = None) -> Column:
    """Dollar text in millions, thousands or units.  ``num`` is the parsed and
    turned number where the caller has it as a column already."""
    x = _c(x)
    if num is None:
        num = safe_float(x) if sign is None else sign_flip(safe_float(x), sign)
    return (
        F.when(is_blank_token(x), F.lit(DASH))
        .when(num.isNull(), x)
        .otherwise(F.concat(F.lit("$"), _scaled(num, signed=False)))
    )


def fmt_indicator(x: Column | str) -> Column:
    x = _c(x)
    return (
        F.when(is_blank_token(x), F.lit(DASH))
        .when(x.isin(*YES_TOKENS), F.lit("Yes"))
        .when(x.isin(*NO_TOKENS), F.lit("No"))
        .otherwise(x)
    )


def fmt_percent(x: Column | str, num: Column | None = None) -> Column:
    x = _c(x)
    num = safe_float(x) if num is None else num
    return (
        F.when(is_blank_token(x), F.lit(DASH))
        .when(num.isNull(), x)
        .otherwise(F.concat(plain_number(num * 100, "0.00"), F.lit("%")))
    )


def fmt_rate(x: Column | str, num: Column | None = None) -> Column:
    x = _c(x)
    num = safe_float(x) if num is None else num
    return (
        F.when(is_blank_token(x), F.lit(DASH))
        .when(num.isNull(), x)
        .otherwise(plain_number(num, "0.0000000"))
    )


def fmt_value(x: Column | str, type_: Column, sign: Column, num: Column | None = None) -> Column:
    """Display text of a field by its catalogue type.

    Give ``num`` (see ``value_number``) as a column of an earlier select to keep
    the parse out of every branch."""
    x = _c(x)
    return (
        F.when(is_blank_token(x), F.lit(DASH))
        .when(type_ == "amount", fmt_amount(x, sign, num))
        .when(type_ == "indicator", fmt_indicator(x))
        .when(type_ == "percentage", fmt_percent(x, num))
        .when(type_ == "rate", fmt_rate(x, num))
        .otherwise(x)
    )


def value_number(x: Column | str, sign: Column) -> Column:
    """Number behind a display text, turned where the field shows it turned."""
    return sign_flip(safe_float(x), sign)


def fmt_diff(diff: Column) -> Column:
    """Signed difference in millions, thousands or units; a dash for none."""
    return F.when(diff.isNull() | (diff == 0), F.lit(DASH)).otherwise(_scaled(diff, signed=True))


def plain_number(x: Column, pattern: str) -> Column:
    """Decimal text by pattern, half-even like ``format_number`` but ungrouped."""
    return F.call_function("format_number", x, F.lit(pattern))


def money(x: Column) -> Column:
    return F.format_number(x, 0)


# --- names, labels and cuts ------------------------------------------------


def name_clean(x: Column | str) -> Column:
    """Cut a former-name suffix, trim, drop trailing dots."""
    head = F.trim(F.substring_index(_c(x), "(FKA", 1))
    return F.regexp_replace(head, r"\.+$", "")


def year_token(x: Column | str) -> Column:
    """Year of the first blank-separated token ``FYnnnn`` or ``20nn``."""
    tokens = F.split(F.trim(_c(x)), r"\s+")
    hit = F.filter(
        tokens,
        lambda t: (F.startswith(t, F.lit("FY")) & (F.length(t) >= 4))
        | (F.startswith(t, F.lit("20")) & (F.length(t) == 4)),
    )
    first = F.get(hit, F.lit(0))
    return F.when(F.startswith(first, F.lit("FY")), F.substring(first, F.lit(3), F.length(first))).otherwise(first)


def basket_label(code: Column | str) -> Column:
    return F.when(_c(code) == "GEN", "21-General Limitation Income").otherwise("3-Passive Income")


def basket_number(label: Column | str) -> Column:
    return F.when(F.contains(_c(label), F.lit("General")), "21").otherwise("3")


# fixed values: typographic characters and their plain spelling
_ONE_TO_ONE = ("—–‘’“”×", "--''\"\"x")
_ONE_TO_MANY = {"→": "->", "…": "...", "≤": "<=", "≥": ">="}


def text_sanitize(x: Column | str) -> Column:
    out = F.translate(_c(x), *_ONE_TO_ONE)
    for a, b in _ONE_TO_MANY.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def short_form_name(x: Column | str) -> Column:
    out = F.replace(_c(x), F.lit("IRS5471"), F.lit("5471"))
    return F.substring(F.replace(out, F.lit("Schedule"), F.lit("Sch")), 1, 31)


def display_cut(x: Column | str, n: int) -> Column:
    return F.left(_c(x), F.lit(n))


def tolerance(floor: float, x: Column, share: float) -> Column:
    """The larger of an absolute floor and a share of an amount."""
    return F.greatest(F.lit(float(floor)), F.abs(x) * share)


# --- similarity ------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def similarity(a, b):  # noqa: ANN001 - series in, series out
    """Ratcliff-Obershelp ratio; no built-in expression computes it."""
    import difflib

    import pandas as pd

    return pd.Series(
        [None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)],
        dtype="float64",
    )


def levenshtein_ratio(a: Column | str, b: Column | str) -> Column:
    """JVM-side stand-in for ``similarity``: 1 - distance / longer length."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.try_subtract(F.lit(1.0), F.try_divide(F.levenshtein(a, b).cast("double"), longest.cast("double")))
