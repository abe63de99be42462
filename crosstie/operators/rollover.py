"""Prior-year to current-year reports.

Entities are matched by reference id, then by lower-cased name.  Each side is
first reduced to one row per entity holding a small map of the fields a report
needs, so the match moves entities, not facts, and every report line is an
expression over the matched pair.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie.functions.scalar import DASH, safe_float
from crosstie.operators.pools import number
from crosstie.operators.reshape import value_map
from crosstie.operators.rules import lit
from crosstie.schema import ITEM_COLUMNS
from crosstie.session import shared_dir

Paths = dict[str, list[str]]  # form -> tags


def entity_rows(facts: DataFrame, year: int, wanted: Paths, instance: str = "last") -> DataFrame:
    """One row per filed entity with a path -> value map ``m``.

    A form filed several times is read from its ``last`` or ``first``
    occurrence as a whole.
    """
    forms = sorted({D.MAIN, *wanted})
    paths = sorted({*forms, *(f"{f}_{t}" for f, tags in wanted.items() for t in tags)})
    rows = facts.where((F.col("tax_year") == year) & F.col("form").isin(*forms) & F.col("path").isin(*paths))
    pick = "max" if instance == "last" else "min"
    keys = ["return_id", "sub_no", "entity_code", "entity_name"]
    agg = rows.groupBy(*keys).agg(
        F.expr("collect_list(struct(form, instance, path, value)) AS xs"),
        *[F.expr(f"{pick}(CASE WHEN form = '{f}' THEN instance END) AS at_{f}") for f in forms],
    )
    chosen = " ".join(f"WHEN '{f}' THEN at_{f}" for f in forms)
    return agg.selectExpr(
        *keys,
        f"map_from_entries(transform(filter(xs, x -> x.instance = CASE x.form {chosen} END),"
        " x -> struct(x.path, x.value))) AS m",
    )


def match_entities(py: DataFrame, cy: DataFrame) -> DataFrame:
    """Prior-year rows with their current-year row: by code, else by name.

    Of several current-year rows with the same key the last one counts.  The match
    moves keys only; the maps of both sides are joined to the pairs once, each by
    all that names its row.
    """
    def last(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy("return_id", F.expr(key).alias(name)).agg(
            F.expr(f"max_by(struct(sub_no AS cy_sub, entity_code AS cy_code, entity_name AS cy_name), sub_no) AS {name}_hit"))

    def named(rows: DataFrame) -> DataFrame:
        return rows.select("return_id", "sub_no", "entity_code", "entity_name")

    by_code = last(named(cy).where("coalesce(entity_code, '') <> ''"), "entity_code", "k_code")
    by_name = last(named(cy), "lower(entity_name)", "k_name")
    # rows without a code get a key of their own, so they do not pile up in one task
    code = F.expr("coalesce(nullif(entity_code, ''), concat('\\u0000', sub_no))")
    left = named(py).withColumns({"k_code": code, "k_name": F.lower("entity_name")})
    hit = (left.join(by_code, ["return_id", "k_code"], "left").join(by_name, ["return_id", "k_name"], "left")
           .withColumn("hit", F.coalesce("k_code_hit", "k_name_hit")).where("hit IS NOT NULL"))
    pairs = hit.select("return_id", "entity_name", "entity_code", F.col("sub_no").alias("py_sub"), "hit.*")
    old = py.selectExpr("return_id AS p_return", "sub_no AS p_sub", "entity_code AS p_code", "entity_name AS p_name", "m AS p")
    new = cy.selectExpr("return_id AS c_return", "sub_no AS c_sub", "entity_code AS c_code", "entity_name AS c_name", "m AS c")
    both = pairs.join(old, F.expr("return_id = p_return AND py_sub <=> p_sub AND entity_code <=> p_code AND entity_name <=> p_name"))
    both = both.join(new, F.expr("return_id = c_return AND cy_sub <=> c_sub AND cy_code <=> c_code AND cy_name <=> c_name"))
    return both.select("return_id", "entity_name", "entity_code", "py_sub", "cy_sub", "p", "c")


def matched(facts: DataFrame, py: int, cy: int, py_wanted: Paths, cy_wanted: Paths | None = None,
            instance: str = "last") -> DataFrame:
    return match_entities(entity_rows(facts, py, py_wanted, instance),
                          entity_rows(facts, cy, cy_wanted or py_wanted, instance))


def field_text(m: str, *paths: str) -> str:
    """First non-blank of some paths, else blank."""
    return "coalesce(" + ", ".join(f"nullif({m}['{p}'], '')" for p in paths) + ", '')"


Line = tuple[str, str, list[str], list[str]]  # description, line, prior paths, current paths


def _items(pairs: DataFrame, report: str, lines: Iterable[Line]) -> DataFrame:
    """One row per pair and report line.  The lines are one literal array, so
    the look-up is written once however many lines a report has."""
    def paths(xs: list[str]) -> str:
        return ", ".join(f"'{xs[i] if i < len(xs) else xs[0]}'" for i in range(2))

    cells = ", ".join(f"struct({lit(d)} AS description, {lit(ln)} AS line, array({paths(p)}) AS pp, array({paths(c)}) AS cc)"
                      for d, ln, p, c in lines)
    rows = pairs.selectExpr("return_id", "entity_name", "entity_code", "p", "c", f"inline(array({cells}))")
    value = "coalesce(nullif({m}[{a}[0]], ''), nullif({m}[{a}[1]], ''), '') AS {n}"
    return rows.selectExpr("return_id", f"{lit(report)} AS report", "entity_name", "entity_code", "description", "line",
                           value.format(m="p", a="pp", n="py_value"), value.format(m="c", a="cc", n="cy_value"))


def _with_difference(items: DataFrame) -> DataFrame:
    def num(c: str):
        return F.when(F.col(c) == "", F.lit(0.0)).otherwise(safe_float(c))

    return (items.withColumns({"p_num": num("py_value"), "c_num": num("cy_value")})
            .withColumn("difference", F.coalesce(F.col("c_num") - F.col("p_num"), F.lit(0.0))))


def _some(items: DataFrame) -> DataFrame:
    return items.where("py_value <> '' OR cy_value <> ''")


def _balances(items: DataFrame, limit: float) -> DataFrame:
    """Numbers pass within the limit; other texts pass when equal."""
    both = F.col("p_num").isNotNull() & F.col("c_num").isNotNull()
    ok = F.when(both, F.abs("difference") < limit).otherwise(F.col("py_value") == F.col("cy_value"))
    return _with_difference(_some(items)).withColumn("passes", ok).select(*ITEM_COLUMNS)


def _schf_lines() -> list[Line]:
    return [
        (desc, "", [f"{D.SCH_F}_{e}", f"{D.MAIN}_{D.SCH_F}_{e}"], [f"{D.SCH_F}_{b}", f"{D.MAIN}_{D.SCH_F}_{b}"])
        for concept, _, desc in D.BALANCE_PAIRS
        for e, b in [(D.end_tag(concept), D.begin_tag(concept))]
    ]


def _schf_pairs(facts: DataFrame, py: int, cy: int) -> DataFrame:
    ends = [D.end_tag(c) for c, _, _ in D.BALANCE_PAIRS]
    begins = [D.begin_tag(c) for c, _, _ in D.BALANCE_PAIRS]

    def both(tags: list[str]) -> Paths:
        return {D.SCH_F: tags, D.MAIN: [f"{D.SCH_F}_{t}" for t in tags]}

    return matched(facts, py, cy, both(ends), both(begins))


def schf_rollover(facts: DataFrame, py: int, cy: int) -> DataFrame:
    """Closing balances of last year are this year's opening balances."""
    return _balances(_items(_schf_pairs(facts, py, cy), D.REPORTS[0], _schf_lines()), 1.0)


def schf_rollover_banded(facts: DataFrame, py: int, cy: int) -> DataFrame:
    """The same pairs with an immaterial band below ten units."""
    items = _with_difference(_some(_items(_schf_pairs(facts, py, cy), D.REPORTS[0], _schf_lines())))
    size = F.abs("difference")
    return items.select(
        "return_id", "entity_name", "entity_code", "description",
        F.coalesce("p_num", F.lit(0.0)).alias("py_ending"), F.coalesce("c_num", F.lit(0.0)).alias("cy_beginning"),
        "difference", F.when(size == 0, "PASS").otherwise("FAIL").alias("status"),
        F.when(size < 10, "OK").otherwise("Review").alias("review"),
        F.when(size == 0, F.lit("")).when(size < 10, "immaterial").otherwise("material").alias("severity"),
    )


def schf_footing(facts: DataFrame, year: int) -> DataFrame:
    """Year-end balance sheet cross-checks: assets foot, liabilities and equity
    foot, and both totals agree."""
    ends = {c: D.end_tag(c) for c, _, _ in D.BALANCE_PAIRS}
    rows = entity_rows(facts, year, {D.SCH_F: list(ends.values())}, "first")

    def num(concept: str) -> str:
        return f"coalesce({number(f'''m['{D.SCH_F}_{ends[concept]}']''')}, 0D)"

    order = [c for c, _, _ in D.BALANCE_PAIRS]
    checks = [
        ("assets", num("TotalAssets"), " + ".join(map(num, order[:8]))),
        ("liabilities and equity", num("TotLiabShrEqty"), " + ".join(map(num, order[9:15]))),
        ("balance", num("TotalAssets"), num("TotLiabShrEqty")),
    ]
    cells = ", ".join(f"named_struct('check', '{n}', 'total', {t}, 'parts', {p})" for n, t, p in checks)
    return (rows.where(F.expr(f"m['{D.SCH_F}'] IS NOT NULL"))
            .selectExpr("return_id", "entity_code", f"inline(array({cells}))")
            .withColumn("difference", F.col("total") - F.col("parts"))
            .withColumn("status", F.when(F.abs("difference") < 1, "OK").otherwise("Review")))


def page1_rollover(facts: DataFrame, py: int, cy: int, fields: list[tuple[str, str, str]] | None = None, form: str = D.MAIN) -> DataFrame:
    """Identity fields of a form stay the same; case and outer blanks do not matter."""
    fields = fields or D.PAGE1_FIELDS
    pairs = matched(facts, py, cy, {form: [f for f, _, _ in fields]})
    lines = [(d, ln, [f"{form}_{f}"], [f"{form}_{f}"]) for f, d, ln in fields]
    return (_some(_items(pairs, D.REPORTS[2], lines))
            .withColumn("difference", F.lit(0.0))
            .withColumn("passes", F.expr("upper(trim(py_value)) = upper(trim(cy_value))")).select(*ITEM_COLUMNS))


def schj_rollover(facts: DataFrame, py: int, cy: int) -> DataFrame:
    """Closing pools of last year are this year's opening pools, read from the
    last basket filed."""
    pools = [p for p, _ in D.RULE_POOLS]
    pairs = matched(facts, py, cy, {D.SCH_J: [f"{p}_{D.J_EOY}" for p in pools]},
                    {D.SCH_J: [f"{p}_{D.J_BOY}" for p in pools]})
    lines = [(d, "J", [f"{D.SCH_J}_{p}_{D.J_EOY}"], [f"{D.SCH_J}_{p}_{D.J_BOY}"]) for p, d in D.RULE_POOLS]
    return _balances(_items(pairs, D.REPORTS[1], lines), 1.0)


def _movement(facts: DataFrame, py: int, cy: int, form: str, report: str, fields: list[tuple[str, str, str]]) -> DataFrame:
    pairs = matched(facts, py, cy, {form: [f for f, _, _ in fields]})
    lines = [(d, ln, [f"{form}_{f}"], [f"{form}_{f}"]) for f, d, ln in fields]
    return (_with_difference(_some(_items(pairs, report, lines)))
            .withColumn("passes", F.lit(True)).select(*ITEM_COLUMNS))


def ep_movement(facts: DataFrame, py: int, cy: int) -> DataFrame:
    """Movement of the E&P figures; informational, always passes."""
    return _movement(facts, py, cy, D.SCH_H, D.REPORTS[3], D.EP_MOVEMENT_FIELDS)


def gilti_comparison(facts: DataFrame, py: int, cy: int) -> DataFrame:
    """Movement of the tested-income figures; informational, always passes."""
    return _movement(facts, py, cy, D.SCH_I1, D.REPORTS[4], D.GILTI_FIELDS)


def entity_changes(facts: DataFrame, py: int, cy: int) -> DataFrame:
    """Entities that are new or gone, keyed by code or else name."""
    tags = ["CountryUnderWhoseLawsIncCd", "FunctionalCurrencyCd"]
    return _entity_changes(entity_rows(facts, py, {D.MAIN: tags}), entity_rows(facts, cy, {D.MAIN: tags}))


def _entity_changes(old_rows: DataFrame, new_rows: DataFrame) -> DataFrame:
    tags = ["CountryUnderWhoseLawsIncCd", "FunctionalCurrencyCd"]

    def keyed(entities: DataFrame) -> DataFrame:
        rows = entities.withColumn("k", F.expr("coalesce(nullif(entity_code, ''), entity_name)"))
        place = f"concat({field_text('m', f'{D.MAIN}_{tags[0]}')}, ' | ', {field_text('m', f'{D.MAIN}_{tags[1]}')})"
        return (rows.groupBy("return_id", "k")
                .agg(F.expr(f"max_by(struct(entity_name, entity_code, {place} AS place), sub_no) AS x"))
                .select("return_id", "k", "x.*"))

    old, new = keyed(old_rows), keyed(new_rows)

    def rows(a: DataFrame, b: DataFrame, text: str, py_value, cy_value) -> DataFrame:
        return a.join(b, ["return_id", "k"], "left_anti").select(
            "return_id", F.lit(D.REPORTS[5]).alias("report"), "entity_name", "entity_code",
            F.lit(text).alias("description"), F.lit(DASH).alias("line"), py_value.alias("py_value"),
            cy_value.alias("cy_value"), F.lit(0.0).alias("difference"), F.lit(False).alias("passes"))

    none = F.lit("")
    return (rows(new, old, "NEW ENTITY (not in prior year)", none, F.col("place"))
            .unionByName(rows(old, new, "REMOVED (final return or liquidated)", F.col("place"), none)))


def schg_changes(facts: DataFrame, py: int, cy: int) -> DataFrame:
    """Indicators whose raw text changed; a missing one shows as a dash."""
    tags = [f"{D.SCH_G}_{f}" for f, _, _ in D.INDICATOR_REPORT_FIELDS]
    pairs = matched(facts, py, cy, {D.MAIN: tags})
    lines = [(d, ln, [f"{D.MAIN}_{t}"], [f"{D.MAIN}_{t}"]) for t, (_, d, ln) in zip(tags, D.INDICATOR_REPORT_FIELDS)]
    dash = {c: F.when(F.col(c) == "", F.lit(DASH)).otherwise(F.col(c)) for c in ("py_value", "cy_value")}
    return (_items(pairs, D.REPORTS[6], lines).where("py_value <> cy_value").withColumns(dash)
            .withColumn("difference", F.lit(0.0)).withColumn("passes", F.lit(False)).select(*ITEM_COLUMNS))


def _review_lines() -> list[tuple[str, str, float | None, list[str], list[Line]]]:
    """(report, kind, limit, forms, lines) of the reports that compare matched pairs."""
    page1 = [(d, ln, [f"{D.MAIN}_{f}"], [f"{D.MAIN}_{f}"]) for f, d, ln in D.PAGE1_FIELDS]
    pools = [(d, "J", [f"{D.SCH_J}_{p}_{D.J_EOY}"], [f"{D.SCH_J}_{p}_{D.J_BOY}"]) for p, d in D.RULE_POOLS]
    marks = [(d, ln, [f"{D.MAIN}_{D.SCH_G}_{f}"], [f"{D.MAIN}_{D.SCH_G}_{f}"]) for f, d, ln in D.INDICATOR_REPORT_FIELDS]

    def moves(form: str, fields: list[tuple[str, str, str]]) -> list[Line]:
        return [(d, ln, [f"{form}_{f}"], [f"{form}_{f}"]) for f, d, ln in fields]

    return [(D.REPORTS[0], "balance", 1.0, [D.SCH_F, D.MAIN], _schf_lines()), (D.REPORTS[1], "balance", 1.0, [D.SCH_J, D.MAIN], pools),
            (D.REPORTS[2], "same", None, [D.MAIN], page1), (D.REPORTS[3], "move", None, [D.SCH_H, D.MAIN], moves(D.SCH_H, D.EP_MOVEMENT_FIELDS)),
            (D.REPORTS[4], "move", None, [D.SCH_I1, D.MAIN], moves(D.SCH_I1, D.GILTI_FIELDS)), (D.REPORTS[6], "mark", None, [D.MAIN], marks)]


def review_forms() -> list[str]:
    """Forms that ``full_review`` reads."""
    return list(dict.fromkeys(f for _, _, _, forms, _ in _review_lines() for f in forms))


def full_review(facts: DataFrame, py: int, cy: int) -> DataFrame:
    """The seven reports as one table, from one reading of each year and one match.

    The entities of both years with all fields of all reports are stored, matched
    once, and every report line is an element of one array per pair.  An entity
    counts for a report if both sides file one of the report's forms.
    """
    reports = _review_lines()
    sides: dict[int, Paths] = {py: {}, cy: {}}
    for _, _, _, forms, lines in reports:
        for year, at in ((py, 2), (cy, 3)):
            for form in forms:
                sides[year].setdefault(form, []).extend(
                    x[len(form) + 1:] for ln in lines for x in ln[at] if x.startswith(f"{form}_"))
    for wanted in sides.values():
        wanted[D.MAIN] += ["CountryUnderWhoseLawsIncCd", "FunctionalCurrencyCd"]
    path = shared_dir(facts.sparkSession, "review-entities")
    for year, wanted in sides.items():
        entity_rows(facts, year, wanted).write.parquet(f"{path}/year={year}")
    stored = facts.sparkSession.read.parquet(path)
    old, new = (stored.where(F.col("year") == y).drop("year") for y in (py, cy))

    def cell(report: str, kind: str, limit: float | None, forms: list[str], line: Line) -> str:
        d, ln, p, c = line
        look = [", ".join(f"'{xs[i] if i < len(xs) else xs[0]}'" for i in range(2)) for xs in (p, c)]
        return (f"struct({lit(report)} AS report, '{kind}' AS kind, {limit or 0.0}D AS most, array({', '.join(lit(f) for f in forms)}) AS forms,"
                f" {lit(d)} AS description, {lit(ln)} AS line, array({look[0]}) AS pp, array({look[1]}) AS cc)")

    cells = ", ".join(cell(r, k, m, f, ln) for r, k, m, f, lines in reports for ln in lines)
    rows = match_entities(old, new).selectExpr("return_id", "entity_name", "entity_code", "p", "c", f"inline(array({cells}))")
    rows = rows.where("exists(forms, f -> p[f] IS NOT NULL) AND exists(forms, f -> c[f] IS NOT NULL)")
    value = "coalesce(nullif({m}[{a}[0]], ''), nullif({m}[{a}[1]], ''), '') AS {n}"
    items = _some(rows.selectExpr("return_id", "report", "kind", "most", "entity_name", "entity_code", "description", "line",
                                  value.format(m="p", a="pp", n="py_value"), value.format(m="c", a="cc", n="cy_value")))
    items = _with_difference(items).where("kind <> 'mark' OR py_value <> cy_value")
    kind = F.col("kind")
    near = F.when(F.col("p_num").isNotNull() & F.col("c_num").isNotNull(), F.abs("difference") < F.col("most")).otherwise(F.col("py_value") == F.col("cy_value"))
    passes = (F.when(kind == "balance", near).when(kind == "same", F.expr("upper(trim(py_value)) = upper(trim(cy_value))")).otherwise(kind == "move"))
    dash = {c: F.when((kind == "mark") & (F.col(c) == ""), F.lit(DASH)).otherwise(F.col(c)) for c in ("py_value", "cy_value")}
    items = items.withColumn("passes", passes).withColumn("difference", F.when(kind.isin("balance", "move"), F.col("difference")).otherwise(F.lit(0.0))).withColumns(dash)
    mains = (side.where(F.col("m")[D.MAIN].isNotNull()) for side in (old, new))
    return items.select(*ITEM_COLUMNS).unionByName(_entity_changes(*mains).select(*ITEM_COLUMNS))


def rollover_summary(items: DataFrame) -> DataFrame:
    """Counts per report and in total, with status and pass rate."""
    agg = items.rollup("report").agg(
        F.expr("count(*) AS checks"), F.expr("count_if(passes) AS passed"), F.expr("count_if(NOT passes) AS failed"),
        F.expr("count(DISTINCT CASE WHEN NOT passes THEN struct(return_id, entity_name) END) AS entities_with_issues"),
        F.expr("grouping(report) AS is_total"),
    )
    return agg.selectExpr(
        "CASE WHEN is_total = 1 THEN 'TOTAL' ELSE report END AS report", "checks", "passed", "failed",
        "entities_with_issues", "CASE WHEN failed = 0 THEN 'CLEAN' ELSE concat(failed, ' issues') END AS status",
        "round(100 * passed / greatest(checks, 1), 1) AS pass_rate")


def rollover_exact(facts: DataFrame, py: int, cy: int) -> DataFrame:
    """Closing against opening balances to the cent; blanks count as zero."""
    ends = {D.SCH_F: [D.end_tag(c) for c, _, _ in D.BALANCE_PAIRS]}
    begins = {D.SCH_F: [D.begin_tag(c) for c, _, _ in D.BALANCE_PAIRS]}
    pairs = matched(facts, py, cy, ends, begins, "first")
    lines = [(d, ln, [f"{D.SCH_F}_{D.end_tag(c)}"], [f"{D.SCH_F}_{D.begin_tag(c)}"]) for c, ln, d in D.BALANCE_PAIRS]
    zero = {c: F.coalesce(safe_float(c), F.lit(0.0)) for c in ("py_value", "cy_value")}
    return (_items(pairs, "Sch F exact", lines)
            .withColumn("status", F.when(F.abs(zero["py_value"] - zero["cy_value"]) < 0.01, "PASS").otherwise("FAIL"))
            .select("return_id", "entity_code", "line", "description", "py_value", "cy_value", "status"))


def mismatch_count(exact: DataFrame) -> DataFrame:
    """Per entity result row of the exact check."""
    return (exact.groupBy("return_id", "entity_code").agg(F.expr("count_if(status = 'FAIL') AS mismatches"))
            .withColumn("result", F.when(F.col("mismatches") == 0, "ALL LINES MATCH")
                        .otherwise(F.concat("mismatches", F.lit(" MISMATCH(ES)")))))


__all__ = ["entity_rows", "match_entities", "matched", "value_map", "full_review", "rollover_summary"]
