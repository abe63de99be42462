"""The 32 review rules as a registry of SQL expressions.

A rule names the cells it reads through ``Matrix`` and returns nullable finding
structs as SQL text.  All rules of a run are evaluated on one row per entity:
the structs go into one array that is filtered and exploded, so adding a rule
adds expressions, not passes over the data.  Comparisons with NULL do not fire.

Rules are texts rather than ``Column`` calls because a run has thousands of
nodes: one parsed expression costs the driver a fraction of building them one
call at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from crosstie import dims as D
from crosstie.functions.scalar import RULE_YES_TOKENS
from crosstie.operators.matrix import Matrix

SEVERITY_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
CATEGORIES = {"FLO": "flow", "CMP": "completeness", "RSN": "reasonableness", "ROL": "rollover"}

Sql = str


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str  # "cells" | "text" | "return"
    build: Callable[..., list[Sql]]

    @property
    def category(self) -> str:
        return CATEGORIES[self.id[:3]]

    @property
    def needs_prior(self) -> bool:
        return self.category == "rollover"


RULES: dict[str, Rule] = {}


def rule(id_: str, kind: str = "cells"):
    def register(fn):
        RULES[id_] = Rule(id_, kind, fn)
        return fn

    return register


def lit(text: str | None) -> Sql:
    return "CAST(NULL AS STRING)" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def say(template: str, **parts: Sql) -> Sql:
    """Text with ``{name}`` places taken by SQL expressions."""
    out, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [lit(before)] * bool(before) + [parts[name]]
    return f"concat({', '.join(out + [lit(rest)] * bool(rest))})"


def money(x: Sql) -> Sql:
    return f"format_number({x}, 0)"


def percent(x: Sql, pattern: str = "0") -> Sql:
    return f"format_number(({x}) * 100, '{pattern}')"


def bound(floor: int, x: Sql, share: str) -> Sql:
    """The larger of an absolute floor and a share of an amount."""
    return f"greatest({floor}, abs({x}) * {share})"


def finding(when: Sql, check_id: str, severity: str, description: Sql, expected: Sql | None = None,
            actual: Sql | None = None, delta: Sql = "NULL", context: str | None = None, sub_key: str = "") -> Sql:
    """A finding struct where the predicate holds, else NULL."""
    return (
        f"CASE WHEN {when} THEN named_struct('check_id', '{check_id}', 'severity', '{severity}',"
        f" 'category', '{CATEGORIES[check_id[:3]]}', 'sub_key', {lit(sub_key)},"
        f" 'description', {description}, 'expected', {expected or lit(None)}, 'actual', {actual or lit(None)},"
        f" 'delta', CAST({delta} AS DOUBLE), 'context', {lit(context)}) END"
    )


# cells by their role ---------------------------------------------------------


def _h(m: Matrix, tag: str, side: str = "cy") -> Sql:
    return m.num(side, D.SCH_H, tag)


def _ni(m: Matrix) -> Sql:
    return _h(m, "ForeignCYNetIncomePerBooksAmt")


def _ep_fc(m: Matrix) -> Sql:
    return _h(m, "CurrentEarningsAndProfitsAmt")


def _ep_usd(m: Matrix, side: str = "cy") -> Sql:
    return _h(m, "CurrEarnAndPrftInUSDollarsAmt", side)


def _rate(m: Matrix, side: str = "cy") -> Sql:
    return _h(m, "ExchangeRt", side)


def _i1(m: Matrix, tag: str, side: str = "cy") -> Sql:
    return m.num(side, D.SCH_I1, tag)


def _tested_usd(m: Matrix, side: str = "cy") -> Sql:
    return _i1(m, "TestedIncomeLossGrp_USDollarAmt", side)


def _tested(m: Matrix) -> Sql:
    """USD amount, or the FC amount where it is missing or zero."""
    return f"coalesce(nullif({_tested_usd(m)}, 0), {_i1(m, 'TestedIncomeLossGrp_FunctionalCurrencyAmt')})"


def _f(m: Matrix, concept: str, begin: bool = False, side: str = "cy") -> Sql:
    return m.num(side, D.SCH_F, D.begin_tag(concept) if begin else D.end_tag(concept))


def _c(m: Matrix, tag: str) -> Sql:
    return m.num("cy", D.SCH_C, tag)


def _zero(x: Sql) -> Sql:
    return f"coalesce({x}, 0D)"


# flow ------------------------------------------------------------------------


@rule("FLO-001")
def _(m: Matrix) -> list[Sql]:
    h, c = _ni(m), _c(m, "ForeignCYNetIncomePerBookAmt")
    d = f"abs({h} - {c})"
    return [finding(f"{d} > {bound(1, h, '0.001')}", "FLO-001", "HIGH",
                    say("Net income differs between Schedules H and C by {d} FC", d=money(d)),
                    say("Schedule C net income {c}", c=money(c)), say("Schedule H net income {h}", h=money(h)), d,
                    "Schedule H starts from the net income per books of Schedule C")]


@rule("FLO-002")
def _(m: Matrix) -> list[Sql]:
    fc, fx, usd = _ep_fc(m), _rate(m), _ep_usd(m)
    want = f"try_divide({fc}, {fx})"
    d = f"abs({want} - {usd})"
    return [finding(f"{fx} > 0 AND {d} > {bound(10, usd, '0.01')}", "FLO-002", "MEDIUM",
                    say("E&P in USD is off the converted FC amount by ${d}", d=money(d)),
                    say("${w} = {fc} FC at {fx}", w=money(want), fc=money(fc), fx=f"format_number({fx}, 4)"),
                    say("${u}", u=money(usd)), d)]


@rule("FLO-003")
def _(m: Matrix) -> list[Sql]:
    gross = _i1(m, "GrossIncomeAmt")
    tested, hte = _zero(_tested(m)), _zero(_i1(m, "HighTaxExceptionIncomeAmt"))
    subf, alloc = _zero(_i1(m, "SubpartFIncomeAmt")), _zero(_i1(m, "AllocableDeductionAmt"))
    total = f"({tested} + {hte} + {subf} + {alloc})"
    d = f"abs({gross} - {total})"
    return [finding(f"{m.has('cy', D.SCH_H)} AND {gross} <> 0 AND {d} > {bound(1000, gross, '0.05')}",
                    "FLO-003", "HIGH", say("Schedule I-1 components miss gross income by ${d}", d=money(d)),
                    say("Gross ${g} from tested {t}, high-tax {h}, Subpart F {s}, deductions {a}", g=money(gross),
                        t=money(tested), h=money(hte), s=money(subf), a=money(alloc)),
                    say("Components add to ${t}", t=money(total)), d)]


@rule("FLO-004")
def _(m: Matrix) -> list[Sql]:
    tax, ni = m.num("cy", D.SCH_E, "TotalTaxInFunctionalCurAmt"), _ni(m)
    cap = f"({ni} * 0.45D)"
    return [finding(f"{ni} > 0 AND {tax} > {cap} AND {tax} > 10000", "FLO-004", "MEDIUM",
                    say("Schedule E taxes of {t} FC are above 45% of income of {n} FC", t=money(tax), n=money(ni)),
                    say("At most {c} FC", c=money(cap)),
                    say("{t} FC, {p}%", t=money(tax), p=percent(f"try_divide({tax}, {ni})")), f"{tax} - {cap}",
                    "Taxes above any statutory rate point to a data error or to earlier years")]


@rule("FLO-005")
def _(m: Matrix) -> list[Sql]:
    tested, tax = _tested(m), _i1(m, "TestedForeignIncomeTaxesGrp_USDollarAmt")
    return [finding(f"{m.has('cy', D.SCH_H)} AND {tested} < 0 AND {tax} > 0", "FLO-005", "HIGH",
                    lit("A tested loss carries tested foreign taxes"), lit("No tested taxes with a tested loss"),
                    say("Tested income ${t}, taxes ${x}", t=money(tested), x=money(tax)),
                    context="Only entities with tested income claim tested taxes")]


@rule("FLO-006")
def _(m: Matrix) -> list[Sql]:
    inc, ded, net = (_c(m, t) for t in
                     ("ForeignTotalIncomeAmt", "ForeignTotalDeductionsAmt", "ForeignCYNetIncomePerBookAmt"))
    want = f"({inc} - {ded})"
    d = f"abs({want} - {net})"
    return [finding(f"{m.has('cy', D.SCH_H)} AND {d} > 1", "FLO-006", "HIGH",
                    say("Schedule C does not foot: {i} less {d} is not {n}", i=money(inc), d=money(ded), n=money(net)),
                    say("Net {w}", w=money(want)), say("Net {n}", n=money(net)), d,
                    "Total income less total deductions is net income")]


@rule("FLO-007")
def _(m: Matrix) -> list[Sql]:
    out = []
    for begin, label, key in ((False, "end", "EOY"), (True, "beginning", "BOY")):
        x = _f(m, "TotalAssets", begin)
        out.append(finding(f"{m.has('cy', D.SCH_H)} AND {x} < 0", "FLO-007", "HIGH",
                           say(f"Total assets at the {label} of the year are negative ({{x}})", x=money(x)),
                           lit("Total assets of zero or more"), money(x),
                           context="A balance sheet cannot show negative total assets", sub_key=key))
    return out


@rule("FLO-008")
def _(m: Matrix) -> list[Sql]:
    assets, le = _f(m, "TotalAssets"), _f(m, "TotLiabShrEqty")
    d = f"abs({assets} - {le})"
    return [finding(f"{m.has('cy', D.SCH_H)} AND {d} > 1", "FLO-008", "HIGH",
                    say("Balance sheet is out of balance by {d}", d=money(d)),
                    say("Assets {a} equal liabilities and equity {l}", a=money(assets), l=money(le)),
                    say("Difference {d}", d=money(d)), d, "Assets equal liabilities plus equity")]


# completeness ----------------------------------------------------------------


@rule("CMP-001")
def _(m: Matrix) -> list[Sql]:
    return [finding(f"{m.has('cy', D.MAIN)} AND NOT {m.has('cy', D.SCH_H)}", "CMP-001", "HIGH",
                    lit("No Schedule H is filed for the entity"),
                    context="Current E&P is computed for every reported entity")]


@rule("CMP-002")
def _(m: Matrix) -> list[Sql]:
    return [finding(f"{m.has('cy', D.SCH_H)} AND NOT {m.has('cy', D.SCH_I1)}", "CMP-002", "MEDIUM",
                    lit("Schedule H is filed without Schedule I-1"),
                    context="Income of every controlled entity is classified on Schedule I-1")]


@rule("CMP-003")
def _(m: Matrix) -> list[Sql]:
    tested = _tested_usd(m)
    return [finding(f"{m.has('cy', D.SCH_I1)} AND NOT {m.has('cy', D.SCH_E)} AND {tested} > 0", "CMP-003", "MEDIUM",
                    say("Tested income of ${t} without a Schedule E", t=money(tested)),
                    context="Tested income usually comes with foreign taxes")]


@rule("CMP-004")
def _(m: Matrix) -> list[Sql]:
    boy, eoy = _f(m, "TotalAssets", begin=True), _f(m, "TotalAssets")
    return [finding(f"{m.has('cy', D.SCH_F)} AND {boy} <> 0 AND coalesce({eoy}, 0) = 0", "CMP-004", "HIGH",
                    say("Assets of {b} at the beginning but none at the end of the year", b=money(boy)),
                    lit("Year-end amounts are filled in"), lit("Year-end total assets are zero or missing"),
                    context="The balance sheet looks unfinished")]


@rule("CMP-005")
def _(m: Matrix) -> list[Sql]:
    return [finding(f"{m.has('cy', D.SCH_H)} AND coalesce({_rate(m)}, 0) = 0", "CMP-005", "MEDIUM",
                    lit("Schedule H has no exchange rate"), context="E&P cannot be converted to USD without a rate")]


@rule("CMP-006")
def _(m: Matrix) -> list[Sql]:
    return [finding(f"{m.has('cy', D.MAIN)} AND length(trim(entity_code)) < 3", "CMP-006", "HIGH",
                    lit("The reference id is too short to be valid"))]


# reasonableness --------------------------------------------------------------


@rule("RSN-001")
def _(m: Matrix) -> list[Sql]:
    ep = _ep_usd(m)
    return [finding(f"abs({ep}) > 1e9", "RSN-001", "LOW", say("E&P of ${e} is beyond one billion", e=money(ep)),
                    actual=say("${e}", e=money(ep)))]


def fx_band(fx: Sql) -> Sql:
    """First currency band that holds the rate with a wide margin, else NULL.

    The 15 fixed bands are tried in order inside one expression, so the range
    join needs neither a shuffle nor a nested loop.
    """
    arms = " ".join(
        f"WHEN {fx} >= {low * 0.7!r}D AND {fx} <= {high * 1.3!r}D THEN named_struct('currency', '{ccy}',"
        f" 'low', {low!r}D, 'high', {high!r}D, 'edge_low', {low * 0.85!r}D, 'edge_high', {high * 1.15!r}D)"
        for ccy, low, high in D.FX_BANDS
    )
    return f"CASE {arms} END"


@rule("RSN-002")
def _(m: Matrix) -> list[Sql]:
    fx = _rate(m)
    band = m.let("fx_band", fx_band(fx))
    rate = f"format_number({fx}, 4)"
    return [finding(f"{fx} > 0 AND ({fx} < {band}.edge_low OR {fx} > {band}.edge_high)", "RSN-002", "MEDIUM",
                    say("Rate {r} is at the edge of the usual band of {c}", r=rate, c=f"{band}.currency"),
                    say("{l} to {h}", l=f"CAST({band}.low AS STRING)", h=f"CAST({band}.high AS STRING)"), rate,
                    context="The rate may be stale or mistyped")]


@rule("RSN-003")
def _(m: Matrix) -> list[Sql]:
    ni, ep = _ni(m), _ep_fc(m)
    etr = f"try_divide({ni} - {ep}, {ni})"
    return [finding(f"{ni} <> 0 AND ({etr} > 0.50 OR {etr} < -0.10)", "RSN-003", "MEDIUM",
                    say("Implied tax rate of {p}% is unusual", p=percent(etr)), lit("0% to 50%"),
                    say("{p}% with income {n} and E&P {e}", p=percent(etr, "0.0"), n=money(ni), e=money(ep)),
                    context="Adjustments, refunds or errors explain rates outside the usual range")]


@rule("RSN-004")
def _(m: Matrix) -> list[Sql]:
    tested, subf = _tested_usd(m), _i1(m, "SubpartFIncomeAmt")
    return [finding(f"{m.has('cy', D.SCH_H)} AND {tested} > 0 AND {subf} > 0 AND abs({tested} - {subf}) < 1",
                    "RSN-004", "LOW", say("Tested income and Subpart F income are both ${t}", t=money(tested)),
                    lit("Two different amounts"), say("${t} in both", t=money(tested)),
                    context="The same income may be reported in two categories")]


@rule("RSN-005", kind="return")
def _() -> list[Sql]:
    return [finding("n >= 5 AND (positive = 0 OR negative = 0)", "RSN-005", "LOW",
                    say("All {n} entities report {s} E&P", n="CAST(n AS STRING)",
                        s="CASE WHEN positive > 0 THEN 'positive' ELSE 'negative' END"),
                    context="Groups usually mix profitable and loss-making entities")]


@rule("RSN-006")
def _(m: Matrix) -> list[Sql]:
    qbai, assets = _i1(m, "QBAIAmt"), _f(m, "TotalAssets")
    return [finding(f"{m.has('cy', D.SCH_H)} AND {qbai} > {assets} AND {qbai} > 0", "RSN-006", "HIGH",
                    say("QBAI of ${q} is above total assets of ${a}", q=money(qbai), a=money(assets)),
                    say("At most ${a}", a=money(assets)), say("${q}", q=money(qbai)), f"{qbai} - {assets}",
                    "QBAI is part of the assets on Schedule F")]


@rule("RSN-007")
def _(m: Matrix) -> list[Sql]:
    interest, gross = _i1(m, "InterestExpenseAmt"), _i1(m, "GrossIncomeAmt")
    return [finding(f"{m.has('cy', D.SCH_H)} AND {interest} > 0 AND {gross} > 0 AND {interest} > {gross}",
                    "RSN-007", "MEDIUM",
                    say("Interest expense of ${i} is above gross income of ${g}", i=money(interest), g=money(gross)),
                    lit("Interest below gross income"),
                    say("{p}% of gross income", p=percent(f"try_divide({interest}, {gross})")),
                    context="Check the financing structure of the entity")]


# rollover --------------------------------------------------------------------


@rule("ROL-001")
def _(m: Matrix) -> list[Sql]:
    out = []
    for (concept, _, _), name in zip(D.BALANCE_PAIRS, D.BALANCE_RULE_NAMES):
        end, begin = _f(m, concept, side="py"), _f(m, concept, begin=True)
        py, cy = _zero(end), _zero(begin)
        d = f"abs({cy} - {py})"
        out.append(finding(
            f"{m.has('py', D.SCH_F)} AND {m.has('cy', D.SCH_F)} AND coalesce({end}, {begin}) IS NOT NULL"
            f" AND {d} > 10000 AND {d} > {bound(1, py, '0.001')}", "ROL-001", "HIGH" if "Total" in name else "MEDIUM",
            say(f"{name}: opening balance {{c}} is not last year's closing {{p}}", c=money(cy), p=money(py)),
            say("Opening = {p}", p=money(py)), say("Opening = {c}, off by {d}", c=money(cy), d=money(d)), d,
            "Balances carry forward; retranslation explains small differences", sub_key=concept))
    return out


@rule("ROL-002")
def _(m: Matrix) -> list[Sql]:
    return [finding(f"{m.has('py', D.MAIN)} AND NOT {m.has('cy', D.MAIN)}", "ROL-002", "MEDIUM",
                    lit("Entity of last year is missing this year"),
                    context="Check for a liquidation, sale or merger")]


@rule("ROL-003")
def _(m: Matrix) -> list[Sql]:
    return [finding(f"{m.has('cy', D.MAIN)} AND NOT {m.has('py', D.MAIN)}", "ROL-003", "MEDIUM",
                    lit("Entity is new this year"),
                    context="Check for an acquisition, formation or reclassification")]


@rule("ROL-004")
def _(m: Matrix) -> list[Sql]:
    py, cy = _ep_usd(m, "py"), _ep_usd(m)
    return [finding(f"({cy} > 50000 AND {py} < -50000) OR ({cy} < -50000 AND {py} > 50000)", "ROL-004", "MEDIUM",
                    say("E&P changes sign from ${p} to ${c}", p=money(py), c=money(cy)),
                    lit("The same sign unless something material happened"),
                    say("${p} then ${c}", p=money(py), c=money(cy)),
                    context="Check for an acquisition, disposition or one-time item")]


@rule("ROL-005")
def _(m: Matrix) -> list[Sql]:
    py, cy = _rate(m, "py"), _rate(m)
    change = f"try_divide(abs({cy} - {py}), {py})"
    parts = {"p": f"format_number({py}, 4)", "c": f"format_number({cy}, 4)", "x": percent(change)}
    return [finding(f"{py} > 0 AND {cy} > 0 AND {change} > 0.25", "ROL-005", "LOW",
                    say("Exchange rate moved by {x}%: {p} then {c}", **parts), lit("A move below 25%"),
                    say("{p} then {c}, {x}%", **parts),
                    context="Volatile currencies move this much; mistyped rates do too")]


@rule("ROL-006")
def _(m: Matrix) -> list[Sql]:
    py, cy = _ep_usd(m, "py"), _ep_usd(m)
    known = m.in_return("cy", D.SCH_H, "CurrEarnAndPrftInUSDollarsAmt")
    return [finding(f"{m.has('py', D.SCH_H)} AND {m.has('cy', D.SCH_H)} AND {known}"
                    f" AND abs({py}) > 100000 AND coalesce({cy}, 0) = 0", "ROL-006", "HIGH",
                    say("E&P of ${p} last year is gone this year", p=money(py)),
                    lit("E&P unless the entity was disposed of"), lit("$0 this year"), f"abs({py})",
                    "Check for a liquidation, a disposition or an omission")]


@rule("ROL-007")
def _(m: Matrix) -> list[Sql]:
    out = []
    for pool, name in D.RULE_POOLS:
        boy, eoy = f"{pool}_{D.J_BOY}", f"{pool}_{D.J_EOY}"
        begin, end = m.num("cy", D.SCH_J, boy), m.num("py", D.SCH_J, eoy)
        known = f"{m.in_return('cy', D.SCH_J, boy)} AND {m.in_return('py', D.SCH_J, eoy)}"
        cy, py = _zero(begin), _zero(end)
        d = f"abs({cy} - {py})"
        out.append(finding(
            f"{m.has('py', D.SCH_J)} AND {m.has('cy', D.SCH_J)} AND {known}"
            f" AND coalesce({begin}, {end}) IS NOT NULL AND {d} > {bound(1, py, '0.001')} AND {d} > 100",
            "ROL-007", "HIGH",
            say(f"{name}: opening pool ${{c}} is not last year's closing ${{p}}", c=money(cy), p=money(py)),
            say("Opening = ${p}", p=money(py)), say("Opening = ${c}, off by ${d}", c=money(cy), d=money(d)), d,
            "Pools carry forward; a gap is a missed movement or a data error", sub_key=pool))
    return out


@rule("ROL-008", kind="text")
def _(pairs: list[tuple[Sql, Sql]]) -> list[Sql]:
    out = []
    for (tag, name), (py, cy) in zip(D.STATIC_RULE_FIELDS, pairs):
        a, b = f"upper(trim({py}))", f"upper(trim({cy}))"
        out.append(finding(f"{a} NOT IN ('', 'NAN') AND {b} NOT IN ('', 'NAN') AND {a} <> {b}", "ROL-008",
                           "HIGH" if "currency" in name.lower() else "MEDIUM",
                           say(f"{name} went from '{{a}}' to '{{b}}'", a=a, b=b), say("Still {a}", a=a), b,
                           context="Identity data stays the same unless the entity was reorganized", sub_key=tag))
    return out


@rule("ROL-009", kind="text")
def _(pairs: list[tuple[Sql, Sql]], known: list[Sql]) -> list[Sql]:
    yes = ", ".join(lit(t) for t in RULE_YES_TOKENS)
    out = []
    for (tag, name), (py, cy), asked in zip(D.INDICATOR_RULE_FIELDS, pairs, known):
        a, b = (f"upper(trim(coalesce({x}, 'nan')))" for x in (py, cy))
        said = {k: f"CASE WHEN {x} IN ({yes}) THEN 'Yes' ELSE 'No' END" for k, x in (("a", a), ("b", b))}
        shown = {k: f"CASE WHEN {x} = '' THEN 'blank' ELSE {x} END" for k, x in (("a", a), ("b", b))}
        out.append(finding(f"{asked} AND {a} <> {b} AND NOT ({a} IN ('', 'NAN') AND {b} IN ('', 'NAN'))",
                           "ROL-009", "MEDIUM", say(f"{name} flips ({{a}} -> {{b}})", **said),
                           say("Last year {a}", **shown), say("This year {b}", **shown),
                           context="A changed indicator can change filing duties", sub_key=tag.rsplit("_", 1)[-1]))
    return out


@rule("ROL-010")
def _(m: Matrix) -> list[Sql]:
    py, cy = _tested_usd(m, "py"), _tested_usd(m)
    both = {"p": money(py), "c": money(cy)}
    return [finding(f"{py} > 10000 AND {cy} < -10000", "ROL-010", "MEDIUM",
                    say("Tested income turns into a tested loss: ${p} then ${c}", **both),
                    lit("The same classification"), say("${p} then ${c}", **both),
                    context="Check whether the business really worsened"),
            finding(f"{py} < -10000 AND {cy} > 10000", "ROL-010", "LOW",
                    say("Tested loss turns into tested income: ${p} then ${c}", **both),
                    lit("The same classification"), say("${p} then ${c}", **both),
                    context="Check whether the business really recovered")]


@rule("ROL-011")
def _(m: Matrix) -> list[Sql]:
    pool = "Post2017EPNotPrevTaxedGrp"
    boy, cyep, eoy = (m.num("cy", D.SCH_J, f"{pool}_{t}") for t in (D.J_BOY, D.J_CYEP, D.J_EOY))
    h = _ep_usd(m)
    known = " AND ".join([
        m.has("cy", D.SCH_H), m.has("cy", D.SCH_J),
        m.in_return("cy", D.SCH_H, "CurrEarnAndPrftInUSDollarsAmt"),
        m.in_return("cy", D.SCH_J, f"{pool}_{D.J_BOY}"), m.in_return("cy", D.SCH_J, f"{pool}_{D.J_EOY}"),
    ])
    d, want = f"abs({cyep} - {h})", f"({boy} + {cyep})"
    over = f"({eoy} - {want})"
    return [finding(f"{known} AND {d} > {bound(100, h, '0.01')} AND {d} > 1000", "ROL-011", "HIGH",
                    say("Current E&P is ${j} on Schedule J and ${h} on Schedule H", j=money(cyep), h=money(h)),
                    say("${h}", h=money(h)), say("${j}, off by ${d}", j=money(cyep), d=money(d)), d,
                    "Both schedules report the same current E&P", sub_key="tie"),
            finding(f"{known} AND {eoy} > {want} + {bound(1000, want, '0.05')}", "ROL-011", "MEDIUM",
                    say("Closing pool ${e} is above opening plus current E&P by ${o}", e=money(eoy), o=money(over)),
                    say("At most {b} + {c}", b=money(boy), c=money(cyep)), say("${e}", e=money(eoy)), over,
                    "The pool grew by more than the year's earnings", sub_key="growth")]
