"""Adapter from the given star-schema tables to tax-return facts.

One customer plays one foreign entity.  Every two consecutive order years make a
pair, and the customers of a market segment in one pair make a filer group
(``seg``, named after the segment and the first year): orders of the first year
are its prior-year return, those of the second its current-year one.  The two
returns of all groups are filed under the same two tax years, ``PY`` and ``CY``,
so one run reviews all pairs of all order years.  Amounts are whole numbers made
from order lines; arithmetic on the customer key seeds the defects the rules
look for.

The expressions below are plain SQL texts that Spark and other engines read
alike, so checks can rebuild the very same input.  ``{s}`` is the side: ``p``
for the prior, ``c`` for the current year.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie.plans.store import stored_partitions, stored_table
from crosstie.schema import FACT_COLUMNS, FACT_PARTITIONS

PY, CY = 1996, 1997
SIDES = {"p": PY, "c": CY}
#: first order years of the pairs; None means all, which timing alone narrows
FIRST_YEARS: tuple[int, ...] | None = None


def every(n: int, then: str, other: str = "0", rest: int = 0) -> str:
    return f"(CASE WHEN k % {n} = {rest} THEN {then} ELSE {other} END)"


def _half(x: str) -> str:
    return f"CAST(floor(({x}) / 2) AS BIGINT)"


def _part(x: str, n: int) -> str:
    return f"CAST(floor(({x}) / {n}) AS BIGINT)"


_REGION_RATE = ("0.80", "1.20", "110", "0.92", "5.1")
_REGION_RATE_UP = ("1.12", "1.68", "154", "1.288", "7.14")
_REGION_CURRENCY = ("GBP", "USD", "JPY", "EUR", "BRL")


def _by_region(values: tuple[str, ...], quote: bool) -> str:
    q = "'" if quote else ""
    arms = " ".join(f"WHEN {i} THEN {q}{v}{q}" for i, v in enumerate(values))
    return f"(CASE region {arms} END)"


#: derived columns in dependency order; each layer only uses earlier layers
LAYERS: list[list[tuple[str, str]]] = [
    [
        ("code", "concat('C', lpad(CAST(k AS STRING), 6, '0'))"),
        ("rate", f"CAST({_by_region(_REGION_RATE, True)} AS DOUBLE)"),
        *[
            (f"{n}_{s}", e.replace("{s}", s))
            for s in SIDES
            for n, e in [
                ("net", f"g_{{s}} - r_{{s}} - d_{{s}} + {every(11, '250')}"),
                ("ni", f"g_{{s}} - r_{{s}} - d_{{s}} + {every(13, _part('g_{s}', 10))}"),
            ]
        ],
        ("fx_p", every(23, "CAST(NULL AS STRING)", _by_region(_REGION_RATE, True))),
        ("fx_c", every(23, "CAST(NULL AS STRING)",
                       every(19, _by_region(_REGION_RATE_UP, True), _by_region(_REGION_RATE, True)))),
        ("name_p", "cname"),
        ("name_c", every(67, "concat(cname, ' HOLDINGS')", "cname")),
        ("ccy_p", _by_region(_REGION_CURRENCY, True)),
        ("ccy_c", every(71, "'CHF'", _by_region(_REGION_CURRENCY, True))),
        ("country", "concat('N', CAST(nat AS STRING))"),
    ],
    [
        ("ep_p", "ni_p - t_p"),
        ("ep_c", every(17, "-ni_c", "ni_c - t_c")),
        *[(f"x_{s}", f"COALESCE(CAST(fx_{s} AS DOUBLE), rate)") for s in SIDES],
    ],
    [
        (f"usd0_{s}", f"CAST(round(ep_{s} / x_{s}) AS BIGINT) + {every(29, _part(f'abs(ep_{s})', 10) + ' + 100')}")
        for s in SIDES
    ],
    [
        ("usd_p", every(37, "usd0_p * 1000000", "usd0_p")),
        ("usd_c", every(39, "0", every(37, "usd0_c * 1000000", "usd0_c"))),
    ],
    [
        (f"jcy_{s}", f"usd_{s} + {every(27, '5000')}") for s in SIDES
    ],
    [
        # accumulated pools: b = beginning, e = ending; a c s h u v = the six pools
        ("ba_p", "g_p"), ("ea_p", f"g_p + jcy_p + {every(35, _part('g_p', 5))}"),
        ("bc_p", "r_p"), ("ec_p", every(18, "0", "r_p")),
        ("bs_p", "d_p"), ("es_p", "d_p"),
        ("bh_p", "g_p + r_p + d_p"), ("eh_p", "g_p + r_p + d_p"),
        ("bu_p", "t_p"), ("eu_p", "t_p"),
        ("bv_p", "q_p"), ("ev_p", "q_p"),
    ],
    [
        ("ba_c", f"CASE WHEN n_p > 0 THEN ea_p + {every(5, '500')} ELSE 0 END"),
        ("bc_c", f"CASE WHEN n_p > 0 THEN ec_p - {every(15, '500')} + {every(18, '300')} ELSE 0 END"),
        ("ec_c", "r_c"),
        ("bs_c", f"CASE WHEN n_p > 0 THEN es_p + {every(20, '200')} ELSE 0 END"), ("es_c", "d_c"),
        ("bh_c", "CASE WHEN n_p > 0 THEN eh_p ELSE 0 END"), ("eh_c", "g_c + r_c + d_c"),
        ("bu_c", f"CASE WHEN n_p > 0 THEN eu_p + {every(21, '50')} ELSE 0 END"), ("eu_c", "t_c"),
        ("bv_c", f"CASE WHEN n_p > 0 THEN ev_p + {every(22, '5')} ELSE 0 END"), ("ev_c", "q_c"),
    ],
    [
        ("ea_c", f"ba_c + jcy_c + {every(35, _part('g_c', 5))}"),
    ],
]

POOL_LETTER = {
    "Post2017EPNotPrevTaxedGrp": "a", "Section951APTEPGrp": "c", "Section951a1APTEPGrp": "s",
    "TotalSection964AEPGrp": "h", "Post1986UndistributedEarnGrp": "u", "HoveringDeficitDedSspndTaxGrp": "v",
}


@dataclass(frozen=True)
class FactSpec:
    form: str
    path: str  # without the form prefix; "" marks the form itself
    p: str | None  # SQL text of the prior-year value, NULL = absent
    c: str | None
    instance: int = 1
    basket: str = ""

    @property
    def full_path(self) -> str:
        return f"{self.form}_{self.path}" if self.path else self.form


def _both(text: str) -> tuple[str, str]:
    return text.replace("{s}", "p"), text.replace("{s}", "c")


def _only(cond: str, value: str) -> str:
    return f"CASE WHEN {cond} THEN {value} END"


# concept -> (PY end, PY begin, CY end, seeded shift of the CY beginning)
_F_AMOUNTS = {
    "Cash": (_half("g_{s}"), "25000"),
    "TradeNotes": ("g_{s} - " + _half("g_{s}"), "0"),
    "Inventories": ("q_{s}", "0"),
    "TotalAssets": ("g_{s} + q_{s}", "25000"),
    "AccountsPayable": ("d_{s}", "0"),
    "CommonStock": ("t_{s}", "0"),
    "RtnEarnings": ("g_{s} + q_{s} - d_{s} - t_{s}", "25000"),
    "TotLiabShrEqty": ("g_{s} + q_{s}", "0"),
}


def _fact_specs() -> list[FactSpec]:
    out: list[FactSpec] = []

    def add(form: str, cond: str, pairs: list[tuple[str, str | tuple[str | None, str | None]]],
            instance: int = 1, basket: str = "") -> None:
        for path, text in pairs:
            p, c = _both(text) if isinstance(text, str) else text
            p, c = ((_only(cond.replace("{s}", s), v) if v is not None and cond else v)
                    for s, v in (("p", p), ("c", c)))
            out.append(FactSpec(form, path, p, c, instance, basket))

    g = f"{D.SCH_G}_"
    c_inline, f_inline = f"{D.SCH_C}_", f"{D.SCH_F}_"
    add(D.MAIN, "", [
        ("", "concat('M', CAST(k AS STRING))"),
        ("ForeignCorporation_BusinessName_BusinessNameLine1Txt", "name_{s}"),
        ("ForeignCorporation_ForeignAddress_CityNm", "concat('CITY ', CAST(nat AS STRING))"),
        ("ForeignCorporation_ForeignAddress_CountryCd", "country"),
        ("ForeignEntityIdentificationGrp_ForeignEntityReferenceIdNum", "code"),
        ("CountryUnderWhoseLawsIncCd", ("country", every(79, "'ZZ'", "country"))),
        ("FunctionalCurrencyCd", "ccy_{s}"),
        ("IncorporationDt", ("'1990-01-01'", every(77, "''", "'1990-01-01'"))),
        ("PrincipalPlaceOfBusCountryCd", "lower(country)"),
        ("EIN", every(6, "''", "lpad(CAST(k AS STRING), 9, '0')")),
        ("EmployerEIN", every(6, "concat('00-', CAST(k AS STRING))", "CAST(NULL AS STRING)")),
        ("VotingStockOwnedPct", every(4, "'0.75'", "'1'")),
        ("dormantForeignCorporationCd", every(30, "'Y'", "CAST(NULL AS STRING)")),
        ("CategoryOfFiler1Ind", every(2, "'X'", "CAST(NULL AS STRING)")),
        ("CategoryOfFiler4Ind", "'X'"),
        ("CategoryOfFiler5Ind", every(3, "'X'", "CAST(NULL AS STRING)")),
        # indicators
        (g + "DisallowedInterestExpenseInd",
         (every(3, "'X'", "'false'"), every(73, every(3, "'false'", "'X'"), every(3, "'X'", "'false'")))),
        (g + "BaseErosionPaymentBenefitInd",
         (every(4, "'1'", "'0'"), every(73, every(4, "'0'", "'1'"), every(4, "'1'", "'0'"), rest=1))),
        (g + "FDIIBenefitsClaimInd",
         (every(5, "'true'", "CAST(NULL AS STRING)"),
          every(74, "CAST(NULL AS STRING)", every(5, "'true'", "CAST(NULL AS STRING)"), rest=0))),
        (g + "PayOrAccrueTopUpTaxInd", (None, every(75, "'X'", "CAST(NULL AS STRING)"))),
        (g + "ForeignTaxSection909Ind", (every(9, "'N'", "CAST(NULL AS STRING)"), every(27, "'Y'", every(9, "'N'", "CAST(NULL AS STRING)")))),
        # schedules filed inline
        (c_inline + "ForeignGrossReceiptsOrSalesAmt", "CAST(g_{s} AS STRING)"),
        (c_inline + "ForeignReturnsAndAllowancesAmt", "CAST(r_{s} AS STRING)"),
        (c_inline + "ForeignTotalIncomeAmt", "CAST(g_{s} - r_{s} AS STRING)"),
        (c_inline + "ForeignTaxesAmt", every(8, "CAST(NULL AS STRING)", "CAST(t_{s} AS STRING)")),
        (c_inline + "ForeignTotalDeductionsAmt", "CAST(d_{s} AS STRING)"),
        (c_inline + "ForeignCYNetIncomePerBookAmt", "CAST(net_{s} AS STRING)"),
        (c_inline + "ForeignCYNetIncomePerBooksAmt", "CAST(net_{s} AS STRING)"),
        (c_inline + "USTotalIncomeAmt", f"CAST({_half('g_{s} - r_{s}')} AS STRING)"),
        (c_inline + "USTotalDeductionsAmt", f"CAST({_half('d_{s}')} AS STRING)"),
        (c_inline + "USCYNetIncomePerBooksAmt", f"CAST({_half('net_{s}')} AS STRING)"),
    ])

    def balance(prefix: str, form: str, cond: str, defects: bool) -> None:
        for concept, (end, shift) in _F_AMOUNTS.items():
            e_p, e_c = _both(end)
            b_p, b_c = e_p, f"CASE WHEN n_p > 0 THEN {e_p} + {every(8, shift)} ELSE 0 END"
            ends = []
            for e in (e_p, e_c):
                if defects and concept == "TotalAssets":
                    e = every(61, "CAST(NULL AS BIGINT)", every(59, f"-({e})", e))
                if defects and concept == "TotLiabShrEqty":
                    e = f"{e} + {every(53, '5')}"
                ends.append(f"CAST({e} AS STRING)")
            add(form, cond, [(prefix + D.begin_tag(concept), (f"CAST({b_p} AS STRING)", f"CAST({b_c} AS STRING)")),
                             (prefix + D.end_tag(concept), (ends[0], ends[1]))])

    balance(f_inline, D.MAIN, "", defects=False)

    add(D.SCH_C, "", [
        ("", "''"),
        ("ForeignTotalIncomeAmt", "CAST(g_{s} - r_{s} AS STRING)"),
        ("ForeignTotalDeductionsAmt", "CAST(d_{s} AS STRING)"),
        ("ForeignCYNetIncomePerBookAmt", "CAST(net_{s} AS STRING)"),
    ])
    add(D.SCH_E, "k % 9 <> 0", [
        ("", "''"),
        ("TotalTaxInFunctionalCurAmt", f"CAST({every(47, 't_{s} * 20', 't_{s}')} AS STRING)"),
        ("TotalTaxInUSDollarsAmt", f"CAST({_half('t_{s}')} AS STRING)"),
    ])
    add(D.SCH_F, "", [("", "''")])
    balance("", D.SCH_F, "", defects=True)
    add(D.SCH_H, "k % 31 <> 0", [
        ("", "concat('H', CAST(k AS STRING))"),
        ("ForeignCYNetIncomePerBooksAmt", "CAST(ni_{s} AS STRING)"),
        ("TotalNetAdditionsAmt", "CAST(q_{s} AS STRING)"),
        ("TotalNetSubtractionsAmt", every(10, "''", "CAST(t_{s} AS STRING)")),
        ("CurrentEarningsAndProfitsAmt", "CAST(ep_{s} AS STRING)"),
        ("CurrEarnAndPrftInUSDollarsAmt", "CAST(usd_{s} AS STRING)"),
        ("ExchangeRt", "fx_{s}"),
    ])
    add(D.SCH_I, "k % 12 <> 0", [
        ("", "''"),
        ("SubpartFPHCIncomeAmt", "CAST(r_{s} AS STRING)"),
        ("OtherSubpartFNotIncludedAmt", "CAST(d_{s} AS STRING)"),
    ])
    loss = f"-{_half('g_c')}"
    tested_p = every(41, "r_p", "g_p - r_p - d_p")
    tested_c = every(41, "r_c", every(10, loss, "g_c - r_c - d_c", rest=1))
    add(D.SCH_I1, "k % 7 <> 0", [
        ("", "''"),
        ("GrossIncomeAmt", "CAST(g_{s} AS STRING)"),
        ("SubpartFIncomeAmt", "CAST(r_{s} AS STRING)"),
        ("HighTaxExceptionIncomeAmt", every(5, "'0'", "CAST(NULL AS STRING)")),
        ("GrossIncomeLessTotIncmExclAmt", "CAST(g_{s} - r_{s} AS STRING)"),
        ("AllocableDeductionAmt", "CAST(d_{s} AS STRING)"),
        ("TestedIncomeLossGrp_FunctionalCurrencyAmt",
         tuple(every(46, f"CAST({v} AS STRING)", "CAST(NULL AS STRING)") for v in (tested_p, tested_c))),
        ("TestedIncomeLossGrp_USDollarAmt",
         tuple(every(46, "'0'", f"CAST({v} AS STRING)") for v in (tested_p, tested_c))),
        ("TestedForeignIncomeTaxesGrp_USDollarAmt", "CAST(t_{s} AS STRING)"),
        ("QBAIAmt", f"CAST({every(44, 'q_{s} * 100000', 'q_{s} * 100')} AS STRING)"),
        ("InterestExpenseAmt", f"CAST({every(43, 'g_{s} * 2', 'd_{s}')} AS STRING)"),
    ])
    for instance, basket in enumerate(("GEN", "PAS", "TOTAL"), 1):
        def amt(letter: str, b: str = basket) -> str:
            x = f"{letter}_{{s}}"
            return {"GEN": x, "PAS": _half(x), "TOTAL": f"{x} + {_half(x)}"}[b]

        conds = {"GEN": ("", ""), "PAS": ("k % 2 = 0", "k % 2 = 0 AND k % 24 <> 0"), "TOTAL": ("k % 2 = 0", "k % 2 = 0")}
        rows: list[tuple[str, str]] = [
            ("", f"'J{instance}'"),
            ("ForeignCorporationName_BusinessNameLine1Txt", "name_{s}"),
            ("SeparateCategoryCd", f"'{basket}'"),
        ]
        for pool, letter in POOL_LETTER.items():
            rows.append((f"{pool}_{D.J_BOY}", f"CAST({amt('b' + letter)} AS STRING)"))
            if letter == "a":
                rows.append((f"{pool}_{D.J_CYEP}", f"CAST({amt('jcy')} AS STRING)"))
                if basket == "TOTAL":
                    rows.append((f"{pool}_{D.J_CYDEF}", f"CAST(-(ep_{{s}}) + {every(25, '700')} AS STRING)"))
            rows.append((f"{pool}_{D.J_EOY}", f"CAST({amt('e' + letter)} AS STRING)"))
        for path, text in rows:
            p, c = _both(text)
            cp, cc = conds[basket]
            out.append(FactSpec(D.SCH_J, path, _only(cp, p) if cp else p, _only(cc, c) if cc else c, instance, basket))
    return out


FACT_SPECS: list[FactSpec] = _fact_specs()
FORMS = tuple(dict.fromkeys(f.form for f in FACT_SPECS))


# --- Spark side ------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and pair of order years with the amounts of both, stored once."""
    return stored_table(spark, sf_dir, "customers", lambda: build_customers(spark, sf_dir))


def facts(spark: SparkSession, sf_dir: str, *years: int, forms: Collection[str] | None = None) -> DataFrame:
    """The stored facts table of both tax years and all forms, or of the given ones.

    A year and form is derived and stored when it is first asked for."""
    def build(side: str, form: str) -> Callable[[], DataFrame]:
        return lambda: build_facts(customers(spark, sf_dir), side, form).drop(*FACT_PARTITIONS)

    parts = {f"tax_year={year}/form={form}": build(side, form) for side, year in SIDES.items() for form in FORMS
             if (not years or year in years) and (forms is None or form in forms)}
    df = stored_partitions(spark, sf_dir, "facts", parts).select(*FACT_COLUMNS)
    return df.where(F.col("tax_year").isin(*years)) if years else df


_GROUP = "concat(seg, '_', CAST(pair AS STRING))"


def _year_sides(years: DataFrame) -> DataFrame:
    """Each order year as the sides it plays: ``pair`` (first year), ``y``, ``side``.
    One row per calendar year and side, so the frame is small at any size."""
    first = years.select(F.col("y").alias("pair")).join(years.select((F.col("y") - 1).alias("pair")), "pair")
    if FIRST_YEARS is not None:
        first = first.where(F.col("pair").isin(*FIRST_YEARS))
    return first.selectExpr("pair", "inline(array(struct(pair AS y, 'p' AS side), struct(pair + 1 AS y, 'c' AS side)))")


def build_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"))
    o = o.join(F.broadcast(_year_sides(o.select("y").distinct())), "y").drop("y")

    def cents(c: str) -> Column:
        return F.round(F.col(c) * 100).cast("bigint")

    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), cents("l_extendedprice").alias("pc"),
        cents("l_discount").alias("dc"), cents("l_tax").alias("tc"),
        F.col("l_quantity").cast("bigint").alias("qty"), (F.col("l_returnflag") == "R").alias("ret"),
    )
    sums = []
    for s in SIDES:
        def total(x: Column, side: str = s) -> Column:
            return F.coalesce(F.sum(F.when(F.col("side") == side, x)), F.lit(0)).cast("bigint")

        sums += [
            total(F.lit(1)).alias(f"n_{s}"),
            total(F.col("pc")).alias(f"g_{s}"),
            total(F.when(F.col("ret"), F.col("pc"))).alias(f"r_{s}"),
            total(F.col("pc") * F.col("dc")).alias(f"d_{s}"),
            total(F.col("pc") * F.col("tc")).alias(f"t_{s}"),
            total(F.col("qty")).alias(f"q_{s}"),
        ]
    per_k = li.join(o, "o_orderkey").groupBy("k", "pair").agg(*sums)
    scale = {"g": 100, "r": 100, "d": 10000, "t": 10000}
    per_k = per_k.withColumns({
        f"{n}_{s}": F.floor(F.col(f"{n}_{s}") / v).cast("bigint") for n, v in scale.items() for s in SIDES
    })
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("cname"), F.col("c_mktsegment").alias("seg"),
        F.col("c_nationkey").alias("nat"),
    )
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nat"), F.col("n_regionkey").alias("region"))
    out = per_k.join(cust, "k").join(nation, "nat").withColumn("seg", F.expr(_GROUP))
    for layer in LAYERS:
        out = out.selectExpr("*", *[f"{e} AS {n}" for n, e in layer])
    return out


def build_facts(base: DataFrame, side: str, form: str) -> DataFrame:
    """Long facts of one year and form: one narrow generate step.

    Only the values are made per entity; the rest of a fact is looked up by its
    place.  An array of whole facts is one method too long for the JVM to compile."""
    specs = [(i, f) for i, f in enumerate(FACT_SPECS) if f.form == form and getattr(f, side) is not None]
    values = ", ".join(f"CAST({getattr(f, side)} AS STRING)" for _, f in specs)
    items = ", ".join(f"struct({f.instance} AS instance, '{f.basket}' AS basket, '{f.full_path}' AS path, {i} AS ordinal)" for i, f in specs)
    rows = base.where(F.col(f"n_{side}") > 0).selectExpr(
        "seg AS return_id", "k AS sub_no", "code AS entity_code", f"name_{side} AS entity_name", f"array({values}) AS texts")
    # the outer form keeps the optimizer from making the array again to see that it has elements
    rows = rows.selectExpr("return_id", "sub_no", "entity_code", "entity_name", "posexplode_outer(texts) AS (at, value)").where("value IS NOT NULL")
    return rows.withColumn("item", F.expr(f"get(array({items}), at)")).selectExpr(
        "return_id", f"{SIDES[side]} AS tax_year", "sub_no", "entity_code", "entity_name", f"'{form}' AS form", "item.instance", "'' AS document_id",
        "item.basket", "item.path", "item.ordinal", "value", "value = '' AS is_blank").select(*FACT_COLUMNS)


# --- the same input as SQL text for checks ---------------------------------


def sql_customers() -> str:
    """CTE list ending in ``cust``; readable by any ANSI engine."""
    sums = []
    for s in SIDES:
        def total(x: str, side: str = s) -> str:
            return f"CAST(COALESCE(SUM(CASE WHEN side = '{side}' THEN {x} END), 0) AS BIGINT)"

        sums += [f"{total('1')} AS n_{s}", f"{total('pc')} AS g_{s}",
                 f"{total('CASE WHEN ret THEN pc END')} AS r_{s}", f"{total('pc * dc')} AS d_{s}",
                 f"{total('pc * tc')} AS t_{s}", f"{total('qty')} AS q_{s}"]
    year = "CAST(EXTRACT(year FROM o_orderdate) AS INT)"
    ctes = [
        f"years AS (SELECT DISTINCT {year} AS y FROM orders)",
        "sides AS (SELECT y AS pair, y, 'p' AS side FROM years WHERE y + 1 IN (SELECT y FROM years) UNION ALL"
        " SELECT y - 1, y, 'c' FROM years WHERE y - 1 IN (SELECT y FROM years))",
        "li AS (SELECT o_custkey AS k, pair, side,"
        " CAST(round(l_extendedprice * 100) AS BIGINT) AS pc, CAST(round(l_discount * 100) AS BIGINT) AS dc,"
        " CAST(round(l_tax * 100) AS BIGINT) AS tc, CAST(l_quantity AS BIGINT) AS qty, l_returnflag = 'R' AS ret"
        f" FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN sides ON sides.y = {year})",
        f"sums AS (SELECT k, pair, {', '.join(sums)} FROM li GROUP BY k, pair)",
        "cust0 AS (SELECT k, c_name AS cname, concat(c_mktsegment, '_', CAST(pair AS STRING)) AS seg, c_nationkey AS nat, n_regionkey AS region, "
        + ", ".join(f"n_{s}, q_{s}, " + ", ".join(
            f"CAST(floor({n}_{s} / {v}) AS BIGINT) AS {n}_{s}"
            for n, v in (("g", 100), ("r", 100), ("d", 10000), ("t", 10000))) for s in SIDES)
        + " FROM sums JOIN customer ON c_custkey = k JOIN nation ON n_nationkey = c_nationkey)",
    ]
    for i, layer in enumerate(LAYERS):
        name = "cust" if i == len(LAYERS) - 1 else f"cust{i + 1}"
        ctes.append(f"{name} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in layer) + f" FROM cust{i})")
    return ",\n".join(ctes)


def sql_facts(forms: list[str] | None = None, name: str = "facts", markers: bool = False) -> str:
    """CTE ``facts(seg, k, code, side, name, form, instance, basket, path, ordinal, value)``."""
    parts = []
    for side in SIDES:
        items = []
        for i, f in enumerate(FACT_SPECS):
            text = getattr(f, side)
            if text is None or (forms is not None and f.form not in forms) or (not f.path and not markers):
                continue
            items.append(f"{{'form': '{f.form}', 'instance': {f.instance}, 'basket': '{f.basket}',"
                         f" 'path': '{f.full_path}', 'ordinal': {i}, 'value': CAST({text} AS VARCHAR)}}")
        parts.append(f"SELECT seg, k, code, '{side}' AS side, name_{side} AS name,"
                     f" unnest([{', '.join(items)}], recursive := true) FROM cust WHERE n_{side} > 0")
    return f"{name} AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL)"
