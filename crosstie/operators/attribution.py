"""Checks along the ownership graph of each return, read from its facts.

Schedule G names the direct holders of an entity, one instance each.  From these
edges come the indirect shares (``ownership.chains``); amounts of the entities
are attributed to the shareholders by them, or handed up tier by tier, and held
against what the shareholder's own forms report.

Everything is keyed by return and year.  Levels are visited from the bottom, one
written round each, so the rounds are the tiers of the deepest return.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie.operators import ownership as O
from crosstie.session import shared_dir

KEYS = ("return_id", "tax_year")

#: Schedule G of an entity: one instance per direct holder
OWNER, OWNER_SHARE, OWNER_US, IS_CFC = (f"{D.SCH_G}_{t}" for t in (
    "OwnerReferenceIdNum", "OwnerDirectOwnershipPct", "OwnerUSShareholderInd", "ControlledForeignCorporationInd"))
TESTED_INCOME, QBAI = (f"{D.SCH_I1}_{t}" for t in ("TestedIncomeLossGrp_USDollarAmt", "QBAIAmt"))
TAX = f"{D.SCH_E}_TotalTaxInUSDollarsAmt"
PTEP_OPENING, PTEP_PAID, PTEP_RECEIVED = (f"{D.SCH_P}_{t}" for t in ("BeginningBalanceAmt", "DistributionsMadeAmt", "DistributionsReceivedAmt"))
FORM_8992, FORM_8993, FORM_1118 = "IRS8992", "IRS8993", "IRS1118"
#: the holder of what no listed holder has
OUTSIDE = ""


@dataclass(frozen=True)
class RollUp:
    check_id: str
    severity: str
    form: str
    path: str  # amount of the entity
    reported: str  # line of the shareholder's form
    positive: bool = False  # losses are reported elsewhere
    by_basket: bool = False


#: fixed values: the form lines that sums over controlled entities must meet
ROLL_UPS = {
    c.check_id: c for c in (
        RollUp("AGG-001", "HIGH", D.SCH_I1, TESTED_INCOME, f"{FORM_8992}_TestedIncomeAmt", positive=True),
        RollUp("AGG-002", "HIGH", D.SCH_E, TAX, f"{FORM_8992}_TestedForeignIncomeTaxesAmt"),
        RollUp("AGG-005", "MEDIUM", D.SCH_I1, QBAI, f"{FORM_8992}_QBAIAmt"),
        RollUp("AGG-006", "MEDIUM", D.SCH_E, TAX, f"{FORM_1118}_ForeignTaxesAmt", by_basket=True),
    )
}


def _of_year(facts: DataFrame, year: int) -> DataFrame:
    return facts.where(F.col("tax_year") == year)


def _value(path: str, number: bool = True) -> Column:
    text = F.when(F.col("path") == path, F.nullif("value", F.lit("")))
    return F.max(text.try_cast("double") if number else text)


def edges(facts: DataFrame, year: int) -> DataFrame:
    """Direct holdings of every return: keys, owner, owned, share, is_us."""
    rows = _of_year(facts, year).where((F.col("form") == D.SCH_G) & F.col("path").isin(OWNER, OWNER_SHARE, OWNER_US))
    found = rows.groupBy(*KEYS, F.col("entity_code").alias("owned"), "instance").agg(
        _value(OWNER, number=False).alias("owner"), _value(OWNER_SHARE).alias("share"), _value(OWNER_US, number=False).alias("us"))
    return found.where("owner IS NOT NULL AND share > 0").select(*KEYS, "owner", "owned", "share", F.coalesce(F.col("us") == "X", F.lit(False)).alias("is_us"))


def shareholders(edges: DataFrame) -> DataFrame:
    return edges.where("is_us").select(*KEYS, "owner").distinct()


@dataclass
class Graph:
    """Holdings of all returns of a year, indirect ones too, and who is controlled."""

    edges: DataFrame
    holdings: DataFrame
    control: DataFrame


def graph(facts: DataFrame, year: int) -> Graph:
    direct = edges(facts, year)
    root = shared_dir(facts.sparkSession, "holdings")
    direct.write.parquet(f"{root}/edges")
    direct = facts.sparkSession.read.parquet(f"{root}/edges")
    O.chains(direct, KEYS).write.parquet(f"{root}/chains")
    holdings = facts.sparkSession.read.parquet(f"{root}/chains")
    return Graph(direct, holdings, O.control(holdings, shareholders(direct), KEYS))


def roll_up(facts: DataFrame, year: int, check: RollUp, of: Graph | None = None, tolerance: float = 1.0) -> DataFrame:
    """Amounts of the controlled entities by the shareholders' shares against the shareholders' forms.

    One row per return and shareholder (and basket): ``expected`` is the sum over
    all tiers of share times amount, each way down counted once; entities that
    file no amount count as zero.  A shareholder whose form lacks the line has a
    null ``reported`` and fails unless nothing is expected.
    """
    of = of or graph(facts, year)
    group = [*KEYS, "owner", *(["basket"] if check.by_basket else [])]
    amount = F.col("value").try_cast("double")
    rows = _of_year(facts, year)
    own = rows.where((F.col("form") == check.form) & (F.col("path") == check.path)).select(
        *KEYS, F.col("entity_code").alias("owned"), "basket", (F.greatest(amount, F.lit(0.0)) if check.positive else amount).alias("amount"))
    own = own.groupBy(*KEYS, "owned", *(["basket"] if check.by_basket else [])).agg(F.sum("amount").alias("amount"))
    held = of.holdings.join(shareholders(of.edges), [*KEYS, "owner"], "left_semi").join(
        of.control.where("is_controlled"), [*KEYS, "owned"], "left_semi")
    sums = held.join(own, [*KEYS, "owned"]).groupBy(*group).agg(F.sum(F.col("share") * F.col("amount")).alias("expected"))
    filed = rows.where(F.col("path") == check.reported).select(*KEYS, F.col("entity_code").alias("owner"), "basket", amount.alias("amount"))
    filed = filed.groupBy(*group).agg(F.sum("amount").alias("reported"))
    who = shareholders(of.edges)
    both = sums.join(filed, group, "full_outer") if check.by_basket else who.join(sums, group, "left").join(filed, group, "left")
    expected = F.round(F.coalesce("expected", F.lit(0.0)), 2)
    gap = F.coalesce("reported", F.lit(0.0)) - expected
    return both.select(
        *group, F.lit(check.check_id).alias("check_id"), F.lit(check.severity).alias("severity"), expected.alias("expected"), "reported",
        F.round(gap, 2).alias("difference"), (F.abs(gap) <= tolerance).alias("passes"))


def cfc_findings(facts: DataFrame, year: int, of: Graph | None = None) -> DataFrame:
    """AGG-003: controlled but not filed as such; AGG-004: files Schedule I-1 without being controlled.

    An entity whose holders Schedule G does not name counts as held by nobody.
    """
    of = of or graph(facts, year)
    rows = _of_year(facts, year).where(F.col("form").isin(D.SCH_G, D.SCH_I1))
    filed = rows.groupBy(*KEYS, F.col("entity_code").alias("owned")).agg(
        F.max(F.expr(f"path = '{IS_CFC}' AND value IN ('X', '1', 'true')")).alias("says_cfc"),
        F.max(F.col("form") == D.SCH_I1).alias("has_i1"))
    both = filed.join(of.control, [*KEYS, "owned"], "left").withColumn("held", F.coalesce("held", F.lit(0.0))).withColumn(
        "is_controlled", F.coalesce("is_controlled", F.lit(False)))
    check = F.when(F.col("is_controlled") & ~F.col("says_cfc"), "AGG-003").when(~F.col("is_controlled") & F.col("has_i1"), "AGG-004")
    return both.select(*KEYS, F.col("owned").alias("entity_code"), check.alias("check_id"), F.lit("HIGH").alias("severity"),
                       F.round("held", 9).alias("held")).where("check_id IS NOT NULL")


def _turning(of: Graph) -> DataFrame:
    """Entities that hold themselves through others."""
    a = of.holdings.select(*KEYS, F.col("owner").alias("code"), F.col("owned").alias("other"))
    b = of.holdings.select(*KEYS, F.col("owned").alias("code"), F.col("owner").alias("other"))
    return a.join(b, [*KEYS, "code", "other"]).select(*KEYS, "code").distinct().withColumn("turns", F.lit(True))


def _levels(of: Graph, amounts: DataFrame) -> tuple[DataFrame, int]:
    """Entities with the longest way to the bottom (null above a cycle), and the largest of these."""
    codes = of.edges.select(*KEYS, F.col("owned").alias("code")).union(of.edges.select(*KEYS, "owner")).union(amounts.select(*KEYS, "code")).distinct()
    up = of.holdings.groupBy(*KEYS, F.col("owner").alias("code")).agg(
        F.when(F.count("last_tier") == F.count(F.lit(1)), F.max("last_tier")).alias("longest"), F.lit(True).alias("holds"))
    turning = _turning(of)
    found = codes.join(up, [*KEYS, "code"], "left").join(turning, [*KEYS, "code"], "left")
    level = F.when(F.col("turns").isNull(), F.when(F.col("holds").isNull(), F.lit(0)).otherwise(F.col("longest")))
    found = found.select(*KEYS, "code", level.cast("long").alias("level")).join(amounts, [*KEYS, "code"], "left")
    path = f"{shared_dir(codes.sparkSession, 'levels')}/entities"
    found.write.parquet(path)
    found = codes.sparkSession.read.parquet(path)
    return found, found.agg(F.max("level")).first()[0] or 0


def _amounts(facts: DataFrame, year: int, **paths: str) -> DataFrame:
    rows = _of_year(facts, year).where(F.col("path").isin(*paths.values()))
    amount = F.col("value").try_cast("double")
    return rows.groupBy(*KEYS, F.col("entity_code").alias("code")).agg(*(F.sum(F.when(F.col("path") == p, amount)).alias(n) for n, p in paths.items()))


def ptep_flow(facts: DataFrame, year: int, of: Graph | None = None, tolerance: float = 1.0) -> DataFrame:
    """AGG-008: distributions of each tier against what the tier above reports.

    From the bottom up, an entity has its opening balance and its shares of what
    flows out of the entities it holds; what flows out of it is its distribution
    as far as that covers it, the rest is ``overdrawn`` and carried no further.
    One row per entity that holds others: ``expected`` receipts, those
    ``reported``, and the difference.  Above a cycle nothing is expected and
    ``passes`` is null.
    """
    of = of or graph(facts, year)
    entities, top = _levels(of, _amounts(facts, year, opening=PTEP_OPENING, paid=PTEP_PAID, reported=PTEP_RECEIVED))
    root, spark = shared_dir(facts.sparkSession, "ptep-flow"), facts.sparkSession
    paths: list[str] = []
    for level in range(top + 1):
        here = entities.where(F.col("level") == level)
        if paths:
            below = spark.read.parquet(*paths).select(*KEYS, F.col("code").alias("owned"), "flow")
            got = of.edges.join(below, [*KEYS, "owned"]).groupBy(*KEYS, F.col("owner").alias("code")).agg(F.sum(F.col("share") * F.col("flow")).alias("expected"))
            here = here.join(got, [*KEYS, "code"], "left")
        else:
            here = here.withColumn("expected", F.lit(None).cast("double"))
        has = F.coalesce("opening", F.lit(0.0)) + F.coalesce("expected", F.lit(0.0))
        paid = F.coalesce("paid", F.lit(0.0))
        path = f"{root}/level-{level}"
        here.withColumn("flow", F.greatest(F.least(paid, has), F.lit(0.0))).withColumn("overdrawn", F.greatest(paid - has, F.lit(0.0))).write.parquet(path)
        paths.append(path)
    done = spark.read.parquet(*paths).unionByName(entities.where("level IS NULL"), allowMissingColumns=True)
    holders = of.edges.select(*KEYS, F.col("owner").alias("code")).distinct()
    gap = F.coalesce("reported", F.lit(0.0)) - F.col("expected")
    return done.join(holders, [*KEYS, "code"], "left_semi").select(
        *KEYS, F.col("code").alias("entity_code"), "level", F.round("expected", 2).alias("expected"), "reported", F.round(gap, 2).alias("difference"),
        F.round("overdrawn", 2).alias("overdrawn"), ((F.abs(gap) <= tolerance) & (F.col("overdrawn") <= tolerance)).alias("passes"))


def allocate_up(of: Graph, amounts: DataFrame) -> DataFrame:
    """Whole cents of every entity handed up to its holders, tier by tier.

    ``amounts`` holds the keys, code and ``cents``.  Each holder gets the whole
    cents of its share, and those left go one each to the largest remainders
    (equal ones by code), so what an entity hands up is what it has: the holder
    ``OUTSIDE`` stands for what Schedule G does not list.  Returns keys, owned,
    owner, cents.  Entities that hold themselves, and all above them, hand up
    nothing and get nothing here.
    """
    entities, top = _levels(of, amounts)
    root, spark = shared_dir(amounts.sparkSession, "allocation"), amounts.sparkSession
    listed = of.edges.groupBy(*KEYS, "owned", "owner").agg(F.sum("share").alias("share"))
    rest = listed.groupBy(*KEYS, "owned").agg((1 - F.sum("share")).alias("share")).where("share > 1e-12").select(*KEYS, "owned", F.lit(OUTSIDE).alias("owner"), "share")
    shares = listed.unionByName(rest)
    by_entity = Window.partitionBy(*KEYS, "owned")
    paths: list[str] = []
    for level in range(top + 1):
        here = entities.where(F.col("level") == level).select(*KEYS, F.col("code").alias("owned"), F.coalesce("cents", F.lit(0)).alias("cents"))
        if paths:
            got = spark.read.parquet(*paths).groupBy(*KEYS, F.col("owner").alias("owned")).agg(F.sum("cents").alias("more"))
            here = here.join(got, [*KEYS, "owned"], "left").select(*KEYS, "owned", (F.col("cents") + F.coalesce("more", F.lit(0))).alias("cents"))
        split = here.where("cents <> 0").join(shares, [*KEYS, "owned"]).withColumn("exact", F.col("cents") * F.col("share"))
        split = split.withColumn("floor", F.floor("exact")).withColumn("left", F.col("cents") - F.sum("floor").over(by_entity))
        place = F.row_number().over(by_entity.orderBy(F.desc(F.col("exact") - F.col("floor")), "owner"))
        given = (F.col("floor") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("long")
        path = f"{root}/level-{level}"
        split.withColumn("place", place).select(*KEYS, "owned", "owner", given.alias("cents")).write.parquet(path)
        paths.append(path)
    return spark.read.parquet(*paths)


def deemed_paid(facts: DataFrame, year: int, of: Graph | None = None) -> DataFrame:
    """AGG-007: taxes handed up to the shareholders against what their forms claim as deemed paid.

    One row per return and shareholder, in whole cents; ``passes`` within one cent.
    """
    of = of or graph(facts, year)
    own = _amounts(facts, year, tax=TAX).select(*KEYS, "code", F.round(F.col("tax") * 100).cast("long").alias("cents"))
    got = allocate_up(of, own).groupBy(*KEYS, "owner").agg(F.sum("cents").alias("allocated"))
    filed = _amounts(facts, year, claim=f"{FORM_1118}_DeemedPaidTaxesAmt").select(
        *KEYS, F.col("code").alias("owner"), F.round(F.col("claim") * 100).cast("long").alias("reported"))
    both = shareholders(of.edges).join(got, [*KEYS, "owner"], "left").join(filed, [*KEYS, "owner"], "left")
    allocated = F.coalesce("allocated", F.lit(0)).cast("long")
    gap = F.coalesce("reported", F.lit(0)).cast("long") - allocated
    return both.select(*KEYS, "owner", allocated.alias("allocated"), "reported", gap.alias("difference"), (F.abs(gap) <= 1).alias("passes"))


#: fixed values: totals of a return that need no graph (check, entity line, positive only, line of the return's form)
TOTALS = (
    ("8992 tested income", TESTED_INCOME, True, f"{FORM_8992}_TestedIncomeAmt", False),
    ("8993 eligible income", f"{D.SCH_I1}_GrossIncomeLessTotIncmExclAmt", False, f"{FORM_8993}_ForeignDerivedDeductionEligibleIncomeAmt", False),
    ("1118 taxes by basket", TAX, False, f"{FORM_1118}_ForeignTaxesAmt", True),
    ("951A inclusion", TESTED_INCOME, False, f"{FORM_8992}_GILTIAmt", False),
)


def cross_form_totals(facts: DataFrame, year: int, tolerance: float = 1.0) -> DataFrame:
    """Forms of the return against plain sums over its entities, all from one scan.

    One row per return, check and basket (only taxes have baskets); a total that
    one side alone has counts as zero on the other.
    """
    rows = [(c, p, basket, "own", pos) for c, p, pos, _, basket in TOTALS] + [(c, r, basket, "form", False) for c, _, _, r, basket in TOTALS]
    spark = facts.sparkSession
    wanted = F.broadcast(spark.createDataFrame(rows, "check string, path string, has_basket boolean, side string, positive boolean"))
    amount = F.coalesce(F.col("value").try_cast("double"), F.lit(0.0))
    found = _of_year(facts, year).where(F.col("path").isin(*{r[1] for r in rows})).join(wanted, "path").select(
        *KEYS, "check", F.when(F.col("has_basket"), F.col("basket")).otherwise("").alias("basket"), "side",
        F.when(F.col("positive"), F.greatest(amount, F.lit(0.0))).otherwise(amount).alias("amount"))
    sums = found.groupBy(*KEYS, "check", "basket").agg(
        *(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("amount"))), F.lit(0.0)).alias(n) for s, n in (("own", "entities"), ("form", "reported"))))
    gap = F.col("reported") - F.col("entities")
    return sums.select(*KEYS, "check", "basket", "entities", "reported", gap.alias("difference"), (F.abs(gap) <= tolerance).alias("passes"))
