"""Histories of entities over any number of years, and their trends.

An entity goes on under its code.  A code that begins anew takes up the history
of a code that has ended before under the same name, so an entity that is renamed
in one year and renumbered in another stays one history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstie.session import shared_dir

#: a change of more than this part of the amount before, per year, is a break
BREAK = 0.5


def histories(filings: DataFrame) -> DataFrame:
    """The history of every code: return_id, entity_code, history_id (its first code).

    ``filings`` holds return_id, tax_year, entity_code, entity_name, one row per
    entity and year or more.  A code takes up the code that ended last before its
    first year under its first name (case and outer blanks aside).  Of several
    that ended in one year, and of several that begin in one, the smallest is
    meant; a code is taken up once, by the earliest.  Blank names and codes join
    nothing.  Names are brought down to one row per year before they meet, so a
    name that many share costs no more than one that is rare.
    """
    name = F.upper(F.trim("entity_name"))
    named = filings.where("entity_code <> ''").withColumn("name", name)
    runs = named.groupBy("return_id", "entity_code").agg(
        F.min("tax_year").alias("first_year"), F.max("tax_year").alias("last_year"),
        F.min_by("name", F.struct("tax_year", "name")).alias("first_name"), F.max_by("name", F.struct("tax_year", "name")).alias("last_name"))
    spark, root = filings.sparkSession, shared_dir(filings.sparkSession, "histories")
    runs.write.parquet(f"{root}/runs")
    runs = spark.read.parquet(f"{root}/runs")
    ended = runs.where("last_name <> ''").groupBy("return_id", F.col("last_name").alias("name"), "last_year").agg(F.min("entity_code").alias("before"))
    begun = runs.where("first_name <> ''").groupBy("return_id", F.col("first_name").alias("name"), "first_year").agg(F.min("entity_code").alias("entity_code"))
    met = begun.join(ended, ["return_id", "name"]).where("last_year < first_year AND before <> entity_code")
    taken = met.groupBy("return_id", "entity_code", "first_year").agg(F.max_by("before", "last_year").alias("before"))
    taken = taken.groupBy("return_id", "before").agg(F.min_by("entity_code", F.struct("first_year", "entity_code")).alias("entity_code"))
    link = runs.select("return_id", "entity_code").join(taken, ["return_id", "entity_code"], "left").select(
        "return_id", "entity_code", F.coalesce("before", "entity_code").alias("history_id"))
    n = 0
    while True:  # pointers double, and years decrease along them
        path = f"{root}/links-{n}"
        link.write.parquet(path)
        link = spark.read.parquet(path)
        up = link.select("return_id", F.col("entity_code").alias("history_id"), F.col("history_id").alias("up"))
        if link.join(up, ["return_id", "history_id"]).where("up <> history_id").isEmpty():
            return link
        link = link.join(up, ["return_id", "history_id"]).select("return_id", "entity_code", F.col("up").alias("history_id"))
        n += 1


def trends(filings: DataFrame, links: DataFrame, least_years: int = 3, limit: float = BREAK) -> DataFrame:
    """Trend of ``amount`` over each history of at least ``least_years`` filed years.

    One row per history: its first and last year, the years filed and those
    ``missing`` between, the codes and names it went by, the slope per year over
    all filed years, ``breaks`` (years whose change per year since the last filed
    one exceeds ``limit`` of that one's size), ``turns`` (sign changes) and
    ``trend``: rising or falling if the last three years were filed without a gap
    and moved one way, else mixed.  Amounts that are no numbers leave the year
    unfiled; several rows of a code in one year are added.
    """
    per_year = filings.join(links, ["return_id", "entity_code"]).groupBy("return_id", "history_id", "tax_year").agg(
        F.sum("amount").alias("amount"), F.min("entity_code").alias("code"), F.min(F.upper(F.trim("entity_name"))).alias("name")).where("amount IS NOT NULL")
    w = Window.partitionBy("return_id", "history_id").orderBy("tax_year")
    step = per_year.withColumns({
        "last": F.lag("amount").over(w), "gap": F.col("tax_year") - F.lag("tax_year").over(w), "left": F.count(F.lit(1)).over(w.rowsBetween(1, Window.unboundedFollowing))})
    change = (F.col("amount") - F.col("last")) / F.col("gap")
    step = step.withColumn("is_break", F.abs(change) > limit * F.abs("last")).withColumn("turn", F.signum("amount") * F.signum("last") < 0)
    recent = (F.col("left") < 2) & (F.col("gap") == 1)
    out = step.groupBy("return_id", "history_id").agg(
        F.min("tax_year").alias("first_year"), F.max("tax_year").alias("last_year"), F.count(F.lit(1)).alias("n_years"),
        F.count_distinct("code").alias("n_codes"), F.count_distinct("name").alias("n_names"), F.round(F.regr_slope("amount", "tax_year"), 4).alias("slope"),
        F.count_if("is_break").alias("breaks"), F.count_if("turn").alias("turns"),
        F.count_if(recent & (F.col("amount") > F.col("last"))).alias("up"), F.count_if(recent & (F.col("amount") < F.col("last"))).alias("down"))
    trend = F.when(F.col("up") == 2, "rising").when(F.col("down") == 2, "falling").otherwise("mixed")
    return out.where(F.col("n_years") >= least_years).select(
        "return_id", "history_id", "first_year", "last_year", "n_years", (F.col("last_year") - F.col("first_year") + 1 - F.col("n_years")).cast("long").alias("missing"),
        "n_codes", "n_names", "slope", "breaks", "turns", trend.alias("trend"))


def filings_of(facts: DataFrame, path: str) -> DataFrame:
    """Filed amounts of one path: return_id, tax_year, entity_code, entity_name, amount."""
    return facts.where((F.col("path") == path) & (F.col("instance") == 1)).select(
        "return_id", "tax_year", "entity_code", "entity_name", F.col("value").try_cast("double").alias("amount"))
