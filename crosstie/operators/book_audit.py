"""Audit of workbook amounts: signs by line family, look-up targets that lead
nowhere, and amounts against an export that carries the other sign."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstie import workbook_dims as W
from crosstie.session import broadcast_if_small, shared_dir
from crosstie.sources import grid

#: expected sign of a line; a line without a rule takes that of the next total below it that has one
SIGN_RULES = {
    "sch_c_fc": {"ForeignReturnsAndAllowancesAmt": -1, "ForeignTotalIncomeAmt": 1, "ForeignTotalDeductionsAmt": -1},
    "sch_h_fc": {"TotalNetAdditionsAmt": 1},
}
ELIMINATION = "ELIM"


def sign_families(rules: dict[str, dict[str, int]] | None = None) -> list[tuple[str, str, int, str]]:
    """(schedule, field, expected sign, field whose rule it is) of every line with an own or inherited rule."""
    out = []
    for schedule, signs in (rules or SIGN_RULES).items():
        heir = None
        for _, _, field in reversed(W.MATRIX_LAYOUTS[schedule].lines):
            if field in signs:
                out.append((schedule, field, signs[field], field))
                heir = field if "Total" in field else heir
            elif "Total" in field:
                heir = None  # a total without a rule ends the family
            elif heir is not None:
                out.append((schedule, field, signs[heir], heir))
    return out


def sign_convention(cells: DataFrame, rules: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Amounts whose sign is not that of their line family, with their place on the sheet.

    Zero, blank and non-numeric cells have no sign.  ``family`` is the line that
    states the rule: the line itself or the total it runs into.
    """
    families = sign_families(rules)
    dim = F.broadcast(cells.sparkSession.createDataFrame(families, "schedule string, field string, expected int, family string"))
    found = grid.matrix_positions(cells, list(rules or SIGN_RULES)).join(dim, ["schedule", "field"])
    return found.where(F.col("num") * F.col("expected") < 0).select(
        "workbook_id", "sheet", "row", "col", "entity_code", "line", "family", F.col("num").alias("amount"), "expected")


def pseudo_entities(lookups: DataFrame, registry: DataFrame) -> DataFrame:
    """Where each looked-up code ends: return_id, entity_code, resolved, steps, status.

    ``lookups`` holds return_id, entity_code, target; ``registry`` holds
    return_id, entity_code.  A code leads on to its target until one is
    registered or has no target.  ``status``: registered, elimination (the last
    code begins with ``ELIMINATION``), loop (no end, ``resolved`` null), else
    pseudo.  Of several targets of a code the smallest counts; a blank target is
    none.  Pointers double each round, so the rounds are the logarithm of the
    longest way, and those of a loop stop when more steps are taken than there
    are codes.
    """
    spark, root = lookups.sparkSession, shared_dir(lookups.sparkSession, "lookups")
    known = registry.select("return_id", "entity_code").where("entity_code <> ''").distinct()
    link = lookups.where("entity_code <> ''").groupBy("return_id", "entity_code").agg(F.min(F.nullif(F.trim("target"), F.lit(""))).alias("target"))
    link = link.join(known.withColumn("known", F.lit(True)), ["return_id", "entity_code"], "left")
    # a registered code is an end, and so is one that leads nowhere
    link = link.select("return_id", "entity_code", F.when(F.col("known").isNull(), F.col("target")).alias("target"))
    link.withColumn("steps", F.when(F.col("target").isNotNull(), 1).otherwise(0).cast("long")).withColumn(
        "target", F.coalesce("target", "entity_code")).write.parquet(f"{root}/0")
    start = at = spark.read.parquet(f"{root}/0")
    n_codes, n = start.count(), 0
    while True:
        up = at.where("steps > 0").select("return_id", F.col("entity_code").alias("target"), F.col("target").alias("next"), F.col("steps").alias("more"))
        moved = at.where("steps > 0").join(up, ["return_id", "target"])
        if moved.isEmpty() or 2**n > n_codes:
            break
        n += 1
        at.join(up, ["return_id", "target"], "left").select(
            "return_id", "entity_code", F.coalesce("next", "target").alias("target"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")).write.parquet(f"{root}/{n}")
        at = spark.read.parquet(f"{root}/{n}")
    going = start.where("steps > 0").select("return_id", F.col("entity_code").alias("target"), F.lit(True).alias("going"))
    ends = known.select("return_id", F.col("entity_code").alias("target"), F.lit(True).alias("is_known"))
    status = F.when(F.col("going"), "loop").when(F.col("is_known"), "registered").when(F.startswith("target", F.lit(ELIMINATION)), "elimination").otherwise("pseudo")
    return at.join(going, ["return_id", "target"], "left").join(ends, ["return_id", "target"], "left").select(
        "return_id", "entity_code", F.when(F.col("going").isNull(), F.col("target")).alias("resolved"),
        F.when(F.col("going").isNull(), F.col("steps")).alias("steps"), status.alias("status"))


def crosscheck(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float = 1.0) -> DataFrame:
    """One-to-one pairs of amounts that agree but for the sign.

    Both sides hold the keys, ``ref`` and ``amount``.  Amounts pair inside a key
    when left + right is at most ``tolerance`` away from zero: each round pairs
    the amounts that are nearest to each other (the smaller of equally near
    ones), until none is left.  Equal amounts are one value with a count and
    are dealt by ``ref`` afterwards, so repeated amounts never meet all with
    all; values meet by bands of the tolerance.  Zero and null amounts check
    nothing and are left out.  Returns keys, ref, amount, other_ref,
    other_amount, status: exact, near, left_only or right_only.
    """
    if tolerance <= 0:
        raise ValueError("the tolerance must be above zero")
    keys = list(keys)
    spark, root = left.sparkSession, shared_dir(left.sparkSession, "crosscheck")

    def side(df: DataFrame, name: str, sign: int) -> DataFrame:
        rows = df.where("amount <> 0").select(*keys, "ref", (F.col("amount") * sign).alias("v"))
        rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "v").orderBy("ref"))).write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    a_rows, b_rows = side(left, "left", 1), side(right, "right", -1)

    def values(rows: DataFrame, k: str) -> DataFrame:
        return rows.groupBy(*keys, F.col("v").alias(k)).agg(F.count(F.lit(1)).alias(f"n{k}")).withColumn(f"used{k}", F.lit(0).cast("long"))

    a, b = values(a_rows, "a"), values(b_rows, "b")
    band = tolerance
    done: list[str] = []
    while True:
        wide = b.withColumn("band", F.explode(F.expr(f"transform(array(-1, 0, 1), x -> floor(b / {band}D) + x)")))
        near = a.withColumn("band", F.floor(F.col("a") / band)).join(wide, [*keys, "band"]).withColumn("gap", F.abs(F.col("a") - F.col("b"))).where(
            F.col("gap") <= tolerance + 1e-9)
        path = f"{root}/round={len(done)}"
        to_b = Window.partitionBy(*keys, "a").orderBy("gap", "b")
        to_a = Window.partitionBy(*keys, "b").orderBy("gap", "a")
        near = near.withColumn("pa", F.row_number().over(to_b)).withColumn("pb", F.row_number().over(to_a)).where("pa = 1 AND pb = 1")
        near.select(*keys, "a", "b", "useda", "usedb", F.least("na", "nb").alias("q")).write.parquet(path)
        got = spark.read.parquet(path)
        if got.isEmpty():
            break
        done.append(path)

        def rest(v: DataFrame, k: str) -> DataFrame:
            took = v.join(broadcast_if_small(got.select(*keys, k, "q")), [*keys, k], "left").withColumn("q", F.coalesce("q", F.lit(0)))
            out = f"{root}/{k}-{len(done)}"
            took.select(*keys, k, (F.col(f"n{k}") - F.col("q")).alias(f"n{k}"), (F.col(f"used{k}") + F.col("q")).alias(f"used{k}")).where(f"n{k} > 0").write.parquet(out)
            return spark.read.parquet(out)

        a, b = rest(a, "a"), rest(b, "b")

    if not done:
        found = got.drop("round")
    else:
        found = spark.read.parquet(*done)
    one = a_rows.withColumnRenamed("v", "a").join(found, [*keys, "a"]).where("n > useda AND n <= useda + q").select(
        *keys, "ref", "a", "b", (F.col("n") - F.col("useda")).alias("i"))
    two = b_rows.withColumnRenamed("v", "b").join(found, [*keys, "b"]).where("n > usedb AND n <= usedb + q").select(
        *keys, F.col("ref").alias("other_ref"), "a", "b", (F.col("n") - F.col("usedb")).alias("i"))
    paired = one.join(two, [*keys, "a", "b", "i"]).select(
        *keys, "ref", F.col("a").alias("amount"), "other_ref", (-F.col("b")).alias("other_amount"),
        F.when(F.abs(F.col("a") - F.col("b")) < 1e-9, "exact").otherwise("near").alias("status"))
    # of a value, those of the highest numbers are left
    a_rest = a_rows.withColumnRenamed("v", "a").join(a, [*keys, "a"]).where("n > useda").select(
        *keys, "ref", F.col("a").alias("amount"), F.lit(None).cast("string").alias("other_ref"), F.lit(None).cast("double").alias("other_amount"), F.lit("left_only").alias("status"))
    b_rest = b_rows.withColumnRenamed("v", "b").join(b, [*keys, "b"]).where("n > usedb").select(
        *keys, F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount"), F.col("ref").alias("other_ref"), (-F.col("b")).alias("other_amount"),
        F.lit("right_only").alias("status"))
    return paired.union(a_rest).union(b_rest)
