"""Entity matrix: the numeric cells the rules read, one row per entity.

Rules name the cells they need; ``Matrix`` collects them and turns the facts of
both years into one row per (return, entity) with a single hash aggregation.
Cells are numbered by a small broadcast dimension that also filters the scan,
and values are parsed before they are aggregated, so the aggregate buffers are
fixed-width and the map side collapses an entity's facts before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie.functions.scalar import safe_float
from crosstie.session import salted_lookup

KEYS = ["return_id", "entity_code"]
SIDES = ("py", "cy")


@dataclass
class Matrix:
    """Collects (side, form, tag) cells while rules are being built; every
    method returns the SQL name under which the value can be used."""

    cells: dict[tuple[str, str, str], str] = field(default_factory=dict)
    flags: dict[tuple[str, str, str], str] = field(default_factory=dict)
    lets: dict[str, str] = field(default_factory=dict)

    def num(self, side: str, form: str, tag: str) -> str:
        """Number of a field, NULL when the entity has several rows of the form."""
        self.cells.setdefault((side, form, ""), f"{side}_{form}")
        return self.cells.setdefault((side, form, tag), f"{side}_{form}_{tag}")

    def has(self, side: str, form: str) -> str:
        """Whether the entity files the form at all."""
        return self.cells.setdefault((side, form, ""), f"{side}_{form}")

    def in_return(self, side: str, form: str, tag: str) -> str:
        """Whether any entity of the return carries the field."""
        name = self.flags.setdefault((side, form, tag), f"any_{side}_{form}_{tag}")
        return f"coalesce({name}, false)"

    def let(self, name: str, sql: str) -> str:
        """Names a derived value that several expressions use."""
        self.lets[name] = sql
        return name


def path_of(form: str, tag: str) -> str:
    return f"{form}_{tag}" if tag else form


def coded(facts: DataFrame) -> DataFrame:
    return facts.where(F.coalesce(F.col("entity_code"), F.lit("")) != "")


def first_instance(facts: DataFrame) -> DataFrame:
    """Forms filed once are read from their first occurrence."""
    return facts.where((F.col("instance") == 1) | F.col("form").isin(*D.MULTI_INSTANCE_FORMS))


def side_year(side: str, py: int | None, cy: int) -> int | None:
    return cy if side == "cy" else py


def _scan(facts: DataFrame, wanted: list[tuple[str, str, str]], py: int | None, cy: int) -> DataFrame:
    """Facts of the wanted (side, form, tag) only; years and forms prune partitions."""
    years = sorted({y for s, _, _ in wanted if (y := side_year(s, py, cy)) is not None})
    return facts.where(
        F.col("tax_year").isin(*years)
        & F.col("form").isin(*sorted({f for _, f, _ in wanted}))
        & F.col("path").isin(*sorted({path_of(f, t) for _, f, t in wanted}))
    )


def build_matrix(facts: DataFrame, matrix: Matrix, cy: int, py: int | None = None) -> DataFrame:
    spark = facts.sparkSession
    cells = [(i, k, name) for i, (k, name) in enumerate(matrix.cells.items())]
    dim = spark.createDataFrame(
        [(i, side_year(s, py, cy), form, path_of(form, tag)) for i, ((s, form, tag), _) in
         ((i, (k, n)) for i, k, n in cells) if side_year(s, py, cy) is not None],
        "cell int, tax_year int, form string, path string",
    )
    scan = first_instance(coded(_scan(facts, list(matrix.cells), py, cy)))
    # the dimension has at most a few hundred rows whatever the data
    rows = scan.join(F.broadcast(dim), ["tax_year", "form", "path"]).select(
        *KEYS, "cell",
        safe_float("value").alias("num"),
    )
    aggs, out = [], list(KEYS)
    for i, (side, form, tag), name in cells:
        mark = f"{side}_{form}"
        if tag:
            aggs.append(f"max(CASE WHEN cell = {i} THEN num END) AS {name}")
            out.append(f"CASE WHEN n_{mark} = 1 THEN {name} END AS {name}")
        else:
            # one marker row per filed form: a form filed twice reads as ambiguous
            aggs.append(f"count_if(cell = {i}) AS n_{name}")
            out.append(f"n_{name} > 0 AS {name}")
    wide = rows.groupBy(*KEYS).agg(*map(F.expr, aggs)).selectExpr(*out)
    if matrix.flags:
        wide = salted_lookup(wide, return_flags(facts, matrix, cy, py), ["return_id"], "entity_code")
    if matrix.lets:
        wide = wide.selectExpr("*", *[f"{sql} AS {name}" for name, sql in matrix.lets.items()])
    return wide


def return_flags(facts: DataFrame, matrix: Matrix, cy: int, py: int | None = None) -> DataFrame:
    """One row per return: which of the asked fields occur in it at all."""
    keys = [k for k in matrix.flags if side_year(k[0], py, cy) is not None]
    scan = _scan(facts, keys, py, cy)
    aggs = [
        F.expr(f"max(tax_year = {side_year(s, py, cy)} AND path = '{path_of(form, tag)}') AS {matrix.flags[s, form, tag]}")
        for s, form, tag in keys
    ]
    return scan.groupBy("return_id").agg(*aggs)


def entity_names(facts: DataFrame, cy: int, py: int | None = None) -> DataFrame:
    """First name of each code, current year before prior year."""
    years = [y for y in (py, cy) if y is not None]
    marks = coded(facts.where(F.col("tax_year").isin(*years) & (F.col("form") == D.MAIN) & (F.col("path") == D.MAIN)))
    rank = F.when(F.col("tax_year") == cy, F.lit(0)).otherwise(F.lit(1))
    return marks.groupBy(*KEYS).agg(
        F.min_by("entity_name", F.struct(rank, F.col("sub_no"))).alias("entity_name")
    )


def text_matrix(facts: DataFrame, tags: list[str], cy: int, py: int) -> DataFrame:
    """First text of main-form paths per entity and year, with presence flags.

    Columns are ``py_0, cy_0, py_1, ...`` in the order of ``tags``; the tag
    ``_entity_name`` reads the name the entity is filed under.
    """
    paths = [D.MAIN if t == "_entity_name" else t for t in tags]
    scan = first_instance(coded(facts.where(
        F.col("tax_year").isin(py, cy) & (F.col("form") == D.MAIN) & F.col("path").isin(D.MAIN, *paths))))
    aggs = []
    for side, year in (("py", py), ("cy", cy)):
        aggs.append(f"max(tax_year = {year} AND path = '{D.MAIN}') AS has_{side}")
        for i, (tag, path) in enumerate(zip(tags, paths)):
            value = "entity_name" if tag == "_entity_name" else "value"
            aggs.append(f"min_by({value}, CASE WHEN tax_year = {year} AND path = '{path}' THEN sub_no END) AS {side}_{i}")
    return scan.groupBy(*KEYS).agg(*map(F.expr, aggs))
