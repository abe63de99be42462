"""Stored inputs of the registered queries.

The engine works on stored tables (facts partitioned by year and form, workbook
cells, documents).  The registered queries derive those tables from the given
ones with Spark once per session and then read them back, so each query plan
starts from a pruned scan, and a lost executor only re-reads shared files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crosstie.session import shared_dir

#: stored tables are read a few times only, so their size counts more than the time to unpack them
PACKED = "zstd"

_PATHS: dict[tuple[str, str, str], str] = {}


def stored_path(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None], at: str | None = None) -> str:
    """Path of a derived input, written on first use in this application, to a new folder or ``at`` a given one."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _PATHS:
        path = at or shared_dir(spark, name)
        write(path)
        _PATHS[key] = path
    return _PATHS[key]


def stored_table(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame],
                 partition_by: list[str] | None = None) -> DataFrame:
    def write(path: str) -> None:
        writer = build().write.option("compression", PACKED)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)

    return spark.read.parquet(stored_path(spark, sf_dir, name, write))


def stored_partitions(spark: SparkSession, sf_dir: str, name: str, parts: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """A stored table of partition folders (``a=1/b=x``), each written when it is
    first asked for.  A folder holds one value of the partition columns, so the
    rows are written as they come, without a sort, and a query that needs few
    folders makes no others."""
    root = stored_path(spark, sf_dir, name, lambda path: None)

    def write(folder: str) -> Callable[[str], None]:
        return lambda path: parts[folder]().write.option("compression", PACKED).parquet(path)

    paths = [stored_path(spark, sf_dir, f"{name}/{folder}", write(folder), f"{root}/{folder}") for folder in parts]
    return spark.read.option("basePath", root).parquet(*paths)
