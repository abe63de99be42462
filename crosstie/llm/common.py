"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstie.session import shared_dir

#: white space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return
SPACE = r"[\x20\x09-\x0D]+"

#: broadcast an index of at most this many rows; beyond it the same join is shuffled
BROADCAST_ROWS = 200_000


def ship(module: str) -> None:
    """Sends the functions of a module to the workers with each task, so that
    this package need not be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once per row and hands it to ``body``.

    A plain reference inside a higher-order function is evaluated again for
    every element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text in order (null text: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def line_words(line: Column) -> Column:
    """Words of a line.  A single blank as pattern is split without a regular
    expression; other white space inside a line is rare and takes the long way."""
    odd = line.contains("\t") | line.contains("\x0b") | line.contains("\x0c") | line.contains("\r")
    return F.array_remove(F.when(odd, F.split(line, SPACE)).otherwise(F.split(line, " ")), "")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Writes an intermediate result to the shared folder and reads it back, so
    that neither a lost executor nor a second use computes it again."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table of a known row count below the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
