"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crosstie.plans import fixture as X

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, facts: list[str] | None = None, ctes: str = "") -> Callable[[Query], Query]:
    """Registers a query; its check runs over the customer amounts (``cust``),
    the facts of some forms (``facts``) and further common tables."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            parts = [X.sql_customers()]
            if facts is not None:
                parts.append(X.sql_facts(facts or None, markers=True))
            if ctes:
                parts.append(ctes)
            ORACLES[name] = f"WITH {', '.join(parts)}\n{oracle}"
        return fn

    return register


def plain(name: str, oracle: str) -> Callable[[Query], Query]:
    """Registers a query whose check reads the given tables only."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        ORACLES[name] = oracle
        return fn

    return register
