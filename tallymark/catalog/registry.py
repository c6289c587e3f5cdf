"""Named queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tallymark.catalog.inputs import Inputs, with_ctes

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` may use the views of ``inputs``."""

    def keep(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = with_ctes(oracle)
        return build

    return keep
