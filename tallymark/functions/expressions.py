"""Two ways to say: compute this once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that later filters must not compute a second time.

    A filter on a projected column moves below the projection together with
    its expression; a generated column stays where it is.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))
