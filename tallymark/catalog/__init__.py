"""The registered queries. Importing a module registers what it holds."""

from tallymark.catalog import (  # noqa: F401
    answer_queries,
    metric_queries,
    plan_queries,
    program_queries,
    source_queries,
    text_queries,
)
from tallymark.catalog.inputs import Inputs
from tallymark.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "Inputs"]
