"""The registry of catalog.py with the queries of the other modules that use it."""

from topicloom.plans import corpus_queries, model_queries  # noqa: F401  (they register their queries)
from topicloom.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
