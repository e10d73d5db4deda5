"""Imports every query module, so that the registry is full."""

from annalist.plans import bundling, columns, directories, documents, dossiers, ingesting, intervals, loading, paging, readmodels, resolving, streams, votepages  # noqa: F401
from annalist.plans.registry import REGISTRY, check_sql, spark_queries  # noqa: F401
