"""The queries of the retrieval engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talus.plans import catalog, chunking, dialogue, evaluate, quality, sources, text, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (catalog, chunking, dialogue, evaluate, quality, sources, text, vectors):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
