"""Every registered query with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import analytics, enrichment, governance, relational, retrieval, streams, temporal  # noqa: F401  they register
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused retrieval: two channels, fusion, deduplication and the ten best of each query."""
    return QUERIES["v13_fused_retrieval"](spark, sf_dir)
