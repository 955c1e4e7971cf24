"""All queries outside the optional subpackages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnstat.plans import analysis_queries, general, marker_queries

_PARTS = (general, marker_queries, analysis_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["score_markers"](spark, d)
