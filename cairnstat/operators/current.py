"""The current row of each key in a table with repeats and superseded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def current_rows(df: DataFrame, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """One row (keys, values) per key: the values of its row with the largest ``version``.

    The shuffle is on the whole key, so a frequent leading column does not
    unbalance it. A NULL version counts as the earliest. Rows with the same key
    and version are settled on the greatest values (NULL lowest, NaN highest),
    so the outcome does not depend on row order. NULL keys form a key of their
    own. An empty table gives an empty result; other columns are dropped.
    """
    latest = F.max(F.struct(F.col(version).alias("v"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(values)]))
    out = df.groupBy(*keys).agg(latest.alias("__latest"))
    return out.select(*keys, *[F.col(f"__latest.c{i}").alias(c) for i, c in enumerate(values)])
