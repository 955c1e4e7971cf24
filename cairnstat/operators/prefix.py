"""Ranks and running totals within groups of any size.

A window over a whole group would put a group that holds a third of all rows
in one task. Here every group is cut into buckets; a window runs within a
(group, bucket) and an offset per bucket, from a small aggregate, is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnstat.session import parallelism

#: Rows of one group that one bucket takes on average.
BUCKET_ROWS = 200_000


def bucket_count(df: DataFrame, n_rows: int) -> int:
    """Buckets per group, so that a group with every row has tasks of about BUCKET_ROWS."""
    return max(parallelism(df.sparkSession), -(-n_rows // BUCKET_ROWS))


def running_total(
    df: DataFrame, group: list[str], key: str, value: Column, buckets: int, out: str, total: str | None = None
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before this row.

    The order within a group is that of a hash of ``key``, then ``key``: fixed,
    but without meaning. ``key`` is unique within its group. ``value`` is an
    integer and never NULL. ``total``, if named, receives the group's sum. NULL
    in a group column forms a group of its own. With ``value`` 1, ``out`` is a
    rank from 0.
    """
    cols = df.columns
    x = df.withColumn("__v", value.cast("bigint")).withColumn("__b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    sums = x.groupBy(*group, "__b").agg(F.sum("__v").alias("__s"))
    over = Window.partitionBy(*group)
    before = over.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col("__b").alias("__ob"),
        F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__off"),
        F.sum("__s").over(over).alias("__tot"),
    )
    inner = Window.partitionBy(*group, "__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = x.withColumn("__l", F.coalesce(F.sum("__v").over(inner), F.lit(0)))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    on = F.col("__b") == F.col("__ob")
    for c in same:
        on = on & c
    res = local.join(offsets, on).select(*cols, (F.col("__l") + F.col("__off")).alias(out), *([F.col("__tot").alias(total)] if total else []))
    return res
