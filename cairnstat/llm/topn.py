"""The N best rows of every group, however large the groups are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.internal import InternalFunction


def heap(order: Column, n: int) -> Column:
    """Aggregate: the ``n`` smallest values of ``order``, kept in a bounded heap per group.

    The heaps are built before the shuffle and merged after it, so at most
    ``n`` values of a group leave each task.
    """
    return InternalFunction._invoke_internal_function_over_columns("collect_top_k", order, F.lit(n), F.lit(True))


def top_n(df: DataFrame, group: list[str], score: str, ties: list[str], n: int, payload: list[str] = ()) -> DataFrame:
    """The ``n`` rows of each group with the highest ``score``: group, score, ties, payload, ``place`` from 1.

    Equal scores: ascending order of ``ties`` (NULL first), which ends with a
    unique identifier; rows alike in all of these are settled on the payload.
    Rows whose score is NULL or NaN are left out; a group with only such rows
    does not appear. NULL in a group column is a group of its own. Groups with
    fewer rows come whole; an empty table gives an empty result. Exact repeats
    of a row are rows of their own. Only the named columns are read, and the
    result's own names win over clashing extra columns.
    """
    score_ = F.col(score).cast("double")
    kept = df.filter(score_.isNotNull() & ~F.isnan(score_))
    rest = [*ties, *payload]
    entry = F.struct((-score_).alias("s"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(rest)])
    best = kept.groupBy(*group).agg(heap(entry, n).alias("__best"))
    flat = best.select(*group, F.posexplode("__best").alias("__at", "__e"))
    return flat.select(
        *group, (-F.col("__e.s")).alias(score), *[F.col(f"__e.t{i}").alias(c) for i, c in enumerate(rest)], (F.col("__at") + 1).alias("place")
    )
