"""The pairs of features a pairwise operator runs over."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pairings(features: DataFrame, pairs=None, ordered: bool = False) -> DataFrame:
    """(gene1, gene2): a pool, a product of two sets, or an explicit table of pairs.

    ``pairs`` None pairs all features; a list of names is a pool; a tuple of
    two lists pairs the first set with the second; a DataFrame (gene1, gene2)
    is taken as it is, with pairs of a feature and itself. Unknown names are
    dropped. A pool or a product pairs no feature with itself. A pool gives each pair once, by feature_idx, or in both orders if
    ``ordered``. The output is what was asked for, so its size is quadratic in
    the pool: restrict the features first.
    """
    names = features.select("feature", "feature_idx")
    if isinstance(pairs, DataFrame):
        known = names.select("feature")
        return pairs.select("gene1", "gene2").join(known.withColumnRenamed("feature", "gene1"), "gene1", "left_semi").join(known.withColumnRenamed("feature", "gene2"), "gene2", "left_semi")
    if isinstance(pairs, tuple):
        left, right = (names.filter(F.col("feature").isin(list(p))) for p in pairs)
        on = F.col("l.feature") != F.col("r.feature")
    else:
        left = right = names if pairs is None else names.filter(F.col("feature").isin(list(pairs)))
        on = F.col("l.feature_idx") != F.col("r.feature_idx") if ordered else F.col("l.feature_idx") < F.col("r.feature_idx")
    return left.alias("l").join(right.alias("r"), on).select(F.col("l.feature").alias("gene1"), F.col("r.feature").alias("gene2"))
