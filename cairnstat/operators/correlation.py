"""Rank correlations between features, with implicit zeros."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cairnstat.functions.testing import bh_large, stouffer_many, weighted_mean
from cairnstat.operators.linear import residuals
from cairnstat.operators.pairings import pairings
from cairnstat.operators.ranks import with_rho_p
from cairnstat.session import materialize
from cairnstat.sources.assays import Assay

#: Blocks with fewer observations are left out.
LEAST = 3


def standardized_ranks(assay: Assay) -> DataFrame:
    """(feature, block, obs, n, z, z0, ss): average ranks of the stored values, relative to the rank of a zero.

    With d the rank minus that of zero, sums over all observations only need
    the stored ones: the sum of (r - mean)^2 is sum d^2 - (sum d)^2 / n. ``z``
    is d, ``z0`` the sum of d, ``ss`` the centred sum of squares. Negative
    values rank below zero.
    """
    o = assay.observations.filter("block is not null").select("obs", "block")
    sizes = o.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    x = assay.values.filter("value <> 0").join(o, "obs").join(sizes, "block")
    per = Window.partitionBy("feature", "block")
    order = per.orderBy("value")
    neg = F.count_if(F.col("value") < 0).over(per)
    zeros = F.col("n") - F.count("*").over(per)
    place = F.rank().over(order) + (F.count("*").over(order.rangeBetween(0, 0)) - 1) / 2.0
    rank = place + F.when(F.col("value") > 0, zeros).otherwise(0)
    x = x.withColumn("d", rank - (neg + (zeros + 1) / 2.0))
    return x.select("feature", "block", "obs", "n", "d")


def spearman(assay: Assay, pairs=None, equal_weight: bool = True) -> DataFrame:
    """(gene1, gene2, rho, n, p_value, fdr): rank correlation of each pair over all observations, absent rows being zero.

    Products are summed over the observations where both features are stored,
    which the ranks relative to zero make enough. With blocks, rho is the mean
    over blocks (weighted by size unless ``equal_weight``) and one-sided
    p-values combine by z-scores in both directions. rho is NULL without rank
    variance. p-values use the t approximation.
    """
    d = standardized_ranks(assay)
    wanted = pairings(assay.features, pairs)
    used = wanted.select(F.explode(F.array("gene1", "gene2")).alias("feature")).distinct()
    d = materialize(d.join(used, "feature", "left_semi"))
    o = assay.observations.filter("block is not null").groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    blocks = o.collect()  # levels of a design factor
    sums = d.groupBy("feature", "block").agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"))
    # products over the observations where both are stored: an explicit table of pairs leads, a pool takes what each observation holds
    a, b = d.select(F.col("feature").alias("gene1"), "block", "obs", F.col("d").alias("d1")), d.select(F.col("feature").alias("gene2"), "block", "obs", F.col("d").alias("d2"))
    if isinstance(pairs, DataFrame):
        both = a.join(wanted.distinct(), "gene1").join(b, ["gene2", "block", "obs"])
    else:
        both = a.join(b, ["block", "obs"]).join(wanted, ["gene1", "gene2"], "left_semi")
    cross = both.groupBy("gene1", "gene2", "block").agg(F.sum(F.col("d1") * F.col("d2")).alias("c"))
    levels = F.array(*[F.struct(F.lit(r.block).alias("block"), F.lit(r.n).cast("bigint").alias("n")) for r in blocks]) if blocks else F.array().cast("array<struct<block:string,n:bigint>>")
    x = wanted.select("gene1", "gene2", F.explode(levels).alias("__l")).select("gene1", "gene2", "__l.block", "__l.n")
    x = x.join(cross, ["gene1", "gene2", "block"], "left")
    x = x.join(sums.select(F.col("feature").alias("gene1"), "block", F.col("s").alias("s1"), F.col("q").alias("q1")), ["gene1", "block"], "left")
    x = x.join(sums.select(F.col("feature").alias("gene2"), "block", F.col("s").alias("s2"), F.col("q").alias("q2")), ["gene2", "block"], "left")
    v1, v2 = F.col("q1") - F.col("s1") * F.col("s1") / F.col("n"), F.col("q2") - F.col("s2") * F.col("s2") / F.col("n")
    rho = (F.coalesce("c", F.lit(0.0)) - F.col("s1") * F.col("s2") / F.col("n")) / F.sqrt(v1 * v2)
    x = x.select("gene1", "gene2", "block", "n", F.when((v1 > 1e-9) & (v2 > 1e-9), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("rho"))
    x = with_rho_p(with_rho_p(x, "rho", F.col("n"), True, "up"), "rho", F.col("n"), False, "down")
    keys = ["gene1", "gene2"]
    w = F.lit(1.0) if equal_weight else F.col("n").cast("double")
    means = [weighted_mean(F.col("rho"), F.col("w")).alias("rho"), F.sum("n").alias("n")]
    both = stouffer_many(x.withColumn("w", w), {"up": "up", "down": "down"}, keys, "w", means)
    out = both.select(*keys, "rho", "n", F.when(F.col("rho").isNotNull(), F.least(F.lit(1.0), 2 * F.exp(F.least("up", "down")))).alias("p_value"))
    return bh_large(out, "p_value", "fdr")


def spearman_residuals(assay: Assay, design: DataFrame, columns: list[str], pairs=None) -> DataFrame:
    """As `spearman`, on the residuals of a linear model of every feature; all observations of the design are one block."""
    return spearman(residuals(assay, design, columns), pairs)


def per_feature(pairs: DataFrame) -> DataFrame:
    """(gene, rho, p_value, fdr) from pair correlations: Simes p, and the rho of the smallest p (largest in size on ties)."""
    both = pairs.select(F.explode(F.array("gene1", "gene2")).alias("gene"), "rho", "p_value").filter("p_value is not null")
    fam = Window.partitionBy("gene")
    r = both.withColumn("k", F.row_number().over(fam.orderBy("p_value"))).withColumn("m", F.count("*").over(fam))
    g = r.groupBy("gene").agg(F.least(F.lit(1.0), F.min(F.col("p_value") * F.col("m") / F.col("k"))).alias("p_value"), F.min_by("rho", F.struct("p_value", (-F.abs("rho")).alias("a"), "rho")).alias("rho"))
    return bh_large(g, "p_value", "fdr").select("gene", "rho", "p_value", "fdr")


def null_correlations(spark: SparkSession, n: int, iterations: int, seed: int = 1, blocks: list[int] | None = None, design: np.ndarray | None = None, equal_weight: bool = True) -> DataFrame:
    """(iteration, rho): rank correlations of independent rankings of ``n`` observations.

    Each iteration has its own random stream, so results do not depend on the
    partitions. With ``blocks`` (sizes), the mean over blocks of more than 2;
    with ``design``, ranks of residuals of two simulated variables.
    """
    sizes = [b for b in (blocks or [n]) if b > 2]
    q = None if design is None else np.linalg.qr(np.asarray(design, float))[0]
    if not sizes or (q is not None and q.shape[0] - q.shape[1] <= 2):
        return spark.createDataFrame([], "iteration bigint, rho double")

    def one(i: int) -> float:
        rng = np.random.default_rng([seed, i])
        if q is not None:
            e = rng.standard_normal((q.shape[0], 2))
            r = np.argsort(np.argsort(e - q @ (q.T @ e), axis=0), axis=0).astype(float)
            return float(np.corrcoef(r.T)[0, 1])
        rho = []
        for s in sizes:
            d = rng.permutation(s) - np.arange(s)
            rho.append(1.0 - 6.0 * float((d.astype(float) ** 2).sum()) / (s * (s * s - 1.0)))
        return float(np.average(rho, weights=None if equal_weight else sizes))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"iteration": b.id, "rho": [one(int(i)) for i in b.id]})

    return spark.range(iterations).mapInPandas(run, "iteration bigint, rho double")
