"""Size factors by pooling observations and solving for their shares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cairnstat.session import parallelism
from cairnstat.sources.assays import Assay


def solve_ring(pools: dict[int, np.ndarray], k: int, pull: float = 1e-6) -> np.ndarray:
    """Least-squares shares of ``k`` observations on a ring from the values of their sliding pools.

    ``pools`` gives, for a pool size s, the value of the pool of positions i to
    i + s - 1 (round the ring) for every i. All equations of a size shift into
    each other, so the normal equations are circulant and a Fourier transform
    solves them; shares are pulled to 1 with weight ``pull``.
    """
    left, right = np.full(k, pull), np.fft.fft(np.full(k, pull))
    for s, value in pools.items():
        window = np.zeros(k)
        window[:s] = 1.0
        f = np.fft.fft(window)
        left = left + np.abs(f) ** 2
        right = right + f * np.fft.fft(value)
    return np.fft.ifft(right / left).real


def pooled_size_factors(assay: Assay, clusters: DataFrame | None = None, sizes: tuple[int, ...] = (21, 31, 41, 51, 61, 71, 81, 91, 101), min_mean: float = 0.1, max_cluster_size: int = 3_000) -> DataFrame:
    """(obs, size_factor): centred to mean 1.

    Within a cluster, observations stand on a ring by library size; sliding pools are compared
    with the cluster's average profile by the median ratio over features, and
    the linear system of pools is solved by least squares with a weak pull to
    library sizes. Negative solutions fall back to library sizes; parts are
    put on one scale by their average profiles. Clusters above
    ``max_cluster_size`` are divided into smaller ones of that size at most,
    by a hash of obs.
    """
    o = assay.observations.select("obs")
    o = o.join(clusters.select("obs", F.col("cluster").alias("__c")), "obs", "left") if clusters is not None else o.withColumn("__c", F.lit("all"))
    o = o.withColumn("__c", F.coalesce("__c", F.lit("all")))
    n = o.groupBy("__c").agg(F.ceil(F.count("*") / max_cluster_size).alias("__p"))
    o = o.join(n, "__c").select("obs", F.concat_ws("/", "__c", F.pmod(F.xxhash64("obs"), "__p")).alias("__c"))
    names = sorted(r.feature for r in assay.features.select("feature").collect())
    at = {f: i for i, f in enumerate(names)}
    cells = o.join(assay.values.groupBy("obs").agg(F.collect_list(F.struct("feature", "value")).alias("v")), "obs", "left")
    whole = assay.values.groupBy("feature").agg(F.sum("value").alias("s")).toPandas().set_index("feature")["s"].reindex(names).fillna(0.0).to_numpy()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("obs")
        x = np.zeros((len(names), len(pdf)))
        for j, v in enumerate(pdf["v"]):
            if v is not None and len(v):
                x[[at[e["feature"]] for e in v], j] = [e["value"] for e in v]
        lib = x.sum(axis=0)
        good = lib > 0
        out = np.full(len(pdf), np.nan)
        if good.any():
            y = x[:, good] / lib[good]
            ref = y.mean(axis=1)
            use = ref * lib[good].mean() >= min_mean
            use = use if use.any() else ref > 0
            factor = np.ones(good.sum())
            k = good.sum()
            order = np.argsort(lib[good], kind="stable")
            ring = np.concatenate([order[::2], order[1::2][::-1]])
            pools = {}
            for s in sizes:
                if s > k:
                    continue
                two = np.concatenate([ring, ring[: s - 1]])
                cum = np.concatenate([np.zeros((use.sum(), 1)), np.cumsum(y[use][:, two], axis=1)], axis=1)
                pools[s] = np.median((cum[:, s:] - cum[:, :-s]) / ref[use][:, None], axis=0)
            if pools:
                factor[ring] = solve_ring(pools, k)
                factor = np.where(factor > 0, factor, 1.0)
            both = (ref > 0) & (whole > 0)
            scale = np.median(ref[both] / whole[both]) if both.any() else 1.0
            out[good] = factor * lib[good] * scale
        return pd.DataFrame({"obs": pdf.obs, "size_factor": out})

    raw = cells.repartition(parallelism(cells.sparkSession), "__c").groupBy("__c").applyInPandas(run, "obs bigint, size_factor double")
    raw = raw.withColumn("size_factor", F.when(~F.isnan("size_factor"), F.col("size_factor")))
    mean = raw.agg(F.avg("size_factor").alias("__m"))
    return raw.join(F.broadcast(mean)).select("obs", (F.col("size_factor") / F.col("__m")).alias("size_factor"))  # one row is broadcast
