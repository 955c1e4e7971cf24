"""Marker pairs: features whose order tells classes of observations apart."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cairnstat.operators.moments import levels
from cairnstat.operators.pairings import pairings
from cairnstat.sources.assays import Assay


def _orders(assay: Assay, wanted: DataFrame) -> DataFrame:
    """(first, second, obs, v1, v2) where at least one of a wanted pair is stored; absent values are 0."""
    x = assay.values
    left = wanted.join(x.select(F.col("feature").alias("first"), "obs", F.col("value").alias("v1")), "first")
    right = wanted.join(x.select(F.col("feature").alias("second"), "obs", F.col("value").alias("v2")), "second")
    both = left.join(right, ["first", "second", "obs"], "full")
    return both.select("first", "second", "obs", F.coalesce("v1", F.lit(0.0)).alias("v1"), F.coalesce("v2", F.lit(0.0)).alias("v2"))


def marker_pairs(assay: Assay, fraction: float = 0.5, subset: list[str] | None = None) -> DataFrame:
    """(phase, first, second): pairs with first > second in at least ceil(n * fraction) of the phase's observations, and first < second in as many of every other phase.

    Phases are the groups of the assay; absent values are zeros.
    """
    rows = levels(assay.observations, ["grp"])
    need = {r.grp: max(0, int(np.ceil(r.n * fraction))) for r in rows}
    if len(rows) < 2:
        raise ValueError("at least two phases are needed")
    wanted = pairings(assay.features, subset).select(F.col("gene1").alias("first"), F.col("gene2").alias("second"))
    seen = _orders(assay, wanted).join(assay.observations.select("obs", "grp"), "obs").groupBy("first", "second").agg(
        *[F.count_if((F.col("grp") == g) & (F.col("v1") > F.col("v2"))).alias(f"up{i}") for i, g in enumerate(need)],
        *[F.count_if((F.col("grp") == g) & (F.col("v1") < F.col("v2"))).alias(f"dn{i}") for i, g in enumerate(need)],
    )
    hits = []
    for i, g in enumerate(need):
        for side, other, a, b in (("up", "dn", "first", "second"), ("dn", "up", "second", "first")):
            ok = F.col(f"{side}{i}") >= need[g]
            for j, h in enumerate(need):
                if j != i:
                    ok = ok & (F.col(f"{other}{j}") >= need[h])
            hits.append(F.when(ok, F.struct(F.lit(g).alias("phase"), F.col(a).alias("first"), F.col(b).alias("second"))))
    return seen.select(F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("h.*")


def pair_proportions(assay: Assay, pairs: DataFrame) -> DataFrame:
    """(obs, phase, proportion, used): share of a phase's pairs with first > second among those that differ."""
    wanted = pairs.select("first", "second").distinct()
    known = assay.features.select("feature")
    wanted = wanted.join(known.withColumnRenamed("feature", "first"), "first", "left_semi").join(known.withColumnRenamed("feature", "second"), "second", "left_semi")
    seen = _orders(assay, wanted).filter("v1 <> v2").join(pairs.distinct(), ["first", "second"])
    got = seen.groupBy("obs", "phase").agg(F.count_if(F.col("v1") > F.col("v2")).alias("__up"), F.count("*").alias("used"))
    return got.select("obs", "phase", (F.col("__up") / F.col("used")).alias("proportion"), "used")


def pair_scores(assay: Assay, pairs: DataFrame, iterations: int = 1000, least_iterations: int = 100, least_pairs: int = 50, seed: int = 1) -> DataFrame:
    """(obs, phase, score): share of random reorderings of an observation's values whose proportion lies strictly below the observed one.

    NULL with fewer than ``least_pairs`` differing pairs or fewer than
    ``least_iterations`` usable reorderings. Each observation and phase has a
    random stream of its own, so partitions do not matter. The table of pairs
    and the features in it go to every task: it is a trained classifier.
    """
    table = pairs.distinct().orderBy("phase", "first", "second").toPandas()
    names = sorted(set(table["first"]) | set(table["second"]))
    at = {f: i for i, f in enumerate(names)}
    phases = {p: (t["first"].map(at).to_numpy(), t["second"].map(at).to_numpy()) for p, t in table.groupby("phase")}
    order = sorted(phases)
    stored = assay.values.filter(F.col("feature").isin(names)) if len(names) < 500 else assay.values.join(assay.values.sparkSession.createDataFrame(pd.DataFrame({"feature": names})), "feature", "left_semi")
    cells = assay.observations.select("obs").join(stored.groupBy("obs").agg(F.collect_list(F.struct("feature", "value")).alias("v")), "obs", "left")

    def proportion(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, dn = (x[..., a] > x[..., b]).sum(axis=-1), (x[..., a] < x[..., b]).sum(axis=-1)
        return up, up + dn

    def run(batches):
        for batch in batches:
            rows = []
            for o, v in zip(batch.obs, batch.v):
                x = np.zeros(len(names))
                for e in v if v is not None else ():
                    x[at[e["feature"]]] = e["value"]
                for k, phase in enumerate(order):
                    a, b = phases[phase]
                    up, used = proportion(x, a, b)
                    if used < least_pairs:
                        rows.append((o, phase, None))
                        continue
                    rng = np.random.default_rng([seed, int(o), k])
                    below = good = 0
                    for lo in range(0, iterations, 100):
                        shuffled = rng.permuted(np.tile(x, (min(100, iterations - lo), 1)), axis=1)
                        u, n = proportion(shuffled, a, b)
                        ok = n >= least_pairs
                        good += int(ok.sum())
                        below += int((u[ok] / n[ok] < up / used).sum())
                    rows.append((o, phase, below / good if good >= least_iterations else None))
            yield pd.DataFrame(rows, columns=["obs", "phase", "score"])

    return cells.mapInPandas(run, "obs bigint, phase string, score double")


def call_phases(scores: DataFrame, value: str = "score", g1: str = "G1", g2m: str = "G2M") -> DataFrame:
    """(obs, call): g1 or g2m, whichever scores higher (g1 on ties), S if both are below 0.5, NULL if a score is missing."""
    a, b = F.max(F.when(F.col("phase") == g1, F.col(value))), F.max(F.when(F.col("phase") == g2m, F.col(value)))
    s = scores.groupBy("obs").agg(a.alias("__a"), b.alias("__b"))
    call = F.when(F.col("__a").isNull() | F.col("__b").isNull(), None).when((F.col("__a") < 0.5) & (F.col("__b") < 0.5), "S").when(F.col("__a") >= F.col("__b"), g1).otherwise(g2m)
    return s.select("obs", call.alias("call"))


def normalized_scores(scores: DataFrame, value: str = "score") -> DataFrame:
    """Add ``normalized``: scores of an observation divided by their sum over the phases; NULL if any is missing."""
    w = Window.partitionBy("obs")
    total = F.when(F.count(value).over(w) == F.count("*").over(w), F.sum(value).over(w))
    return scores.withColumn("normalized", F.when(total > 0, F.col(value) / total))
