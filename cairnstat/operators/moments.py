"""Means and variances per feature and label, with zeros implicit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cairnstat.sources.assays import Assay

#: Group and block levels an operator will enumerate; a design factor with more is an identifier.
MOST_LEVELS = 5_000


def levels(observations: DataFrame, by: Sequence[str]) -> list:
    """Distinct labels with their number of observations; rows with a NULL label are left out."""
    known = observations
    for c in by:
        known = known.filter(F.col(c).isNotNull())
    rows = known.groupBy(*by).agg(F.count("*").alias("n")).orderBy(*by).limit(MOST_LEVELS + 1).collect()
    if len(rows) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels of {', '.join(by)}: restrict the groups")
    return rows


def spine(features: DataFrame, by: Sequence[str], rows: list) -> DataFrame:
    """Every feature with every level and its size, without a join."""
    names = [*by, "n"]
    each = [F.struct(*[F.lit(r[c]).alias(c) for c in names]) for r in rows]
    if not each:
        return features.select("feature", *[F.lit(None).cast("string").alias(c) for c in by], F.lit(0).cast("bigint").alias("n")).limit(0)
    x = features.select("feature", F.explode(F.array(*each)).alias("__l"))
    return x.select("feature", *[F.col(f"__l.{c}").alias(c) for c in by], F.col("__l.n").cast("bigint").alias("n"))


def moments(assay: Assay, by: Sequence[str] = ("block",), detection: float = 0.0) -> DataFrame:
    """(feature, by, n, mean, variance, detected): detected counts values above ``detection`` in size.

    With k non-zero values of mean m and centred sum of squares S among n
    observations: mean = m k / n, variance = (S + m^2 (k/n) (n - k)) / (n - 1).
    Variance is NULL where n < 2. Every feature appears at every level;
    observations with a NULL label are left out.
    """
    by = list(by)
    rows = levels(assay.observations, by)
    labelled = assay.values.join(assay.observations.select("obs", *by), "obs")
    part = labelled.groupBy("feature", *by).agg(
        F.count("value").alias("__k"), F.sum("value").alias("__s"), F.var_pop("value").alias("__v"), F.count_if(F.col("value") > detection).alias("__d")
    )
    x = spine(assay.features, by, rows).join(part, ["feature", *by], "left")
    k, total, n = F.coalesce("__k", F.lit(0)), F.coalesce("__s", F.lit(0.0)), F.col("n")
    m = F.when(k > 0, total / k).otherwise(0.0)
    ss = F.coalesce(F.col("__v") * F.col("__k"), F.lit(0.0))
    return x.select(
        "feature", *by, "n", (total / n).alias("mean"),
        F.when(n > 1, (ss + m * m * (k / n) * (n - k)) / (n - 1)).alias("variance"),
        F.coalesce("__d", F.lit(0)).alias("detected"),
    )


def shifted_lognorm_moments(assay: Assay, by: Sequence[str] = ("block",), pseudo: float = 1.0) -> DataFrame:
    """Moments of log2(value / size_factor + pseudo) for any pseudo-count.

    A zero becomes log2(pseudo) whatever its size factor, so the logs are
    taken relative to it and the mean is shifted back.
    """
    scaled = F.log2(F.col("value") / F.col("size_factor") + pseudo) - F.log2(F.lit(pseudo))
    values = assay.values.join(assay.observations.select("obs", "size_factor"), "obs").select("feature", "obs", scaled.alias("value"))
    out = moments(Assay(values, assay.features, assay.observations), by)
    return out.withColumn("mean", F.col("mean") + F.log2(F.lit(pseudo)))


def average_counts(assay: Assay) -> DataFrame:
    """(feature, average): mean of value / size_factor over all observations."""
    m = moments(Assay(assay.normalized(log=False).values, assay.features, assay.observations.withColumn("__one", F.lit("all"))), ["__one"])
    return m.select("feature", F.col("mean").alias("average"))


def rescale_spikes(observations: DataFrame, spike: str, by: Sequence[str] = ()) -> DataFrame:
    """Centre ``size_factor`` to mean 1 and scale ``spike`` so that its mean equals that of size_factor (within ``by``)."""
    key = [F.col(b) for b in by] or [F.lit(1)]
    means = observations.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(key)]).agg(F.avg("size_factor").alias("__g"), F.avg(spike).alias("__s"))
    whole = observations.agg(F.avg("size_factor").alias("__a"))
    x = observations.join(F.broadcast(whole))
    on = F.lit(True)
    for i, k in enumerate(key):
        on = on & k.eqNullSafe(F.col(f"__k{i}"))
    x = x.join(means, on)
    cols = [c for c in observations.columns if c not in ("size_factor", spike)]
    return x.select(*cols, (F.col("size_factor") / F.col("__a")).alias("size_factor"), (F.col(spike) / F.col("__s") * F.col("__g") / F.col("__a")).alias(spike))


def group_summary(assay: Assay, by: Sequence[str] = ("grp",), detection: float = 0.0) -> DataFrame:
    """(feature, by, n, total, mean, detected_share): pseudo-bulk sums and detection per label."""
    m = moments(assay, by, detection)
    return m.select("feature", *by, "n", (F.col("mean") * F.col("n")).alias("total"), "mean", (F.col("detected") / F.col("n")).alias("detected_share"))
