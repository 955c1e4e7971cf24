"""Multiple-testing corrections and p-value combinations as window plans.

``by`` names the columns that separate the families of tests. NULL p-values
are ignored: they take no rank, do not count, and stay NULL. A window runs over
one family; families larger than one task are for `bh_large`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cairnstat.functions import special
from cairnstat.session import materialize, parallelism


def _family(by: Sequence[str], *more):
    return Window.partitionBy(*by, *more)


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str], out: str, log: bool = False) -> DataFrame:
    """Add ``out``: the smallest false discovery rate at which the test is kept; on the ln scale with ``log``."""
    known = F.col(p).isNotNull()
    fam = _family(by, known)
    order = fam.orderBy(F.col(p).asc_nulls_last())
    rank = F.row_number().over(order)
    m = F.count(p).over(fam)
    raw = F.col(p) + F.log(m / rank) if log else F.col(p) * m / rank
    x = df.withColumn("__r", rank).withColumn("__raw", raw)
    # from the largest p down: a frame that grows is linear, one that shrinks is computed anew for every row
    after = fam.orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.lit(0.0 if log else 1.0)
    return x.withColumn(out, F.when(known, F.least(top, F.min("__raw").over(after)))).drop("__r", "__raw")


def bh_large(df: DataFrame, p: str, out: str) -> DataFrame:
    """Benjamini-Hochberg over one family of any size: no window spans more than a bucket.

    p-values are put in buckets of equal width on a sorted sample's quantiles;
    ranks are rank within the bucket plus the counts of lower buckets, and the
    running minimum carries over from the buckets above. Both side tables have
    a row per bucket.
    """
    df = materialize(df)
    parts = 8 * parallelism(df.sparkSession)
    cuts = sorted(set(df.stat.approxQuantile(p, [i / parts for i in range(1, parts)], 0.25 / parts)))
    edges = np.array(cuts, dtype=float)

    @F.pandas_udf(T.IntegerType())
    def bucket_of(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, v.to_numpy(dtype=float), side="left").astype(np.int32))

    x = materialize(df.withColumn("__b", F.when(F.col(p).isNotNull(), bucket_of(p))))
    counts = {r[0]: r[1] for r in x.filter("__b is not null").groupBy("__b").count().collect()}  # at most `parts` rows
    m, below, run = sum(counts.values()), {}, 0
    for b in sorted(counts):
        below[b], run = run, run + counts[b]
    if not m:
        return x.withColumn(out, F.lit(None).cast("double")).drop("__b")
    bucket = Window.partitionBy("__b").orderBy(p)
    y = _by_bucket(x.filter("__b is not null"), below, "bigint").withColumn("__r", F.row_number().over(bucket) + F.col("__v")).drop("__v")
    y = materialize(y.withColumn("__raw", F.col(p) * m / F.col("__r")))
    lowest = {r[0]: r[1] for r in y.groupBy("__b").agg(F.min("__raw")).collect()}
    above, low = {}, 1.0
    for b in sorted(lowest, reverse=True):
        above[b], low = low, min(low, lowest[b])
    after = Window.partitionBy("__b").orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = _by_bucket(y, above, "double").withColumn(out, F.least(F.col("__v"), F.min("__raw").over(after))).drop("__b", "__r", "__raw", "__v")
    return known.unionByName(x.filter("__b is null").drop("__b").withColumn(out, F.lit(None).cast("double")))


def _by_bucket(df: DataFrame, values: dict[int, float], kind: str) -> DataFrame:
    """Add ``__v``, a number per bucket; the table of buckets has a fixed number of rows and is broadcast."""
    return df.join(F.broadcast(df.sparkSession.createDataFrame(list(values.items()), f"__b int, __v {kind}")), "__b")


def _ranked(df: DataFrame, p: str, by: Sequence[str], ties: Sequence[str]) -> DataFrame:
    fam = _family(by)
    known = df.filter(F.col(p).isNotNull())
    return known.withColumn("__k", F.row_number().over(fam.orderBy(p, *ties))).withColumn("__m", F.count("*").over(fam))


def simes(df: DataFrame, p: str, by: Sequence[str], out: str) -> DataFrame:
    """(by, out): m times the smallest p / rank."""
    return _ranked(df, p, by, ()).groupBy(*by).agg(F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__k"))).alias(out))


def berger(df: DataFrame, p: str, by: Sequence[str], out: str) -> DataFrame:
    """(by, out): the largest p."""
    return df.filter(F.col(p).isNotNull()).groupBy(*by).agg(F.max(p).alias(out))


def holm_middle(df: DataFrame, p: str, by: Sequence[str], out: str, share: float = 0.5) -> DataFrame:
    """(by, out): the k-th smallest Holm-adjusted p, k = max(1, ceil(m * share))."""
    x = _ranked(df, p, by, ())
    upto = _family(by).orderBy("__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("__h", F.least(F.lit(1.0), F.max((F.col("__m") - F.col("__k") + 1) * F.col(p)).over(upto)))
    return x.filter(F.col("__k") == kth(F.col("__m"), share)).select(*by, F.col("__h").alias(out))


def kth(m: Column, share: float) -> Column:
    """max(1, ceil(m * share))."""
    return F.greatest(F.lit(1), F.ceil(m * share - 1e-9)).cast("int")


def fisher(df: DataFrame, p: str, by: Sequence[str], out: str) -> DataFrame:
    """(by, out): upper chi-square tail of -2 sum ln p. Its degrees of freedom are even, so the tail is a finite sum."""
    s = df.filter(F.col(p).isNotNull()).groupBy(*by).agg((-F.sum(F.log(p))).alias("__y"), F.count("*").alias("__k"), F.max((F.col(p) == 0).cast("int")).alias("__z"))
    # terms y^j / j! e^-y on the ln scale: e^-y alone underflows where many tests combine
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("__k").cast("int") - 1, F.lit(1))),
        F.struct((-F.col("__y")).alias("t"), F.exp(-F.col("__y")).alias("s")),
        lambda a, j: F.when(j < F.col("__k"), F.struct((a["t"] + F.log("__y") - F.log(j)).alias("t"), (a["s"] + F.exp(a["t"] + F.log("__y") - F.log(j))).alias("s"))).otherwise(a),
        lambda a: a["s"],
    )
    return s.select(*by, F.when(F.col("__z") == 1, F.lit(0.0)).when(F.col("__y") <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), terms)).alias(out))


def stouffer_many(df: DataFrame, lps: dict[str, str], by: Sequence[str], weight: str | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """(by, extra, one column per entry of ``lps``): `stouffer` of several columns, and other aggregates, in one pass.

    ``lps`` maps a result's name to the column of ln p; NULL where a group has none.
    """
    inf = float("inf")
    x = df.withColumn("__w", F.col(weight) if weight else F.lit(1.0))
    aggs = list(extra)
    for i, lp in enumerate(lps.values()):
        x = x.withColumn(f"__z{i}", -special.quantile_log_udf(lp))
        z, w = F.when(F.col("__w") > 0, F.col(f"__z{i}")), F.col("__w")
        aggs += [
            F.sum(F.when(F.abs(z) < inf, w * z)).alias(f"__s{i}"), F.sqrt(F.sum(F.when(z.isNotNull(), w * w))).alias(f"__d{i}"),
            F.count_if(z == inf).alias(f"__up{i}"), F.count_if(z == -inf).alias(f"__dn{i}"),
        ]
    g = x.groupBy(*by).agg(*aggs)
    kept = [c for c in g.columns if not c.startswith("__")]
    for i in range(len(lps)):
        up, down = F.col(f"__up{i}") > 0, F.col(f"__dn{i}") > 0
        g = g.withColumn(f"__q{i}", F.when(up & down, None).when(up, inf).when(down, -inf).otherwise(F.col(f"__s{i}") / F.col(f"__d{i}")))
    return g.select(*kept, *[special.normal_tail_udf(f"__q{i}").alias(out) for i, out in enumerate(lps)])


def stouffer(df: DataFrame, lp: str, by: Sequence[str], out: str, weight: str | None = None) -> DataFrame:
    """(by, out): ln of the combined p, z = sum(w z) / sqrt(sum(w^2)); NULL if opposite infinities meet."""
    some = df.filter(F.col(lp).isNotNull() & ((F.col(weight) if weight else F.lit(1.0)) > 0))
    return stouffer_many(some, {out: lp}, by, weight)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean over the rows whose value is present."""
    ok = value.isNotNull() & (weight > 0)
    return F.sum(F.when(ok, value * weight)) / F.sum(F.when(ok, weight))


#: Names of combination methods, with their older aliases.
METHODS = {"simes": simes, "berger": berger, "holm-min": holm_middle, "fisher": fisher, "holm-middle": holm_middle}
