"""Pairwise comparisons of groups and the marker tables made from them.

Statistics are computed once per (feature, block, group) with one shuffle; the
groups of a feature and block are then paired inside the row they share, so no
self-join is needed. The number of groups is that of a design factor.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnstat.functions import special
from cairnstat.functions.testing import benjamini_hochberg, kth, stouffer_many, weighted_mean
from cairnstat.operators.moments import levels, moments
from cairnstat.sources.assays import Assay

DIRECTIONS = ("any", "up", "down")
FLOOR = 1e-8


def pair_groups(stats: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(feature, block, first, second, x_1.., x_2..): all ordered pairs of groups of each feature and block.

    ``keep`` are the statistics carried for both sides. Self-pairs are left out.
    """
    one = F.struct("grp", *keep)
    rows = stats.groupBy("feature", "block").agg(F.collect_list(one).alias("__g"))
    left = rows.select("feature", "block", "__g", F.explode("__g").alias("__a"))
    both = left.select("feature", "block", "__a", F.explode("__g").alias("__b")).filter("__a.grp <> __b.grp")
    return both.select(
        "feature", "block", F.col("__a.grp").alias("first"), F.col("__b.grp").alias("second"),
        *[F.col(f"__a.{c}").alias(f"{c}_1") for c in keep], *[F.col(f"__b.{c}").alias(f"{c}_2") for c in keep],
    )


def only_pairs(df: DataFrame, pairs: list[tuple[str, str]] | None) -> DataFrame:
    if pairs is None:
        return df
    wanted = F.lit(False)
    for a, b in pairs:
        wanted = wanted | ((F.col("first") == a) & (F.col("second") == b))
    return df.filter(wanted)


def marker_moments(assay: Assay, detection: float = 0.0) -> DataFrame:
    return moments(assay, ["block", "grp"], detection)


# effect sizes


def cohen_d(lfc: float = 0.0) -> Column:
    """(m1 - m2 - lfc) over the root of the average variance; 0 when the numerator is 0, NULL when undefined."""
    top = F.col("mean_1") - F.col("mean_2") - lfc
    pooled = (F.col("variance_1") + F.col("variance_2")) / 2.0
    return F.when(pooled.isNull(), None).when(top == 0, 0.0).when(pooled > 0, top / F.sqrt(pooled))


def lfc_detected() -> Column:
    """log2 ratio of detected shares, each shrunk by a pseudo-count in proportion to its group's size."""
    small = F.least("n_1", "n_2")
    p1, p2 = F.col("n_1") / small, F.col("n_2") / small
    return F.log2((F.col("detected_1") + p1) / (F.col("n_1") + 2 * p1)) - F.log2((F.col("detected_2") + p2) / (F.col("n_2") + 2 * p2))


def lfc_detected_mean() -> Column:
    """As `lfc_detected`, with pseudo-counts in proportion to the mean group size."""
    mid = (F.col("n_1") + F.col("n_2")) / 2.0
    p1, p2 = F.col("n_1") / mid, F.col("n_2") / mid
    return F.log2((F.col("detected_1") + p1) / (F.col("n_1") + 2 * p1)) - F.log2((F.col("detected_2") + p2) / (F.col("n_2") + 2 * p2))


def overlaps(assay: Assay, lfc: float = 0.0) -> DataFrame:
    """(feature, block, first, second, n_1, n_2, u, ties): rank-sum overlap of all ordered pairs of groups.

    ``u`` counts the pairs of observations whose value in first, less ``lfc``,
    exceeds that in second, ties by half; ``ties`` sums t^3 - t over tied
    values. All pairs come from one pass over the counts per distinct value:
    zeros enter as one counted value. NULL and NaN values must be absent.
    """
    rows = levels(assay.observations, ["block", "grp"])
    groups = sorted({r.grp for r in rows})
    size = {(r.block, r.grp): r.n for r in rows}
    blocks = sorted({r.block for r in rows})
    labelled = assay.values.join(assay.observations.select("obs", "block", "grp").filter("block is not null and grp is not null"), "obs")
    counts = labelled.groupBy("feature", "block", "value").agg(*[F.count_if(F.col("grp") == g).alias(f"c{i}") for i, g in enumerate(groups)])
    filled = counts.groupBy("feature", "block").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(groups))])
    per_block = F.array(*[F.struct(F.lit(b).alias("block"), *[F.lit(size.get((b, g), 0)).cast("bigint").alias(f"s{i}") for i, g in enumerate(groups)]) for b in blocks])
    base = assay.features.select("feature", F.explode(per_block).alias("__s")).select("feature", "__s.*")
    zeros = base.join(filled, ["feature", "block"], "left").select(
        "feature", "block", F.lit(0.0).alias("value"), *[(F.col(f"s{i}") - F.coalesce(f"c{i}", F.lit(0))).alias(f"c{i}") for i in range(len(groups))]
    )
    all_counts = counts.unionByName(zeros)
    cs = [f"c{i}" for i in range(len(groups))]
    if lfc:
        zero = [F.lit(0).cast("bigint")]
        both = all_counts.select("feature", "block", (F.col("value") - lfc).alias("value"), *[F.col(c).alias(f"l{c}") for c in cs], *[zero[0].alias(f"r{c}") for c in cs]).unionByName(
            all_counts.select("feature", "block", "value", *[zero[0].alias(f"l{c}") for c in cs], *[F.col(c).alias(f"r{c}") for c in cs])
        )
        both = both.groupBy("feature", "block", "value").agg(*[F.sum(f"{s}{c}").alias(f"{s}{c}") for s in "lr" for c in cs])
    else:
        both = all_counts.select("feature", "block", "value", *[F.col(c).alias(f"{s}{c}") for s in "lr" for c in cs])
    below = Window.partitionBy("feature", "block").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    x = both.select("feature", "block", *[f"l{c}" for c in cs], *[f"r{c}" for c in cs], *[F.coalesce(F.sum(f"r{c}").over(below), F.lit(0)).alias(f"b{c}") for c in cs])
    if len(groups) < 2:
        return x.select("feature", "block", *[F.lit(None).cast(t).alias(c) for c, t in (("first", "string"), ("second", "string"), ("n_1", "bigint"), ("n_2", "bigint"), ("u", "double"), ("ties", "double"))]).limit(0)
    # one row per value and group that has it, with sums against every other group: their number grows with the groups, not with the pairs
    last = len(groups)
    each = x.select("feature", "block", *[f"{k}{c}" for k in "rb" for c in cs], F.posexplode(F.array(*[f"l{c}" for c in cs], F.lit(-1))).alias("i", "l")).filter("l <> 0")
    cube = lambda t: t * t * t - t
    sums = []
    for c in cs:
        r, tied = F.col(f"r{c}").cast("double"), (F.col("l") + F.col(f"r{c}")).cast("double")
        # the last row of each value (l = -1) gives the ties of the second group by itself
        sums += [F.sum(F.col("l") * (F.col(f"b{c}") + r / 2.0)).alias(f"u{c}"), F.sum(F.when(F.col("i") == last, cube(r)).otherwise(cube(tied) - cube(r))).alias(f"t{c}")]
    per = each.groupBy("feature", "block", "i").agg(*sums).select("feature", "block", F.struct("i", F.array(*[f"u{c}" for c in cs]).alias("u"), F.array(*[f"t{c}" for c in cs]).alias("t")).alias("e"))
    rows = per.groupBy("feature", "block").agg(F.collect_list("e").alias("__g"))
    own = F.filter("__g", lambda e: e["i"] == last)[0]["t"]
    flat = rows.select("feature", "block", own.alias("own"), F.explode(F.filter("__g", lambda e: e["i"] < last)).alias("e"))
    flat = flat.select("feature", "block", F.col("e.i").alias("i"), F.posexplode(F.arrays_zip(F.col("e.u").alias("u"), F.col("e.t").alias("t"), F.col("own").alias("own"))).alias("j", "z")).filter("i <> j")
    names = F.array(*[F.lit(g) for g in groups])
    n = F.element_at(F.create_map(*[v for b in blocks for v in (F.lit(b), F.array(*[F.lit(size.get((b, g), 0)).cast("bigint") for g in groups]))]), F.col("block"))
    at = lambda a, k: F.element_at(a, F.col(k) + 1)
    out = flat.select("feature", "block", at(names, "i").alias("first"), at(names, "j").alias("second"), at(n, "i").alias("n_1"), at(n, "j").alias("n_2"), F.col("z.u").alias("u"), (F.col("z.t") + F.col("z.own")).alias("ties"))
    return out.filter("n_1 > 0 and n_2 > 0")


def auc() -> Column:
    return F.col("u") / (F.col("n_1") * F.col("n_2"))


# marker scores


def average_effects(effects: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, first, second, names): block averages weighted by n_1 * n_2, skipping blocks without the effect."""
    w = (F.col("n_1") * F.col("n_2")).cast("double")
    return effects.groupBy("feature", "first", "second").agg(*[weighted_mean(F.col(c), w).alias(c) for c in names])


def effect_sizes(assay: Assay, lfc: float = 0.0, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(feature, first, second, logfc_cohen, auc, logfc_detected) of every ordered pair of groups."""
    stats = only_pairs(pair_groups(marker_moments(assay), ["n", "mean", "variance", "detected"]), pairs)
    e = stats.select("feature", "block", "first", "second", "n_1", "n_2", cohen_d(lfc).alias("logfc_cohen"), lfc_detected().alias("logfc_detected"))
    a = only_pairs(overlaps(assay, lfc), pairs).select("feature", "block", "first", "second", auc().alias("auc"))
    return average_effects(e.join(a, ["feature", "block", "first", "second"]), ["logfc_cohen", "auc", "logfc_detected"])


EFFECTS = ("logfc_cohen", "auc", "logfc_detected")


#: Decimals to which effects are compared when ranked, so that rounding errors do not part equal ones.
RANK_DIGITS = 10


def min_rank(effects: DataFrame, effect: str, out: str) -> DataFrame:
    """(grp, feature, out): smallest rank of the feature over a group's comparisons, highest effect first, ties share the lowest rank.

    The window runs over the features of one comparison.
    """
    w = Window.partitionBy("first", "second").orderBy(F.round(effect, RANK_DIGITS).desc())
    ranked = effects.filter(F.col(effect).isNotNull()).select("first", "feature", F.rank().over(w).alias("__r"))
    return ranked.groupBy(F.col("first").alias("grp"), "feature").agg(F.min("__r").alias(out))


def score_markers(assay: Assay, lfc: float = 0.0, pairs: list[tuple[str, str]] | None = None, row_data: DataFrame | None = None) -> DataFrame:
    """Per (grp, feature): averages in and outside the group, and mean, median, min, max and rank of each effect over its comparisons.

    With several blocks the averages are freed of block effects
    (`corrected_summaries`). Those outside a group are over the groups it is
    compared with.
    """
    effects = effect_sizes(assay, lfc, pairs)
    ranked = effects
    for e in EFFECTS:
        w = Window.partitionBy("first", "second", F.col(e).isNotNull()).orderBy(F.round(e, RANK_DIGITS).desc())
        ranked = ranked.withColumn(f"__r_{e}", F.when(F.col(e).isNotNull(), F.rank().over(w)))
    aggs = []
    for e in EFFECTS:
        aggs += [F.avg(e).alias(f"mean_{e}"), F.median(e).alias(f"median_{e}"), F.min(e).alias(f"min_{e}"), F.max(e).alias(f"max_{e}"), F.min(f"__r_{e}").alias(f"rank_{e}")]
    summary = ranked.groupBy(F.col("first").alias("grp"), "feature").agg(*aggs)
    out = others_of(corrected_summaries(assay), pairs).join(summary, ["grp", "feature"])
    return out.join(row_data, "feature", "left") if row_data is not None else out


def full_scores(assay: Assay, lfc: float = 0.0, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per (grp, feature): every effect of every comparison, as maps from the other group."""
    effects = effect_sizes(assay, lfc, pairs)
    return effects.groupBy(F.col("first").alias("grp"), "feature").agg(*[F.map_from_entries(F.sort_array(F.collect_list(F.struct("second", e)))).alias(f"full_{e}") for e in EFFECTS])


def summary_stats(assay: Assay) -> DataFrame:
    """Per (grp, feature): mean and detected share in the group, and the mean of those of the other groups.

    With blocks, each group's value is the mean over its blocks weighted by
    their number of observations.
    """
    g = marker_moments(assay).groupBy("feature", "grp").agg(
        (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("a"), (F.sum("detected") / F.sum("n")).alias("d")
    )
    return others_of(g.select("grp", "feature", F.col("a").alias("average"), F.col("d").alias("detected_share")))


def others_of(g: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(grp, feature, self_average, other_average, self_detected, other_detected): each group's summaries, and their mean over the groups it is paired with, all others without ``pairs``."""
    if pairs is None:
        w = Window.partitionBy("feature")
        others = F.count("*").over(w) - 1
        other = {c: F.when(others > 0, (F.sum(c).over(w) - F.col(c)) / others) for c in ("average", "detected_share")}
        x = g
    else:
        wanted = g.sparkSession.createDataFrame(sorted({(a, b) for a, b in pairs if a != b}), "grp string, second string")
        seconds = F.broadcast(wanted).join(g.withColumnRenamed("grp", "second"), "second").groupBy("grp", "feature").agg(F.avg("average").alias("__a"), F.avg("detected_share").alias("__d"))
        x = g.join(seconds, ["grp", "feature"], "left")
        other = {"average": F.col("__a"), "detected_share": F.col("__d")}
    return x.select(
        "grp", "feature", F.col("average").alias("self_average"), other["average"].alias("other_average"),
        F.col("detected_share").alias("self_detected"), other["detected_share"].alias("other_detected"),
    )


#: Added to detected shares, and taken off again, so that shares of 0 and 1 have a logit.
LOGIT_OFFSET = 0.01


def corrected_summaries(assay: Assay, detection: float = 0.0) -> DataFrame:
    """(grp, feature, average, detected_share): group effects freed of block effects.

    Means of (group, block), weighted by their observations, are modelled as
    group + block; a group's value is its effect in the average block, all
    blocks counting alike. Detected shares are modelled on the logit scale,
    shrunk towards a half by LOGIT_OFFSET. The model is the same for all features, so each result is a
    fixed combination of that feature's means, found once on the driver. With
    one block both are the plain ones.
    """
    rows = levels(assay.observations, ["grp", "block"])
    groups, blocks = sorted({r.grp for r in rows}), sorted({r.block for r in rows})
    x = np.zeros((len(rows), len(groups) + len(blocks) - 1))
    for k, r in enumerate(rows):
        x[k, groups.index(r.grp)] = 1.0
        if r.block != blocks[0]:
            x[k, len(groups) + blocks.index(r.block) - 1] = 1.0
    w = np.array([float(r.n) for r in rows])
    beta = np.linalg.pinv(x * np.sqrt(w)[:, None]) * np.sqrt(w)[None]
    share = np.full(len(blocks) - 1, 1.0 / len(blocks))
    take = beta[: len(groups)] + share @ beta[len(groups) :]
    spark = assay.values.sparkSession
    factors = [(g, r.grp, r.block, float(take[i, k])) for i, g in enumerate(groups) for k, r in enumerate(rows) if abs(take[i, k]) > 1e-12]
    f = spark.createDataFrame(factors, "to string, grp string, block string, w double")
    p = (F.col("detected") / F.col("n") + LOGIT_OFFSET) / (1 + 2 * LOGIT_OFFSET)
    m = marker_moments(assay, detection).withColumn("__logit", F.log(p / (1 - p)))
    s = m.join(f, ["grp", "block"]).groupBy(F.col("to").alias("grp"), "feature").agg(F.sum(F.col("w") * F.col("mean")).alias("average"), F.sum(F.col("w") * F.col("__logit")).alias("__l"))
    back = (1 + 2 * LOGIT_OFFSET) / (1 + F.exp(-F.col("__l"))) - LOGIT_OFFSET
    return s.select("grp", "feature", "average", F.greatest(F.lit(0.0), F.least(F.lit(1.0), back)).alias("detected_share"))


# pairwise tests


def welch(lfc: float = 0.0) -> tuple[Column, Column, Column]:
    """t for "less", t for "greater" and the Welch degrees of freedom; NULL where a group has fewer than 2 observations."""
    v1, v2 = F.greatest("variance_1", F.lit(FLOOR)), F.greatest("variance_2", F.lit(FLOOR))
    e1, e2 = v1 / F.col("n_1"), v2 / F.col("n_2")
    ok = (F.col("n_1") > 1) & (F.col("n_2") > 1)
    df = (e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n_1") - 1) + e2 * e2 / (F.col("n_2") - 1))
    d = F.col("mean_1") - F.col("mean_2")
    se = F.sqrt(e1 + e2)
    return F.when(ok, (d + lfc) / se), F.when(ok, (d - lfc) / se), F.when(ok, df)


def welch_stats(assay: Assay, lfc: float = 0.0) -> DataFrame:
    """Per block and pair: difference of means, t, degrees of freedom, weight 1 / (1/n1 + 1/n2)."""
    t_left, t_right, df = welch(lfc)
    s = pair_groups(marker_moments(assay), ["n", "mean", "variance"])
    w = 1.0 / (1.0 / F.col("n_1") + 1.0 / F.col("n_2"))
    return s.select("feature", "block", "first", "second", (F.col("mean_1") - F.col("mean_2")).alias("logfc"), "mean_1", "mean_2", "variance_1", "variance_2", "n_1", "n_2", t_left.alias("t_left"), t_right.alias("t_right"), df.alias("df"), w.alias("weight"))


def _combined(per_block: DataFrame, effect: str, direction: str, log: bool) -> DataFrame:
    """From (feature, block, first, second, left, right, weight, effect, valid) to p-values over blocks.

    One-sided ln p-values of the valid blocks combine by weighted z-scores, the
    effect by weighted mean. Pairs without a valid block have NULLs.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    keys = ["feature", "first", "second"]
    x = per_block.select("feature", "first", "second", effect, "weight", "valid", F.when(F.col("valid"), F.col("left")).alias("left"), F.when(F.col("valid"), F.col("right")).alias("right"))
    eff = weighted_mean(F.when(F.col("valid"), F.col(effect)), F.col("weight")).alias(effect)
    both = stouffer_many(x, {"left": "left", "right": "right"}, keys, "weight", [eff])
    ln2 = special.LN2
    lp = {"up": F.col("right"), "down": F.col("left"), "any": F.least(F.lit(0.0), F.least("left", "right") + ln2)}[direction]
    out = both.select(*keys, F.col(effect), F.when(F.col("left").isNotNull() & F.col("right").isNotNull(), lp).alias("log_p"))
    out = benjamini_hochberg(out, "log_p", ["first", "second"], "log_fdr", log=True)
    if log:
        return out
    return out.select(*keys, effect, F.exp("log_p").alias("p_value"), F.exp("log_fdr").alias("fdr"))


def pairwise_t(assay: Assay, direction: str = "any", lfc: float = 0.0, std_lfc: bool = False, log: bool = False) -> DataFrame:
    """Welch tests of every ordered pair of groups: logfc, p_value, fdr (or their ln).

    With ``std_lfc`` the effect is divided by the pooled standard deviation.
    """
    s = welch_stats(assay, lfc)
    if std_lfc:
        pooled = ((F.col("n_1") - 1) * F.col("variance_1") + (F.col("n_2") - 1) * F.col("variance_2")) / (F.col("n_1") + F.col("n_2") - 2)
        s = s.withColumn("logfc", F.when(F.col("logfc") == 0, 0.0).when(pooled > 0, F.col("logfc") / F.sqrt(pooled)))
    s = s.withColumn("valid", F.col("df").isNotNull())
    s = s.withColumn("left", special.t_tail_udf(-F.col("t_left"), "df")).withColumn("right", special.t_tail_udf("t_right", "df"))
    return _combined(s, "logfc", direction, log)


def wilcox_stats(assay: Assay, lfc: float = 0.0) -> DataFrame:
    """Per block and pair: U, its standard deviation with ties, and z for "less" and "greater" with continuity correction."""
    o = overlaps(assay, lfc)
    n = F.col("n_1") + F.col("n_2")
    var = F.col("n_1") * F.col("n_2") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    sigma = F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(FLOOR))
    centre = F.col("u") - F.col("n_1") * F.col("n_2") / 2.0
    return o.withColumn("sigma", sigma).withColumn("z_left", (centre + 0.5) / sigma).withColumn("z_right", (centre - 0.5) / sigma).withColumn("auc", auc()).withColumn("weight", (F.col("n_1") * F.col("n_2")).cast("double")).withColumn("valid", F.col("n_1") * F.col("n_2") > 1.5)


def pairwise_wilcox(assay: Assay, direction: str = "any", lfc: float = 0.0, log: bool = False) -> DataFrame:
    """Rank-sum tests of every ordered pair of groups: auc, p_value, fdr.

    With ``lfc`` the greater side tests against a shift of first down by it and
    the less side up; the AUC is the average of both, or that of the side tested.
    """
    down = wilcox_stats(assay, lfc)
    s = down
    if lfc:
        up = wilcox_stats(assay, -lfc).select("feature", "block", "first", "second", F.col("z_left").alias("zl"), F.col("auc").alias("auc_up"))
        s = down.join(up, ["feature", "block", "first", "second"]).withColumn("z_left", F.col("zl"))
        side = {"any": (F.col("auc") + F.col("auc_up")) / 2.0, "up": F.col("auc"), "down": F.col("auc_up")}[direction]
        s = s.withColumn("auc", side)
    s = s.withColumn("left", special.normal_tail_udf(-F.col("z_left"))).withColumn("right", special.normal_tail_udf("z_right"))
    return _combined(s, "auc", direction, log)


def binom_stats(assay: Assay, threshold: float = FLOOR) -> DataFrame:
    """Per block and pair: detected counts, group sizes and the log2 ratio of detection."""
    s = pair_groups(marker_moments(assay, threshold), ["n", "detected"])
    return s.withColumn("logfc", lfc_detected_mean()).withColumn("weight", (F.col("n_1") + F.col("n_2")).cast("double"))


def pairwise_binom(assay: Assay, direction: str = "any", lfc: float = 0.0, threshold: float = FLOOR, log: bool = False) -> DataFrame:
    """Binomial tests of detection: given the detected of both groups, those of first follow its share of observations."""
    fold = 2.0**lfc
    s = binom_stats(assay, threshold).withColumn("valid", (F.col("n_1") > 0) & (F.col("n_2") > 0))
    share = lambda f: F.col("n_1") * f / (F.col("n_2") + F.col("n_1") * f)
    z = F.col("detected_1") + F.col("detected_2")
    s = s.withColumn("left", special.binomial_tails_udf("detected_1", z, share(1.0 / fold))["left"])
    s = s.withColumn("right", special.binomial_tails_udf("detected_1", z, share(fold))["right"])
    return _combined(s, "logfc", direction, log)


TESTS = {"t": pairwise_t, "wilcox": pairwise_wilcox, "binom": pairwise_binom}
EFFECT_OF = {"t": "logfc", "wilcox": "auc", "binom": "logfc"}


# combination into one table per group

SHARE = {"any": 0.0, "some": 0.5, "all": 1.0}


def combine_markers(pairs: DataFrame, features: DataFrame, p: str = "p_value", effect: str = "logfc", pval_type: str = "any", min_prop: float | None = None) -> DataFrame:
    """One row per (grp, feature) from pairwise results (first, second, feature, p, effect).

    ``any``: Simes p and ``top``, the k-th smallest of the feature's ranks over
    the comparisons (k from ``min_prop``); ``some``: Holm p of rank k; ``all``:
    the largest p. ``summary`` is the effect behind that p; ``effects`` maps
    the other group to its effect. NULL p-values drop out of their comparison.
    Ties in rank follow feature_idx.
    """
    if pval_type not in SHARE:
        raise ValueError(f"pval_type must be one of {sorted(SHARE)}")
    share = SHARE[pval_type] if min_prop is None else min_prop
    x = pairs.join(features.select("feature", "feature_idx"), "feature").withColumnRenamed("first", "grp")
    known = x.filter(F.col(p).isNotNull())
    known = known.withColumn("__r", F.row_number().over(Window.partitionBy("grp", "second").orderBy(p, "feature_idx")))
    fam = Window.partitionBy("grp", "feature")
    known = known.withColumn("__m", F.count("*").over(fam)).withColumn("__k", F.row_number().over(fam.orderBy(p, effect, "second")))
    upto = fam.orderBy("__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = known.withColumn("__h", F.least(F.lit(1.0), F.max((F.col("__m") - F.col("__k") + 1) * F.col(p)).over(upto)))
    k = kth(F.col("__m"), share)
    value = {"any": F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__k"))), "some": F.min(F.when(F.col("__k") == k, F.col("__h"))), "all": F.max(p)}[pval_type]
    behind = {"any": F.min_by(effect, F.struct(p, "second")), "some": F.min(F.when(F.col("__k") == k, F.col(effect))), "all": F.max_by(effect, F.struct(F.col(p), F.col("second")))}[pval_type]
    g = known.groupBy("grp", "feature").agg(
        value.alias("p_value"), behind.alias("summary"), F.array_sort(F.collect_list("__r")).alias("__ranks"), F.max("__m").alias("__m"),
    )
    g = g.withColumn("top", F.element_at("__ranks", kth(F.col("__m"), share)))
    maps = x.groupBy("grp", "feature").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("second", effect)))).alias("effects"))
    out = maps.join(g.select("grp", "feature", "top", "p_value", "summary"), ["grp", "feature"], "left")
    return benjamini_hochberg(out, "p_value", ["grp"], "fdr")


def find_markers(assay: Assay, test: str = "t", pval_type: str = "any", min_prop: float | None = None, row_data: DataFrame | None = None, add_summary: bool = False, **options) -> DataFrame:
    """Pairwise tests of all groups, combined per group."""
    pairs = TESTS[test](assay, **options)
    out = combine_markers(pairs, assay.features, effect=EFFECT_OF[test], pval_type=pval_type, min_prop=min_prop)
    if add_summary:
        out = out.join(summary_stats(assay), ["grp", "feature"], "left")
    return out.join(row_data, "feature", "left") if row_data is not None else out


def top_markers(pairs: DataFrame, features: DataFrame, n: int = 10, pairwise: bool = True, pval_type: str = "any", fdr: float = 0.05, p: str = "p_value", effect: str = "logfc") -> DataFrame:
    """The ``n`` leading features per comparison, or per group after combination, among those with an FDR of at most ``fdr``."""
    if pairwise:
        x = pairs.join(features.select("feature", "feature_idx"), "feature").filter(F.col("fdr") <= fdr)
        w = Window.partitionBy("first", "second").orderBy(p, "feature_idx")
        return x.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("first", "second", "feature", "place")
    c = combine_markers(pairs, features, p, effect, pval_type).filter(F.col("fdr") <= fdr)
    if pval_type == "any":
        return c.filter(F.col("top") <= n).select("grp", "feature", F.col("top").alias("place"))
    w = Window.partitionBy("grp").orderBy("p_value", "feature_idx")
    c = c.join(features.select("feature", "feature_idx"), "feature")
    return c.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("grp", "feature", "place")


def multi_markers(tables: dict[str, DataFrame], repeated: Sequence[str] = ()) -> DataFrame:
    """Join marker tables of several methods: top and p_value are the worst of each, FDR anew; other columns come as method_column.

    Columns in ``repeated`` are alike in all tables and come once. Tables
    whose (grp, feature) rows differ are refused, as is a repeated column, or
    top or p_value, that only some of them have.
    """
    out, names = None, list(tables)
    for c in {*repeated, "top", "p_value"}:
        if len({c in t.columns for t in tables.values()}) > 1:
            raise ValueError(f"column {c} is in some of the tables only")
    keys = None
    for name, t in tables.items():
        own = t.select("grp", "feature").distinct().withColumn("__i", F.lit(1))
        keys = own if keys is None else keys.unionByName(own)
    if not keys.groupBy("grp", "feature").agg(F.count("*").alias("n")).filter(F.col("n") != len(names)).isEmpty():
        raise ValueError("the tables do not hold the same features of the same groups")
    for name, t in tables.items():
        own = [c for c in t.columns if c not in ("grp", "feature") and (c not in repeated or name == names[0])]
        t = t.select("grp", "feature", *[F.col(c).alias(c if c in repeated else f"{name}_{c}") for c in own])
        out = t if out is None else out.join(t, ["grp", "feature"])
    worst = lambda c: (F.greatest(*[F.col(f"{n}_{c}") for n in names]) if len(names) > 1 else F.col(f"{names[0]}_{c}")).alias(c)
    both = [c for c in ("top", "p_value") if all(f"{n}_{c}" in out.columns for n in names)]
    out = out.select("grp", "feature", *[worst(c) for c in both], *[c for c in out.columns if c not in ("grp", "feature")])
    return benjamini_hochberg(out, "p_value", ["grp"], "fdr") if "p_value" in both else out


def marker_effects(combined: DataFrame, remove_missing: bool = False) -> DataFrame:
    """Long form (grp, feature, other, effect) of the effect maps; with ``remove_missing``, comparisons with any NULL are dropped."""
    long = combined.select("grp", "feature", F.explode("effects").alias("other", "effect"))
    if not remove_missing:
        return long
    bad = long.filter("effect is null").select("grp", "other").distinct()
    return long.join(bad, ["grp", "other"], "left_anti")
