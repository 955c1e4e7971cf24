"""Queries on moments, effect sizes, pairwise tests and marker tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnstat.functions import testing
from cairnstat.operators import markers as mk, moments as mo
from cairnstat.operators.current import current_rows
from cairnstat.plans import sql as S
from cairnstat.sources import assays, table

GROUPS = ["amber", "basil", "cedar", "dune", "elm", "fjord", "grove", "heath"]


#: Added before rounding to 6 decimals here and in the SQL: many means end in an exact half there, which engines round either way.
NUDGE = 1e-9


def _r(name: str, digits: int = 6):
    return F.round(F.col(name) + NUDGE if digits == 6 else F.col(name), digits).alias(name)


def _p9(name: str):
    """p-values to 9 decimals; exact halves occur there too."""
    return F.round(F.col(name) + 1e-13, 9).alias(name)


def moments_blocked(spark: SparkSession, d: str) -> DataFrame:
    """Mean and variance of every part in every nation's suppliers, zeros included."""
    m = mo.moments(assays.part_by_supplier(spark, d), ["block"])
    return m.select("feature", "block", "n", _r("mean"), _r("variance"), "detected")


def moments_stored(spark: SparkSession, d: str) -> DataFrame:
    """Mean and variance of every feature of the stored assay per block."""
    m = mo.moments(assays.stored(spark, d), ["block"])
    return m.select("feature", "block", "n", _r("mean"), _r("variance"), "detected")


def lognorm_moments(spark: SparkSession, d: str) -> DataFrame:
    m = mo.moments(assays.brand_by_customer(spark, d).normalized(), ["block"])
    return m.select("feature", "block", "n", _r("mean"), _r("variance"))


def lognorm_moments_pseudo(spark: SparkSession, d: str) -> DataFrame:
    m = mo.shifted_lognorm_moments(assays.brand_by_customer(spark, d), ["block"], 2.0)
    return m.select("feature", "block", "n", _r("mean"), _r("variance"))


def cv2_blocked(spark: SparkSession, d: str) -> DataFrame:
    m = mo.moments(assays.brand_by_customer(spark, d).normalized(log=False), ["block"])
    return m.select("feature", "block", _r("mean"), F.round(F.col("variance") / (F.col("mean") * F.col("mean")) + NUDGE, 6).alias("cv2"))


def size_factors(spark: SparkSession, d: str) -> DataFrame:
    return assays.brand_by_customer(spark, d).observations.select("obs", _r("size_factor"))


def spike_size_factors(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of size factors brought to the same mean within each block: library sizes and account balances."""
    o = assays.brand_by_customer(spark, d).observations
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("obs"), (F.abs("c_acctbal") + 1).alias("spike"))
    out = mo.rescale_spikes(o.join(c, "obs"), "spike", ["block"])
    return out.select("obs", _r("size_factor", 5), _r("spike", 5))


def average_counts(spark: SparkSession, d: str) -> DataFrame:
    return mo.average_counts(assays.brand_by_customer(spark, d)).select("feature", _r("average"))


def group_summary(spark: SparkSession, d: str) -> DataFrame:
    g = mo.group_summary(assays.brand_by_customer(spark, d), ["grp"])
    return g.select("feature", "grp", "n", _r("total", 4), _r("mean"), _r("detected_share"))


def pseudobulk_sum(spark: SparkSession, d: str) -> DataFrame:
    """Counts added up per (feature, label, sample): brands by segment and region."""
    g = mo.group_summary(assays.brand_by_customer(spark, d), ["grp", "block"])
    return g.select("feature", F.col("grp").alias("label"), F.col("block").alias("sample"), "n", _r("total", 4))


def _brand(spark: SparkSession, d: str):
    return assays.brand_by_customer(spark, d)


def cohen_d(spark: SparkSession, d: str) -> DataFrame:
    p = mk.pair_groups(mk.marker_moments(_brand(spark, d).normalized()), ["n", "mean", "variance"])
    return p.select("feature", "block", "first", "second", F.round(mk.cohen_d() + NUDGE, 6).alias("logfc_cohen"))


def cohen_d_lfc(spark: SparkSession, d: str) -> DataFrame:
    p = mk.pair_groups(mk.marker_moments(_brand(spark, d).normalized()), ["n", "mean", "variance"])
    return p.select("feature", "block", "first", "second", F.round(mk.cohen_d(0.5) + NUDGE, 6).alias("logfc_cohen"))


def detection_lfc(spark: SparkSession, d: str) -> DataFrame:
    p = mk.pair_groups(mk.marker_moments(_brand(spark, d)), ["n", "detected"])
    return p.select("feature", "block", "first", "second", F.round(mk.lfc_detected() + NUDGE, 6).alias("logfc_detected"))


def auc_pairs(spark: SparkSession, d: str) -> DataFrame:
    return mk.overlaps(_brand(spark, d)).select("feature", "block", "first", "second", F.round(mk.auc() + NUDGE, 6).alias("auc"))


def auc_pairs_lfc(spark: SparkSession, d: str) -> DataFrame:
    return mk.overlaps(_brand(spark, d), 5.0).select("feature", "block", "first", "second", F.round(mk.auc() + NUDGE, 6).alias("auc"))


_COLUMNS = [f"{s}_{e}" for e in mk.EFFECTS for s in ("mean", "median", "min", "max")]


_AVERAGES = ("self_average", "other_average", "self_detected", "other_detected")


def _scores(df: DataFrame, digits: int) -> DataFrame:
    return df.select("grp", "feature", *[_r(c, digits) for c in (*_AVERAGES, *_COLUMNS)], *[f"rank_{e}" for e in mk.EFFECTS])


def score_markers(spark: SparkSession, d: str) -> DataFrame:
    """All effects summarised per group and brand, averaged over regions. Counts, so that ties are exact."""
    return _scores(mk.score_markers(_brand(spark, d)), 8).drop(*_AVERAGES)


def score_markers_averages(spark: SparkSession, d: str) -> DataFrame:
    """The averages of score_markers, freed of the regions' effects."""
    return mk.others_of(mk.corrected_summaries(_brand(spark, d))).select("grp", "feature", *[_r(c) for c in _AVERAGES])


def score_markers_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same on the stored assay, for its eight large groups, all blocks as one."""
    a = assays.stored(spark, d).restrict(GROUPS).relabel()
    return _scores(mk.score_markers(a), 8)


def full_scores(spark: SparkSession, d: str) -> DataFrame:
    f = mk.full_scores(_brand(spark, d))
    return f.select("grp", "feature", F.explode("full_auc").alias("other", "auc")).select("grp", "feature", "other", _r("auc"))


def min_rank(spark: SparkSession, d: str) -> DataFrame:
    """Smallest rank of each feature over the comparisons of each first, on stored pairwise effects."""
    now = current_rows(table(spark, d, "pair_stats").filter("first <> ''"), ["first", "second", "feature"], "loaded_at", ["effect"])
    return mk.min_rank(now.filter("not isnan(effect)"), "effect", "min_rank")


def summary_marker_stats(spark: SparkSession, d: str) -> DataFrame:
    s = mk.summary_stats(_brand(spark, d).relabel())
    return s.select("grp", "feature", *[_r(c) for c in s.columns[2:]])


def welch_stats(spark: SparkSession, d: str) -> DataFrame:
    w = mk.welch_stats(_brand(spark, d).normalized())
    return w.select("feature", "block", "first", "second", _r("logfc"), _r("t_right", 5), _r("df", 4))


def wilcox_stats(spark: SparkSession, d: str) -> DataFrame:
    w = mk.wilcox_stats(_brand(spark, d))
    return w.select("feature", "block", "first", "second", "u", _r("sigma"), _r("z_left"), _r("z_right"))


def binom_effect(spark: SparkSession, d: str) -> DataFrame:
    b = mk.binom_stats(_brand(spark, d))
    return b.select("feature", "block", "first", "second", "detected_1", "detected_2", _r("logfc"))


def _pvalues(spark: SparkSession, d: str) -> DataFrame:
    """Stored pairwise p-values of all groups; current rows."""
    p = table(spark, d, "pair_stats").filter("first <> '' and second <> ''")
    p = p.join(table(spark, d, "features").select("feature"), "feature")
    now = current_rows(p, ["first", "second", "feature"], "loaded_at", ["effect", "p_value"])
    return now.select("first", "second", "feature", F.when(~F.isnan("effect"), F.col("effect")).alias("effect"), "p_value")


def _combine(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        c = mk.combine_markers(_pvalues(spark, d), table(spark, d, "features"), effect="effect", pval_type=kind)
        top = ["top"] if kind == "any" else []
        return c.select("grp", "feature", *top, _p9("p_value"), _p9("fdr"), _r("summary"), F.size("effects").alias("n_effects"))

    query.__doc__ = f"Stored pairwise p-values combined per group, type {kind}."
    return query


def _pair_bh(spark: SparkSession, d: str) -> DataFrame:
    return testing.benjamini_hochberg(_pvalues(spark, d), "p_value", ["first", "second"], "fdr")


def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    return _pair_bh(spark, d).select("first", "second", "feature", _p9("fdr"))


def log_bh(spark: SparkSession, d: str) -> DataFrame:
    """Corrected p-values on the ln scale; a p-value of 0 counts, with ln 0 as -infinity."""
    x = _pvalues(spark, d).filter("p_value is not null").withColumn("lp", F.when(F.col("p_value") > 0, F.log("p_value")).otherwise(float("-inf")))
    return testing.benjamini_hochberg(x, "lp", ["first", "second"], "log_fdr", log=True).select("first", "second", "feature", _r("log_fdr"))


def bh_whole_table(spark: SparkSession, d: str) -> DataFrame:
    """One family over all current rows of pair_stats, without a window over all of them."""
    p = table(spark, d, "pair_stats").filter("first <> ''")
    now = current_rows(p, ["first", "second", "feature"], "loaded_at", ["p_value"])
    return testing.bh_large(now, "p_value", "fdr").select("first", "second", "feature", _p9("fdr"))


def fisher_combine(spark: SparkSession, d: str) -> DataFrame:
    """p-values of a feature's comparisons combined; a p-value of 0 makes the combined one 0."""
    return testing.fisher(_pvalues(spark, d), "p_value", ["first", "feature"], "p").select("first", "feature", _p9("p"))


def simes_combine(spark: SparkSession, d: str) -> DataFrame:
    return testing.simes(_pvalues(spark, d), "p_value", ["first", "feature"], "p").select("first", "feature", _p9("p"))


def berger_combine(spark: SparkSession, d: str) -> DataFrame:
    return testing.berger(_pvalues(spark, d), "p_value", ["first", "feature"], "p").select("first", "feature", _p9("p"))


def holm_combine(spark: SparkSession, d: str) -> DataFrame:
    return testing.holm_middle(_pvalues(spark, d), "p_value", ["first", "feature"], "p").select("first", "feature", _p9("p"))


def top_markers(spark: SparkSession, d: str) -> DataFrame:
    return mk.top_markers(_pair_bh(spark, d), table(spark, d, "features"), 10, effect="effect")


def top_markers_combined(spark: SparkSession, d: str) -> DataFrame:
    return mk.top_markers(_pair_bh(spark, d), table(spark, d, "features"), 3, False, "any", effect="effect")


def multi_marker_max(spark: SparkSession, d: str) -> DataFrame:
    """The any and all combinations of the same pairs joined: worst p of both."""
    f = table(spark, d, "features")
    one, two = (mk.combine_markers(_pvalues(spark, d), f, effect="effect", pval_type=k).select("grp", "feature", "p_value", "summary") for k in ("any", "all"))
    m = mk.multi_markers({"any": one, "all": two})
    return m.select("grp", "feature", _p9("p_value"), _p9("any_p_value"), _p9("all_p_value"), _p9("fdr"))


def marker_effects(spark: SparkSession, d: str) -> DataFrame:
    c = mk.combine_markers(_pvalues(spark, d), table(spark, d, "features"), effect="effect")
    return mk.marker_effects(c).select("grp", "feature", "other", "effect")


def _find(test: str, kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        a = _brand(spark, d)
        m = mk.find_markers(a.normalized() if test == "t" else a, test, kind, add_summary=True)
        return m.select("grp", "feature", "top", _r("p_value", 8), _r("fdr", 8), _r("summary"), _r("self_average"), _r("other_average"))

    query.__doc__ = f"Markers of each segment by {test} tests, combined as {kind}."
    return query


QUERIES = {
    "moments_blocked": moments_blocked, "moments_stored": moments_stored, "lognorm_moments": lognorm_moments, "lognorm_moments_pseudo": lognorm_moments_pseudo,
    "cv2_blocked": cv2_blocked, "size_factors": size_factors, "spike_size_factors": spike_size_factors, "average_counts": average_counts, "group_summary": group_summary, "pseudobulk_sum": pseudobulk_sum,
    "cohen_d": cohen_d, "cohen_d_lfc": cohen_d_lfc, "detection_lfc": detection_lfc, "auc_pairs": auc_pairs, "auc_pairs_lfc": auc_pairs_lfc,
    "score_markers": score_markers, "score_markers_averages": score_markers_averages, "score_markers_stored": score_markers_stored, "full_scores": full_scores, "min_rank": min_rank, "summary_marker_stats": summary_marker_stats,
    "welch_stats": welch_stats, "wilcox_stats": wilcox_stats, "binom_effect": binom_effect,
    "combine_any": _combine("any"), "combine_some": _combine("some"), "combine_all": _combine("all"),
    "bh_adjust": bh_adjust, "log_bh": log_bh, "bh_whole_table": bh_whole_table, "fisher_combine": fisher_combine, "simes_combine": simes_combine, "berger_combine": berger_combine, "holm_combine": holm_combine,
    "top_markers": top_markers, "top_markers_combined": top_markers_combined, "multi_marker_max": multi_marker_max, "marker_effects": marker_effects,
    "find_markers_t": _find("t", "any"), "find_markers_wilcox": _find("wilcox", "some"), "find_markers_binom": _find("binom", "all"),
}

_M = S.moments("x", "block, grp")
_Y = S.moments("y", "block, grp")
_PAIRS = "FROM m a JOIN m b ON a.feature = b.feature AND a.block = b.block AND a.grp <> b.grp"
_KEYS = "a.feature AS feature, a.block AS block, a.grp AS first, b.grp AS second"
_COHEN = "CASE WHEN a.variance IS NULL OR b.variance IS NULL THEN NULL WHEN a.mean - b.mean - {lfc} = 0 THEN 0 WHEN a.variance + b.variance > 0 THEN (a.mean - b.mean - {lfc}) / sqrt((a.variance + b.variance) / 2) END"
_DET = "log2((a.detected + a.n / least(a.n, b.n)) / (a.n + 2 * a.n / least(a.n, b.n))) - log2((b.detected + b.n / least(a.n, b.n)) / (b.n + 2 * b.n / least(a.n, b.n)))"
_DETM = "log2((a.detected + 2 * a.n / (a.n + b.n)) / (a.n + 4 * a.n / (a.n + b.n))) - log2((b.detected + 2 * b.n / (a.n + b.n)) / (b.n + 4 * b.n / (a.n + b.n)))"


def _u(lfc: float = 0.0, block: str = "block") -> str:
    """CTEs h (counts per value and group, zeros included) and u (overlaps)."""
    return f"""h0 AS (SELECT feature, {block} AS block, grp, value, count(*) AS c FROM x JOIN o ON x.obs = o.obs WHERE block IS NOT NULL AND grp IS NOT NULL GROUP BY ALL),
hl AS (SELECT {block} AS block, grp, count(*) AS n FROM o WHERE block IS NOT NULL AND grp IS NOT NULL GROUP BY ALL),
h AS (SELECT * FROM h0 UNION ALL SELECT f.feature, hl.block, hl.grp, 0, n - coalesce(k, 0) FROM f CROSS JOIN hl
  LEFT JOIN (SELECT feature, block, grp, sum(c) AS k FROM h0 GROUP BY ALL) z ON z.feature = f.feature AND z.block = hl.block AND z.grp = hl.grp),
w AS (SELECT feature, block, value - {lfc} AS value, grp, c AS l, 0 AS r FROM h UNION ALL SELECT feature, block, value, grp, 0, c FROM h),
v AS (SELECT feature, block, grp, value, sum(l) AS l, sum(r) AS r FROM w GROUP BY ALL),
rr AS (SELECT v.*, sum(r) OVER (PARTITION BY feature, block, grp ORDER BY value) - r AS below FROM v),
vals AS (SELECT DISTINCT feature, block, value FROM v WHERE l > 0),
g AS (SELECT vals.feature AS feature, vals.block AS block, vals.value AS value, hl.grp AS grp FROM vals JOIN hl ON vals.block = hl.block),
cum AS (SELECT g.feature AS feature, g.block AS block, g.value AS value, g.grp AS grp, rr.value AS at, rr.below AS below, rr.r AS r FROM g ASOF LEFT JOIN rr
  ON g.feature = rr.feature AND g.block = rr.block AND g.grp = rr.grp AND g.value >= rr.value),
u AS (SELECT a.feature AS feature, a.block AS block, a.grp AS first, b.grp AS second,
  CAST(sum(a.l * CASE WHEN b.at IS NULL THEN 0 WHEN b.at = a.value THEN b.below + b.r / 2 ELSE b.below + b.r END) AS DOUBLE) AS u
  FROM v a JOIN cum b ON a.feature = b.feature AND a.block = b.block AND a.value = b.value AND a.grp <> b.grp WHERE a.l > 0 GROUP BY ALL),
auc AS (SELECT u.*, p.n AS n1, q.n AS n2, u / (p.n * q.n) AS auc FROM u JOIN hl p ON u.block = p.block AND first = p.grp JOIN hl q ON u.block = q.block AND second = q.grp)"""


def _score(assay: str, digits: int, block: bool = True) -> str:
    stats = ", ".join(
        f"round(avg({e}), {digits}) AS mean_{e}, round(median({e}), {digits}) AS median_{e}, round(min({e}), {digits}) AS min_{e}, round(max({e}), {digits}) AS max_{e}, CAST(min(r_{e}) AS INT) AS rank_{e}"
        for e in mk.EFFECTS
    )
    ranks = ", ".join(f"CASE WHEN {e} IS NOT NULL THEN rank() OVER (PARTITION BY first, second, {e} IS NULL ORDER BY round({e}, 10) DESC) END AS r_{e}" for e in mk.EFFECTS)
    means = ", ".join(f"sum({e} * n1 * n2) / sum(n1 * n2) FILTER ({e} IS NOT NULL) AS {e}" for e in mk.EFFECTS)
    return f"""WITH {assay}, {S.moments("x", "block, grp")}, {_u()},
e AS (SELECT {_KEYS}, a.n AS n1, b.n AS n2, {_COHEN.format(lfc=0)} AS logfc_cohen, {_DET} AS logfc_detected {_PAIRS}),
s AS (SELECT first, second, feature, {means} FROM e JOIN (SELECT feature, block, first, second, auc FROM auc) USING (feature, block, first, second) GROUP BY first, second, feature),
t AS (SELECT *, {ranks} FROM s),
k AS (SELECT first AS grp, feature, {stats} FROM t GROUP BY 1, 2),
gm AS (SELECT feature, grp, sum(mean * n) / sum(n) AS a, sum(detected) / sum(n) AS d FROM m GROUP BY ALL),
sm AS (SELECT grp, feature, round(a, {digits}) AS self_average, round((sum(a) OVER w - a) / (count(*) OVER w - 1), {digits}) AS other_average,
  round(d, {digits}) AS self_detected, round((sum(d) OVER w - d) / (count(*) OVER w - 1), {digits}) AS other_detected FROM gm WINDOW w AS (PARTITION BY feature))
SELECT * FROM sm JOIN k USING (grp, feature)"""


_G = ", ".join(f"'{g}'" for g in GROUPS)
_P = f"""pv AS (SELECT first, second, feature, feature_idx, CASE WHEN NOT isnan(m.e) THEN m.e END AS effect, m.p AS p_value FROM (
  SELECT first, second, feature, arg_max({{'e': effect, 'p': p_value}}, loaded_at) AS m FROM pair_stats WHERE first <> '' AND second <> '' GROUP BY 1, 2, 3)
  JOIN features USING (feature))"""
_PBH = f"""{_P}, pr AS (SELECT *, p_value AS p, row_number() OVER (PARTITION BY first, second ORDER BY p_value) AS r, count(*) OVER (PARTITION BY first, second) AS m FROM pv WHERE p_value IS NOT NULL),
pb AS (SELECT first, second, feature, feature_idx, effect, p_value, {S.BH.format(by="first, second")} AS fdr FROM pr)"""


def _comb(kind: str) -> str:
    """CTE c<kind> with grp, feature, top, p_value, summary, fdr."""
    p = {"any": "least(1, min(p_value * m / k))", "some": "min(h) FILTER (k = greatest(1, ceil(m * 0.5)))", "all": "max(p_value)"}[kind]
    s = {"any": "arg_min(effect_, (p_value, second))", "some": "min(effect) FILTER (k = greatest(1, ceil(m * 0.5)))", "all": "arg_max(effect_, (p_value, second))"}[kind]
    s = s if kind == "some" else f"({s}).e"
    return f"""{kind}_1 AS (SELECT *, {{'e': effect}} AS effect_, row_number() OVER (PARTITION BY first, second ORDER BY p_value, feature_idx) AS rk,
  count(*) OVER (PARTITION BY first, feature) AS m, row_number() OVER (PARTITION BY first, feature ORDER BY p_value, effect NULLS FIRST, second) AS k FROM pv WHERE p_value IS NOT NULL),
{kind}_2 AS (SELECT *, least(1, max((m - k + 1) * p_value) OVER (PARTITION BY first, feature ORDER BY k ROWS UNBOUNDED PRECEDING)) AS h FROM {kind}_1),
{kind}_3 AS (SELECT first AS grp, feature, CAST(min(rk) AS INT) AS top, {p} AS p, {s} AS summary FROM {kind}_2 GROUP BY 1, 2),
{kind}_4 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p) AS r, count(*) OVER (PARTITION BY grp) AS m FROM {kind}_3),
{kind}_5 AS (SELECT *, {S.BH.format(by="grp")} AS fdr FROM {kind}_4),
c{kind} AS (SELECT z.first AS grp, z.feature AS feature, top, p AS p_value, summary, fdr, ne AS n_effects
  FROM (SELECT first, feature, CAST(count(*) AS INT) AS ne FROM pv GROUP BY 1, 2) z LEFT JOIN {kind}_5 q ON z.first = q.grp AND z.feature = q.feature)"""


SQL = {
    "moments_blocked": f"WITH {S.PART}, {S.moments('x', 'block')} SELECT feature, block, n, round(mean, 6) AS mean, round(variance, 6) AS variance, detected FROM m",
    "moments_stored": f"WITH {S.STORED}, {S.moments('x', 'block')} SELECT feature, block, n, round(mean, 6) AS mean, round(variance, 6) AS variance, detected FROM m",
    "lognorm_moments": f"WITH {S.BRAND}, {S.moments('y', 'block')} SELECT feature, block, n, round(mean, 6) AS mean, round(variance, 6) AS variance FROM m",
    "lognorm_moments_pseudo": f"""WITH {S.BRAND}, d AS (SELECT f.feature AS feature, o.block AS block, log2(coalesce(x.value, 0) / o.size_factor + 2) AS v
  FROM f CROSS JOIN o LEFT JOIN x ON x.feature = f.feature AND x.obs = o.obs)
SELECT feature, block, count(*) AS n, round(avg(v), 6) AS mean, round(var_samp(v), 6) AS variance FROM d GROUP BY feature, block""",
    "cv2_blocked": f"""WITH {S.BRAND}, z AS (SELECT x.feature AS feature, x.obs AS obs, x.value / size_factor AS value FROM x JOIN o ON x.obs = o.obs), {S.moments('z', 'block')}
SELECT feature, block, round(mean, 6) AS mean, round(variance / (mean * mean), 6) AS cv2 FROM m""",
    "size_factors": f"WITH {S.BRAND} SELECT obs, round(size_factor, 6) AS size_factor FROM o",
    "spike_size_factors": f"""WITH {S.BRAND}, j AS (SELECT o.*, abs(c_acctbal) + 1 AS spike FROM o JOIN customer ON obs = c_custkey)
SELECT obs, round(size_factor / avg(size_factor) OVER (), 5) AS size_factor,
  round(spike / avg(spike) OVER (PARTITION BY block) * avg(size_factor) OVER (PARTITION BY block) / avg(size_factor) OVER (), 5) AS spike FROM j""",
    "average_counts": f"WITH {S.BRAND} SELECT f.feature AS feature, round(coalesce(sum(value / size_factor), 0) / (SELECT count(*) FROM o), 6) AS average FROM f LEFT JOIN x ON f.feature = x.feature LEFT JOIN o ON x.obs = o.obs GROUP BY f.feature",
    "group_summary": f"WITH {S.BRAND}, {S.moments('x', 'grp')} SELECT feature, grp, n, round(mean * n, 4) AS total, round(mean, 6) AS mean, round(detected / n, 6) AS detected_share FROM m",
    "pseudobulk_sum": f"WITH {S.BRAND}, {S.moments('x', 'grp, block')} SELECT feature, grp AS label, block AS sample, n, round(mean * n, 4) AS total FROM m",
    "cohen_d": f"WITH {S.BRAND}, {_Y} SELECT {_KEYS}, round({_COHEN.format(lfc=0)}, 6) AS logfc_cohen {_PAIRS}",
    "cohen_d_lfc": f"WITH {S.BRAND}, {_Y} SELECT {_KEYS}, round({_COHEN.format(lfc=0.5)}, 6) AS logfc_cohen {_PAIRS}",
    "detection_lfc": f"WITH {S.BRAND}, {_M} SELECT {_KEYS}, round({_DET}, 6) AS logfc_detected {_PAIRS}",
    "auc_pairs": f"WITH {S.BRAND}, {_u()} SELECT feature, block, first, second, round(auc, 6) AS auc FROM auc",
    "auc_pairs_lfc": f"WITH {S.BRAND}, {_u(5)} SELECT feature, block, first, second, round(auc, 6) AS auc FROM auc",
    "score_markers": _score(S.BRAND, 8).replace("SELECT * FROM sm JOIN k USING (grp, feature)", "SELECT * FROM k"),
    "score_markers_stored": _score(S.STORED.replace("o AS (", "o AS (SELECT obs, grp, 'all' AS block FROM (").replace("GROUP BY obs)),", f"GROUP BY obs)) WHERE grp IN ({_G})),"), 8),
    "full_scores": f"WITH {S.BRAND}, {_u()} SELECT first AS grp, feature, second AS other, round(sum(auc * n1 * n2) / sum(n1 * n2), 6) AS auc FROM auc GROUP BY 1, 2, 3",
    "min_rank": """WITH now AS (SELECT first, second, feature, m.e AS effect FROM (
  SELECT first, second, feature, arg_max({'e': effect}, loaded_at) AS m FROM pair_stats WHERE first <> '' GROUP BY ALL)),
r AS (SELECT first, feature, rank() OVER (PARTITION BY first, second ORDER BY round(effect, 10) DESC) AS r FROM now WHERE effect IS NOT NULL AND NOT isnan(effect))
SELECT first AS grp, feature, CAST(min(r) AS INT) AS min_rank FROM r GROUP BY 1, 2""",
    "summary_marker_stats": f"""WITH {S.BRAND}, {S.moments('x', 'grp')} SELECT grp, feature, round(mean, 6) AS self_average, round((sum(mean) OVER w - mean) / (count(*) OVER w - 1), 6) AS other_average,
  round(detected / n, 6) AS self_detected, round((sum(detected / n) OVER w - detected / n) / (count(*) OVER w - 1), 6) AS other_detected FROM m WINDOW w AS (PARTITION BY feature)""",
    "welch_stats": f"""WITH {S.BRAND}, {_Y}, w AS (SELECT {_KEYS}, a.mean - b.mean AS d, greatest(a.variance, 1e-8) / a.n AS e1, greatest(b.variance, 1e-8) / b.n AS e2, a.n AS n1, b.n AS n2 {_PAIRS})
SELECT feature, block, first, second, round(d, 6) AS logfc, CASE WHEN n1 > 1 AND n2 > 1 THEN round(d / sqrt(e1 + e2), 5) END AS t_right,
  CASE WHEN n1 > 1 AND n2 > 1 THEN round((e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)), 4) END AS df FROM w""",
    "wilcox_stats": f"""WITH {S.BRAND}, {_u()}, tt AS (SELECT a.feature AS feature, a.block AS block, a.grp AS first, b.grp AS second, sum((a.c + b.c) * (a.c + b.c) * (a.c + b.c) - (a.c + b.c)) AS t,
  FROM (SELECT feature, block, value, grp, c FROM h UNION ALL SELECT k.feature, k.block, k.value, hl.grp, 0 FROM (SELECT DISTINCT feature, block, value FROM h) k JOIN hl ON k.block = hl.block
    LEFT JOIN h ON h.feature = k.feature AND h.block = k.block AND h.value = k.value AND h.grp = hl.grp WHERE h.c IS NULL) a
  JOIN (SELECT feature, block, value, grp, c FROM h UNION ALL SELECT k.feature, k.block, k.value, hl.grp, 0 FROM (SELECT DISTINCT feature, block, value FROM h) k JOIN hl ON k.block = hl.block
    LEFT JOIN h ON h.feature = k.feature AND h.block = k.block AND h.value = k.value AND h.grp = hl.grp WHERE h.c IS NULL) b
  ON a.feature = b.feature AND a.block = b.block AND a.value = b.value AND a.grp <> b.grp GROUP BY ALL),
j AS (SELECT *, greatest(sqrt(greatest(n1 * n2 / 12 * ((n1 + n2 + 1) - CAST(t AS DOUBLE) / ((n1 + n2) * (n1 + n2 - 1))), 0)), 1e-8) AS s FROM auc JOIN tt USING (feature, block, first, second))
SELECT feature, block, first, second, u, round(s, 6) AS sigma, round((u - n1 * n2 / 2 + 0.5) / s, 6) AS z_left, round((u - n1 * n2 / 2 - 0.5) / s, 6) AS z_right FROM j""",
    "binom_effect": f"WITH {S.BRAND}, {_M} SELECT {_KEYS}, a.detected AS detected_1, b.detected AS detected_2, round({_DETM}, 6) AS logfc {_PAIRS}",
    "combine_any": f"WITH {_P}, {_comb('any')} SELECT grp, feature, top, round(p_value, 9) AS p_value, round(fdr, 9) AS fdr, round(summary, 6) AS summary, n_effects FROM cany",
    "combine_some": f"WITH {_P}, {_comb('some')} SELECT grp, feature, round(p_value, 9) AS p_value, round(fdr, 9) AS fdr, round(summary, 6) AS summary, n_effects FROM csome",
    "combine_all": f"WITH {_P}, {_comb('all')} SELECT grp, feature, round(p_value, 9) AS p_value, round(fdr, 9) AS fdr, round(summary, 6) AS summary, n_effects FROM call",
    "bh_adjust": f"WITH {_PBH} SELECT first, second, feature, round(fdr, 9) AS fdr FROM pb UNION ALL SELECT first, second, feature, NULL FROM pv WHERE p_value IS NULL",
    "log_bh": f"""WITH {_P}, l AS (SELECT *, CASE WHEN p_value > 0 THEN ln(p_value) ELSE CAST('-infinity' AS DOUBLE) END AS p,
  row_number() OVER (PARTITION BY first, second ORDER BY p_value) AS r, count(*) OVER (PARTITION BY first, second) AS m FROM pv WHERE p_value IS NOT NULL)
SELECT first, second, feature, round(least(0, min(p + ln(m / r)) OVER (PARTITION BY first, second ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS log_fdr FROM l""",
    "bh_whole_table": """WITH now AS (SELECT first, second, feature, m.p AS p FROM (SELECT first, second, feature, arg_max({'p': p_value}, loaded_at) AS m FROM pair_stats WHERE first <> '' GROUP BY ALL)),
r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM now WHERE p IS NOT NULL)
SELECT first, second, feature, round(least(1, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS fdr FROM r
UNION ALL SELECT first, second, feature, NULL FROM now WHERE p IS NULL""",
    "fisher_combine": f"""WITH {_P}, s AS (SELECT first, feature, -sum(CASE WHEN p_value > 0 THEN ln(p_value) END) AS y, count(*) AS k, min(p_value) AS low FROM pv WHERE p_value IS NOT NULL GROUP BY 1, 2)
SELECT first, feature, round(CASE WHEN low = 0 THEN 0 WHEN y <= 0 THEN 1 ELSE least(1, (SELECT sum(exp(j * ln(y) - lgamma(j + 1) - y)) FROM range(0, 1000) t(j) WHERE j < k)) END, 9) AS p FROM s""",
    "simes_combine": f"WITH {_P}, k AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY first, feature) AS m FROM pv WHERE p_value IS NOT NULL WINDOW w AS (PARTITION BY first, feature ORDER BY p_value)) SELECT first, feature, round(least(1, min(p_value * m / k)), 9) AS p FROM k GROUP BY 1, 2",
    "berger_combine": f"WITH {_P} SELECT first, feature, round(max(p_value), 9) AS p FROM pv WHERE p_value IS NOT NULL GROUP BY 1, 2",
    "holm_combine": f"""WITH {_P}, k AS (SELECT *, row_number() OVER (PARTITION BY first, feature ORDER BY p_value) AS k, count(*) OVER (PARTITION BY first, feature) AS m FROM pv WHERE p_value IS NOT NULL),
h AS (SELECT *, least(1, max((m - k + 1) * p_value) OVER (PARTITION BY first, feature ORDER BY k ROWS UNBOUNDED PRECEDING)) AS h FROM k)
SELECT first, feature, round(h, 9) AS p FROM h WHERE k = greatest(1, ceil(m * 0.5))""",
    "top_markers": f"WITH {_PBH}, t AS (SELECT *, row_number() OVER (PARTITION BY first, second ORDER BY p_value, feature_idx) AS place FROM pb WHERE fdr <= 0.05) SELECT first, second, feature, CAST(place AS INT) AS place FROM t WHERE place <= 10",
    "top_markers_combined": f"WITH {_P}, {_comb('any')} SELECT grp, feature, top AS place FROM cany WHERE fdr <= 0.05 AND top <= 3",
    "multi_marker_max": f"""WITH {_P}, {_comb('any')}, {_comb('all')}, j AS (SELECT cany.grp AS grp, cany.feature AS feature, cany.p_value AS a, call.p_value AS b, greatest(cany.p_value, call.p_value) AS p
  FROM cany JOIN call ON cany.grp = call.grp AND cany.feature = call.feature),
k AS (SELECT *, row_number() OVER (PARTITION BY grp, p IS NULL ORDER BY p) AS r, count(p) OVER (PARTITION BY grp) AS m FROM j)
SELECT grp, feature, round(p, 9) AS p_value, round(a, 9) AS any_p_value, round(b, 9) AS all_p_value,
  CASE WHEN p IS NOT NULL THEN round(least(1, min(p * m / r) OVER (PARTITION BY grp, p IS NULL ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) END AS fdr FROM k""",
    "marker_effects": f"WITH {_P} SELECT first AS grp, feature, second AS other, effect FROM pv",
}
SQL = {name: text.replace(", 6) AS ", " + 1e-9, 6) AS ").replace(", 9) AS ", " + 1e-13, 9) AS ") for name, text in SQL.items()}
