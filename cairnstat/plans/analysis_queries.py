"""Queries on correlation, variance models, linear models, components, graphs and marker pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnstat.functions.fits import fit_trend_var
from cairnstat.operators import classify as cl, correlation as co, graphs as gr, linear as li, markers as mk, pooling, ranks as rk, reduction as re, variance as va
from cairnstat.operators.current import current_rows
from cairnstat.operators.moments import moments
from cairnstat.plans import sql as S
from cairnstat.session import materialize
from cairnstat.sources import assays, table
from cairnstat.sources.assays import Assay
from cairnstat.streaming.moments import windowed_moments


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _whole(a: Assay) -> Assay:
    return a.relabel()


# correlation


def spearman_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of all pairs of brands over all customers, zeros included."""
    c = co.spearman(_whole(assays.brand_by_customer(spark, d)))
    return c.select("gene1", "gene2", _r("rho"), "n")


def spearman_blocked(spark: SparkSession, d: str) -> DataFrame:
    """The same within regions, averaged."""
    c = co.spearman(assays.brand_by_customer(spark, d))
    return c.select("gene1", "gene2", _r("rho"), "n")


def correlate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """With p-values and FDR, smallest p first."""
    c = co.spearman(assays.brand_by_customer(spark, d))
    return c.select("gene1", "gene2", _r("rho"), _r("p_value", 8), _r("fdr", 8)).orderBy("p_value", F.abs("rho").desc())


def spearman_signed(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of embedding dimensions, which have values of both signs."""
    c = co.spearman(assays.embedding_dimensions(spark, d))
    return c.select("gene1", "gene2", _r("rho"), "n")


def correlate_genes(spark: SparkSession, d: str) -> DataFrame:
    """Per brand: its strongest correlation and Simes p."""
    return co.per_feature(co.spearman(_whole(assays.brand_by_customer(spark, d)))).select("gene", _r("rho"), _r("p_value", 8), _r("fdr", 8))


def gene_simes(spark: SparkSession, d: str) -> DataFrame:
    """Simes p and strongest effect per group from stored pairs of groups."""
    now = current_rows(table(spark, d, "pair_stats").filter("first <> '' and second <> ''"), ["first", "second", "feature"], "loaded_at", ["effect", "p_value"])
    pairs = now.filter("p_value is not null and effect is not null and not isnan(effect)").groupBy(F.col("first").alias("gene1"), F.col("second").alias("gene2")).agg(
        F.max("effect").alias("rho"), F.min("p_value").alias("p_value")
    )
    return co.per_feature(pairs).select("gene", _r("rho"), _r("p_value", 9))


def correlate_null(spark: SparkSession, d: str) -> DataFrame:
    """Null rank correlations of as many observations as there are nations, in two designs."""
    table(spark, d, "nation")
    a = co.null_correlations(spark, 25, 10_000).withColumn("kind", F.lit("plain"))
    b = co.null_correlations(spark, 25, 10_000, blocks=[10, 15]).withColumn("kind", F.lit("blocked"))
    return a.unionByName(b)


def correlate_pairs_design(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of residuals on account balance."""
    a, x = _design(spark, d)
    return co.spearman_residuals(a, x, ["one", "balance"]).select("gene1", "gene2", _r("rho"), "n")


# ranks


def scaled_ranks(spark: SparkSession, d: str) -> DataFrame:
    return rk.scaled_column_ranks(assays.brand_by_customer(spark, d)).select("feature", "obs", _r("value"))


def scaled_ranks_sparse(spark: SparkSession, d: str) -> DataFrame:
    return rk.scaled_column_ranks(assays.brand_by_customer(spark, d), min_mean=0.5, sparse=True).select("feature", "obs", _r("value"))


def _part_stats(spark: SparkSession, d: str) -> DataFrame:
    m = moments(_whole(assays.part_by_supplier(spark, d)), ["block"])
    return m.select("feature", "mean", "variance", (F.col("variance") / (F.col("mean") * F.col("mean"))).alias("cv2"))


def dm_running_median(spark: SparkSession, d: str) -> DataFrame:
    return rk.distance_to_median(_part_stats(spark, d).select("feature", F.round("mean", 9).alias("mean"), F.round("cv2", 9).alias("cv2"))).select("feature", _r("dm"))


# variance


def top_hvg(spark: SparkSession, d: str) -> DataFrame:
    """The tenth of the parts with the highest variance, above 1."""
    return va.top_features(_part_stats(spark, d).withColumn("variance", F.round("variance", 6)), "variance", n=20, prop=0.1, threshold=1.0)


def model_var(spark: SparkSession, d: str) -> DataFrame:
    m = va.model_var(_whole(assays.part_by_supplier(spark, d)).normalized())
    return m.select("feature", _r("mean"), _r("total"), _r("tech"), _r("bio"), _r("p_value", 8), _r("fdr", 8))


def model_var_blocked(spark: SparkSession, d: str) -> DataFrame:
    m = va.model_var(assays.part_by_supplier(spark, d).relabel(block="grp").normalized())
    return m.select("feature", _r("mean"), _r("total"), _r("tech"), _r("bio"), _r("p_value", 8), _r("fdr", 8), F.size("per_block").alias("n_blocks"))


def _split(spark: SparkSession, d: str) -> tuple[Assay, Assay]:
    """Parts, and every tenth of them as if they were spike-ins."""
    a = _whole(assays.part_by_supplier(spark, d))
    spike = F.col("feature").cast("bigint") % 10 == 0
    return Assay(a.values.filter(~spike), a.features.filter(~spike), a.observations), Assay(a.values.filter(spike), a.features.filter(spike), a.observations)


def model_var_spikes(spark: SparkSession, d: str) -> DataFrame:
    m = va.model_var_spikes(*_split(spark, d))
    return m.select("feature", _r("mean"), _r("total"), _r("tech"), _r("bio"), _r("p_value", 8), _r("fdr", 8))


def model_var_poisson(spark: SparkSession, d: str) -> DataFrame:
    m = va.model_var_poisson(_whole(assays.part_by_supplier(spark, d)))
    return m.select("feature", _r("mean"), _r("total"), _r("tech"), _r("bio"), _r("p_value", 8), _r("fdr", 8))


def model_cv2(spark: SparkSession, d: str) -> DataFrame:
    m = va.model_cv2(_whole(assays.part_by_supplier(spark, d)))
    return m.select("feature", _r("mean"), _r("total"), _r("trend"), _r("ratio"), _r("p_value", 8), _r("fdr", 8))


def model_cv2_spikes(spark: SparkSession, d: str) -> DataFrame:
    m = va.model_cv2(*_split(spark, d))
    return m.select("feature", _r("mean"), _r("total"), _r("trend"), _r("ratio"), _r("p_value", 8), _r("fdr", 8))


def combine_var(spark: SparkSession, d: str) -> DataFrame:
    """Two decompositions of the same features combined."""
    a = _whole(assays.part_by_supplier(spark, d))
    one, two = va.model_var(a.normalized()), va.model_var_poisson(a)
    m = va.combine_tables([one, two], weights=[2.0, 1.0])
    return m.select("feature", _r("mean"), _r("total"), _r("tech"), _r("bio"), _r("p_value", 8), _r("fdr", 8))


def combine_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Moments of each region averaged with weights, and their p-values (one each) combined by Fisher."""
    m = moments(assays.brand_by_customer(spark, d), ["block"]).withColumn("log_p", -F.col("detected") / F.col("n"))
    c = va.combine_blocks(m, ["mean", "variance"], weight="n")
    return c.select("feature", _r("mean"), _r("variance"), _r("p_value", 9), _r("fdr", 9))


def combine_blocks_geometric(spark: SparkSession, d: str) -> DataFrame:
    m = moments(assays.brand_by_customer(spark, d), ["block"]).withColumn("log_p", -F.col("detected") / F.col("n"))
    c = va.combine_blocks(m.filter("mean > 0 and variance > 0"), ["mean", "variance"], geometric=True)
    return c.select("feature", _r("mean"), _r("variance"), _r("p_value", 9))


def size_factors_pooled(spark: SparkSession, d: str) -> DataFrame:
    return pooling.pooled_size_factors(assays.brand_by_customer(spark, d)).select("obs", _r("size_factor"))


# linear models


def _design(spark: SparkSession, d: str) -> tuple[Assay, DataFrame]:
    a = assays.brand_by_customer(spark, d)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("obs"), (F.col("c_acctbal") / 1000).alias("balance"))
    x = a.observations.join(c, "obs").withColumn("one", F.lit(1.0)).withColumn("asia", (F.col("block") == "ASIA").cast("double")).withColumn("auto", (F.col("grp") == "AUTOMOBILE").cast("double"))
    return a, materialize(x)


def simple_ols(spark: SparkSession, d: str) -> DataFrame:
    """Intercept, slope on account balance and residual variance of each brand's counts."""
    a, x = _design(spark, d)
    fit, _, _ = li.least_squares(a.values, a.features, x, ["one", "balance"])
    return fit.select("feature", _r("b0"), _r("b1"), _r("sigma2", 5))


def residual_variance(spark: SparkSession, d: str) -> DataFrame:
    a, x = _design(spark, d)
    return li.residual_moments(a, x, ["one", "balance"]).select("feature", _r("mean"), _r("variance", 5))


def linear_model(spark: SparkSession, d: str) -> DataFrame:
    a, x = _design(spark, d)
    t = li.contrast_test(a.normalized(), x, ["one", "asia", "auto", "balance"])
    return t.select("feature", _r("logfc"), _r("p_value", 8), _r("fdr", 8))


def linear_model_f(spark: SparkSession, d: str) -> DataFrame:
    a, x = _design(spark, d)
    t = li.contrast_test(a.normalized(), x, ["one", "asia", "auto", "balance"], coefs=[1, 2])
    return t.select("feature", _r("asia"), _r("auto"), _r("p_value", 8), _r("fdr", 8))


def linear_model_blocked(spark: SparkSession, d: str) -> DataFrame:
    a, x = _design(spark, d)
    t = li.contrast_test_blocked(a.normalized(), x, ["one", "auto"])
    return t.select("feature", _r("logfc"), _r("p_value", 8), _r("fdr", 8))


def pairwise_t_design(spark: SparkSession, d: str) -> DataFrame:
    """Segments compared in one model with account balance."""
    a, x = _design(spark, d)
    t = li.pairwise_t_design(a.normalized(), x, ["balance"])
    return t.select("feature", "first", "second", _r("logfc"), _r("p_value", 8), _r("fdr", 8))


def model_var_design(spark: SparkSession, d: str) -> DataFrame:
    a, x = _design(spark, d)
    m = va.model_var_design(a.normalized(), x, ["one", "balance"])
    return m.select("feature", _r("mean"), _r("total"), _r("tech"), _r("bio"), _r("p_value", 8), _r("fdr", 8))


def corrected_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Group averages freed of region effects."""
    c = mk.corrected_summaries(assays.brand_by_customer(spark, d))
    return c.select("grp", "feature", _r("average"), _r("detected_share"))


def _bulk(spark: SparkSession, d: str) -> DataFrame:
    """Counts per brand, region (label), supplier and line status (sample)."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = table(spark, d, "lineitem").join(s.select("s_suppkey", F.col("r_name").alias("label")), F.col("l_suppkey") == F.col("s_suppkey"))
    x = x.join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("feature")), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("label", F.concat_ws("_", (F.col("l_suppkey") % 4).cast("string"), "l_linestatus").alias("sample"), F.col("l_linestatus").alias("condition"), "feature").agg(F.sum("l_quantity").alias("value"))


def _by_condition(samples: pd.DataFrame) -> np.ndarray:
    return np.column_stack([np.ones(len(samples)), samples["condition"] == samples["condition"].max()])


def _dge(method: str, lfc: float = 0.0):
    def query(spark: SparkSession, d: str) -> DataFrame:
        t = li.pseudo_bulk(_bulk(spark, d), _by_condition, np.array([0.0, 1.0]), lfc, method)
        return t.select("label", "feature", _r("logfc"), _r("abundance"), _r("p_value", 8), _r("fdr", 8))

    query.__doc__ = f"Pseudo-bulk tests of line status within each region, {method}."
    return query


def pseudobulk_specific(spark: SparkSession, d: str) -> DataFrame:
    t = li.pseudo_bulk_specific(li.pseudo_bulk(_bulk(spark, d), _by_condition, np.array([0.0, 1.0])))
    return t.select("label", "feature", _r("logfc"), _r("other_average"), _r("p_value", 8), _r("fdr", 8))


def _label_tests(spark: SparkSession, d: str) -> DataFrame:
    now = current_rows(table(spark, d, "markers").filter("grp <> ''"), ["grp", "feature"], "loaded_at", ["logfc_cohen", "p_value"])
    return now.select(F.col("grp").alias("label"), "feature", F.when(~F.isnan("logfc_cohen"), F.col("logfc_cohen")).alias("logfc"), "p_value")


def decide_tests(spark: SparkSession, d: str) -> DataFrame:
    return li.decide_tests(_label_tests(spark, d))


def summarize_tests(spark: SparkSession, d: str) -> DataFrame:
    return li.summarize_tests(li.decide_tests(_label_tests(spark, d)))


# components


def pca(spark: SparkSession, d: str) -> DataFrame:
    """Variance shares of the embedding's components."""
    a = assays.embedding_dimensions(spark, d)
    c = re.components(a, 10, [f"d{i:02d}" for i in range(64)])
    return spark.createDataFrame([(i + 1, float(round(v, 6)), float(round(p, 4))) for i, (v, p) in enumerate(zip(c.variances, c.percent))], "component int, variance double, percent double")


def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    a = assays.embedding_dimensions(spark, d)
    c = re.components(a, 5, [f"d{i:02d}" for i in range(64)])
    return c.scores.select("obs", *[F.round(F.col("pc")[i], 4).alias(f"pc{i + 1}") for i in range(5)])


def pca_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Components of half of the dimensions, with loadings for all."""
    a = assays.embedding_dimensions(spark, d)
    c = re.components(a, 5, [f"d{i:02d}" for i in range(32)])
    return re.extrapolated_rotation(a, c).select("feature", *[F.round(F.col("loadings")[i], 4).alias(f"l{i + 1}") for i in range(5)])


def pca_low_rank(spark: SparkSession, d: str) -> DataFrame:
    a = assays.embedding_dimensions(spark, d)
    return re.low_rank(re.components(a, 5, [f"d{i:02d}" for i in range(64)])).select("feature", "obs", _r("value", 4))


def pca_total(spark: SparkSession, d: str) -> DataFrame:
    """Total variance over the components, which is that over the features."""
    c = re.components(assays.embedding_dimensions(spark, d), 64, [f"d{i:02d}" for i in range(64)])
    return spark.createDataFrame([(float(round(c.total, 6)), float(round(float(c.variances.sum()), 6)))], "total double, by_component double")


def denoise_rank(spark: SparkSession, d: str) -> DataFrame:
    """Components to keep when each of the parts' variances is one and a fifth of their sum is technical."""
    from pyspark.sql import Window

    v = _part_stats(spark, d).select("feature", F.round("variance", 6).alias("variance"))
    comp = v.select(F.row_number().over(Window.orderBy(F.col("variance").desc(), "feature")).alias("component"), "variance")
    total = float(v.agg(F.sum(F.col("variance").cast("decimal(30,6)"))).first()[0])
    return re.denoise_rank(comp, total, 0.2 * total)


def denoised_pcs(spark: SparkSession, d: str) -> DataFrame:
    """Components of the brands above a fitted trend."""
    a = _whole(assays.brand_by_customer(spark, d)).normalized()
    m = moments(a, ["block"]).select("mean", "variance").toPandas()
    trend = fit_trend_var(m["mean"], m["variance"], smooth=False)
    c = re.denoised(a, lambda x: 0.9 * trend(x))
    return c.scores.select("obs", F.size("pc").alias("n_components"), F.round(F.col("pc")[0], 4).alias("pc1"))


# graphs


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("obs"), F.col("embedding").cast("array<double>").alias("pc"))


def nearest_points(spark: SparkSession, d: str) -> DataFrame:
    return gr.nearest_points(_points(spark, d), 10).select("src", "dst", "place", _r("distance"))


def knn_edges(spark: SparkSession, d: str) -> DataFrame:
    return gr.knn_edges(_points(spark, d), 10)


def snn_edges(spark: SparkSession, d: str) -> DataFrame:
    return gr.snn_edges(_points(spark, d), 10)


def snn_edges_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return gr.snn_edges(_points(spark, d), 10, "jaccard").select("src", "dst", _r("weight"))


def modularity(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("obs"), F.col("label").alias("cluster"))
    return gr.modularity(gr.knn_edges(_points(spark, d), 10), labels).select(_r("modularity"))


def cluster_cells(spark: SparkSession, d: str) -> DataFrame:
    return gr.cluster_points(_points(spark, d))


def quick_cluster(spark: SparkSession, d: str) -> DataFrame:
    return gr.quick_cluster(assays.brand_by_customer(spark, d), least=20, by="block")


def quick_cluster_ranks(spark: SparkSession, d: str) -> DataFrame:
    return gr.quick_cluster(assays.brand_by_customer(spark, d), least=20, by="block", ranks=True)


def quick_sub_cluster(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("obs"), F.col("label").cast("string").alias("grp"))
    return gr.sub_cluster(_points(spark, d), labels, least=40)


def clustered_pcs(spark: SparkSession, d: str) -> DataFrame:
    """Clusters found over growing numbers of components."""
    best, tried = re.clustered_rank(materialize(_points(spark, d)), gr.cluster_points)
    return spark.createDataFrame([(a, b, a == best) for a, b in tried], "components int, clusters int, chosen boolean")


# marker pairs


def _phases(spark: SparkSession, d: str) -> Assay:
    a = assays.embedding_dimensions(spark, d)
    phase = F.element_at(F.array(F.lit("G1"), F.lit("S"), F.lit("G2M")), F.col("grp").cast("int") % 3 + 1)
    return Assay(a.values, a.features, a.observations.withColumn("grp", phase))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """A fixed classifier: the first ten dimensions paired, dealt to three phases."""
    f = assays.embedding_dimensions(spark, d).features.filter("feature_idx <= 10")
    a, b = f.select(F.col("feature").alias("first"), F.col("feature_idx").alias("i")), f.select(F.col("feature").alias("second"), F.col("feature_idx").alias("j"))
    phase = F.element_at(F.array(F.lit("G1"), F.lit("S"), F.lit("G2M")), (F.col("i") + F.col("j")) % 3 + 1)
    return a.join(b, F.col("i") < F.col("j")).select(phase.alias("phase"), "first", "second")


def marker_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cl.marker_pairs(_phases(spark, d), 0.45)


def pair_proportion(spark: SparkSession, d: str) -> DataFrame:
    return cl.pair_proportions(_phases(spark, d), _pairs(spark, d)).select("obs", "phase", _r("proportion"), "used")


def phase_call(spark: SparkSession, d: str) -> DataFrame:
    return cl.call_phases(cl.pair_proportions(_phases(spark, d), _pairs(spark, d)), "proportion")


def cyclone_scores(spark: SparkSession, d: str) -> DataFrame:
    s = cl.pair_scores(_phases(spark, d), _pairs(spark, d), least_pairs=5)
    return cl.normalized_scores(s).select("obs", "phase", _r("score"), _r("normalized"))


# events


def event_moments(spark: SparkSession, d: str) -> DataFrame:
    """Moments of event values per hour and type, in the form that also runs on a stream."""
    m = windowed_moments(table(spark, d, "events"), "ts", ["event_type"], "value", "1 day")
    return m.select("window_start", "event_type", "n", _r("mean"), _r("variance"))


QUERIES = {f.__name__: f for f in (
    spearman_pairs, spearman_blocked, spearman_signed, correlate_pairs, correlate_genes, gene_simes, correlate_null, correlate_pairs_design, scaled_ranks, scaled_ranks_sparse, dm_running_median,
    top_hvg, model_var, model_var_blocked, model_var_spikes, model_var_poisson, model_cv2, model_cv2_spikes, combine_var, combine_blocks, combine_blocks_geometric, size_factors_pooled,
    simple_ols, residual_variance, linear_model, linear_model_f, linear_model_blocked, pairwise_t_design, model_var_design, corrected_summaries, pseudobulk_specific, decide_tests, summarize_tests,
    pca, pca_scores, pca_rotation, pca_low_rank, pca_total, denoise_rank, denoised_pcs,
    nearest_points, knn_edges, snn_edges, snn_edges_jaccard, modularity, cluster_cells, quick_cluster, quick_cluster_ranks, quick_sub_cluster, clustered_pcs,
    marker_pairs, pair_proportion, phase_call, cyclone_scores, event_moments,
)} | {"pseudobulk_dge": _dge("quasi"), "pseudobulk_voom": _dge("voom"), "pseudobulk_treat": _dge("quasi", 0.1)}

_DENSE = "dn AS (SELECT f.feature AS feature, o.obs AS obs, {block} AS block, coalesce(x.value, 0) AS v FROM f CROSS JOIN o LEFT JOIN x ON x.feature = f.feature AND x.obs = o.obs)"


def _rho(block: str) -> str:
    return f"""{_DENSE.format(block=block)},
rk AS (SELECT feature, obs, block, rank() OVER w + (count(*) OVER (PARTITION BY feature, block, v) - 1) / 2 AS r FROM dn WINDOW w AS (PARTITION BY feature, block ORDER BY v)),
cc AS (SELECT a.feature AS gene1, b.feature AS gene2, a.block AS block, corr(a.r, b.r) AS rho, count(*) AS n FROM rk a JOIN rk b ON a.obs = b.obs AND a.feature < b.feature GROUP BY 1, 2, 3)
SELECT gene1, gene2, round(avg(rho), 6) AS rho, CAST(sum(n) AS BIGINT) AS n FROM cc GROUP BY 1, 2"""


_PSTAT = f"""{S.PART}, ps AS (SELECT f.feature AS feature, coalesce(s, 0) / n AS mean, greatest(coalesce(q, 0) - coalesce(s, 0) * coalesce(s, 0) / n, 0) / (n - 1) AS variance
  FROM f CROSS JOIN (SELECT count(*) AS n FROM o) LEFT JOIN (SELECT feature, sum(value) AS s, sum(value * value) AS q FROM x GROUP BY 1) z ON f.feature = z.feature)"""
_KNN = """pt AS (SELECT vec_id AS obs, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
dd AS (SELECT a.obs AS src, b.obs AS dst, list_distance(a.v, b.v) AS dist FROM pt a JOIN pt b ON a.obs <> b.obs),
nn AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY round(dist * dist, 9), dst) AS place FROM dd QUALIFY place <= 10),
un AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM nn)"""
_SNN = f"""{_KNN}, li AS (SELECT src AS p, dst AS n, place AS r FROM nn UNION ALL SELECT obs, obs, 0 FROM pt),
sh AS (SELECT a.p AS src, b.p AS dst, min(a.r + b.r) AS r, count(*) AS c FROM li a JOIN li b ON a.n = b.n AND a.p < b.p GROUP BY 1, 2)"""
_PH = f"""{S.EMBED}, ob AS (SELECT obs, ['G1', 'S', 'G2M'][CAST(grp AS INT) % 3 + 1] AS phase FROM o), fi AS (SELECT feature, row_number() OVER (ORDER BY feature) AS i FROM (SELECT DISTINCT feature FROM x)),
pr AS (SELECT a.feature AS first, b.feature AS second, ['G1', 'S', 'G2M'][(a.i + b.i) % 3 + 1] AS phase FROM fi a JOIN fi b ON a.i < b.i WHERE b.i <= 10),
pp AS (SELECT a.obs AS obs, phase, count(*) FILTER (a.value > b.value) / count(*) AS proportion, count(*) AS used FROM pr JOIN x a ON a.feature = first JOIN x b ON b.feature = second AND a.obs = b.obs
  WHERE a.value <> b.value GROUP BY 1, 2)"""
_LAB = """lt AS (SELECT grp AS label, feature, CASE WHEN NOT isnan(m.e) THEN m.e END AS logfc, m.p AS p FROM (SELECT grp, feature, arg_max({'e': logfc_cohen, 'p': p_value}, loaded_at) AS m FROM markers WHERE grp <> '' GROUP BY 1, 2)),
lr AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY p) AS r, count(*) OVER (PARTITION BY label) AS m FROM lt WHERE p IS NOT NULL),
lf AS (SELECT label, feature, logfc, least(1, min(p * m / r) OVER (PARTITION BY label ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fdr FROM lr),
dt AS (SELECT label, feature, CAST(CASE WHEN fdr <= 0.05 THEN sign(logfc) ELSE 0 END AS INT) AS status FROM lf UNION ALL SELECT label, feature, NULL FROM lt WHERE p IS NULL)"""
_CB = f"""{S.moments('x', 'block')}, cb AS (SELECT feature, sum(n * mean) / sum(n) AS mean, sum(n * variance) / sum(n) AS variance, exp(avg(ln(mean))) AS gm, exp(avg(ln(variance))) AS gv, sum(detected / n) AS y, count(*) AS k
  FROM m GROUP BY feature),
cp AS (SELECT *, least(1, exp(-y) * (SELECT sum(pow(y, j) / factorial(CAST(j AS INT))) FROM range(0, 12) t(j) WHERE j < k)) AS p FROM cb)"""

SQL = {
    "spearman_pairs": f"WITH {S.BRAND}, {_rho(chr(39) + 'all' + chr(39))}",
    "spearman_blocked": f"WITH {S.BRAND}, {_rho('o.block')}",
    "spearman_signed": f"WITH {S.EMBED}, f AS (SELECT DISTINCT feature FROM x), {_rho(chr(39) + 'all' + chr(39))}",
    "gene_simes": """WITH now AS (SELECT first, second, feature, m.e AS e, m.p AS p FROM (
  SELECT first, second, feature, arg_max({'e': effect, 'p': p_value}, loaded_at) AS m FROM pair_stats WHERE first <> '' AND second <> '' GROUP BY ALL)),
pr AS (SELECT first, second, max(e) AS rho, min(p) AS p FROM now WHERE p IS NOT NULL AND e IS NOT NULL AND NOT isnan(e) GROUP BY 1, 2),
b AS (SELECT first AS gene, rho, p FROM pr UNION ALL SELECT second, rho, p FROM pr),
k AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY p) AS k, count(*) OVER (PARTITION BY gene) AS m FROM b)
SELECT gene, round(arg_min(rho, (p, -abs(rho), rho)), 6) AS rho, round(least(1, min(p * m / k)), 9) AS p_value FROM k GROUP BY gene""",
    "scaled_ranks": f"""WITH {S.BRAND}, {_DENSE.format(block="'all'")}, r AS (SELECT feature, obs, rank() OVER (PARTITION BY obs ORDER BY v) + (count(*) OVER (PARTITION BY obs, v) - 1) / 2 AS r FROM dn),
c AS (SELECT *, r - avg(r) OVER (PARTITION BY obs) AS d FROM r), s AS (SELECT *, 2 * sqrt(sum(d * d) OVER (PARTITION BY obs)) AS s FROM c)
SELECT feature, obs, CASE WHEN s > 0 THEN round(d / s, 6) END AS value FROM s""",
    "scaled_ranks_sparse": f"""WITH {S.BRAND}, av AS (SELECT x.feature AS feature, sum(value / size_factor) / (SELECT count(*) FROM o) AS a FROM x JOIN o ON x.obs = o.obs GROUP BY 1),
{_DENSE.format(block="'all'")}, r AS (SELECT feature, obs, v, rank() OVER (PARTITION BY obs ORDER BY v) + (count(*) OVER (PARTITION BY obs, v) - 1) / 2 AS r FROM dn WHERE feature IN (SELECT feature FROM av WHERE a >= 0.5)),
c AS (SELECT *, r - avg(r) OVER (PARTITION BY obs) AS d, (1 + count(*) FILTER (v = 0) OVER (PARTITION BY obs)) / 2 AS z FROM r), s AS (SELECT *, 2 * sqrt(sum(d * d) OVER (PARTITION BY obs)) AS s FROM c)
SELECT feature, obs, CASE WHEN s > 1e-9 THEN round((r - z) / s, 6) END AS value FROM s WHERE v > 0""",
    "dm_running_median": f"""WITH {_PSTAT}, ok AS (SELECT feature, log10(round(mean, 9)) AS x, log10(round(variance / (mean * mean), 9)) AS y FROM ps WHERE mean > 0 AND round(variance / (mean * mean), 9) > 0),
i AS (SELECT *, row_number() OVER (ORDER BY x, feature) AS i, count(*) OVER () AS n FROM ok), h AS (SELECT *, least(25, i - 1, n - i) AS h FROM i),
md AS (SELECT a.feature AS feature, any_value(a.i) AS i, any_value(a.n) AS n, any_value(a.y) AS y, median(b.y) AS m FROM h a JOIN h b ON abs(a.i - b.i) <= a.h GROUP BY 1),
e AS (SELECT *, lead(m, 1) OVER w AS n1, lead(m, 2) OVER w AS n2, lag(m, 1) OVER w AS p1, lag(m, 2) OVER w AS p2 FROM md WINDOW w AS (ORDER BY i)),
s AS (SELECT feature, y - CASE WHEN i = 1 THEN m + n1 + (3 * n1 - 2 * n2) - greatest(m, n1, 3 * n1 - 2 * n2) - least(m, n1, 3 * n1 - 2 * n2)
  WHEN i = n THEN m + p1 + (3 * p1 - 2 * p2) - greatest(m, p1, 3 * p1 - 2 * p2) - least(m, p1, 3 * p1 - 2 * p2) ELSE m END AS dm FROM e)
SELECT f.feature AS feature, round(dm, 6) AS dm FROM f LEFT JOIN s ON f.feature = s.feature""",
    "top_hvg": f"""WITH {_PSTAT}, v AS (SELECT feature, round(variance, 6) AS v FROM ps), k AS (SELECT feature, v, row_number() OVER (ORDER BY v DESC, feature) AS place, count(*) OVER () AS n FROM v WHERE v > 1)
SELECT feature, CAST(place AS INT) AS place FROM k WHERE place <= greatest(20, round_even(0.1 * n, 0))""",
    "combine_blocks": f"""WITH {S.BRAND}, {_CB}, k AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS t FROM cp)
SELECT feature, round(mean, 6) AS mean, round(variance, 6) AS variance, round(p, 9) AS p_value, round(least(1, min(p * t / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS fdr FROM k""",
    "combine_blocks_geometric": f"WITH {S.BRAND}, {_CB} SELECT feature, round(gm, 6) AS mean, round(gv, 6) AS variance, round(p, 9) AS p_value FROM cp",
    "simple_ols": f"""WITH {S.BRAND}, dn AS (SELECT f.feature AS feature, c_acctbal / 1000 AS b, coalesce(x.value, 0) AS v FROM f CROSS JOIN o JOIN customer ON o.obs = c_custkey LEFT JOIN x ON x.feature = f.feature AND x.obs = o.obs)
SELECT feature, round(regr_intercept(v, b), 6) AS b0, round(regr_slope(v, b), 6) AS b1, round((regr_syy(v, b) - regr_sxy(v, b) * regr_sxy(v, b) / regr_sxx(v, b)) / (count(*) - 2), 5) AS sigma2 FROM dn GROUP BY feature""",
    "residual_variance": f"""WITH {S.BRAND}, dn AS (SELECT f.feature AS feature, c_acctbal / 1000 AS b, coalesce(x.value, 0) AS v FROM f CROSS JOIN o JOIN customer ON o.obs = c_custkey LEFT JOIN x ON x.feature = f.feature AND x.obs = o.obs)
SELECT feature, round(avg(v), 6) AS mean, round((regr_syy(v, b) - regr_sxy(v, b) * regr_sxy(v, b) / regr_sxx(v, b)) / (count(*) - 2), 5) AS variance FROM dn GROUP BY feature""",
    "decide_tests": f"WITH {_LAB} SELECT label, feature, status FROM dt",
    "summarize_tests": f"WITH {_LAB} SELECT label, count(*) FILTER (status = -1) AS down, count(*) FILTER (status = 0) AS unchanged, count(*) FILTER (status = 1) AS up, count(*) FILTER (status IS NULL) AS missing FROM dt GROUP BY label",
    "pca_total": f"WITH {S.EMBED} SELECT round(sum(v), 6) AS total, round(sum(v), 6) AS by_component FROM (SELECT var_samp(value) AS v FROM x GROUP BY feature)",
    "denoise_rank": f"""WITH {_PSTAT}, v AS (SELECT round(variance, 6) AS v, row_number() OVER (ORDER BY round(variance, 6) DESC, feature) AS i FROM ps),
s AS (SELECT sum(v) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS left_, sum(v) OVER () AS t FROM v) SELECT CAST(greatest(1, count(*) - count(*) FILTER (left_ <= 0.2 * t)) AS INT) AS rank FROM s""",
    "nearest_points": f"WITH {_KNN} SELECT src, dst, CAST(place AS INT) AS place, round(dist, 6) AS distance FROM nn",
    "knn_edges": f"WITH {_KNN} SELECT src, dst, 1.0::DOUBLE AS weight FROM un",
    "snn_edges": f"WITH {_SNN} SELECT src, dst, greatest(10 - r / 2, 1e-6)::DOUBLE AS weight FROM sh",
    "snn_edges_jaccard": f"WITH {_SNN} SELECT src, dst, round(c / (22.0 - c), 6)::DOUBLE AS weight FROM sh",
    "modularity": f"""WITH {_KNN}, e AS (SELECT a.label AS ca, b.label AS cb FROM un JOIN pt a ON src = a.obs JOIN pt b ON dst = b.obs),
k AS (SELECT c, count(*) AS k FROM (SELECT ca AS c FROM e UNION ALL SELECT cb FROM e) GROUP BY c)
SELECT round((SELECT count(*) FILTER (ca = cb) / count(*) FROM e) - (SELECT sum(k * k) FROM k) / (4.0::DOUBLE * (SELECT count(*) FROM e) * (SELECT count(*) FROM e)), 6) AS modularity""",
    "marker_pairs": f"""WITH {_PH}, np AS (SELECT phase, ceil(count(*) * 0.45) AS need FROM ob GROUP BY 1),
c AS (SELECT a.feature AS f1, b.feature AS f2, phase, count(*) FILTER (a.value > b.value) AS u, count(*) FILTER (a.value < b.value) AS d FROM x a JOIN x b ON a.obs = b.obs AND a.feature < b.feature JOIN ob ON a.obs = ob.obs GROUP BY 1, 2, 3),
g AS (SELECT c.*, u >= need AS hu, d >= need AS hd FROM c JOIN np ON c.phase = np.phase)
SELECT phase, f1 AS first, f2 AS second FROM g WHERE hu AND NOT EXISTS (SELECT 1 FROM g z WHERE z.f1 = g.f1 AND z.f2 = g.f2 AND z.phase <> g.phase AND NOT z.hd)
UNION ALL SELECT phase, f2, f1 FROM g WHERE hd AND NOT EXISTS (SELECT 1 FROM g z WHERE z.f1 = g.f1 AND z.f2 = g.f2 AND z.phase <> g.phase AND NOT z.hu)""",
    "pair_proportion": f"WITH {_PH} SELECT obs, phase, round(proportion, 6) AS proportion, used FROM pp",
    "phase_call": f"""WITH {_PH}, s AS (SELECT obs, max(proportion) FILTER (phase = 'G1') AS a, max(proportion) FILTER (phase = 'G2M') AS b FROM pp GROUP BY obs)
SELECT obs, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a < 0.5 AND b < 0.5 THEN 'S' WHEN a >= b THEN 'G1' ELSE 'G2M' END AS call FROM s""",
    "event_moments": """SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean, CASE WHEN count(*) > 1 THEN round(var_samp(value), 6) END AS variance
FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2""",
}
