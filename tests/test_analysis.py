"""Fits, models, components, graphs and classifiers against brute force and planted truth."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnstat.functions import fits
from cairnstat.operators import classify as cl, correlation as co, graphs as gr, linear as li, pooling, ranks as rk, reduction as re, retired, variance as va
from cairnstat.operators.moments import moments
from cairnstat.operators.pairings import pairings
from cairnstat.sources.assays import Assay
from test_markers import make


def test_trend_limits():
    rng = np.random.default_rng(0)
    m = rng.uniform(0.05, 6, 800)
    v = 4 * m / (m**2 + 2) * rng.gamma(20, 1 / 20, 800)
    for kw in ({}, {"smooth": False}, {"parametric": False}, {"density_weights": False}):
        t = fits.fit_trend_var(m, v, **kw)
        assert t(np.array([0.0]))[0] == 0 and np.isclose(t(np.array([0.01]))[0] / t(np.array([0.005]))[0], 2, rtol=0.05)
        mid = np.linspace(0.5, 5, 20)
        assert np.abs(np.log(t(mid) / (4 * mid / (mid**2 + 2)))).max() < 0.3
        assert 0.15 < t.std_dev < 0.35
    with pytest.raises(ValueError):
        fits.fit_trend_var([1.0], [1.0])
    with pytest.raises(ValueError):
        fits.fit_trend_var(m, v, parametric=False, smooth=False)


def test_trend_cv2_and_poisson():
    rng = np.random.default_rng(1)
    m = np.exp(rng.uniform(-1, 6, 600))
    y = (0.2 + 3 / m) * rng.gamma(25, 1 / 25, 600)
    y[:10] *= 50  # outliers
    t = fits.fit_trend_cv2(m, y, 1000)
    assert np.allclose(np.exp(t.params), [0.2, 3], rtol=0.2)
    p = fits.fit_trend_poisson(rng.uniform(0.2, 4, 50), np.ones(200), points=200)
    x = np.log2(10 + 1.0)
    sim = np.log2(rng.poisson(10, 100_000) + 1).var()
    assert abs(p(np.array([x]))[0] / sim - 1) < 0.2


def test_weighted_median():
    assert fits.weighted_median(np.array([3.0, 1, 2]), np.ones(3)) == 2
    assert fits.weighted_median(np.array([1.0, 2, 3, 4]), np.ones(4)) == 2.5
    assert fits.weighted_median(np.array([1.0, 2, 3]), np.array([1, 1, 10])) == 3


def test_moments_by_hand(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (5, 30)) * (rng.random((5, 30)) < 0.4)
    block = [str(b) if b != "z" else None for b in rng.choice(list("pqz"), 30)]
    block[0] = "lone"
    a = make(spark, x, ["g"] * 30, block)
    for r in moments(a, ["block"]).collect():
        v = x[int(r.feature[1:]), [i for i, b in enumerate(block) if b == r.block]]
        assert r.n == len(v) and r["mean"] == pytest.approx(v.mean(), abs=1e-12)
        assert r.variance == (None if len(v) < 2 else pytest.approx(v.var(ddof=1), abs=1e-12))


def test_planted_variance(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(np.exp(rng.uniform(0, 3, 300))[:, None], (300, 120)).astype(float)
    x[0] = np.where(rng.random(120) < 0.5, 60, 1)
    a = make(spark, x, ["g"] * 120, [str(b) for b in rng.choice(list("xy"), 120)])
    for m in (va.model_var(a.normalized()), va.model_var_poisson(a, points=200)):
        rows = m.orderBy(F.col("bio").desc()).collect()
        assert len(rows) == 300 and rows[0].feature == "g0" and rows[0].fdr < 0.01 and len(rows[0].per_block) == 2
    cv = va.model_cv2(a).orderBy(F.col("ratio").desc()).first()
    assert cv.feature == "g0"
    top = va.top_features(va.model_var(a.normalized()), n=3).collect()
    assert top[0].feature == "g0" and len(top) == 3


def test_running_median_rule(spark):
    y = [5.0, 1.0, 4.0, 2.0, 8.0, 3.0, 9.0, 0.0]
    df = spark.createDataFrame([(f"f{i}", float(i), v) for i, v in enumerate(y)], "feature string, x double, y double")
    got = [r.m for r in rk.running_median(df, "x", "y", 4, "m").orderBy("x").collect()]
    inner = [y[0], 4, np.median(y[:5]), np.median(y[1:6]), np.median(y[2:7]), np.median(y[3:8]), 3, y[7]]
    first, last = np.median([y[0], inner[1], 3 * inner[1] - 2 * inner[2]]), np.median([y[7], inner[6], 3 * inner[6] - 2 * inner[5]])
    assert got == [first, *inner[1:7], last]


def test_pairings(spark):
    f = spark.createDataFrame([(c, i) for i, c in enumerate("abcde")], "feature string, feature_idx int")
    as_set = lambda df: {(r.gene1, r.gene2) for r in df.collect()}
    assert len(as_set(pairings(f))) == 10 and len(as_set(pairings(f, ordered=True))) == 20
    assert as_set(pairings(f, ["a", "c", "zz"])) == {("a", "c")}
    assert as_set(pairings(f, (["a", "b"], ["b", "c", "zz"]))) == {("a", "b"), ("a", "c"), ("b", "c")}
    t = spark.createDataFrame([("e", "a"), ("a", "a"), ("a", "zz")], "gene1 string, gene2 string")
    assert as_set(pairings(f, t)) == {("e", "a"), ("a", "a")}  # an explicit table keeps its self pairs


def test_null_correlations(spark):
    a = co.null_correlations(spark, 20, 400, seed=3)
    b = co.null_correlations(spark, 20, 400, seed=3).repartition(5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    x = a.toPandas().rho
    assert abs(x.mean()) < 0.05 and abs(x.std() - 1 / np.sqrt(19)) < 0.03
    d = co.null_correlations(spark, 20, 200, design=np.column_stack([np.ones(20), np.arange(20)])).toPandas().rho
    assert abs(d.mean()) < 0.08
    assert co.null_correlations(spark, 2, 10).count() == 0


def test_linear_model_by_lstsq(spark):
    rng = np.random.default_rng(5)
    x = rng.poisson(2, (4, 30)).astype(float)
    a = make(spark, x, ["g"] * 30)
    d = pd.DataFrame({"obs": range(30), "one": 1.0, "u": rng.standard_normal(30), "w": rng.standard_normal(30), "block": ["p"] * 15 + ["q"] * 14 + ["r"]})
    design = spark.createDataFrame(d)
    m = d[["one", "u", "w"]].to_numpy()
    got = {r.feature: r for r in li.contrast_test(a, design, ["one", "u", "w"]).collect()}
    for i in range(4):
        beta, rss, *_ = np.linalg.lstsq(m, x[i], rcond=None)
        t = beta[2] / np.sqrt(rss[0] / 27 * np.linalg.inv(m.T @ m)[2, 2])
        from cairnstat.functions.special import log_t_tail

        assert got[f"g{i}"].logfc == pytest.approx(beta[2]) and got[f"g{i}"].p_value == pytest.approx(2 * np.exp(log_t_tail([abs(t)], [27.0])[0]), rel=1e-6)
    one = {r.feature: r.p_value for r in li.contrast_test(a, design, ["one", "u", "w"], coefs=[1]).collect()}
    f = {r.feature: r.p_value for r in li.contrast_test(a, design, ["one", "u", "w"], contrasts=np.array([[0, 1, 0], [0, 2, 0]]).T).collect()}
    assert set(one) == set(f)
    bad = li.contrast_test(a, design.withColumn("two", F.col("one")), ["one", "two"]).collect()
    assert all(r.p_value is None for r in bad)
    assert li.contrast_test_blocked(a, design, ["one", "u"]).filter("p_value is not null").count() == 4
    with pytest.raises(ValueError):
        li.contrast_test_blocked(a, design.filter("obs < 1"), ["one", "u"])


@pytest.mark.parametrize("method", ["quasi", "voom"])
def test_pseudo_bulk_planted(spark, method):
    rng = np.random.default_rng(6)
    rows = []
    for label in ("k1", "k2", "bad"):
        for s in range(8 if label != "bad" else 2):
            cond = "t" if s % 2 else "c"
            for g in range(80):
                mu = 100 * (8 if g == 0 and cond == "t" and label == "k1" else 1)
                rows.append((label, f"s{s}", cond, f"g{g}", float(rng.negative_binomial(10, 10 / (10 + mu)))))
            rows.append((label, f"s{s}", cond, "rare", 0.0))
    df = spark.createDataFrame(rows, "label string, sample string, condition string, feature string, value double")
    design = lambda s: np.column_stack([np.ones(len(s)), s["condition"] == "t"])
    t = li.pseudo_bulk(df, design, np.array([0.0, 1.0]), method=method)
    got = {(r.label, r.feature): r for r in t.collect()}
    assert {k[0] for k in got} == {"k1", "k2"}
    assert got["k1", "g0"].logfc > 2 and got["k1", "g0"].fdr < 0.01 and got["k1", "rare"].p_value is None
    assert sum(r.fdr is not None and r.fdr < 0.05 for k, r in got.items() if k[1] != "g0") <= 4
    s = {(r.label, r.feature): r for r in li.pseudo_bulk_specific(t).collect()}
    assert s["k1", "g0"].p_value < 0.01
    assert [r.label for r in li.failed_labels(df, t).collect()] == ["bad"]
    # against the other label's effect, with the effect's own standard error and degrees of freedom
    for f in ("g1", "g2", "g7"):
        a, b = got["k1", f], got["k2", f].logfc
        assert s["k1", f].other_average == b
        inside = a.logfc * b > 0 and abs(a.logfc) <= abs(b)
        assert s["k1", f].p_value == pytest.approx(1.0 if inside else max(a.p_value, float(li.effect_p(np.array([a.logfc - b]), np.array([a.se]), np.array([a.df]))[0])))
    assert s["k1", "rare"].other_average is None
    zero = {(r.label, r.feature): r.other_average for r in li.pseudo_bulk_specific(t, missing_as_zero=True).collect()}
    assert zero["k1", "rare"] == 0.0
    d = li.summarize_tests(li.decide_tests(t)).collect()
    assert all(r.missing == 1 and r.down + r.unchanged + r.up == 80 for r in d)


def test_components(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((12, 60)) + np.outer(rng.standard_normal(12), rng.standard_normal(60)) * 3
    a = make(spark, x, ["g"] * 60)
    names = [f"g{i}" for i in range(12)]
    c = re.components(a, 3, names)
    u, s, vt = np.linalg.svd(x.T - x.mean(axis=1), full_matrices=False)
    assert np.allclose(c.variances, s[:3] ** 2 / 59)
    sc = np.array([r.pc for r in c.scores.orderBy("obs").collect()])
    assert np.allclose(np.abs(sc), np.abs(u[:, :3] * s[:3]), atol=1e-8)
    low = {(r.feature, r.obs): r.value for r in re.low_rank(re.components(a, 12, names)).collect()}
    assert all(abs(low[f"g{i}", j] - x[i, j]) < 1e-8 for i in range(12) for j in range(0, 60, 7))
    ex = {r.feature: r.loadings for r in re.extrapolated_rotation(a, re.components(a, 3, names)).collect()}
    assert np.allclose([ex[f] for f in names], c.loadings, atol=1e-8)
    with pytest.warns(UserWarning):
        assert len(re.components(a, 50, names).variances) == 12
    for tech in (lambda m: np.full(len(m), 0.5), {f: 0.5 for f in names}):
        assert 2 <= len(re.denoised(a, tech, least=2).variances) <= 12


def test_denoise_rank(spark):
    v = [5.0, 3.0, 1.0, 0.5, 0.5]
    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(v)], "component int, variance double")
    for tech, want in ((0, 5), (0.5, 4), (1.0, 3), (2.0, 2), (9, 1), (100, 1)):
        left = [sum(v[d:]) for d in range(len(v) + 1)]
        assert re.denoise_rank(df, 10.0, tech).first()["rank"] == max(1, min(d for d in range(6) if left[d] <= tech)) == want


def test_graphs_and_communities(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((60, 5)) + 8 * np.eye(5)[i] for i in range(3)])
    truth = np.repeat([0, 1, 2], 60)
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "obs long, pc array<double>")
    near = {}
    for r in gr.nearest_points(pts, 5).collect():
        near.setdefault(r.src, {})[r.place] = r.dst
    for i in range(0, 180, 9):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert [near[i][k] for k in range(1, 6)] == np.argsort(d)[:5].tolist()
    lab = gr.cluster_points(pts).toPandas().set_index("obs").cluster.sort_index()
    assert all(len(set(truth[lab == c])) == 1 for c in lab.unique())
    edges, labels = gr.knn_edges(pts, 5), spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)], "obs long, cluster int")
    assert gr.modularity(edges, labels).first()[0] > 0.6
    merged = gr.cluster_points(pts, least=50).groupBy("cluster").count().collect()
    assert min(r["count"] for r in merged) >= 50
    sub = gr.sub_cluster(pts, spark.createDataFrame([(i, "big" if i < 170 else "small") for i in range(180)], "obs long, grp string"), least=20)
    assert {r.cluster for r in sub.collect() if r.obs >= 170} == {"small"}


def test_small_merge_terminates():
    lab = gr.merge_small(np.array([0, 0, 0, 1, 2, 2, 2]), np.array([0, 4]), np.array([1, 5]), np.ones(2), 3)
    assert len(set(lab)) == 2


def test_marker_pairs_and_scores(spark):
    rng = np.random.default_rng(9)
    phase = np.repeat(["G1", "S", "G2M"], 20)
    x = rng.poisson(5, (8, 60)).astype(float)
    for k, p in enumerate(("G1", "S", "G2M")):
        x[k, phase == p] += 30
    a = make(spark, x, phase.tolist())
    pairs = cl.marker_pairs(a, 0.5)
    got = {(r.phase, r["first"], r["second"]) for r in pairs.collect()}
    want = set()
    for p in set(phase):
        for i in range(8):
            for j in range(8):
                if i != j and (x[i, phase == p] > x[j, phase == p]).sum() >= 10 and all((x[i, phase == q] < x[j, phase == q]).sum() >= 10 for q in set(phase) - {p}):
                    want.add((p, f"g{i}", f"g{j}"))
    assert got == want and want
    s = cl.pair_scores(a, pairs, iterations=200, least_pairs=1, seed=4)
    t = cl.pair_scores(Assay(a.values, a.features, a.observations.repartition(6)), pairs, iterations=200, least_pairs=1, seed=4)
    assert sorted((r.obs, r.phase, r.score) for r in s.collect()) == sorted((r.obs, r.phase, r.score) for r in t.collect())
    score = {(r.obs, r.phase): r.score for r in s.collect() if r.score is not None}
    for p in {p for p, *_ in want}:
        inside, outside = ([v for (o, q), v in score.items() if q == p and (phase[o] == p) == side] for side in (True, False))
        assert np.mean(inside) > np.mean(outside)
    assert {r.call for r in cl.call_phases(s).collect()} <= {"G1", "S", "G2M", None}
    assert cl.pair_scores(a, pairs, iterations=200, least_pairs=999).filter("score is not null").count() == 0


def test_pooled_size_factors(spark):
    rng = np.random.default_rng(10)
    sf = rng.uniform(0.5, 2, 150)
    x = rng.poisson(np.exp(rng.uniform(0, 3, 100))[:, None] * sf[None]).astype(float)
    got = {r.obs: r.size_factor for r in pooling.pooled_size_factors(make(spark, x, ["g"] * 150)).collect()}
    est = np.array([got[i] for i in range(150)])
    assert abs(est.mean() - 1) < 1e-9 and np.corrcoef(est, sf)[0, 1] > 0.98


def test_retired():
    with pytest.raises(NotImplementedError):
        retired.trendVar(1)
    with pytest.raises(AttributeError):
        retired.somethingElse  # noqa: B018


def test_streaming_equals_batch(spark, tmp_path):
    from cairnstat.streaming.moments import windowed_moments

    rows = [((pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=7 * i)).to_pydatetime(), "ab"[i % 2], float(i % 13)) for i in range(300)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, v double")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_moments(stream, "ts", ["kind"], "v").writeStream.outputMode("complete").format("memory").queryName("wm").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.window_start, r.kind, r.n, round(r["mean"], 9))
    assert sorted(map(key, spark.table("wm").collect())) == sorted(map(key, windowed_moments(df, "ts", ["kind"], "v").collect()))


def test_designs(spark):
    rng = np.random.default_rng(11)
    x = rng.poisson(2, (5, 60)).astype(float)
    grp = [str(g) for g in rng.choice(list("abc"), 60)]
    a = make(spark, x, grp)
    cov = rng.standard_normal(60)
    design = spark.createDataFrame(pd.DataFrame({"obs": range(60), "one": 1.0, "u": cov}))
    m = np.column_stack([np.ones(60), cov])
    res = {(r.feature, r.obs): r.value for r in li.residuals(a, design, ["one", "u"]).values.collect()}
    want = x.T - m @ np.linalg.lstsq(m, x.T, rcond=None)[0]
    assert all(abs(res[f"g{i}", j] - want[j, i]) < 1e-9 for i in range(5) for j in range(60))
    rho = {(r.gene1, r.gene2): r.rho for r in co.spearman_residuals(a, design, ["one", "u"]).collect()}
    rk_ = pd.DataFrame(want).rank().to_numpy()
    assert rho["g0", "g3"] == pytest.approx(np.corrcoef(rk_[:, 0], rk_[:, 3])[0, 1])
    t = {(r.feature, r["first"], r["second"]): r for r in li.pairwise_t_design(a, design, ["u"]).collect()}
    full = np.column_stack([[g == k for g in grp] for k in "abc"] + [cov]).astype(float)
    beta = np.linalg.lstsq(full, x[2], rcond=None)[0]
    assert t["g2", "a", "c"].logfc == pytest.approx(beta[0] - beta[2]) and t["g2", "a", "c"].p_value == pytest.approx(t["g2", "c", "a"].p_value)


def test_corrected_summaries(spark):
    from cairnstat.operators import markers as mk

    rng = np.random.default_rng(12)
    grp = [str(g) for g in rng.choice(list("ab"), 400)]
    block = [("x" if rng.random() < (0.8 if g == "a" else 0.2) else "y") for g in grp]
    x = np.array([[1.0 * (g == "a") + 5.0 * (b == "y") + 1 for g, b in zip(grp, block)]])
    got = {r.grp: r.average for r in mk.corrected_summaries(make(spark, x, grp, block)).collect()}
    assert got["a"] - got["b"] == pytest.approx(1.0)
    one = {r.grp: r.average for r in mk.corrected_summaries(make(spark, x, grp)).collect()}
    assert one["a"] == pytest.approx(x[0][[g == "a" for g in grp]].mean())
