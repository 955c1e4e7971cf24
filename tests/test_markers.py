"""Pairwise tests and marker tables against plain loops, and relations that must hold."""

import math
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnstat.functions import special as sp, testing
from cairnstat.operators import markers as mk
from cairnstat.sources.assays import Assay


def make(spark, x, grp, block=None, sf=None):
    f, n = x.shape
    rows = [(f"g{i}", j, float(x[i, j])) for i in range(f) for j in range(n) if x[i, j] != 0]
    return Assay(
        spark.createDataFrame(rows, "feature string, obs long, value double"),
        spark.createDataFrame([(f"g{i}", i) for i in range(f)], "feature string, feature_idx int"),
        spark.createDataFrame([(j, grp[j], (block[j] if block else "all"), float(sf[j]) if sf is not None else 1.0) for j in range(n)], "obs long, grp string, block string, size_factor double"),
    )


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(1.0, (6, 40)).astype(float)
    x[5] = 0
    grp = [str(v) for v in rng.choice(list("abc"), 40)]
    block = [str(v) for v in rng.choice(list("xy"), 40)]
    return x, grp, block, make(spark, x, grp), make(spark, x, grp, block)


def _by(rows, *keys):
    return {tuple(r[k] for k in keys): r for r in rows}


def test_welch_by_hand(spark, data):
    x, grp, _, a, _ = data
    got = _by(mk.pairwise_t(a, log=True).collect(), "feature", "first", "second")
    g = np.array(grp)
    for i in range(6):
        for p, q in permutations("abc", 2):
            u, v = x[i, g == p], x[i, g == q]
            eu, ev = max(u.var(ddof=1), 1e-8) / len(u), max(v.var(ddof=1), 1e-8) / len(v)
            t = (u.mean() - v.mean()) / math.sqrt(eu + ev)
            df = (eu + ev) ** 2 / (eu**2 / (len(u) - 1) + ev**2 / (len(v) - 1))
            want = min(0.0, sp.log_t_tail([abs(t)], [df])[0] + math.log(2))
            r = got[f"g{i}", p, q]
            assert math.isclose(r.logfc, u.mean() - v.mean(), abs_tol=1e-12) and math.isclose(r.log_p, want, rel_tol=1e-6, abs_tol=1e-9)


@pytest.mark.parametrize("lfc", [0.0, 0.5, -1.0])
def test_overlap_by_hand(spark, data, lfc):
    x, grp, _, a, _ = data
    y = np.random.default_rng(1).integers(-2, 3, x.shape).astype(float)  # signed, with ties and zeros
    a = make(spark, y, grp)
    got = _by(mk.overlaps(a, lfc).collect(), "feature", "first", "second")
    g = np.array(grp)
    for i in range(6):
        for p, q in permutations("abc", 2):
            u, v = y[i, g == p] - lfc, y[i, g == q]
            want = (u[:, None] > v[None]).sum() + 0.5 * (u[:, None] == v[None]).sum()
            ties = sum(c**3 - c for c in np.unique(np.concatenate([u, v]), return_counts=True)[1].tolist())
            r = got[f"g{i}", p, q]
            assert r.u == want and r.ties == ties


def test_binomial_by_hand(spark, data):
    x, grp, _, a, _ = data
    got = _by(mk.pairwise_binom(a, "up").collect(), "feature", "first", "second")
    g = np.array(grp)
    for i in range(6):
        u, v = (x[i, g == "a"] > 0), (x[i, g == "b"] > 0)
        n, k, p = int(u.sum() + v.sum()), int(u.sum()), len(u) / (len(u) + len(v))
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))
        assert math.isclose(got[f"g{i}", "a", "b"].p_value, want, rel_tol=1e-7)


@pytest.mark.parametrize("test", ["t", "wilcox", "binom"])
def test_directions_and_blocks(spark, data, test):
    *_, one, two = data
    run = mk.TESTS[test]
    up, down = (_by(run(two, d).collect(), "feature", "first", "second") for d in ("up", "down"))
    for (f, p, q), r in up.items():  # what is up for a pair is down for its reverse
        s = down[f, q, p]
        assert (r.p_value is None) == (s.p_value is None)
        if r.p_value is not None:
            assert math.isclose(r.p_value, s.p_value, rel_tol=1e-6, abs_tol=1e-12)
    single = make(spark, data[0], data[1], ["only"] * 40)
    a, b = (_by(run(d).collect(), "feature", "first", "second") for d in (one, single))
    assert all(a[k].p_value == pytest.approx(b[k].p_value, nan_ok=True) for k in a)


def test_score_markers_subset_and_repartition(spark, data):
    *_, a = data
    whole = _by(mk.score_markers(a).collect(), "grp", "feature")
    moved = Assay(a.values.repartition(7), a.features, a.observations.repartition(3))
    again = _by(mk.score_markers(moved).collect(), "grp", "feature")
    part = _by(mk.score_markers(a.subset(["g1", "g3"])).collect(), "grp", "feature")
    for k, r in whole.items():
        for c in r.asDict():
            assert r[c] == again[k][c] or r[c] == pytest.approx(again[k][c], abs=1e-12)
            if k in part and not c.startswith("rank_"):
                assert part[k][c] == pytest.approx(r[c], abs=1e-12)
    assert all(r.mean_auc == pytest.approx(0.5) and r.mean_logfc_cohen == 0 for k, r in whole.items() if k[1] == "g5")


def test_restrict_and_singletons(spark, data):
    x, grp, *_ = data
    g = list(grp)
    g[0], g[1], g[2] = None, "", "lone"
    a = make(spark, x, g).restrict(exclude=["c"])
    e = mk.effect_sizes(a).collect()
    assert {r["first"] for r in e} == {"a", "b", "lone"}
    assert all(r.logfc_cohen is None for r in e if "lone" in (r["first"], r["second"]))
    assert all(r.auc is not None for r in e)
    t = [r for r in mk.pairwise_t(a).collect() if "lone" in (r["first"], r["second"])]
    assert t and all(r.p_value is None and r.fdr is None for r in t)
    empty = Assay(a.values.limit(0), a.features.limit(0), a.observations)
    assert mk.effect_sizes(empty).count() == 0


def test_combine_by_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(p, q, f"g{i}", None if rng.random() < 0.1 else float(rng.choice([0.01, 0.2, 0.5, rng.random()])), float(rng.standard_normal())) for p, q in permutations("abcd", 2) for i in range(20)]
    df = spark.createDataFrame(rows, "first string, second string, feature string, p_value double, logfc double")
    feats = spark.createDataFrame([(f"g{i}", i) for i in range(20)], "feature string, feature_idx int")
    pd_rows = pd.DataFrame(rows, columns=["first", "second", "feature", "p", "e"])
    for kind in ("any", "some", "all"):
        got = _by(mk.combine_markers(df, feats, pval_type=kind).collect(), "grp", "feature")
        for (g, f), part in pd_rows.groupby(["first", "feature"]):
            p = np.sort(part.p.dropna().to_numpy())
            m = len(p)
            r = got[g, f]
            if not m:
                assert r.p_value is None
                continue
            if kind == "any":
                want = min(1.0, (p * m / np.arange(1, m + 1)).min())
            elif kind == "some":
                want = np.minimum(1, np.maximum.accumulate((m - np.arange(m)) * p))[max(1, math.ceil(m / 2)) - 1]
            else:
                want = p.max()
            assert math.isclose(r.p_value, want, rel_tol=1e-12)
            assert len(r.effects) == 3


def test_large_bh_equals_window(spark):
    rng = np.random.default_rng(3)
    p = [(i, None if i % 17 == 0 else float(round(rng.random(), 3))) for i in range(3000)]
    df = spark.createDataFrame(p, "id int, p double")
    a = {r.id: r.q for r in testing.bh_large(df, "p", "q").collect()}
    b = {r.id: r.q for r in testing.benjamini_hochberg(df, "p", [], "q").collect()}
    assert a == pytest.approx(b)
    assert testing.bh_large(df.filter("p is null"), "p", "q").filter("q is not null").count() == 0


def test_stouffer_matches_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(math.log(rng.random())), float(rng.integers(1, 5))) for k in range(5) for _ in range(4)] + [(9, 0.0, 1.0), (9, float("-inf"), 1.0)]
    got = {r.k: r.p for r in testing.stouffer(spark.createDataFrame(rows, "k int, lp double, w double"), "lp", ["k"], "p", "w").collect()}
    for k in range(5):
        part = [r for r in rows if r[0] == k]
        assert got[k] == pytest.approx(sp.stouffer_log([r[1] for r in part], [r[2] for r in part]), rel=1e-9)
    assert got[9] is None
