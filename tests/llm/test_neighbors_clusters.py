import numpy as np
import pandas as pd
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from cairnstat.llm import clusters, neighbors as nn, queries

D = 8


def _frame(spark, x, ids=None):
    ids = np.arange(len(x)) if ids is None else ids
    return spark.createDataFrame(pd.DataFrame({"obs": ids, "pc": [list(map(float, r)) for r in x]}), "obs long, pc array<double>")


def test_unit_vectors_dirt(spark):
    nan, inf = float("nan"), float("inf")
    good = [1.0] * D
    rows = [(1, good), (1, good), (2, None), (3, good[:-1]), (4, [0.0] * D), (5, [nan] + good[1:]), (6, [None] + good[1:]), (7, [inf] + good[1:]), (8, [2e300] * D), (9, [1e-300] * D), (None, good)]
    df = spark.createDataFrame(rows, "obs long, pc array<double>").withColumn("v", F.lit("clash")).withColumn("k", F.lit(1))
    got = {r.obs: np.frombuffer(r.v, "<f4") for r in nn.unit_vectors(df, "obs", "pc", D).collect()}
    assert sorted(got) == [1, 8, 9]
    assert all(np.allclose(v, D**-0.5) for v in got.values())
    assert nn.unit_vectors(df.limit(0), "obs", "pc", D).count() == 0


def _brute(x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    u = u.astype(np.float32)
    s = (u @ u.T).astype(float).round(6)
    np.fill_diagonal(s, -2)
    return s, [np.lexsort((np.arange(len(u)), -r))[:k].tolist() for r in s]


@pytest.mark.parametrize("name", ["p4_found", "p4_neighbors"])
def test_against_sql(spark, name):
    assert assert_same(spark, queries.QUERIES[name], queries.SQL[name], "/root/testdata/sf0.01") > 50


def test_pairs_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, D))
    x[100:400] = x[700:1000] * rng.uniform(0.5, 3, (300, 1)) + rng.standard_normal((300, D)) * 0.05
    x[1000:1300] = x[0]  # a class of copies with a fifth of all rows
    s, top = _brute(x, 5)
    want = {(min(i, j), max(i, j)) for i in range(len(x)) for j in top[i] if s[i, j] >= 0.97 and i in top[j]}
    units = nn.unit_vectors(_frame(spark, x), "obs", "pc", D)
    got = {(r.obs_a, r.obs_b) for r in nn.close_pairs(units, 5, 0.97, dimension=D).collect()}
    assert len(want & got) > 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_large_cells_are_searched_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1200, D))
    x[:400] = x[400:800] + rng.standard_normal((400, D)) * 0.05
    units = nn.unit_vectors(_frame(spark, x), "obs", "pc", D)
    want = {tuple(r) for r in nn.close_pairs(units, 5, 0.97, dimension=D).collect()}
    monkeypatch.setattr(nn, "MOST_CELL", 200)
    got = {tuple(r) for r in nn.close_pairs(units.repartition(3, "v"), 5, 0.97, dimension=D).collect()}
    assert got == want and len(got) > 300


def test_similarity_does_not_depend_on_blocks():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((700, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype("<f4")
    ids, p = np.arange(700), x[:, :16].copy()
    floor = np.full(700, -1.0)
    whole = nn.local_search(x, ids, p, x, ids, p, 5, floor, 1e9)
    one = [nn.local_search(x, ids, p, x[i : i + 1], ids[i : i + 1], p[i : i + 1], 5, floor[:1], 1e9) for i in range(0, 700, 7)]
    pairs = {(q, n): s for q, n, s in zip(*whole)}
    assert all(pairs[7 * j, n] == s for j, part in enumerate(one) for _, n, s in zip(*part))


@pytest.mark.parametrize("cell", [200, 100_000])
def test_recall_over_cells(spark, cell):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((1000, D)), rng.standard_normal((1, D)) * 3 + rng.standard_normal((1000, D))])
    _, top = _brute(x, 5)
    units = nn.unit_vectors(_frame(spark, x), "obs", "pc", D)
    asked = units.filter("obs % 20 = 0")
    got = {}
    for r in nn.nearest(units, asked, 5, dimension=D, cell=cell).collect():
        got.setdefault(r.obs, set()).add(r.neighbor)
    assert sorted(got) == list(range(0, 2000, 20)) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(got[i] & set(top[i])) / 5 for i in got]) >= 0.95


def test_copies_and_small_inputs(spark):
    x = np.tile(np.eye(D)[:2], (4, 1))
    units = nn.unit_vectors(_frame(spark, x), "obs", "pc", D)
    near = {(r.obs, r.place): r.neighbor for r in nn.nearest(units, units, 2, dimension=D).collect()}
    assert near[0, 1] == 2 and near[0, 2] == 4 and near[6, 1] == 0 and near[7, 1] == 1
    one = units.filter("obs = 0")
    assert nn.nearest(one, one, 5, dimension=D).count() == 0
    none = units.limit(0)
    assert nn.nearest(none, none, 5, dimension=D).count() == 0 and nn.close_pairs(none, 5, 0.9, dimension=D).count() == 0
    assert clusters.cluster_members(clusters.cluster_vectors(none, dimension=D), none).count() == 0


@pytest.mark.parametrize("shift", [0, -(1 << 62)])
def test_clusters(spark, shift):
    d = 32
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((6, d))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    sizes = [300, 120, 40, 12, 5, 4]
    x = np.concatenate([c + rng.standard_normal((n, d)) * 0.5 / np.sqrt(d) for c, n in zip(centres, sizes)] + [rng.standard_normal((150, d))])
    x = np.concatenate([x, np.tile(rng.standard_normal(d), (7, 1))])  # seven copies are a cluster of their own
    truth = np.concatenate([np.repeat(np.arange(6), sizes), np.full(150, -1), np.full(7, 6)])
    order = rng.permutation(len(x))
    x, truth = x[order], truth[order]
    units = nn.unit_vectors(_frame(spark, x, np.arange(len(x)) + shift), "obs", "pc", d)
    c = clusters.cluster_vectors(units, dimension=d)
    got = {}
    for r in clusters.cluster_members(c, units).collect():
        got.setdefault(r.cluster_obs, set()).add(r.obs)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for t in (0, 1, 2, 3, 4, 6):
        m = np.flatnonzero(truth == t)
        for _ in range(10):
            mean = u[m].sum(axis=0)
            m = np.flatnonzero(u @ mean >= 0.75 * np.linalg.norm(mean))
        want.add(frozenset((m + shift).tolist()))
    assert {frozenset(v) for v in got.values()} == want
    assert all(k == min(v) for k, v in got.items())
    summary = {r.cluster_obs: r for r in clusters.cluster_summary(c).collect()}
    assert {k: r["size"] for k, r in summary.items()} == {k: len(v) for k, v in got.items()}
    assert all(set(r.exemplars) <= got[k] for k, r in summary.items())


def test_spanning_forest_matches_kruskal(spark):
    rng = np.random.default_rng(7)
    n, edges = 60, {}
    for a, b in rng.integers(0, 60, (200, 2)):
        if a != b:
            edges[min(a, b), max(a, b)] = float(rng.uniform(0.46, 0.99))
    vertices = spark.createDataFrame([(i, 1) for i in range(n)], "id long, n long")
    frame = spark.createDataFrame([(int(a), int(b), w) for (a, b), w in edges.items()], "a long, b long, w double")
    h = clusters.density_clusters(vertices, frame)
    got = {(r.a, r.b) for r in h.tree.collect()}
    up = list(range(n))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    want = set()
    for (a, b), w in sorted(edges.items(), key=lambda e: -e[1]):
        if find(a) != find(b):
            up[find(a)] = find(b)
            want.add((a, b))
    assert got == want


def _condensed(n, edges, smallest, loosest, densest):
    """The same hierarchy by plain union-find: {cluster members}, from nodes with members, stability and parts."""
    strength = clusters._strength
    comp = {i: {"m": [i], "node": None} for i in range(n)}
    of, nodes, joined = list(range(n)), [], {}

    def close(node, at):
        node["own"] = node["s1"] - node["size"] * at
        node["best"] = max(node["own"], node["parts"])
        return node

    for (a, b), w in edges:
        p, q = of[a], of[b]
        if p == q:
            continue
        at = strength(min(w, densest))
        x, y = comp[p], comp[q]
        both = x["m"] + y["m"]
        if x["node"] is None and y["node"] is None:
            node = None
            if len(both) >= smallest:
                node = {"s1": len(both) * at, "size": len(both), "parts": 0.0, "kids": [], "m": list(both)}
                nodes.append(node)
        elif x["node"] is None or y["node"] is None:
            big, small = (x, y) if y["node"] is None else (y, x)
            node = big["node"]
            node["s1"] += len(small["m"]) * at
            node["size"] += len(small["m"])
            node["m"] += small["m"]
        else:
            kids = [close(x["node"], at), close(y["node"], at)]
            node = {"s1": len(both) * at, "size": len(both), "parts": sum(k["best"] for k in kids), "kids": kids, "m": list(both)}
            nodes.append(node)
        comp[p] = {"m": both, "node": node}
        for i in y["m"]:
            of[i] = p
    out = set()

    def take(node):
        if node["own"] >= node["parts"]:
            out.add(frozenset(node["m"]))
        else:
            for k in node["kids"]:
                take(k)

    for p in set(of):
        if comp[p]["node"]:
            take(close(comp[p]["node"], strength(loosest)))
    return out


def test_condensed_tree_against_union_find(spark):
    rng = np.random.default_rng(12)
    n, pairs = 400, {}
    for c in range(8):  # groups with dense kernels, a few links between groups
        at = range(c * 50, c * 50 + 50)
        for a, b in rng.integers(c * 50, c * 50 + 50, (260, 2)):
            if a != b:
                core = (a % 50 < 15) and (b % 50 < 15) or (a % 50 >= 35) and (b % 50 >= 35)
                pairs[min(a, b), max(a, b)] = float(rng.uniform(0.8, 0.93) if core else rng.uniform(0.46, 0.6))
    for a, b in rng.integers(0, n, (40, 2)):
        if a != b:
            pairs.setdefault((min(a, b), max(a, b)), float(rng.uniform(0.46, 0.6)))
    vertices = spark.createDataFrame([(i, 1) for i in range(n)], "id long, n long")
    frame = spark.createDataFrame([(int(a), int(b), w) for (a, b), w in pairs.items()], "a long, b long, w double")
    h = clusters.density_clusters(vertices, frame, densest=0.95)
    got = {}
    for r in h.labels.filter("cluster is not null").collect():
        got.setdefault(r.cluster, set()).add(r.id)
    want = _condensed(n, sorted(pairs.items(), key=lambda e: -e[1]), clusters.SMALLEST, clusters.LOOSEST, 0.95)
    assert len(want) > 8 and {frozenset(v) for v in got.values()} == want


def test_long_chains_keep_their_order(spark):
    n = 300  # every edge is less dense than the one before: each vertex points at its predecessor
    vertices = spark.createDataFrame([(i, 1) for i in range(n)], "id long, n long")
    edges = [((i, i + 1), 0.9 - 0.4 * i / n) for i in range(n - 1)]
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges], "a long, b long, w double")
    h = clusters.density_clusters(vertices, frame, densest=0.95)
    got = {r.id: r.strength for r in h.labels.collect()}
    assert len(got) == n and h.nodes.count() == 1 and h.tree.count() == n - 1
    at = [clusters._strength(w) for _, w in edges]
    assert all(abs(got[i] - (at[max(i - 1, 3)])) < 1e-12 for i in range(n))


def test_queries(spark):
    d = "/root/testdata/sf0.001"
    found = queries.p5_found(spark, d).collect()
    assert len({r.obs for r in found}) == len(found) and all(r.cluster_obs <= r.obs for r in found)
    assert {r.cluster_obs for r in found} == {r.obs for r in found if r.obs == r.cluster_obs}
    assert all(r.obs_a < r.obs_b for r in queries.p4_found(spark, d).collect())
