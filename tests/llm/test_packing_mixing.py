
import numpy as np
import pytest
from oracle import assert_same
from hypothesis import given, settings, strategies as st

from cairnstat.llm import mixing, packing, queries
from cairnstat.llm.tokens import encoding, token_counts
from pyspark.sql import functions as F


def test_token_counts(spark):
    texts = [None, "", "  ", "hello world", "x" * 300_000, "日本語\u0000<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("__text", F.lit(1))
    got = {r.id: r.n_tokens for r in token_counts(df, "id", "text").collect()}
    assert got == {i: len(encoding().encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=25))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(histogram):
    plan = packing.best_fit(histogram, 40)
    used = {}
    for n, first, start, per, end in zip(plan.length, plan.first, plan.start, plan.per, [*plan.first[1:], None]):
        stop = end if end is not None and end > first else histogram[int(n)]
        for r in range(first, stop):
            used.setdefault(start + (r - first) // per, []).append(int(n))
    assert sorted(x for v in used.values() for x in v) == sorted(n for n, c in histogram.items() for _ in range(c))
    assert all(sum(v) <= 40 for v in used.values()) and set(used) == set(range(plan.containers))
    free = []  # item by item, as a brute-force check of the number of containers
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(40 - n)
    assert len(free) == plan.containers


def test_pack(spark):
    rng = np.random.default_rng(0)
    sizes = [None, 0, -3, 100, 101, 250, 1000, *rng.integers(1, 130, 3000).tolist(), *[7] * 2000]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, n long").withColumn("__k", F.lit("clash")).repartition(5)
    got = packing.pack(df, "id", "n", 100).toPandas()
    assert sorted(got.id.unique()) == list(range(len(sizes)))
    per = got.groupby("id").n.agg(["sum", "count"])
    for i, s in enumerate(sizes):
        assert per["sum"][i] == max(s or 0, 0)
        assert per["count"][i] == max(1, -(-(s or 0) // 100))
    fill = got.dropna().groupby("container").n.sum()
    assert fill.max() <= 100 and sorted(fill.index) == list(range(len(fill)))
    assert fill.sum() / (100 * len(fill)) > 0.99
    assert packing.pack(df.limit(0), "id", "n", 100).count() == 0
    assert packing.packing_report(packing.pack(df.limit(0), "id", "n", 100), "n", 100).first().containers == 0


def test_pack_query_against_sizes(spark):
    d = "/root/testdata/sf0.01"
    sizes = {r.doc_id: r.n_tokens for r in queries._sizes(spark, d).collect()}
    assert {r.doc_id for r in queries.p6_found(spark, d).collect()} == {k for k, n in sizes.items() if n > 2048}
    report = queries.p6_report(spark, d).first()
    assert report.fullest <= 2048 and report.tokens == sum(sizes.values()) and report.unused_share < 0.02


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        i = np.arange(n)
        p = mixing.permute(i, np.full(n, n), np.full(n, 5))
        assert sorted(p) == list(i)
        if n > 10:
            assert (p != mixing.permute(i, np.full(n, n), np.full(n, 6))).any() and np.corrcoef(i, p)[0, 1] < 0.5


def test_water_fill():
    assert mixing.water_fill([0.5, 0.5], [10, 1000], 100) == [10, 90]
    assert mixing.water_fill([0.5, 0.3, 0.2], [1, 1, 1], 100) == [1, 1, 1]
    assert mixing.water_fill([0.5, 0.0], [5, 5], 100) == [5, 0]


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, ["A ", "b", "c", None, " ", "d"][i % 6] if i < 600 else "a", int(rng.integers(0, 900))) for i in range(1500)]
    rows += [(2000, "b", None), (2001, "c", 30_000)]
    df = spark.createDataFrame(rows, "id long, source string, n long").withColumn("block", F.lit(1)).withColumn("slot", F.lit("x"))
    targets = spark.createDataFrame([("a", 0.3, 2), ("B", 0.4, 2), ("c", 0.2, 3), ("gone", 0.1, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, "id", "source", "n", targets, seed=3, block=64)
    out = m.rows.toPandas()
    sizes = {i: n or 0 for i, s, n in rows if s and s.strip()}
    total = sum(sizes.values())
    per_slot = out.assign(t=out.tok_to - out.tok_from).groupby(["shard", "slot"]).t.sum()
    assert per_slot.max() == 64 and abs(out.tok_to.sum() - out.tok_from.sum() - total) < 64 * 20
    uses = out.groupby(["id", "tok_from"]).size()
    source = dict(zip(out.id, out.source))
    assert all(c <= {"a": 2, "b": 2, "c": 3}[source[i]] for (i, _), c in uses.items())
    shares = {r.source: r for r in m.shares.collect()}
    assert shares["B"].short and shares["gone"].short and not shares["a"].short
    have = sum(n or 0 for _, s, n in rows if s and s.strip().lower() == "b")
    assert shares["B"].tokens == 2 * have
    rest = 1 - shares["B"].actual_share
    assert abs(shares["a"].actual_share / rest - 0.6) < 0.01 and abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    # all blocks of a source are used before one is used again
    a = out[out.source == "a"]
    assert a[a.epoch == 0].groupby(["id", "tok_from"]).size().max() == 1
    empty = mixing.mix(df.limit(0), "id", "source", "n", targets)
    assert empty.rows.count() == 0 and all(r.actual_share is None for r in empty.shares.collect())


def test_mix_queries(spark):
    d = "/root/testdata/sf0.01"
    shares = {r.source: r for r in queries.p7_shares(spark, d).collect()}
    found = {r.source for r in queries.p7_found(spark, d).collect()}
    assert found == {s for s, r in shares.items() if r.short} and "oldharbor" in found
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9


@pytest.mark.parametrize("name", ["p6_invariants", "p7_invariants"])
def test_invariants(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.SQL[name], "/root/testdata/sf0.01")


def test_shards_of_several_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 16)
    monkeypatch.setattr(mixing, "PART_SHARDS", 4)
    plan = [mixing.Source("a", 0.7, 2, 0, 500, 700, False), mixing.Source("b", 0.3, 1, 0, 400, 300, False)]
    out = mixing.slots_of(spark, plan, 5).toPandas()
    assert len(out) == 1000 and out.groupby("shard").size().max() == 16 and out.shard.nunique() == 63
    assert dict(out.groupby("source").size()) == {"a": 700, "b": 300}
    a = out[out.source == "a"]
    assert a[a.epoch == 0].block.nunique() == 500 and a[a.epoch == 1].block.nunique() == 200
    assert not out[out.source == "b"].block.duplicated().any()
