import math
from statistics import NormalDist

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from cairnstat.functions.normal import quantile
from cairnstat.llm import fusion, queries
from cairnstat.llm.topn import top_n


@pytest.mark.parametrize("name", sorted(n for n in queries.SQL if n[:2] in ("p1", "p2")))
def test_against_sql(spark, name):
    assert assert_same(spark, queries.QUERIES[name], queries.SQL[name], "/root/testdata/sf0.01") > 0


def test_top_n_ties_nulls_repeats(spark):
    rows = [("a", 1.0, 3, "x"), ("a", 1.0, 2, "y"), ("a", 1.0, 2, "y"), ("a", None, 1, "n"), ("a", float("nan"), 0, "q"), ("a", 5.0, 9, "z"), (None, 2.0, 1, "w"), ("only", None, 1, "v"), ("b", -1.0, 1, "u")]
    df = spark.createDataFrame(rows, "g string, s double, id int, place string")
    got = [(r.g, r.s, r.id, r.place) for r in top_n(df, ["g"], "s", ["id"], 3).orderBy("g", "place").collect()]
    assert got == [(None, 2.0, 1, 1), ("a", 5.0, 9, 1), ("a", 1.0, 2, 2), ("a", 1.0, 2, 3), ("b", -1.0, 1, 1)]
    assert top_n(df.limit(0), ["g"], "s", ["id"], 3).count() == 0


def test_top_n_hot_group(spark):
    df = spark.range(0, 200_000, 1, 16).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("g"), ((F.col("id") * 7919) % 1000).cast("double").alias("s"), "id")
    got = sorted((r.s, -r.id) for r in top_n(df, ["g"], "s", ["id"], 10).filter("g = 'hot'").collect())
    want = sorted(((i * 7919) % 1000 + 0.0, -i) for i in range(200_000) if i % 3)[-10:]
    assert got == want


def test_normal_quantile(spark):
    ps = [1e-300, 1e-12, 1e-5, 0.02, 0.075, 0.3, 0.5, 0.77, 0.93, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double").withColumn("z", quantile("p"))
    for r in df.collect():
        assert math.isclose(r.z, NormalDist().inv_cdf(r.p), rel_tol=1e-9, abs_tol=1e-12)


def test_percentile_in_pieces_equals_whole(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(fusion, "LARGE", 100)
    rows = [(["hot", None, f"g{i % 7}"][i % 3], float(rng.integers(300))) for i in range(60_000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = fusion.average_percentile(df, ["g"], "v", "q").toPandas()
    for _, part in got.groupby("g", dropna=False):
        want = (part.v.rank() - 0.5) / len(part)
        assert np.allclose(part.q, want)
    assert len(got) == len(rows)


def test_percentile_of_one_hot_tie(spark):
    df = spark.range(0, 50_000, 1, 8).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 > 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"), F.col("id").alias("x"))
    got = fusion.average_percentile(df, ["g"], "v", "q").toPandas()
    assert len(got) == 50_000 and np.allclose(got.q, (got.v.rank() - 0.5) / 50_000)


def test_fused_ranking_missing_and_scale(spark):
    rows = [("g", "a", 9e9, 0.0, 1), ("g", "b", 1.0, 0.5, None), ("g", "c", float("nan"), None, None), ("g", "d", 0.0, 0.9, 3), (None, "a", 1.0, 0.1, 1)]
    df = spark.createDataFrame(rows, "g string, f string, x double, p double, t int").withColumn("combined", F.lit("clash")).withColumn("__v", F.lit(1))
    got = {(r.g, r.f): (r.combined, r.n_scores) for r in fusion.fused_ranking(df, ["g"], ["f"], {"x": (True, 1.0), "p": (False, 1.0), "t": (False, 1.0)}).collect()}
    assert got["g", "c"] == (None, 0) and got["g", "b"][1] == 2
    assert fusion.fused_ranking(df.limit(0), ["g"], ["f"], {"x": (True, 1.0)}).count() == 0
    assert got["g", "a"][0] > got["g", "b"][0] > got["g", "d"][0]
    assert abs(got[None, "a"][0]) < 1e-12
