"""A p-value of 0 is the strongest result, not a missing one."""

import datetime
import math

import pytest
from oracle import assert_same

from cairnstat.functions import testing
from cairnstat.plans import registry


def test_zero_counts(spark, tmp_path):
    p = {("x", "a"): 0.0, ("y", "a"): 0.2, ("x", "b"): 0.5, ("y", "b"): 0.4}
    rows = [("t", s, f, 1.0, v, datetime.datetime(2024, 1, 1)) for (s, f), v in p.items()]
    spark.createDataFrame(rows, "first string, second string, feature string, effect double, p_value double, loaded_at timestamp").write.parquet(f"{tmp_path}/pair_stats.parquet")
    spark.createDataFrame([("a", 1), ("b", 2)], "feature string, feature_idx int").write.parquet(f"{tmp_path}/features.parquet")
    for name in ("fisher_combine", "log_bh"):
        assert_same(spark, registry.QUERIES[name], registry.SQL[name], str(tmp_path))
    combined = {r.feature: r.p for r in registry.QUERIES["fisher_combine"](spark, str(tmp_path)).collect()}
    assert combined == {"a": 0.0, "b": pytest.approx(0.2 * (1 - math.log(0.2)), abs=1e-8)}
    kept = {(r.second, r.feature): r.log_fdr for r in registry.QUERIES["log_bh"](spark, str(tmp_path)).collect()}
    assert kept["x", "a"] == -math.inf and kept["x", "b"] == pytest.approx(math.log(0.5), abs=1e-6)


def test_fisher_of_many(spark):
    df = spark.createDataFrame([(1, 0.4)] * 1000 + [(2, 1.0)] * 3, "g int, p double")
    got = {r.g: r.q for r in testing.fisher(df, "p", ["g"], "q").collect()}
    y = -1000 * math.log(0.4)
    assert got[1] == pytest.approx(sum(math.exp(j * math.log(y) - math.lgamma(j + 1) - y) for j in range(1000)), rel=1e-6)
    assert got[2] == 1.0
