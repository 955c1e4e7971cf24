import numpy as np
import pytest

from cairnstat.operators.accumulate import label_totals
from cairnstat.operators.current import current_rows
from cairnstat.operators.prefix import running_total
from cairnstat.plans import general
from oracle import assert_same
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(general.SQL))
def test_against_sql(spark, name):
    assert assert_same(spark, general.QUERIES[name], general.SQL[name], "/root/testdata/sf0.01") > 0


def test_current_rows_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "z"), (2, None, None), (None, 1, "n")], "k int, t int, v string")
    got = {(r.k, r.v) for r in current_rows(df, ["k"], "t", ["v"]).collect()}
    assert got == {(1, "b"), (2, None), (None, "n")}
    assert current_rows(df.limit(0), ["k"], "t", ["v"]).count() == 0


def test_running_total_is_a_permutation(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "hot").when(F.col("id") < 950, None).otherwise("x"))
    got = running_total(df, ["g"], "id", F.lit(1), 7, "r", "n").toPandas()
    for g, part in got.groupby("g", dropna=False):
        assert sorted(part.r) == list(range(len(part)))
        assert set(part.n) == {len(part)}


def test_label_totals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 50 == 0 else "" if i % 51 == 0 else "hot" if i % 3 else f"t{rng.integers(200)}", None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(rng.integers(9)), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "label string, v double, n int")
    got = {r.label: r for r in label_totals(df, "label", ["v"], blocks=5).collect()}
    assert set(got) == {r[0] for r in rows if r[0] is not None}
    for key, r in got.items():
        vs = [x[1] for x in rows if x[0] == key]
        ok = [v for v in vs if v is not None and v == v]
        assert (r.n, r.v_n) == (len(vs), len(ok))
        assert (r.v_sum, r.v_min, r.v_max) == ((sum(ok), min(ok), max(ok)) if ok else (None, None, None))
    assert label_totals(df.limit(0), "label", ["v"]).count() == 0
