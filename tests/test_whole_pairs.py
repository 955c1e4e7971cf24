"""Queries on pair_stats over every group, on a table whose groups are none of the large ones."""

import datetime

import pytest
from oracle import assert_same

from cairnstat.plans import registry

NAMES = ("combine_any", "combine_some", "combine_all", "bh_adjust", "simes_combine", "berger_combine", "holm_combine", "top_markers", "top_markers_combined", "multi_marker_max", "marker_effects")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pairs")
    old, new = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)
    rows = [(f"tiny{i}", f"tiny{j}", f"f{k}", float(i - j + k), ((7 * i + 3 * j + 5 * k) % 40) / 400.0, new) for i in range(4) for j in range(4) if i != j for k in range(5)]
    rows += [("tiny0", "tiny1", "f0", -9.0, 0.9, old), ("", "tiny1", "f0", 1.0, 0.5, new), (None, "tiny1", "f0", 1.0, 0.5, new), ("tiny0", "amber", "f1", None, None, new)]
    spark.createDataFrame(rows, "first string, second string, feature string, effect double, p_value double, loaded_at timestamp").write.parquet(f"{at}/pair_stats.parquet")
    spark.createDataFrame([(f"f{k}", k + 1) for k in range(5)], "feature string, feature_idx int").write.parquet(f"{at}/features.parquet")
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_every_group_comes_out(spark, folder, name):
    query = registry.QUERIES[f"{name}"]
    rows, all_groups = query(spark, folder).collect(), {f"tiny{i}" for i in range(4)}
    groups = {r["grp"] if "grp" in r else r["first"] for r in rows}
    assert groups and groups <= all_groups and (groups == all_groups or name.startswith("top_"))  # those show only what passes the FDR
    assert_same(spark, query, registry.SQL[f"{name}"], folder)


def test_simes_by_loop(spark, folder):
    got = {(r["first"], r.feature): r.p for r in registry.QUERIES["simes_combine"](spark, folder).collect()}
    for i in range(4):
        for k in range(5):
            p = sorted(((7 * i + 3 * j + 5 * k) % 40) / 400.0 for j in range(4) if j != i)
            assert got[f"tiny{i}", f"f{k}"] == pytest.approx(min(1.0, *(v * 3 / (r + 1) for r, v in enumerate(p))), abs=1e-8)
