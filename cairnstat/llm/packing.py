"""Filling containers of fixed capacity with items of varying length.

The plan is made over the histogram of lengths, so its cost depends on the
capacity and not on the number of items: best fit decreasing places whole
counts of equal items into runs of equal containers. Items then take the
planned slots by their rank among the items of the same length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cairnstat.operators.prefix import bucket_count, running_total

CAPACITY = 2048


@dataclass(frozen=True)
class Plan:
    """Runs of slots: items of length ``length[i]`` with ranks from ``first[i]`` go ``per[i]`` to a container from ``start[i]`` on."""

    length: np.ndarray
    first: np.ndarray
    start: np.ndarray
    per: np.ndarray
    containers: int


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing over counts of items by length (1 to ``capacity``).

    Every length touches each group of like containers once and splits at most
    one, so there are at most two more groups per length.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> (first container, how many)
    sizes: list[int] = []  # the keys of room, ascending
    runs: list[tuple[int, int, int, int]] = []
    containers = 0

    def leave(left: int, start: int, many: int) -> None:
        if left and many:
            if left not in room:
                insort(sizes, left)
            room.setdefault(left, []).append((start, many))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                left, start, many = capacity, containers, -(-todo // (capacity // length))
                containers += many
            else:
                left = sizes[at]
                start, many = room[left].pop()
                if not room[left]:
                    del room[left]
                    sizes.pop(at)
            fit = left // length
            full = min(many, todo // fit)
            if full:
                runs.append((length, rank, start, fit))
                rank, todo = rank + full * fit, todo - full * fit
                leave(left - fit * length, start, full)
            if full < many and todo:  # fewer than fit are left
                runs.append((length, rank, start + full, todo))
                leave(left - todo * length, start + full, 1)
                rank, todo, full = rank + todo, 0, full + 1
            leave(left, start + full, many - full)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 4)
    return Plan(*table.T, containers)


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, size, container): every item, in pieces only where it exceeds ``capacity``.

    An item larger than a container fills whole containers of its own with its
    first pieces; its last, smaller piece is placed like any other item. Items
    of size 0, NULL or less take no room: one row, size 0, container NULL.
    Containers are numbered from 0 without gaps. ``key`` is unique and not
    NULL. An empty table gives an empty result; other columns are ignored. The
    outcome does not depend on row order.
    """
    x = sizes.select(F.col(key).alias("__k"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("__n"))
    x = x.withColumn("__full", F.floor(F.col("__n") / capacity)).withColumn("__len", (F.col("__n") % capacity).cast("int"))
    counts = x.groupBy("__len").agg(F.count("*").alias("c"), F.sum("__full").alias("f")).collect()  # at most `capacity` rows
    plan = best_fit({r["__len"]: r.c for r in counts if r["__len"]}, capacity)
    buckets = bucket_count(sizes, sum(r.c for r in counts))

    ranked = running_total(x.filter("__len > 0"), ["__len"], "__k", F.lit(1), buckets, "__rank")
    shift = 44  # ranks below 2**44 and lengths below 2**19 share one sorted key
    keys = (plan.length << shift) + plan.first

    @F.pandas_udf("bigint")
    def slot(length: pd.Series, rank: pd.Series) -> pd.Series:
        rank = rank.to_numpy()
        at = np.searchsorted(keys, (length.to_numpy().astype(np.int64) << shift) + rank, side="right") - 1
        return pd.Series(plan.start[at] + (rank - plan.first[at]) // plan.per[at])

    last = ranked.select("__k", F.col("__full").cast("int").alias("piece"), F.col("__len").cast("bigint").alias("__s"), slot("__len", "__rank").alias("container"))
    large = running_total(x.filter("__full > 0"), [], "__k", F.col("__full"), buckets, "__before")
    whole = large.select("__k", "__before", F.explode(F.sequence(F.lit(0), (F.col("__full") - 1).cast("int"))).alias("piece"))
    whole = whole.select("__k", "piece", F.lit(capacity).cast("bigint").alias("__s"), (F.col("__before") + F.col("piece") + plan.containers).alias("container"))
    none = x.filter("__n = 0").select("__k", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("__s"), F.lit(None).cast("bigint").alias("container"))
    return last.unionByName(whole).unionByName(none).select(F.col("__k").alias(key), "piece", F.col("__s").alias(size), "container")


def packing_report(packed: DataFrame, size: str, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, split items' pieces, the fewest containers possible by size, and the unused share."""
    used = packed.filter("container is not null").groupBy("container").agg(F.sum(size).alias("u"), F.count("*").alias("p"))
    out = used.agg(F.count("*").alias("containers"), F.coalesce(F.sum("u"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("p"), F.lit(0)).alias("pieces"), F.max("u").alias("fullest"))
    return out.select(
        "*",
        F.ceil(F.col("tokens") / capacity).alias("least_containers"),
        F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused_share"),
    )
