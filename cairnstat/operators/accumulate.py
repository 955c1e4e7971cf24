"""Per-label totals when a handful of labels own most rows.

Labels are dictionary-encoded on each equal split and added up with numpy
bincount and scatter-reduce into dense accumulators, which leave the split as
array blocks; the blocks of all splits are then summed block by block. A label
with a third of all rows costs one array slot per split, like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairnstat.session import parallelism

#: Labels a split holds before it hands its blocks on.
FLUSH_LABELS = 1 << 18
SEP = "\x1f"


class _Dense:
    """Dense accumulators over the labels met so far."""

    def __init__(self, measures: int):
        self.code: dict[str, int] = {}
        self.count = np.zeros(1024, np.int64)
        self.valid = np.zeros((measures, 1024), np.int64)
        self.total = np.zeros((measures, 1024))
        self.low = np.full((measures, 1024), np.inf)
        self.high = np.full((measures, 1024), -np.inf)

    def codes(self, labels: list[str]) -> np.ndarray:
        got = np.fromiter((self.code.setdefault(x, len(self.code)) for x in labels), np.int64, len(labels))
        size = self.count.size
        if len(self.code) > size:
            more = max(len(self.code), 2 * size) - size
            self.count = np.pad(self.count, (0, more))
            self.valid, self.total = (np.pad(a, ((0, 0), (0, more))) for a in (self.valid, self.total))
            self.low = np.pad(self.low, ((0, 0), (0, more)), constant_values=np.inf)
            self.high = np.pad(self.high, ((0, 0), (0, more)), constant_values=-np.inf)
        return got

    def add(self, codes, count, valid, total, low, high) -> None:
        k = len(self.code)
        self.count[:k] += np.bincount(codes, count, k).astype(np.int64)
        for j in range(len(self.valid)):
            self.valid[j, :k] += np.bincount(codes, valid[j], k).astype(np.int64)
            self.total[j, :k] += np.bincount(codes, total[j], k)
            np.minimum.at(self.low[j], codes, low[j])
            np.maximum.at(self.high[j], codes, high[j])


def _encode(column: pa.Array) -> tuple[np.ndarray, list]:
    d = column.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()


def label_totals(df: DataFrame, label: str, measures: list[str], blocks: int | None = None, splits: int | None = None) -> DataFrame:
    """Per value of ``label``: n, and for each measure m: m_n, m_sum, m_min, m_max.

    ``label`` is a string column; rows with a NULL label are left out, the
    empty string is a label. NULL and NaN measures count in n only; a label
    without a usable measure has NULL sum, min and max. Any row order and any
    split give the same counts. An empty table gives an empty result. Other
    columns are ignored, so their names cannot clash.
    """
    spark = df.sparkSession
    parts = parallelism(spark)
    blocks = blocks or parts
    m = len(measures)
    narrow = df.select(F.col(label).cast("string").alias("label"), *[F.col(c).cast("double").alias(f"m{j}") for j, c in enumerate(measures)])
    narrow = narrow.filter("label is not null")
    if splits:
        narrow = narrow.repartition(splits)
    # one row per (split, block): parallel arrays over the labels of that block
    fields = "labels array<string>, n array<bigint>, valid array<array<bigint>>, total array<array<double>>, low array<array<double>>, high array<array<double>>"

    def blocks_of(acc: _Dense) -> Iterator[pa.RecordBatch]:
        names = np.array(list(acc.code), dtype=object)
        if not len(names):
            return
        where = np.fromiter((_block(x, blocks) for x in names), np.int64, len(names))
        rows: dict[str, list] = {k: [] for k in ("block", "labels", "n", "valid", "total", "low", "high")}
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[order])) + 1
        for at in np.split(order, cuts):
            rows["block"].append(int(where[at[0]]))
            rows["labels"].append(names[at].tolist())
            rows["n"].append(acc.count[at].tolist())
            for k in ("valid", "total", "low", "high"):
                rows[k].append(getattr(acc, k)[:, at].tolist())
        yield pa.RecordBatch.from_pydict(rows, schema=_SCHEMA)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = _Dense(m)
        for b in batches:
            local, names = _encode(b.column(0))
            codes = acc.codes(names)[local]
            cols = [b.column(1 + j).to_numpy(zero_copy_only=False).astype(float) for j in range(m)]
            ok = [~np.isnan(v) for v in cols]
            acc.add(codes, np.ones(len(codes)), ok, [np.where(o, v, 0.0) for o, v in zip(ok, cols)], [np.where(o, v, np.inf) for o, v in zip(ok, cols)], [np.where(o, v, -np.inf) for o, v in zip(ok, cols)])
            if len(acc.code) >= FLUSH_LABELS:
                yield from blocks_of(acc)
                acc = _Dense(m)
        yield from blocks_of(acc)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = _Dense(m)
        for b in batches:
            for r in b.to_pylist():
                codes = acc.codes(r["labels"])
                acc.add(codes, r["n"], r["valid"], r["total"], [np.array(x) for x in r["low"]], [np.array(x) for x in r["high"]])
        k = len(acc.code)
        for lo in range(0, k, 50_000):
            at = slice(lo, min(k, lo + 50_000))
            out = {"label": list(acc.code)[at], "n": acc.count[at]}
            for j in range(m):
                none = acc.valid[j, at] == 0
                out |= {f"v{j}": acc.valid[j, at]} | {f"{s}{j}": pa.array(a[j, at], mask=none) for s, a in (("s", acc.total), ("l", acc.low), ("h", acc.high))}
            yield pa.RecordBatch.from_pydict(out)

    partial = narrow.mapInArrow(split, f"block int, {fields}")
    merged = partial.repartition(blocks, "block").mapInArrow(
        merge, "label string, n bigint" + "".join(f", v{j} bigint, s{j} double, l{j} double, h{j} double" for j in range(m))
    )
    named = [F.col(f"{s}{j}").alias(f"{c}_{t}") for j, c in enumerate(measures) for s, t in (("v", "n"), ("s", "sum"), ("l", "min"), ("h", "max"))]
    return merged.select(F.col("label").alias(label), "n", *named)


_LISTS = pa.list_(pa.list_(pa.float64()))
_SCHEMA = pa.schema([("block", pa.int32()), ("labels", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("valid", pa.list_(pa.list_(pa.int64()))), ("total", _LISTS), ("low", _LISTS), ("high", _LISTS)])


def _block(label: str, blocks: int) -> int:
    import zlib

    return zlib.crc32(label.encode("utf-8", "surrogatepass")) % blocks


def pair_label(*cols: str):
    """One string label from several label columns; NULL if any is NULL or empty."""
    has = F.lit(True)
    for c in cols:
        has = has & F.col(c).isNotNull() & (F.col(c) != "")
    return F.when(has, F.concat_ws(SEP, *cols))
