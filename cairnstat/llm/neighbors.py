"""The most similar vectors of every vector, by stable projections and kd-trees.

Unit vectors are projected with a Gaussian (2-stable) matrix to a few
dimensions. A kd-tree fitted on a bounded sample cuts the projected space into
cells; every vector goes to its cell. Inside a cell a local kd-tree yields the
projected neighbours of a query leaf by leaf, nearest first, and their true
similarity is verified until a chi-square test holds: the squared projected
distance of a vector at distance d is d^2 times a chi-square variable, so once
the next leaf lies beyond d_k^2 times its quantile, a closer vector would have
to be an outlier of known probability. Vectors cut off by a cell border are
met in further trees with other projections, or by probing the other cells
that fail the same test.

Exact copies of a vector are searched once, as a class, and come back as
members; no class is ever expanded into all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairnstat.llm.topn import heap
from cairnstat.session import materialize, parallelism

DIMENSION = 64
PROJECTIONS = 16
#: Rows the trees are fitted on, at most (expected number; they only place the cell borders).
SAMPLE = 32_768
CELL = 16_384
#: Rows of one cell that one task holds; a cell with more is searched block by block against all its queries.
MOST_CELL = 4 * CELL
LEAF = 256
#: Decimals of a similarity. It is a sum of float64 products in a fixed order, so it is the same wherever a pair meets.
DECIMALS = 6
#: Probability behind the chi-square quantile of the stopping test.
CONFIDENCE = 0.99


def chi_square_quantile(p: float, dof: int) -> float:
    """Upper limit of a chi-square variable with probability ``p`` (Wilson-Hilferty)."""
    h = 2.0 / (9.0 * dof)
    return dof * (1.0 - h + NormalDist().inv_cdf(p) * math.sqrt(h)) ** 3


def unit_vectors(df: DataFrame, key: str, vector: str, dimension: int = DIMENSION) -> DataFrame:
    """(key, v): usable vectors scaled to length 1, as ``dimension`` float32 numbers in bytes; one row per key.

    A vector that is NULL, of another length, all zero, or holds a NULL, NaN
    or infinite number is left out, as is a NULL key. A key with several
    different vectors keeps the one whose bytes sort last.
    """

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            right = np.asarray(pa.compute.equal(pa.compute.list_value_length(lists), dimension).fill_null(False))
            take = pa.array(np.flatnonzero(right))
            ids, flat = ids.take(take), lists.take(take).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
            top = np.abs(x).max(axis=1, initial=0.0)
            ok = np.isfinite(x).all(axis=1) & (top > 0)
            x = x[ok] / top[ok, None]
            u = (x / np.linalg.norm(x, axis=1)[:, None]).astype("<f4") + np.float32(0)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.flatnonzero(ok))), _bytes(u)], names=["k", "v"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.filter(F.col(key).isNotNull()).select(key, F.col(vector).cast("array<double>")).mapInArrow(scale, f"k {kind}, v binary")
    return rows.groupBy(F.col("k").alias(key)).agg(F.max("v").alias("v"))


def _bytes(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column, without a copy per row."""
    width = x.shape[1] * x.itemsize
    at = pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32).tobytes() if len(x) else np.zeros(1, np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(x), [None, at, pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _matrix(column: pa.Array | pa.ChunkedArray, dimension: int, kind: str = "<f4") -> np.ndarray:
    """The reverse of _bytes: the numbers are read where they lie, and copied only to join chunks."""
    parts = []
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(c):
            wide = np.int64 if pa.types.is_large_binary(c.type) else np.int32
            at = np.frombuffer(c.buffers()[1], dtype=wide)[c.offset : c.offset + len(c) + 1]
            size = np.dtype(kind).itemsize
            parts.append(np.frombuffer(c.buffers()[2], dtype=kind, count=int(at[-1] - at[0]) // size, offset=int(at[0])).reshape(-1, dimension))
    return np.zeros((0, dimension), kind) if not parts else parts[0] if len(parts) == 1 else np.concatenate(parts)


def classes_of(units: DataFrame, key: str, keep: int) -> DataFrame:
    """(id, v, n, members): one row per distinct vector: its smallest key, how many keys share it, the ``keep`` smallest."""
    return units.groupBy("v").agg(F.min(key).alias("id"), F.count("*").alias("n"), heap(F.col(key), keep).alias("members"))


@dataclass(frozen=True)
class Tree:
    """A Gaussian projection and a complete kd-tree over it; cells are numbered by the path of left and right turns."""

    projection: np.ndarray
    dims: np.ndarray
    cuts: np.ndarray
    depth: int

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            right = p[np.arange(len(p)), self.dims[node]] >= self.cuts[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)

    def reach(self, p: np.ndarray, radius2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell that comes within the radius of a row's projected point."""
        row, node = np.arange(len(p)), np.zeros(len(p), np.int64)
        gap = np.zeros((len(p), p.shape[1]), np.float32)  # distance to the cell along each dimension
        for _ in range(self.depth):
            d = self.dims[node]
            off = p[row, d] - self.cuts[node]
            home = off >= 0
            away = gap.copy()
            away[np.arange(len(row)), d] = np.maximum(away[np.arange(len(row)), d], np.abs(off))
            near = (away**2).sum(axis=1) <= radius2[row]
            node = np.concatenate([2 * node + 1 + home, (2 * node + 2 - home)[near]])
            row, gap = np.concatenate([row, row[near]]), np.concatenate([gap, away[near]])
        return row, node - (2**self.depth - 1)


def fit_trees(spark_sample: np.ndarray, rows: int, trees: int, cell: int, seed: int, projections: int = PROJECTIONS) -> list[Tree]:
    depth = max(0, math.ceil(math.log2(max(rows, 1) / cell)))
    depth = min(depth, max(0, int(math.log2(max(len(spark_sample), 1) / 4))))
    out = []
    for t in range(trees):
        m = np.random.default_rng([seed, t]).standard_normal((spark_sample.shape[1], projections)).astype(np.float32)
        p = spark_sample @ m
        dims, cuts = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1, np.float32)
        parts = {0: np.arange(len(p))}
        for node in range(2**depth - 1):
            at = parts.pop(node)
            d = int(np.argmax(p[at].var(axis=0))) if len(at) else 0
            dims[node], cuts[node] = d, np.median(p[at, d]) if len(at) else 0.0
            right = p[at, d] >= cuts[node]
            parts[2 * node + 1], parts[2 * node + 2] = at[~right], at[right]
        out.append(Tree(m, dims, cuts, depth))
    return out


def sample_vectors(classes: DataFrame, rows: int, dimension: int, size: int = SAMPLE) -> np.ndarray:
    """About ``size`` vectors, or all if there are fewer, chosen by a hash of their id."""
    parts = max(1, rows // size)
    got = classes.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == 0).select("v").toArrow()
    return _matrix(got.column("v"), dimension)


def local_search(data: np.ndarray, ids: np.ndarray, proj: np.ndarray, query: np.ndarray, qids: np.ndarray, qproj: np.ndarray, k: int, floor: np.ndarray, quantile: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, neighbour id, similarity): the ``k`` most similar rows of ``data`` for each query, those above its floor.

    Leaves of a kd-tree over ``proj`` are taken by projected distance; a query
    rests once the next leaf fails the chi-square test for its k-th best so
    far. Blocks are compared in float32; what is kept, with some to spare, is
    compared again in float64, so the outcome does not depend on how rows were
    blocked. Equal similarities: smaller id first. A query never meets its own id.
    """
    spare = k + 3
    n, depth = len(data), max(0, math.ceil(math.log2(max(len(data), 1) / LEAF)))
    parts = [np.arange(n)]
    for _ in range(depth):
        halves = []
        for at in parts:
            d = int(np.argmax(proj[at].var(axis=0))) if len(at) else 0
            order = np.argpartition(proj[at, d], len(at) // 2) if len(at) > 1 else np.arange(len(at))
            halves += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
        parts = halves
    parts = [p for p in parts if len(p)]
    low, high = np.array([proj[p].min(axis=0) for p in parts]), np.array([proj[p].max(axis=0) for p in parts])
    order = np.concatenate(parts)
    data, ids = np.ascontiguousarray(data[order]), ids[order]
    start = np.cumsum([0, *map(len, parts)])

    centre = (low + high) / 2
    near = ((qproj**2).sum(1)[:, None] - 2 * qproj @ centre.T + (centre**2).sum(1)[None]).argmin(axis=1)
    found: list[tuple] = []
    by_leaf = np.argsort(near, kind="stable")
    for lo in range(0, len(query), LEAF):
        rows = by_leaf[lo : lo + LEAF]
        q, qi, qp = query[rows], qids[rows], qproj[rows]
        bound = np.zeros((len(rows), len(parts)), np.float32)
        for d in range(qp.shape[1]):
            x = qp[:, d, None]
            bound += np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0) ** 2
        turn = np.argsort(bound.min(axis=0), kind="stable")
        best = floor[rows].astype(np.float64)  # similarity to beat or equal
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        at, step = 0, 1
        while at < len(turn):
            leaves = turn[at : at + step]
            # squared distance of unit vectors is 2 - 2 * similarity
            limit = quantile * (2.0 - 2.0 * best)
            live = np.flatnonzero((bound[:, leaves] <= limit[:, None]).any(axis=1))
            at, step = at + step, min(2 * step, 16)
            if not len(live):
                if (bound[:, turn[at:]] > limit[:, None]).all():
                    break
                continue
            cols = np.concatenate([np.arange(start[f], start[f + 1]) for f in leaves])
            s = q[live] @ data[cols].T
            a, b = np.nonzero(s >= (best[live] - 1e-6)[:, None])
            new = qi[live[a]] != ids[cols[b]]
            a, b = a[new], b[new]
            if not len(a):
                continue
            r, i, v = np.concatenate([kept[0], live[a]]), np.concatenate([kept[1], cols[b]]), np.concatenate([kept[2], s[a, b]])
            o = np.lexsort((ids[i], -v, r))
            r, i, v = r[o], i[o], v[o]
            place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
            keep = place < spare
            kth = place == k - 1
            best[r[kth]] = np.maximum(best[r[kth]], v[kth])
            kept = (r[keep], i[keep], v[keep])
        r, i = kept[0], kept[1]
        v = np.round((q[r].astype(np.float64) * data[i].astype(np.float64)).sum(axis=1), DECIMALS)
        fits = v >= floor[rows][r]
        r, i, v = r[fits], ids[i[fits]], v[fits]
        o = np.lexsort((i, -v, r))
        r, i, v = r[o], i[o], v[o]
        keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
        found.append((rows[r[keep]], i[keep], v[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, ids.dtype), np.zeros(0)
    return tuple(np.concatenate([f[j] for f in found]) for j in range(3))


_RESULT = "q bigint, nb bigint, sim double"


def _search(placed: DataFrame, trees: list[Tree], k: int, dimension: int, quantile: float) -> DataFrame:
    """Search every (tree, cell): ``placed`` has tree, cell, id, v, role (1 data, 2 query, 3 both) and floor.

    A cell with more than MOST_CELL rows is cut into blocks by a hash of the
    id: each row is data in one block and a query in all of them, so no task
    holds more than a block and its share of queries, and no pair is lost.
    """

    def run(group: pa.Table) -> pa.Table:
        tree = trees[group.column("tree")[0].as_py()]
        x, ids = _matrix(group.column("v"), dimension), group.column("id").to_numpy()
        role, floor = group.column("role").to_numpy(), group.column("floor").to_numpy()
        p = x @ tree.projection
        data, query = (role & 1) > 0, (role & 2) > 0
        if not data.any() or not query.any():
            return pa.table({"q": pa.array([], pa.int64()), "nb": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        rows, nb, sim = local_search(x[data], ids[data], p[data], x[query], ids[query], p[query], k, floor[query], quantile)
        return pa.table({"q": ids[query][rows], "nb": nb, "sim": sim})

    # cells are much work for few bytes: partitions are set by their number and not merged by size
    tasks = max(parallelism(placed.sparkSession), len(trees) * 2 ** trees[0].depth // 2)
    large = placed.groupBy("tree", "cell").agg(F.count("*").alias("__n")).filter(F.col("__n") > MOST_CELL)
    large = materialize(large.select("tree", "cell", F.ceil(F.col("__n") / (MOST_CELL // 2)).cast("int").alias("__parts")))
    if large.isEmpty():
        return placed.repartition(tasks, "tree", "cell").groupBy("tree", "cell").applyInArrow(run, _RESULT)
    cut = placed.join(large, ["tree", "cell"], "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("__parts")).cast("int")
    # a query is searched in blocks too: its block of queries meets every block of data
    data = cut.filter("role & 1 = 1").withColumn("role", F.lit(1)).withColumn("__d", own).withColumn("__q", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    query = cut.filter("role & 2 = 2").withColumn("role", F.lit(2)).withColumn("__q", own).withColumn("__d", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    return data.unionByName(query).repartition(tasks, "tree", "cell", "__q", "__d").groupBy("tree", "cell", "__q", "__d").applyInArrow(run, _RESULT)


def _place(vectors: DataFrame, trees: list[Tree], dimension: int) -> DataFrame:
    """One row per vector and tree, with its cell. ``vectors`` has id, v, role, floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dimension)
            for t, tree in enumerate(trees):
                where = tree.cell(x @ tree.projection)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(where.astype(np.int32)), *b.columns], names=["tree", "cell", *b.schema.names])

    return vectors.select("id", "v", "role", "floor").mapInArrow(run, "tree int, cell int, id bigint, v binary, role int, floor double")


def _probe(queries: DataFrame, tree: Tree, dimension: int, quantile: float) -> DataFrame:
    """One row per query and cell other than its own that the stopping test does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dimension)
            p, floor = x @ tree.projection, b.column(3).to_numpy()
            home = tree.cell(p)
            for lo in range(0, len(x), 2048):
                part = slice(lo, lo + 2048)
                row, cell = tree.reach(p[part], quantile * (2.0 - 2.0 * floor[part]))
                away = cell != home[part][row]
                row, cell = row[away] + lo, cell[away]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(row), np.int32)), pa.array(cell.astype(np.int32)), *[c.take(take) for c in b.columns]], names=["tree", "cell", *b.schema.names])

    return queries.select("id", "v", "role", "floor").mapInArrow(run, "tree int, cell int, id bigint, v binary, role int, floor double")


def _merge(found: DataFrame, k: int, most: int) -> DataFrame:
    """The ``k`` best distinct neighbours of every query: (q, best: array of struct(s, nb)), s the negated similarity.

    A pair has the same similarity in every tree, so equal entries are the same neighbour.
    """
    e = F.struct((-F.col("sim")).alias("s"), "nb")
    return found.groupBy("q").agg(F.slice(F.array_distinct(heap(e, most)), 1, k).alias("best"))


def similar_classes(classes: DataFrame, k: int, floor: float = -1.0, trees: int = 6, probe: bool = False, queries: DataFrame | None = None, cell: int = CELL, seed: int = 11, dimension: int = DIMENSION, confidence: float = CONFIDENCE) -> DataFrame:
    """(q, best): up to ``k`` most similar other classes of every class, or of those in ``queries`` (id).

    Only similarities of at least ``floor`` count. With ``probe``, queries also
    visit the cells beyond their own that the test does not rule out.
    ``classes`` is a stored table with bigint id and v, and may say in ``role``
    which rows are data (1), queries (2) or both (3, the default); an id is
    unique within a role. Sample-fitted borders keep cells near ``cell`` rows;
    every row is searched.
    """
    rows = classes.count()
    quantile = chi_square_quantile(confidence, PROJECTIONS)
    fitted = fit_trees(sample_vectors(classes, rows, dimension), rows, trees, cell, seed)
    base = classes.select("id", "v", (F.col("role") if "role" in classes.columns else F.lit(3)).alias("role"), F.lit(float(floor)).alias("floor"))
    if queries is not None:
        wanted = queries.select(F.col("id"), F.lit(3).alias("__r"))
        base = classes.join(wanted, "id", "left").select("id", "v", F.coalesce("__r", F.lit(1)).alias("role"), F.lit(float(floor)).alias("floor"))
    found = _search(_place(base, fitted, dimension), fitted, k, dimension, quantile)
    if not probe or fitted[0].depth == 0:
        return _merge(found, k, k * trees)
    found = materialize(found)
    first = _merge(found, k, k * trees).select(F.col("q").alias("id"), F.when(F.size("best") >= k, -F.element_at("best", -1)["s"]).alias("__kth"))
    asked = base.filter("role = 3").select("id", "v").join(first, "id", "left")
    asked = asked.select("id", "v", F.lit(2).alias("role"), F.greatest(F.coalesce("__kth", F.lit(float(floor))), F.lit(float(floor))).alias("floor"))
    data = _place(classes.select("id", "v", F.lit(1).alias("role"), F.lit(1.0).alias("floor")), fitted[:1], dimension)
    more = _search(data.unionByName(_probe(asked, fitted[0], dimension, quantile)), fitted[:1], k, dimension, quantile)
    return _merge(found.unionByName(more), k, k * (trees + 1))


def member_neighbors(best: DataFrame, classes: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(obs, neighbor, similarity): the ``k`` nearest keys of every key in ``members`` (obs, id), copies of its vector included.

    Each class offers its k + 1 smallest keys, which is all that any of its
    keys or neighbours can need.
    """
    own = classes.filter("n > 1").select(F.col("id").alias("q"), F.lit(1.0).alias("sim"), F.col("members").alias("m"))
    offered = best.select("q", F.explode("best").alias("e")).select("q", (-F.col("e.s")).alias("sim"), F.col("e.nb").alias("nb"))
    others = offered.join(classes.select(F.col("id").alias("nb"), F.col("members").alias("m")), "nb").select("q", "sim", "m")
    pool = own.unionByName(others).select("q", (-F.col("sim")).alias("s"), F.explode("m").alias("neighbor")).groupBy("q").agg(heap(F.struct("s", "neighbor"), k + 1).alias("pool"))
    out = members.join(pool.withColumnRenamed("q", "id"), "id")
    mine = F.slice(F.filter("pool", lambda x: x["neighbor"] != F.col("obs")), 1, k)
    return out.select("obs", F.posexplode(mine).alias("place", "e")).select("obs", F.col("e.neighbor").alias("neighbor"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("e.s"))).alias("similarity"), (F.col("place") + 1).alias("place"))


def close_pairs(units: DataFrame, k: int, floor: float, trees: int = 6, dimension: int = DIMENSION) -> DataFrame:
    """(obs_a, obs_b), a before b: keys each among the ``k`` most similar of the other, with similarity of at least ``floor``.

    ``units`` has (obs, v). Ties go to the smaller key.
    """
    classes = materialize(classes_of(units, "obs", k + 1))
    best = similar_classes(classes, k, floor, trees, dimension=dimension)
    members = classes.select("id", F.explode("members").alias("obs"))
    near = member_neighbors(best, classes, members, k)
    sides = near.filter(F.col("similarity") >= floor).withColumn("up", F.col("obs") < F.col("neighbor"))
    both = sides.groupBy(F.least("obs", "neighbor").alias("obs_a"), F.greatest("obs", "neighbor").alias("obs_b")).agg(F.bool_or("up").alias("a"), F.bool_or(~F.col("up")).alias("b"))
    return both.filter("a and b").select("obs_a", "obs_b")


def nearest(units: DataFrame, queries: DataFrame, k: int, dimension: int = DIMENSION, confidence: float = 0.95, cell: int = CELL) -> DataFrame:
    """(obs, neighbor, similarity, place): the ``k`` most similar keys of each key in ``queries`` (obs), among all of ``units``.

    The search is approximate: each cell border is crossed with a probability
    of at least ``confidence`` where a better neighbour lies beyond it.
    Queries without a usable vector are left out.
    """
    classes = materialize(classes_of(units, "obs", k + 1))
    asked = units.join(queries.select("obs").distinct(), "obs", "left_semi")
    # a third of all keys may share one vector: its class is matched by broadcast, the others by shuffle
    ids = classes.select("v", "id", "n")
    hot = F.col("n") > F.lit(max(1, units_count(classes) // 64))
    few = ids.filter(hot).select("v", "id")  # at most 64 rows
    members = asked.join(F.broadcast(few), "v").select("obs", "id").unionByName(
        asked.join(F.broadcast(few.select("v")), "v", "left_anti").join(ids.filter(~hot).select("v", "id"), "v").select("obs", "id")
    )
    members = materialize(members)
    best = similar_classes(classes, k, -1.0, 1, True, members.select("id").distinct(), cell, dimension=dimension, confidence=confidence)
    return member_neighbors(best, classes, members, k)


def units_count(classes: DataFrame) -> int:
    return classes.agg(F.sum("n")).first()[0] or 0


def exact_nearest(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[list]:
    """Brute force on small inputs, to measure the recall of the search."""
    s = vectors[rows] @ vectors.T
    s[np.arange(len(rows)), rows] = -2
    return [ids[np.lexsort((ids, -x))[:k]].tolist() for x in s]


