"""Clusters of mutually similar vectors by hierarchical density clustering.

A neighbour graph is weighted by mutual reachability: the similarity of an
edge, or the core similarity of either end if that is lower. Boruvka rounds, in
which every component picks its best edge, give the minimum spanning tree, and
at once the hierarchy: up to the moment of its pick a component grows alone, so
all that joined it before is settled in order of density, and what joins later
belongs to the component it went into. A component with enough members is a
node of the condensed tree; where two nodes meet both end, and each keeps the
larger of its own stability and that of its parts. Selected nodes are the
clusters, their members those that joined at the highest density first. No
level is fixed, and nothing is gathered on the driver but counts.

``exact_members`` and ``attach`` are a check that follows: members must reach a
cosine to the mean of their cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairnstat.llm.neighbors import CELL, DIMENSION, _bytes, _matrix, classes_of, similar_classes
from cairnstat.llm.topn import heap
from cairnstat.session import materialize, parallelism

#: Neighbours below this similarity are not searched for: the hierarchy ends at this density.
LOOSEST = 0.45
#: Similarities above this count as this, or a handful of near copies inside a cluster would be a cluster of its own.
DENSEST = 0.85
NEIGHBORS = 6
#: A member's core similarity is that of its neighbour with this rank.
CORE = 2
SMALLEST = 5


def _strength(similarity: float) -> float:
    """Density at a similarity: the inverse of the distance between unit vectors."""
    return 1.0 / (2.0 - 2.0 * similarity) ** 0.5


def neighbor_graph(classes: DataFrame, k: int = NEIGHBORS, floor: float = LOOSEST, trees: int = 4, more_trees: int = 8, dense: float = 0.55, dimension: int = DIMENSION) -> DataFrame:
    """(q, best): up to ``k`` neighbours of every class with a similarity of at least ``floor``.

    All vectors meet in the cells of ``trees`` trees. Those that still lack
    neighbours beyond ``dense`` are few: they meet again in the four times
    larger cells of further trees, where small clusters are not cut up.
    """
    first = materialize(similar_classes(classes, k, floor, trees, dimension=dimension))
    met = first.filter(F.size(F.filter("best", lambda e: -e["s"] >= dense)) >= SMALLEST - 1).select(F.col("q").alias("id"))
    rest = materialize(classes.join(met, "id", "left_anti"))
    cell = 4 * CELL
    again = similar_classes(rest, k, floor, more_trees if rest.count() > cell else 1, cell=cell, seed=29, dimension=dimension)
    both = first.unionByName(again).select("q", F.explode("best").alias("e"))
    # a pair has one similarity wherever it was met, so equal entries are the same neighbour
    return both.groupBy("q").agg(heap(F.col("e"), 2 * k).alias("best")).select("q", F.slice(F.array_distinct("best"), 1, k).alias("best"))


def reachability_edges(graph: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b, w): every edge once, a before b, with its mutual-reachability similarity.

    ``sizes`` (id, n) gives the copies of a class: a class with more than CORE
    copies is its own core. An end with fewer than CORE neighbours in the graph
    has its core below the loosest density, and so have its edges: they are left out.
    """
    edges = graph.select("q", F.explode("best").alias("e")).select("q", F.col("e.nb").alias("nb"), (-F.col("e.s")).alias("sim"))
    core = graph.select(F.col("q").alias("id"), F.when(F.size("best") >= CORE, -F.element_at("best", CORE)["s"]).alias("core"))
    core = sizes.filter(F.col("n") > CORE).select("id", F.lit(1.0).alias("core")).unionByName(core.filter("core is not null")).groupBy("id").agg(F.max("core").alias("core"))
    pairs = edges.groupBy(F.least("q", "nb").alias("a"), F.greatest("q", "nb").alias("b")).agg(F.max("sim").alias("sim"))
    ends = pairs.join(core.select(F.col("id").alias("a"), F.col("core").alias("ca")), "a").join(core.select(F.col("id").alias("b"), F.col("core").alias("cb")), "b")
    return ends.select("a", "b", F.least("sim", "ca", "cb").alias("w"))


#: A component, or one that joined it: number of members, its node and that node's sums, and the few members without a node.
_STATE = "size bigint, node string, s1 double, best double, few array<bigint>"
_FIELDS = ["size", "node", "s1", "best", "few"]
_SCAN = f"kind int, c bigint, {_STATE}, parent string, at double"


def _grow(items: DataFrame, smallest: int, densest: float) -> DataFrame:
    """Settle what joined each component, densest first.

    ``items`` has (c, joined, w, h, sub, state): one row per component (joined
    0) and one per component that joined it (1). A row of the result is a
    component's state afterwards (kind 0), a member's entry into a node at a
    density (1: few holds it), or a node that ended (2: with its parent, s1 its
    stability). The rows of a component pass in order through a running state
    of a few numbers, so none is held in memory, however many there are.
    """
    schema = pa.schema([("kind", pa.int32()), ("c", pa.int64()), ("size", pa.int64()), ("node", pa.string()), ("s1", pa.float64()), ("best", pa.float64()), ("few", pa.list_(pa.int64())), ("parent", pa.string()), ("at", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        c = None
        size, node, s1, best, few = 0, None, 0.0, 0.0, []

        def enter(members: list, into: str, at: float) -> None:
            if members:
                out.append((1, c, 0, into, 0.0, 0.0, members, None, at))

        def end(which: str, total: int, sum1: float, parts: float, at: float, parent: str) -> float:
            own = sum1 - total * at
            out.append((2, c, total, which, own, parts, None, parent, at))
            return max(own, parts)

        for b in batches:
            cols = [col.to_pylist() for col in b.columns]
            for ci, joined, w, sub, n, nd, t1, bt, fw in zip(*cols):
                if not joined:
                    if c is not None:
                        out.append((0, c, size, node, s1, best, few, None, None))
                    c, size, node, s1, best, few = ci, n, nd, t1, bt, fw or []
                    continue
                at = _strength(min(w, densest))
                if node is None and nd is None:
                    size, few = size + n, few + fw
                    if size >= smallest:
                        node, s1, best = str(sub), size * at, 0.0
                        enter(few, node, at)
                        few = []
                elif nd is None:
                    enter(fw, node, at)
                    size, s1 = size + n, s1 + n * at
                elif node is None:
                    enter(few, nd, at)
                    node, s1, best, size, few = nd, t1 + size * at, bt, size + n, []
                else:
                    made = str(sub)
                    best = end(node, size, s1, best, at, made) + end(nd, n, t1, bt, at, made)
                    node, size = made, size + n
                    s1 = size * at
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if c is not None:
            out.append((0, c, size, node, s1, best, few, None, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    ordered = items.repartition(parallelism(items.sparkSession), "c").sortWithinPartitions("c", "joined", F.col("w").desc(), "h")
    return ordered.select("c", "joined", "w", "sub", *_FIELDS).mapInArrow(run, _SCAN)


@dataclass(frozen=True)
class Hierarchy:
    labels: DataFrame
    nodes: DataFrame
    tree: DataFrame


def _jump(up: DataFrame) -> DataFrame:
    """Each component's pointer moved on to where the one it points to points."""
    over = up.select(F.col("c").alias("to"), F.col("to").alias("over"))
    return up.join(over, "to", "left").select("c", F.coalesce("over", "to").alias("to"), "pw", "ph")


def density_clusters(vertices: DataFrame, edges: DataFrame, smallest: int = SMALLEST, loosest: float = LOOSEST, densest: float = DENSEST) -> Hierarchy:
    """Clusters of the condensed tree with the greatest total stability.

    ``vertices`` has (id, n), the number of observations a vertex stands for;
    ``edges`` (a, b, w) with w at most 1; ids are any bigint. ``labels`` is (id,
    cluster, strength), one row per vertex in a node: the cluster is NULL for
    one that fell out above it, strength is the density at which the vertex
    joined. ``nodes`` is the condensed tree (node, parent, stability, size,
    selected); ``tree`` the minimum spanning forest (a, b, w). Equal
    similarities are ordered by a hash of the edge, so the outcome does not
    depend on row order.
    """
    spark = vertices.sparkSession
    top = _strength(densest)
    whole = F.col("n") >= smallest
    made = F.concat(F.col("id").cast("string"), F.lit("c"))  # a node of copies; others are named after what joined when they formed
    items = vertices.select(
        F.col("id").alias("c"), F.lit(0).alias("joined"), F.lit(None).cast("double").alias("w"), F.lit(0).cast("bigint").alias("h"), F.col("id").alias("sub"), F.col("n").cast("bigint").alias("size"),
        F.when(whole, made).alias("node"), F.when(whole, F.col("n") * top).otherwise(F.lit(0.0)).alias("s1"), F.lit(0.0).alias("best"), F.when(~whole, F.array("id")).otherwise(F.array().cast("array<bigint>")).alias("few"),
    )
    items = materialize(items)
    said = [items.filter("node is not null").select(F.lit(1).alias("kind"), F.array("c").alias("few"), "node", F.lit(top).alias("at"), F.lit(None).cast("string").alias("parent"), F.col("size"), "s1", "best")]
    keep = ["kind", "few", "node", "at", "parent", "size", "s1", "best"]
    edges = materialize(edges.filter(F.col("w") >= loosest).select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w", F.xxhash64("a", "b").alias("h"), "a", "b"))
    idle: list[DataFrame] = []
    picked: list[DataFrame] = []
    first = True
    while not edges.isEmpty():
        both = edges.select(F.col("ca").alias("c"), F.col("cb").alias("to"), "w", "h", "a", "b").unionByName(edges.select(F.col("cb").alias("c"), F.col("ca").alias("to"), "w", "h", "a", "b"))
        best = both.groupBy("c").agg(F.min(F.struct((-F.col("w")).alias("s"), "h", "a", "b", "to")).alias("m"))
        best = materialize(best.select("c", F.col("m.to").alias("to"), (-F.col("m.s")).alias("pw"), F.col("m.h").alias("ph"), F.col("m.a").alias("a"), F.col("m.b").alias("b")))
        picked.append(best.select("a", "b", F.col("pw").alias("w")))
        # two that picked each other: the smaller label is the root
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        up = best.join(back, "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"), "pw", "ph")
        up = materialize(_jump(_jump(up)))
        # one that is further than 16 steps from its root waits for the next round as a component of its own
        over = _jump(_jump(up)).withColumnRenamed("to", "far").drop("pw", "ph")
        done = up.select(F.col("c").alias("far"), F.col("to").alias("end"))
        up = materialize(up.drop("to").join(over, "c").join(done, "far", "left").select("c", F.when(F.col("end") == F.col("far"), F.col("far")).otherwise(F.col("c")).alias("to"), "pw", "ph"))
        idle.append(items.join(up.select("c"), "c", "left_anti"))
        live = items.join(up, "c")
        if first:
            state, later = live.select("c", *_FIELDS, "to", "pw", "ph"), None
        else:
            before = (F.col("joined") == 0) | (F.col("w") > F.col("pw")) | ((F.col("w") == F.col("pw")) & (F.col("h") < F.col("ph")))
            grown = materialize(_grow(live.filter(before).drop("to", "pw", "ph"), smallest, densest))
            said.append(grown.filter("kind > 0").select(keep))
            state = grown.filter("kind = 0").select("c", *_FIELDS).join(up, "c")
            later = live.filter(~before).select(F.col("to").alias("c"), "joined", "w", "h", "sub", *_FIELDS)
        root = F.col("to") == F.col("c")
        after = state.select(
            F.col("to").alias("c"), F.when(root, 0).otherwise(1).alias("joined"), F.when(~root, F.col("pw")).alias("w"), F.when(root, F.lit(0).cast("bigint")).otherwise(F.col("ph")).alias("h"), F.col("c").alias("sub"), *_FIELDS
        )
        items = materialize(after.unionByName(later) if later is not None else after)
        here = up.select("c", "to")
        moved = edges.join(here.select(F.col("c").alias("ca"), F.col("to").alias("na")), "ca").join(here.select(F.col("c").alias("cb"), F.col("to").alias("nb")), "cb")
        edges = materialize(moved.select(F.col("na").alias("ca"), F.col("nb").alias("cb"), "w", "h", "a", "b").filter("ca <> cb"))
        first = False
    idle.append(items)
    rest = idle[0]
    for x in idle[1:]:
        rest = rest.unionByName(x)
    # what never met anything and is no node by itself stays outside
    grown = materialize(_grow(rest, smallest, densest))
    said.append(grown.filter("kind > 0").select(keep))
    last = _strength(loosest)
    said.append(grown.filter("kind = 0 and node is not null").select(F.lit(2).alias("kind"), "few", "node", F.lit(last).alias("at"), F.lit(None).cast("string").alias("parent"), "size", (F.col("s1") - F.col("size") * last).alias("s1"), "best").select(keep))
    told = said[0]
    for x in said[1:]:
        told = told.unionByName(x)
    told = materialize(told)
    nodes = materialize(told.filter("kind = 2").select("node", "parent", F.col("s1").alias("stability"), "size", (F.col("s1") >= F.col("best")).alias("selected")))
    entries = told.filter("kind = 1").select(F.explode("few").alias("id"), "node", F.col("at").alias("strength"))
    labels = entries.join(_chosen(nodes), "node", "left").select("id", "cluster", "strength")
    tree = picked[0] if picked else edges.select("a", "b", "w")
    for t in picked[1:]:
        tree = tree.unionByName(t)
    return Hierarchy(labels, nodes, tree.distinct())


def _chosen(nodes: DataFrame) -> DataFrame:
    """(node, cluster): the highest selected node at or above each, by doubling the way looked up."""
    at = nodes.select("node", "parent", F.when(F.col("selected"), F.col("node")).alias("cluster"))
    while True:
        at = materialize(at)
        if at.filter("parent is not null").isEmpty():
            return at.select("node", "cluster")
        over = at.select(F.col("node").alias("parent"), F.col("parent").alias("next"), F.col("cluster").alias("higher"))
        at = at.join(over, "parent", "left").select("node", F.col("next").alias("parent"), F.coalesce("higher", "cluster").alias("cluster"))


def _sums(rows: DataFrame, dimension: int) -> DataFrame:
    """(cluster, n, v): number of members and the sum of their vectors, added up per split before the shuffle.

    ``rows`` has (cluster, n, v): v in float32 bytes, n copies of it. Sums
    travel as float64 bytes.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            kind = "<f8" if len(b.column(2)[0].as_buffer()) == 8 * dimension else "<f4"
            x = _matrix(b.column(2), dimension, kind).astype(np.float64)
            n, c = b.column(1).to_numpy(), b.column(0).to_numpy()
            if kind == "<f4":
                x = x * n[:, None]
            names, code = np.unique(c, return_inverse=True)
            order = np.argsort(code, kind="stable")
            at = np.searchsorted(code[order], np.arange(len(names)))
            s, m = np.add.reduceat(x[order], at, axis=0), np.add.reduceat(n[order], at)
            for j, name in enumerate(names.tolist()):
                if name in total:
                    total[name][0] += int(m[j])
                    total[name][1] += s[j]
                else:
                    total[name] = [int(m[j]), s[j].copy()]
            if len(total) > 50_000:
                yield _batch(total, dimension)
                total = {}
        yield _batch(total, dimension)

    fields = "cluster bigint, n bigint, v binary"
    part = rows.select("cluster", "n", "v").mapInArrow(add, fields)
    return part.repartition("cluster").mapInArrow(add, fields).groupBy("cluster").agg(F.sum("n").alias("n"), F.max("v").alias("v"))


def _batch(total: dict, dimension: int) -> pa.RecordBatch:
    names = np.array(list(total), np.int64)
    sums = np.array([t[1] for t in total.values()]).reshape(-1, dimension)
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array([t[0] for t in total.values()], pa.int64()), _bytes(sums)], names=["cluster", "n", "v"])


def _best_fit(candidates: DataFrame, centres: DataFrame, floor: float, dimension: int) -> DataFrame:
    """(id, cluster, fit): for every candidate (id, n, v, cluster) the cluster whose mean it fits best, if at least ``floor``."""

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), dimension).astype(np.float64)
            m = _matrix(b.column(3), dimension, "<f8")
            c = (x * m).sum(axis=1) / np.maximum(np.linalg.norm(m, axis=1) * np.linalg.norm(x, axis=1), 1e-300)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c)], names=["id", "cluster", "fit"])

    paired = candidates.join(centres.select("cluster", F.col("v").alias("m")), "cluster").select("id", "cluster", "v", "m")
    fits = paired.mapInArrow(cosines, "id bigint, cluster bigint, fit double").filter(F.col("fit") >= floor)
    return fits.groupBy("id").agg(F.min(F.struct((-F.col("fit")).alias("s"), "cluster")).alias("m")).select("id", F.col("m.cluster").alias("cluster"), (-F.col("m.s")).alias("fit"))


def exact_members(classes: DataFrame, graph: DataFrame, labels: DataFrame, floor: float, smallest: int, dimension: int) -> DataFrame:
    """(id, cluster, fit): members made exact against the means of their clusters.

    In each round every vertex is held against the means of its own cluster
    and of its neighbours' clusters and goes to the best of at least
    ``floor``; clusters that become too small end. Rounds go on until nothing
    moves: each raises the sum of fits, or ends a cluster.
    """
    base = classes.select("id", "n", "v")
    links = graph.select(F.col("q").alias("id"), F.explode("best.nb").alias("nb"))
    links = materialize(links.unionByName(links.select(F.col("nb").alias("id"), F.col("id").alias("nb"))).distinct())
    now = materialize(labels.filter("cluster is not null").select("id", "cluster", F.lit(0.0).alias("fit")))
    while True:
        centres = materialize(_sums(base.join(now, "id"), dimension).filter(F.col("n") >= smallest))
        theirs = links.join(now.select(F.col("id").alias("nb"), "cluster"), "nb").select("id", "cluster")
        candidates = base.join(theirs.unionByName(now.select("id", "cluster")).distinct(), "id")
        after = materialize(_best_fit(candidates, centres, floor, dimension))
        same = after.join(now.select("id", F.col("cluster").alias("old")), "id", "full").filter("not (cluster <=> old)").isEmpty()
        now = after
        if same:
            break
    total = now.join(base.select("id", "n"), "id").groupBy("cluster").agg(F.sum("n").alias("__n")).filter(F.col("__n") >= smallest)
    return now.join(total.select("cluster"), "cluster", "left_semi")


def attach(classes: DataFrame, members: DataFrame, floor: float, dimension: int) -> DataFrame:
    """(id, cluster, fit): vectors outside every cluster whose most similar cluster mean reaches ``floor``.

    The vectors left over are queries against the means alone, so a member
    that fell out of the hierarchy still finds its cluster.
    """
    base = classes.select("id", "n", "v")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1), dimension, "<f8")
            u = (m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]).astype("<f4")
            yield pa.RecordBatch.from_arrays([b.column(0), _bytes(u)], names=["cluster", "v"])

    means = _sums(base.join(members.select("id", "cluster"), "id"), dimension).select("cluster", "v").mapInArrow(unit, "cluster bigint, v binary")
    rest = classes.join(members.select("id"), "id", "left_anti").select("id", "v", F.lit(2).alias("role"))
    both = materialize(rest.unionByName(means.select(F.col("cluster").alias("id"), "v", F.lit(1).alias("role"))))
    near = similar_classes(both, 1, floor, 4, seed=31, cell=4 * CELL, dimension=dimension)
    return near.select(F.col("q").alias("id"), F.col("best")[0]["nb"].alias("cluster"), (-F.col("best")[0]["s"]).alias("fit"))


@dataclass(frozen=True)
class Clusters:
    classes: DataFrame
    members: DataFrame
    tree: DataFrame


def cluster_vectors(units: DataFrame, floor: float = 0.75, smallest: int = SMALLEST, dimension: int = DIMENSION) -> Clusters:
    """Clusters of the vectors in ``units`` (obs, v): at least ``smallest`` keys, each with a cosine of at least ``floor`` to the mean.

    ``members`` is (id, cluster, fit, strength), one row per distinct vector;
    ``classes`` maps its id to the keys that share it. Vectors that fit
    nowhere are left out; clusters do not overlap; copies count as members of
    their own. In a set whose members all reach 0.75 against the mean, every
    member has a neighbour in the set with a similarity above 0.45, the
    loosest density. An empty table gives empty results.
    """
    classes = materialize(classes_of(units, "obs", 1))
    graph = materialize(neighbor_graph(classes, dimension=dimension))
    edges = reachability_edges(graph, classes.select("id", "n"))
    h = density_clusters(classes.select("id", "n"), edges, smallest)
    labels = materialize(h.labels)
    # a cluster is called after its smallest vertex
    names = labels.groupBy("cluster").agg(F.min("id").alias("named"))
    chosen = labels.join(names, "cluster").select("id", F.col("named").alias("cluster"))
    members = materialize(exact_members(classes, graph, chosen, floor, smallest, dimension))
    more = materialize(attach(classes, members, floor, dimension))
    if not more.isEmpty():
        members = exact_members(classes, graph, members.unionByName(more), floor, smallest, dimension)
    return Clusters(classes, materialize(members.join(labels.select("id", "strength"), "id", "left")), h.tree)


def cluster_members(c: Clusters, units: DataFrame) -> DataFrame:
    """(cluster_obs, obs): one row per key in a cluster, which is named after its smallest key."""
    named = c.members.withColumn("__m", F.lit(1)).groupBy("cluster").agg(F.min("id").alias("cluster_obs"))
    ids = c.members.join(named, "cluster").select("id", "cluster_obs")
    byv = ids.join(c.classes.select("id", "v", "n"), "id")
    single = byv.filter("n = 1").select("cluster_obs", F.col("id").alias("obs"))
    many = byv.filter("n > 1").select("cluster_obs", "v")
    return single.unionByName(units.join(many, "v").select("cluster_obs", "obs"))


def cluster_summary(c: Clusters, exemplars: int = 3) -> DataFrame:
    """(cluster_obs, size, mean_fit, exemplars): size and the most persistent members, those that joined at the highest density.

    Equal densities: the better fit to the mean, then the smaller key.
    """
    sized = c.members.join(c.classes.select("id", "n"), "id")
    out = sized.groupBy("cluster").agg(
        F.min("id").alias("cluster_obs"), F.sum("n").alias("size"), (F.sum(F.col("n") * F.col("fit")) / F.sum("n")).alias("mean_fit"),
        heap(F.struct((-F.coalesce("strength", F.lit(0.0))).alias("s"), (-F.col("fit")).alias("f"), F.col("id").alias("obs")), exemplars).alias("top"),
    )
    return out.select("cluster_obs", "size", "mean_fit", F.col("top.obs").alias("exemplars"))
