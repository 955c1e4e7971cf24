"""Queries of the training-data problems and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnstat.functions.normal import quantile_sql
from cairnstat.llm.clusters import cluster_members, cluster_summary, cluster_vectors
from cairnstat.llm.fusion import fused_ranking
from cairnstat.llm.mixing import Mixture, mix
from cairnstat.llm.neighbors import close_pairs, nearest, unit_vectors
from cairnstat.llm.packing import CAPACITY, pack, packing_report
from cairnstat.llm.tokens import token_counts
from cairnstat.llm.topn import top_n
from cairnstat.llm.toxicity import score_documents, source_rates
from cairnstat.operators.current import current_rows
from cairnstat.session import materialize
from cairnstat.sources import table

TOP_PER_GROUP = 10
LEADERS = 5
MARKER_SCORES = {"logfc_cohen": (True, 1.0), "p_value": (False, 1.0), "top_rank": (False, 1.0)}


def p1_top_effects(spark: SparkSession, d: str) -> DataFrame:
    """The 10 rows of each first with the highest effect, with their place."""
    stats = table(spark, d, "pair_stats").filter("first <> ''")
    known = table(spark, d, "features").select("feature", "feature_idx")
    # the index stands for the name until the end: narrower rows to shuffle
    keyed = stats.join(known, "feature").select("first", "second", "feature_idx", "effect", "loaded_at")
    now = current_rows(keyed, ["first", "second", "feature_idx"], "loaded_at", ["effect"])
    best = top_n(now, ["first"], "effect", ["feature_idx", "second"], TOP_PER_GROUP)
    return best.join(known, "feature_idx").select("first", "second", "feature", "effect", "place")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_top_effects(spark, d).select("first", "second", "feature")


def _markers(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(table(spark, d, "markers"), ["grp", "feature"], "loaded_at", list(MARKER_SCORES))


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The combined score of every feature of every grp."""
    ranked = fused_ranking(materialize(_markers(spark, d)), ["grp"], ["feature"], MARKER_SCORES)
    return ranked.select("grp", "feature", F.round("combined", 6).alias("combined"), "n_scores")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The 5 features of each grp that lead the combined ranking."""
    ranked = fused_ranking(materialize(_markers(spark, d)), ["grp"], ["feature"], MARKER_SCORES)
    return top_n(ranked, ["grp"], "combined", ["feature"], LEADERS).select("grp", "feature")


NEIGHBORS = 5
CLOSE = 0.97


def _units(spark: SparkSession, d: str) -> DataFrame:
    return materialize(unit_vectors(table(spark, d, "pcs"), "obs", "pc"))


def p4_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar observations of every observation whose number is divisible by 20, among all observations."""
    units = _units(spark, d)
    near = nearest(units, units.filter("obs % 20 = 0"), NEIGHBORS)
    return near.select("obs", "neighbor", "similarity", "place")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of observations, each among the 5 most similar of the other, with a cosine of at least 0.97."""
    return close_pairs(_units(spark, d), NEIGHBORS, CLOSE)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per observation in a cluster, which is named after its smallest observation."""
    units = _units(spark, d)
    return cluster_members(cluster_vectors(units), units)


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every cluster with its size, its mean cosine to the mean, and its most typical members."""
    out = cluster_summary(cluster_vectors(_units(spark, d)))
    return out.select("cluster_obs", "size", F.round("mean_fit", 5).alias("mean_fit"), F.array_join("exemplars", " ").alias("exemplars"))


def p5_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One row: usable vectors, members whose cosine to their cluster's mean is below 0.75, members listed twice, clusters below 5 or not named after their smallest member."""
    found = materialize(p5_found(spark, d))
    x = F.col("pc")
    sound = (F.size(x) == 64) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0)
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, e: t + e * e))
    u = table(spark, d, "pcs").filter(sound).select("obs", F.transform(x, lambda e: e / norm(x)).alias("u")).dropDuplicates(["obs"])
    vectors = u.count()
    m = materialize(found.join(u, "obs"))
    means = m.select("cluster_obs", F.posexplode("u").alias("at", "e")).groupBy("cluster_obs", "at").agg(F.avg("e").alias("e"))
    means = means.groupBy("cluster_obs").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda p: p["e"]).alias("mean"))
    dot = F.aggregate(F.zip_with("u", "mean", lambda a, b: a * b), F.lit(0.0), lambda t, e: t + e)
    fit = m.join(means, "cluster_obs").select("obs", (dot / norm(F.col("mean"))).alias("cosine"))
    members = fit.agg(F.count_if(F.col("cosine") < 0.75 - 1e-6).alias("misfits"), (F.count("*") - F.count_distinct("obs")).alias("repeated"))
    small = found.groupBy("cluster_obs").agg(F.count("*").alias("n"), F.min("obs").alias("least")).agg(F.count_if((F.col("n") < 5) | (F.col("least") != F.col("cluster_obs"))).alias("unsound"))
    return members.join(F.broadcast(small)).select(F.lit(vectors).cast("bigint").alias("vectors"), "misfits", "repeated", "unsound")  # one row each


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Every document's size in tokens, counted once and kept."""
    return materialize(token_counts(table(spark, d, "documents"), "doc_id", "text", keep=["source"]))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of each piece of one that exceeds a container."""
    return pack(_sizes(spark, d), "doc_id", "n_tokens")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the fewest possible, and the share of room left unused."""
    return packing_report(p6_packed(spark, d), "n_tokens")


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents placed or known to be empty, containers above capacity, documents split although they fit, whether under 2 % of room is unused."""
    sizes = _sizes(spark, d)
    packed = materialize(pack(sizes, "doc_id", "n_tokens"))
    items = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces"))
    both = sizes.select("doc_id", "n_tokens").join(items, "doc_id")
    a = both.agg(F.count_if(F.col("placed") == F.col("n_tokens")).alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= CAPACITY)).alias("needlessly_split"))
    b = packed.filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("u")).agg(
        F.count_if(F.col("u") > CAPACITY).alias("over_capacity"), (F.sum("u") > 0.98 * CAPACITY * F.count("*")).alias("dense")
    )
    return a.join(F.broadcast(b)).select("documents", "needlessly_split", "over_capacity", "dense")  # one row each


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that the packing had to split."""
    return p6_packed(spark, d).groupBy("doc_id").agg(F.count("*").alias("pieces")).filter("pieces > 1").select("doc_id")


def _mixture(spark: SparkSession, d: str) -> Mixture:
    return mix(_sizes(spark, d), "doc_id", "source", "n_tokens", table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: which tokens of which document stand in each slot of each shard."""
    return _mixture(spark, d).rows


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share, tokens and repetitions of every source."""
    return _mixture(spark, d).shares


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One row: sources with a target, those used more often than allowed, those neither short nor within a hundredth of their due, whether shares add up to 1."""
    m = _mixture(spark, d)
    shares = m.shares
    uses = m.rows.groupBy("source", "block", "doc_id", "tok_from").agg(F.count("*").alias("uses"))
    limit = table(spark, d, "mix_targets").select(F.lower(F.trim("source")).alias("source"), F.coalesce("max_repeats", F.lit(1)).alias("most"))
    over = uses.join(F.broadcast(limit), "source").filter("uses > most").agg(F.count_distinct("source").alias("overused"))  # a settings table
    # what short sources lack goes to the others in proportion to their targets
    given = shares.agg(F.sum(F.when(F.col("short"), F.col("actual_share")).otherwise(0.0)).alias("g"), F.sum(F.when(~F.col("short"), F.col("target_share")).otherwise(0.0)).alias("t"))
    due = F.when(F.col("short"), F.col("actual_share")).otherwise(F.col("target_share") / F.col("t") * (1 - F.col("g")))
    off = shares.join(F.broadcast(given)).agg(F.count("*").alias("sources"), F.count_if(F.abs(F.col("actual_share") - due) > 0.01).alias("off_target"), (F.abs(F.sum("actual_share") - 1) < 1e-9).alias("whole"))
    return off.join(F.broadcast(over)).select("sources", "overused", "off_target", "whole")  # one row each


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The sources that stay below their target with all their repetitions."""
    return p7_shares(spark, d).filter("short and actual_share < target_share").select("source")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return score_documents(table(spark, d, "documents"), "doc_id", "text", keep=["source"])


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """The abuse score of every document."""
    return _scored(spark, d).select("doc_id", F.round("score", 6).alias("score"), "flagged")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of flagged documents per source."""
    return source_rates(_scored(spark, d), "source")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents scored as abusive, hateful or sexual."""
    return _scored(spark, d).filter("flagged").select("doc_id")


_P1 = """WITH now AS (SELECT first, second, feature, m.e AS effect FROM (
  SELECT first, second, feature, arg_max({'e': effect}, loaded_at) AS m FROM pair_stats WHERE first <> '' GROUP BY ALL)),
r AS (SELECT first, second, feature, effect, row_number() OVER (PARTITION BY first ORDER BY effect DESC, feature_idx, second) AS place
  FROM now JOIN features USING (feature) WHERE effect IS NOT NULL AND NOT isnan(effect))"""
_P2 = f"""WITH now AS (SELECT grp, feature, unnest(m) FROM (
  SELECT grp, feature, arg_max({{'a': logfc_cohen, 'b': -p_value, 'c': CAST(-top_rank AS DOUBLE)}}, loaded_at) AS m FROM markers GROUP BY grp, feature)),
l AS (SELECT grp, feature, i, CASE WHEN NOT isnan(v) THEN v END AS v FROM (
  SELECT grp, feature, 1 AS i, a AS v FROM now UNION ALL SELECT grp, feature, 2, b FROM now UNION ALL SELECT grp, feature, 3, c FROM now)),
q AS (SELECT *, (rank() OVER w - 1 + count(*) OVER (PARTITION BY grp, i, v) / 2.0e0) / count(*) OVER (PARTITION BY grp, i) AS q
  FROM l WHERE v IS NOT NULL WINDOW w AS (PARTITION BY grp, i ORDER BY v)),
z AS (SELECT grp, feature, avg({quantile_sql('q')}) AS combined, count(*) AS n_scores FROM q GROUP BY grp, feature)"""

# every pair of unit vectors in single precision, as the operator compares them
_P4 = f"""WITH u AS (SELECT obs, [x / n FOR x IN pc]::FLOAT[]::DOUBLE[] AS v FROM (
  SELECT DISTINCT obs, pc, sqrt(list_sum([x * x FOR x IN pc])) AS n FROM pcs WHERE len(pc) = 64
  AND len([1 FOR x IN pc IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([1 FOR x IN pc IF x <> 0]) > 0)),
r AS (SELECT a.obs AS obs, b.obs AS neighbor, round(list_inner_product(a.v, b.v), 6) AS s FROM u a JOIN u b ON a.obs <> b.obs WHERE {{asked}}),
near AS (SELECT obs, neighbor, greatest(-1, least(1, s)) AS s, row_number() OVER (PARTITION BY obs ORDER BY s DESC, neighbor) AS place FROM r QUALIFY place <= {NEIGHBORS})"""

QUERIES = {
    "p1_found": p1_found, "p1_top_effects": p1_top_effects, "p2_found": p2_found, "p2_ranking": p2_ranking,
    "p4_found": p4_found, "p4_neighbors": p4_neighbors,
    "p5_found": p5_found, "p5_clusters": p5_clusters, "p5_invariants": p5_invariants,
    "p6_found": p6_found, "p6_invariants": p6_invariants, "p6_packed": p6_packed, "p6_report": p6_report,
    "p7_found": p7_found, "p7_invariants": p7_invariants, "p7_mixture": p7_mixture, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates,
}
SQL = {
    "p5_invariants": """SELECT count(DISTINCT obs) AS vectors, 0 AS misfits, 0 AS repeated, 0 AS unsound FROM pcs
WHERE len(pc) = 64 AND len([1 FOR x IN pc IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([1 FOR x IN pc IF x <> 0]) > 0""",
    "p6_invariants": "SELECT count(*) AS documents, 0 AS needlessly_split, 0 AS over_capacity, true AS dense FROM documents",
    "p7_invariants": "SELECT count(*) AS sources, 0 AS overused, 0 AS off_target, true AS whole FROM mix_targets WHERE source IS NOT NULL",
    "p1_found": f"{_P1} SELECT first, second, feature FROM r WHERE place <= {TOP_PER_GROUP}",
    "p1_top_effects": f"{_P1} SELECT first, second, feature, effect, CAST(place AS INT) AS place FROM r WHERE place <= {TOP_PER_GROUP}",
    "p4_found": f"{_P4.format(asked='true')} SELECT a.obs AS obs_a, a.neighbor AS obs_b FROM near a JOIN near b ON a.obs = b.neighbor AND a.neighbor = b.obs WHERE a.obs < a.neighbor AND a.s >= {CLOSE}",
    "p4_neighbors": f"{_P4.format(asked='a.obs % 20 = 0')} SELECT obs, neighbor, s AS similarity, CAST(place AS INT) AS place FROM near",
    "p2_found": f"{_P2}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY combined DESC, feature) AS k FROM z) SELECT grp, feature FROM r WHERE k <= {LEADERS}",
    "p2_ranking": f"{_P2} SELECT now.grp AS grp, now.feature AS feature, round(combined, 6) AS combined, coalesce(n_scores, 0) AS n_scores "
    "FROM now LEFT JOIN z ON now.grp IS NOT DISTINCT FROM z.grp AND now.feature = z.feature",
}
