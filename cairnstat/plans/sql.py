"""SQL text shared by the oracles."""

#: Brand by customer: x(feature, obs, value), o(obs, grp, block, size_factor), f(feature, feature_idx), y (lognormalised).
BRAND = """x AS (SELECT p_brand AS feature, o_custkey AS obs, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
lib AS (SELECT obs, sum(value) AS t FROM x GROUP BY obs),
sf AS (SELECT obs, t / (SELECT avg(t) FROM lib) AS size_factor FROM lib),
o AS (SELECT c_custkey AS obs, c_mktsegment AS grp, r_name AS block, size_factor FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN sf ON c_custkey = sf.obs),
f AS (SELECT p_brand AS feature, row_number() OVER (ORDER BY p_brand) AS feature_idx FROM (SELECT DISTINCT p_brand FROM part)),
y AS (SELECT x.feature AS feature, x.obs AS obs, log2(x.value / o.size_factor + 1) AS value FROM x JOIN o ON x.obs = o.obs)"""

#: Part by supplier, blocks are nations, groups are regions.
PART = """x AS (SELECT CAST(l_partkey AS VARCHAR) AS feature, l_suppkey AS obs, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
o AS (SELECT s_suppkey AS obs, r_name AS grp, n_name AS block FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT CAST(p_partkey AS VARCHAR) AS feature, p_partkey AS feature_idx FROM part)"""

#: The stored assay and its current observations.
STORED = """x AS (SELECT feature, obs, max(value) AS value FROM assay WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2 HAVING max(value) <> 0),
o AS (SELECT obs, nullif(m.g, '') AS grp, nullif(m.b, '') AS block, coalesce(m.s, 1) AS size_factor FROM (
  SELECT obs, arg_max({'g': grp, 'b': block, 's': size_factor}, loaded_at) AS m FROM observations GROUP BY obs)),
f AS (SELECT feature, feature_idx FROM features)"""

#: Embedding coordinates: every cell is filled.
EMBED = """x AS (SELECT 'd' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS feature, vec_id AS obs, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) r(i)),
o AS (SELECT vec_id AS obs, CAST(label AS VARCHAR) AS grp, 'all' AS block FROM embeddings)"""


def moments(values: str, by: str, name: str = "m") -> str:
    """CTEs for moments per feature and label, zeros filled in."""
    cols = [c.strip() for c in by.split(",")]
    known = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    on = " AND ".join(f"l.{c} = a.{c}" for c in cols)
    lev = ", ".join(f"l.{c} AS {c}" for c in cols)
    return f"""{name}_l AS (SELECT {by}, count(*) AS n FROM o WHERE {known} GROUP BY {by}),
{name}_a AS (SELECT v.feature AS feature, {by}, sum(v.value) AS s, sum(v.value * v.value) AS q, count(*) FILTER (v.value > 0) AS d
  FROM {values} v JOIN o ON v.obs = o.obs WHERE {known} GROUP BY v.feature, {by}),
{name} AS (SELECT f.feature AS feature, {lev}, n, coalesce(s, 0) / n AS mean,
  CASE WHEN n > 1 THEN greatest(coalesce(q, 0) - coalesce(s, 0) * coalesce(s, 0) / n, 0) / (n - 1) END AS variance, coalesce(d, 0) AS detected
  FROM f CROSS JOIN {name}_l l LEFT JOIN {name}_a a ON f.feature = a.feature AND {on})"""


BH = "least(1, min(p * m / r) OVER (PARTITION BY {by} ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
