"""Assays: one measurement table with its features and observations.

An assay is a long table (feature, obs, value) without rows for zeros, the
universe of features with an index that breaks ties, and the observations with
their group, block and size factor. NULL and empty labels mean "no label".
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cairnstat.operators.current import current_rows
from cairnstat.session import materialize
from cairnstat.sources.tables import table


@dataclass(frozen=True)
class Assay:
    values: DataFrame
    features: DataFrame
    observations: DataFrame

    def restrict(self, groups: list[str] | None = None, exclude: list[str] = ()) -> "Assay":
        """Only observations with a label, among ``groups`` and not in ``exclude``; their values follow."""
        keep = self.observations.filter("grp <> ''")
        if groups is not None:
            keep = keep.filter(F.col("grp").isin(list(groups)))
        if exclude:
            keep = keep.filter(~F.col("grp").isin(list(exclude)))
        return replace(self, observations=keep, values=self.values.join(keep.select("obs"), "obs", "left_semi"))

    def subset(self, features: list[str]) -> "Assay":
        """The same assay over the named features; names that do not occur are ignored."""
        return replace(self, values=self.values.filter(F.col("feature").isin(features)), features=self.features.filter(F.col("feature").isin(features)))

    def relabel(self, grp: str | None = None, block: str | None = None) -> "Assay":
        """Take groups and blocks from other columns of the observations; NULL block means one block for all."""
        o = self.observations
        o = o.withColumn("grp", F.col(grp)) if grp else o
        return replace(self, observations=o.withColumn("block", F.col(block) if block else F.lit("all")))

    def normalized(self, log: bool = True, pseudo: float = 1.0) -> "Assay":
        """value / size_factor, or log2 of that plus ``pseudo`` (1 keeps zeros zero; others need `densify` first)."""
        v = F.col("value") / F.col("size_factor")
        v = F.log2(v + pseudo) if log else v
        return replace(self, values=self.values.join(self.observations.select("obs", "size_factor"), "obs").select("feature", "obs", v.alias("value")))


def library_size_factors(values: DataFrame) -> DataFrame:
    """(obs, size_factor): each observation's total over the mean total."""
    totals = values.groupBy("obs").agg(F.sum("value").alias("__t"))
    mean = totals.agg(F.avg("__t").alias("__mean"))
    return totals.join(F.broadcast(mean)).select("obs", (F.col("__t") / F.col("__mean")).alias("size_factor"))  # one row is broadcast


def stored(spark: SparkSession, d: str) -> Assay:
    """The assay, features and current observations of the test tables.

    Repeats are dropped; NULL and NaN values count as absent; observations
    without a size factor get 1.
    """
    x = table(spark, d, "assay").filter("value is not null and not isnan(value)").groupBy("feature", "obs").agg(F.max("value").alias("value")).filter("value <> 0")
    x = materialize(x)
    o = current_rows(table(spark, d, "observations"), ["obs"], "loaded_at", ["grp", "block", "size_factor"])
    label = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    o = materialize(o.select("obs", label("grp"), label("block"), F.coalesce("size_factor", F.lit(1.0)).alias("size_factor")))
    return Assay(x, table(spark, d, "features"), o)


def brand_by_customer(spark: SparkSession, d: str) -> Assay:
    """Quantity of each brand per customer; groups are market segments, blocks are regions."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    x = li.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    values = x.groupBy(F.col("p_brand").alias("feature"), F.col("o_custkey").alias("obs")).agg(F.sum("l_quantity").alias("value"))
    values = materialize(values)  # every statistic of the assay reads it again
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name", "n_name")
    c = table(spark, d, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))  # nations: 25 rows
    o = c.select(F.col("c_custkey").alias("obs"), F.col("c_mktsegment").alias("grp"), F.col("r_name").alias("block")).join(library_size_factors(values), "obs")
    o = materialize(o)
    return Assay(values, _indexed(table(spark, d, "part").select(F.col("p_brand").alias("feature"))), o)


def part_by_supplier(spark: SparkSession, d: str) -> Assay:
    """Quantity of each part per supplier; groups are regions, blocks are nations. Three cells in a hundred are filled."""
    values = table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("feature"), F.col("l_suppkey").alias("obs")).agg(F.sum("l_quantity").alias("value"))
    values = materialize(values)
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name", "n_name")
    s = table(spark, d, "supplier").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))  # nations: 25 rows
    o = s.select(F.col("s_suppkey").alias("obs"), F.col("r_name").alias("grp"), F.col("n_name").alias("block")).join(library_size_factors(values), "obs", "left")
    o = materialize(o)
    feats = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("feature"), F.col("p_partkey").cast("int").alias("feature_idx"))
    return Assay(values, feats, o)


def embedding_dimensions(spark: SparkSession, d: str) -> Assay:
    """Embedding coordinates: features are dimensions, groups are labels; signed and dense."""
    e = table(spark, d, "embeddings")
    values = e.select("vec_id", F.posexplode("embedding").alias("i", "v")).select(F.format_string("d%02d", F.col("i")).alias("feature"), F.col("vec_id").alias("obs"), F.col("v").cast("double").alias("value"))
    o = e.select(F.col("vec_id").alias("obs"), F.col("label").cast("string").alias("grp"), F.lit("all").alias("block"), F.lit(1.0).alias("size_factor"))
    return Assay(values, _indexed(values.select("feature")), o)


def _indexed(features: DataFrame) -> DataFrame:
    """Distinct names with their place in alphabetical order, from 1. For small universes of features."""
    return features.distinct().select("feature", F.row_number().over(Window.orderBy("feature")).alias("feature_idx"))
