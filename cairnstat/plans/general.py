"""Queries of the general training-data problem and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnstat.operators.accumulate import SEP, label_totals, pair_label
from cairnstat.operators.current import current_rows
from cairnstat.session import materialize
from cairnstat.sources import table

SHARE = 0.02


def p3_label_totals(spark: SparkSession, d: str) -> DataFrame:
    """Observations and size factors of every (grp, block) label over the current rows."""
    now = current_rows(table(spark, d, "observations"), ["obs"], "loaded_at", ["grp", "block", "size_factor"])
    labelled = now.withColumn("label", pair_label("grp", "block"))
    t = label_totals(labelled, "label", ["size_factor"])
    part = F.split("label", SEP)
    return t.select(
        part[0].alias("grp"), part[1].alias("block"), "n",
        F.col("size_factor_n").alias("n_size_factor"),
        F.round("size_factor_sum", 4).alias("sum_size_factor"),
        F.col("size_factor_min").alias("min_size_factor"),
        F.col("size_factor_max").alias("max_size_factor"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The labels that hold at least 2 % of the labelled observations."""
    totals = materialize(p3_label_totals(spark, d).select("grp", "block", "n"))
    whole = totals.agg(F.sum("n")).first()[0] or 0
    return totals.filter(F.col("n") >= SHARE * whole).select("grp", "block")


def p3_first_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows and effects of every first over the current rows of pair_stats."""
    now = current_rows(table(spark, d, "pair_stats").filter("first <> ''"), ["first", "second", "feature"], "loaded_at", ["effect"])
    t = label_totals(now, "first", ["effect"])
    return t.select(
        "first", "n", F.col("effect_n").alias("n_effect"), F.round("effect_sum", 4).alias("sum_effect"),
        F.col("effect_min").alias("min_effect"), F.col("effect_max").alias("max_effect"),
    )


_OBS_NOW = """SELECT obs, m.grp AS grp, m.block AS block, m.size_factor AS size_factor FROM (
  SELECT obs, arg_max({'grp': grp, 'block': block, 'size_factor': size_factor}, loaded_at) AS m FROM observations GROUP BY obs)"""

QUERIES = {"p3_found": p3_found, "p3_label_totals": p3_label_totals, "p3_first_totals": p3_first_totals}
SQL = {
    "p3_found": f"""WITH now AS ({_OBS_NOW}), lab AS (SELECT * FROM now WHERE grp <> '' AND block <> '')
SELECT grp, block FROM lab GROUP BY grp, block HAVING count(*) >= {SHARE} * (SELECT count(*) FROM lab)""",
    "p3_label_totals": f"""WITH now AS ({_OBS_NOW})
SELECT grp, block, count(*) AS n, count(size_factor) AS n_size_factor, round(sum(size_factor), 4) AS sum_size_factor,
  min(size_factor) AS min_size_factor, max(size_factor) AS max_size_factor
FROM now WHERE grp <> '' AND block <> '' GROUP BY grp, block""",
    "p3_first_totals": """WITH now AS (SELECT first, second, feature, m.e AS effect FROM (
  SELECT first, second, feature, arg_max({'e': effect}, loaded_at) AS m FROM pair_stats WHERE first <> '' GROUP BY ALL))
SELECT first, count(*) AS n, count(effect) FILTER (NOT isnan(effect)) AS n_effect,
  round(sum(effect) FILTER (NOT isnan(effect)), 4) AS sum_effect,
  min(effect) FILTER (NOT isnan(effect)) AS min_effect, max(effect) FILTER (NOT isnan(effect)) AS max_effect
FROM now GROUP BY first""",
}
