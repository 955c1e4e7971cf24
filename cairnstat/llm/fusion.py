"""One ranking from several scores on unlike scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnstat.functions.normal import quantile
from cairnstat.session import materialize, parallelism

#: Cut points within a group that is ranked in pieces.
PIECES = 64
#: Relative accuracy of those cut points; it only affects how even the pieces are.
ACCURACY = 2_000
#: Rows from which a group may be ranked in pieces.
LARGE = 50_000


def average_percentile(long: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: (average rank of ``value`` within its group - 0.5) / group size.

    Rows are first counted per distinct value, so any number of equal values
    is one row from then on; ranks are taken over distinct values and joined
    back. A group with more than its fair share of distinct values is ranked
    in pieces: cut points of its values, at most PIECES for each of at most 4
    times as many groups as there are tasks, divide it, and each piece adds
    the number of rows below it. ``value`` is neither NULL nor NaN. A group of
    one gets 0.5.
    """
    spark = long.sparkSession
    long = materialize(long)
    gs = [f"__g{i}" for i in range(len(group))]
    named_as = [F.col(g).alias(a) for g, a in zip(group, gs)]

    def same(left: list[str]) -> Column:
        on = F.lit(True)
        for g, a in zip(left, gs):
            on = on & F.col(g).eqNullSafe(F.col(a))
        return on

    each = materialize(long.groupBy(*named_as, F.col(value).alias("__x")).agg(F.count("*").alias("__c")))
    sizes = materialize(each.groupBy(*gs).agg(F.count("*").alias("__n"), F.sum("__c").alias("__size")))
    rows = sizes.agg(F.sum("__n")).first()[0] or 0
    # at most 4 * parallelism groups can be above this
    hot = sizes.filter(F.col("__n") > max(rows // (4 * parallelism(spark)), LARGE)).drop("__n", "__size").collect()
    if hot:
        keys = [f"{a}k" for a in gs]
        rename = lambda df: df.select(*[F.col(a).alias(k) for a, k in zip(gs, keys)], *[c for c in df.columns if c not in gs])
        few = F.broadcast(rename(spark.createDataFrame(hot, sizes.select(*gs).schema)))
        cuts = each.join(few, same(keys)).groupBy(*gs).agg(F.percentile_approx("__x", [i / PIECES for i in range(1, PIECES)], ACCURACY).alias("__cuts"))
        known = spark.createDataFrame(cuts.collect(), cuts.schema)
        x = each.join(F.broadcast(rename(known)), same(keys), "left").drop(*keys)
        x = x.withColumn("__p", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__x"))), F.lit(0))).drop("__cuts")
    else:
        x = each.withColumn("__p", F.lit(0))
    before = Window.partitionBy(*gs, "__p").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__below", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    if hot:
        counts = x.join(few, same(keys), "left_semi").groupBy(*gs, "__p").agg(F.sum("__c").alias("__pc"))
        earlier = Window.partitionBy(*gs).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        offsets = rename(counts.select(*gs, F.col("__p").alias("__cp"), F.coalesce(F.sum("__pc").over(earlier), F.lit(0)).alias("__off")))
        x = x.join(F.broadcast(offsets), (F.col("__p") == F.col("__cp")) & same(keys), "left").withColumn("__below", F.col("__below") + F.coalesce("__off", F.lit(0))).drop(*keys)
    # sizes join on the group, ranks on (group, value)
    total = sizes.select(*[F.col(a).alias(f"{a}s") for a in gs], "__size")
    on = F.lit(True)
    for a in gs:
        on = on & F.col(a).eqNullSafe(F.col(f"{a}s"))
    ranked = x.join(total, on).select(*gs, "__x", ((F.col("__below") + F.col("__c") / 2.0) / F.col("__size")).alias(out))
    return long.join(ranked, same(group) & (F.col(value) == F.col("__x"))).select(*long.columns, out)


def fused_ranking(df: DataFrame, group: list[str], item: list[str], scores: dict[str, tuple[bool, float]]) -> DataFrame:
    """Per group and item: ``combined`` (higher is better) and ``n_scores``, the scores it rests on.

    ``scores`` maps a column to (high is good, weight). Each score becomes its
    empirical percentile within the group, ties averaged, then a normal
    deviate; the weighted mean over the scores present is the combined score.
    NULL and NaN scores count neither for nor against an item; an item without
    any has ``combined`` NULL. It is kept to 12 decimals, so that the order in
    which scores are added up never parts equal items. Infinite scores take the extreme ranks. (group,
    item) is unique. NULL in a group column is a group of its own. An empty
    table gives an empty result; other columns are dropped.
    """
    each = []
    for i, (c, (high, weight)) in enumerate(scores.items()):
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v if high else -v)
        each.append(F.struct(F.lit(i).alias("i"), v.alias("v"), F.lit(float(weight)).alias("w")))
    long = df.select(*group, *item, F.explode(F.array(*each)).alias("__s")).select(*group, *item, F.col("__s.i").alias("__i"), F.col("__s.v").alias("__v"), F.col("__s.w").alias("__w"))
    ranked = average_percentile(long.filter("__v is not null"), [*group, "__i"], "__v", "__q")
    z = ranked.withColumn("__z", quantile("__q")).select(*group, *item, "__w", "__z")
    # items without any score come back from the unranked side
    both = z.unionByName(long.filter("__v is null").select(*group, *item, F.lit(0.0).alias("__w"), F.lit(0.0).alias("__z")))
    out = both.groupBy(*group, *item).agg(F.sum(F.col("__w") * F.col("__z")).alias("__t"), F.sum("__w").alias("__d"), F.count_if(F.col("__w") > 0).alias("n_scores"))
    return out.select(*group, *item, F.when(F.col("__d") > 0, F.round(F.col("__t") / F.col("__d"), 12)).alias("combined"), "n_scores")
