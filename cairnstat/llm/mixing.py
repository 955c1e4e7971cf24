"""Mixing sources to target weights.

Every source's token stream is cut into blocks of fixed length. The mixture is
a sequence of slots in shards; each shard draws its source counts from a
multinomial over what is still owed to each source, and the slots of a source
walk through pseudorandom permutations of its blocks, one permutation per
repetition. Slots and blocks meet in a join on (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairnstat.operators.prefix import bucket_count, running_total
from cairnstat.session import parallelism

BLOCK_TOKENS = 256
SHARD_SLOTS = 1024
#: Shards of one part of the mixture. A part is planned in one task, the parts on the driver (one row a part).
PART_SHARDS = 64


@dataclass(frozen=True)
class Source:
    name: str
    target: float
    repeats: int
    tokens: int
    blocks: int
    slots: int
    short: bool


def water_fill(shares: list[float], caps: list[float], total: float) -> list[float]:
    """Amounts proportional to ``shares``, none above its cap, that add up to ``total`` as far as the caps allow."""
    amount = [0.0] * len(shares)
    free = [i for i in range(len(shares)) if shares[i] > 0]
    left = min(total, sum(caps[i] for i in free))
    while free:
        scale = left / sum(shares[i] for i in free)
        over = [i for i in free if shares[i] * scale >= caps[i]]
        if not over:
            for i in free:
                amount[i] = shares[i] * scale
            break
        for i in over:
            amount[i] = caps[i]
            left -= caps[i]
        free = [i for i in free if i not in over]
        if left <= 0:
            break
    return amount


def plan_sources(targets: list[tuple[str, float, int]], tokens: dict[str, int], total: int, block: int) -> list[Source]:
    """Slots of every source. A source is short if all its repetitions stay below its target."""
    caps = [tokens.get(n, 0) * r for n, _, r in targets]
    amounts = water_fill([s for _, s, _ in targets], [float(c) for c in caps], float(total))
    out = []
    for (name, share, repeats), cap, a in zip(targets, caps, amounts):
        have = tokens.get(name, 0)
        blocks = -(-have // block)
        slots = blocks * repeats if a >= cap else min(round(a / block), blocks * repeats)
        out.append(Source(name, share, repeats, have, blocks, int(slots), cap < share * total))
    return out


def draw_counts(slots: list[int], seed: list[int], per: int) -> np.ndarray:
    """Slots of each source in each run of ``per`` slots; the columns add up to ``slots``.

    Each run is a multinomial draw over what is still owed to each source; a
    draw beyond that is drawn again among the others.
    """
    rng = np.random.default_rng(seed)
    owed = np.array(slots, np.int64)
    rows = []
    while owed.sum():
        n = min(per, int(owed.sum()))
        got = np.minimum(rng.multinomial(n, owed / owed.sum()), owed)
        while got.sum() < n:
            rest = owed - got
            got = got + np.minimum(rng.multinomial(n - got.sum(), rest / rest.sum()), rest)
        rows.append(got)
        owed = owed - got
    return np.array(rows, np.int64).reshape(-1, len(slots))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(size) for every key: a four-round Feistel network, walked until it lands inside."""
    bits = np.maximum(1, -(-np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) // 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    key = key.astype(np.uint64)
    while todo.any():
        left, right = out[todo] >> bits[todo], out[todo] & mask[todo]
        for r in range(4):
            h = right * np.uint64(0x9E3779B97F4A7C15) + key[todo] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(r + 1) * np.uint64(0x165667B19E3779F9)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            left, right = right, left ^ (h & mask[todo])
        out[todo] = (left << bits[todo]) | right
        todo = out >= size.astype(np.uint64)
    return out.astype(np.int64)


def blocks_of(sizes: DataFrame, key: str, source: str, size: str, rows: int, block: int = BLOCK_TOKENS) -> DataFrame:
    """(source, block, key, tok_from, tok_to): which tokens of which document make up each block."""
    x = sizes.filter(F.col(size) > 0).select(F.col(source).alias("source"), F.col(key).alias(key), F.col(size).cast("bigint").alias("__n"))
    at = running_total(x, ["source"], key, F.col("__n"), bucket_count(sizes, rows), "__at")
    first, last = F.floor(F.col("__at") / block), F.floor((F.col("__at") + F.col("__n") - 1) / block)
    each = at.select("source", key, "__at", "__n", F.explode(F.sequence(first, last)).alias("block"))
    start = F.col("block") * block
    return each.select(
        "source", "block", key,
        F.greatest(start - F.col("__at"), F.lit(0)).alias("tok_from"),
        F.least(start + block - F.col("__at"), F.col("__n")).alias("tok_to"),
    )


def slots_of(spark, sources: list[Source], seed: int) -> DataFrame:
    """(source, block, shard, slot, epoch): the slots of the mixture, made in parallel from one row per part.

    Parts and shards have the same size however large the mixture is.
    """
    counts = draw_counts([s.slots for s in sources], [seed], SHARD_SLOTS * PART_SHARDS)
    base = np.cumsum(counts, axis=0) - counts
    rows = [(h, [int(c) for c in counts[h]], [int(b) for b in base[h]]) for h in range(len(counts))]
    names = [s.name for s in sources]
    n_blocks = np.array([max(s.blocks, 1) for s in sources], np.int64)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                drawn = draw_counts(r["counts"], [seed, r["part"]], SHARD_SLOTS)
                start = np.array(r["base"], np.int64) + np.cumsum(drawn, axis=0) - drawn
                for h, (many, first) in enumerate(zip(drawn, start)):
                    which = np.repeat(np.arange(len(names)), many)
                    draw = np.concatenate([np.arange(o, o + c) for o, c in zip(first, many)])
                    epoch, index = draw // n_blocks[which], draw % n_blocks[which]
                    block = permute(index, n_blocks[which], (np.int64(seed) << 40) + which * 1_000_003 + epoch * 7_919)
                    shard = r["part"] * PART_SHARDS + h
                    o = np.random.default_rng([seed, r["part"], h]).permutation(len(which))
                    yield pa.RecordBatch.from_pydict({
                        "source": [names[i] for i in which[o]], "block": block[o], "shard": np.full(len(o), shard, np.int32),
                        "slot": np.arange(len(o), dtype=np.int32), "epoch": epoch[o].astype(np.int32),
                    })

    parts = spark.createDataFrame(rows, "part int, counts array<bigint>, base array<bigint>")
    return parts.repartition(min(max(len(rows), 1), parallelism(spark))).mapInArrow(fill, "source string, block bigint, shard int, slot int, epoch int")


@dataclass(frozen=True)
class Mixture:
    rows: DataFrame
    shares: DataFrame


def mix(sizes: DataFrame, key: str, source: str, size: str, targets: DataFrame, seed: int = 17, block: int = BLOCK_TOKENS) -> Mixture:
    """A mixture as large as all documents with a source taken once, and the shares it reached.

    ``sizes`` has a unique ``key``, a source (compared after trimming and in
    lower case) and a size in tokens; documents whose source is NULL or blank
    or whose size is NULL or 0 take no part. ``targets`` has (source,
    target_share, max_repeats): a small settings table; a NULL share counts as
    0, NULL max_repeats as 1, a NULL source is ignored. Sources without a
    target add to the mixture's size but not to its content. A source that
    stays below its target with all its repetitions is ``short``; the others
    take over what it lacks, in proportion to their shares. ``rows`` has one
    row per slot and document piece: shard, slot, source, epoch, block, key,
    tok_from, tok_to. No block is used more than max_repeats times. Empty
    tables give an empty mixture and actual shares of NULL.
    """
    spark = sizes.sparkSession
    norm = lambda c: F.lower(F.trim(c))
    named = sizes.select(F.col(key), norm(F.col(source)).alias("source"), F.col(size).alias(size)).filter("source <> ''")
    goal = targets.filter("source is not null").select(
        F.col("source").alias("spelled"), norm(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("most")
    ).collect()
    totals = named.groupBy("source").agg(F.sum(size).alias("t"), F.count("*").alias("n"))
    whole = totals.agg(F.sum("t"), F.sum("n")).first()
    wanted = [g.source for g in goal]
    have = {r.source: r.t or 0 for r in totals.filter(F.col("source").isin(wanted)).collect()}
    plan = plan_sources([(g.source, g.share, g.most) for g in goal], have, whole[0] or 0, block)
    pieces = blocks_of(named.filter(F.col("source").isin(wanted)), key, "source", size, whole[1] or 0, block)
    rows = slots_of(spark, plan, seed).join(pieces, ["source", "block"]).select("shard", "slot", "source", "epoch", "block", key, "tok_from", "tok_to")
    used = rows.groupBy("source").agg(F.sum(F.col("tok_to") - F.col("tok_from")).alias("tokens"), (F.max("epoch") + 1).alias("repeats"))
    settings = spark.createDataFrame(
        [(g.spelled, p.name, p.target, p.repeats, p.tokens, p.short) for g, p in zip(goal, plan)],
        "spelled string, source string, target_share double, max_repeats int, source_tokens bigint, short boolean",
    )
    both = settings.join(used, "source", "left").select("spelled", "target_share", "max_repeats", "source_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("repeats", F.lit(0)).alias("repeats"), "short")
    total = both.agg(F.sum("tokens").alias("__all"))
    shares = both.join(F.broadcast(total)).select(F.col("spelled").alias("source"), "target_share", F.when(F.col("__all") > 0, F.col("tokens") / F.col("__all")).alias("actual_share"), "tokens", "source_tokens", "repeats", "max_repeats", "short")
    return Mixture(rows, shares)
