"""Mixing sources to target weights.

Each source's texts, as tokens, are packed end to end into blocks of a fixed
length. The output is a number of shards of equally many slots. The counts of
each source in a shard are drawn from a multinomial, conditioned on each
source's total (a multivariate hypergeometric draw), so shards vary as chance has
it while the whole meets the weights to within one block. A source's slots are
numbered through; each run through all its blocks (an epoch) is a pseudorandom
permutation of its block indices, so no block, and no text, is used more often
than the number of epochs. Slots and blocks are joined by source and index.

Size: the largest total at which no source with texts needs more than
``max_repeats`` epochs, unless a smaller one is asked for.

Defined results: a source without texts or tokens can't be met; the weights of
the others are scaled up and its actual share is 0. Sources without a target, or
with a target of 0 or null, are not used. Repeated targets of one source add up,
with the smaller cap. Null and empty texts hold no tokens. The last block of a
source may be shorter. No usable source gives no slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.plans.lineage import cut
from terrane.plans.skew import meet

BLOCK = 512
#: Texts to a range: a source's prefix sums are taken over ranges, and within each.
RANGE_ROWS = 100_000
#: Target sources, and rows of the plan (shards by sources) that the driver draws; more are refused.
MOST_SOURCES, MOST_PLANNED = 100_000, 5_000_000
#: Shards, by default and at most: the driver draws one row of counts to a shard.
SHARDS, MOST_SHARDS = 64, 100_000


def pack(docs: DataFrame, id: str, source: str, ids: str, block: int = BLOCK, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(source, block, n_tokens, n_docs, tokens)``: a source's tokens end to end, in blocks.

    Prefix sums are taken in two levels, over ranges of texts and within each
    range, so a source that holds most texts is never in one task.
    """
    rows = docs.select(F.col(source).alias("source"), F.col(id).alias("id"), F.col(ids).alias("ids"), F.size(ids).cast("bigint").alias("n")).where("source IS NOT NULL AND n > 0")
    rows = cut(rows.withColumn("h", F.xxhash64("id")))
    # As many ranges as keep each within bounds if all texts were of one source.
    ranges = max(16, -(-rows.count() // range_rows))
    rows = rows.withColumn("range", F.pmod("h", F.lit(ranges)).cast("int")).drop("h")
    sums = rows.groupBy("source", "range").agg(F.sum("n").alias("n"))
    # One row to a source and range.
    base = sums.select("source", "range", F.expr("coalesce(sum(n) OVER (PARTITION BY source ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("base"))
    placed = rows.select("source", "range", "id", "n", F.expr("coalesce(sum(n) OVER (PARTITION BY source, range ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("local"))
    # The ids themselves are not sorted or windowed: only their places are joined back.
    placed = meet(placed, cut(base), ["source", "range"]).select("source", "id", (F.col("base") + F.col("local")).alias("start"))
    parts = rows.join(placed.hint("merge"), ["source", "id"]).select("source", "id", "start", "ids", F.explode(F.expr(f"sequence(start div {block}, (start + n - 1) div {block})")).alias("block"))
    low = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    high = F.least((F.col("block") + 1) * block - F.col("start"), F.size("ids"))
    parts = parts.select("source", "block", F.struct(F.col("start"), F.expr("id").alias("id"), F.slice("ids", (low + 1).cast("int"), (high - low).cast("int")).alias("part")).alias("p"))
    # A block has at most as many parts as tokens.
    packed = parts.groupBy("source", "block").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return packed.select("source", "block", F.flatten("p.part").alias("tokens"), F.size("p").alias("n_docs")).withColumn("n_tokens", F.size("tokens"))


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of ``range(size)`` for each seed: a four-round Feistel network, walked until it lands inside."""
    x, out = index.astype(np.uint64), np.empty(len(index), np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    seed = seed.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            h = (right + seed[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r + 1) * 0xD1B54A32D192ED03 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h >> np.uint64(31)) & mask[todo])
        x[todo] = (left << half[todo]) | right
        ok = x[todo] < size[todo].astype(np.uint64)
        out[todo[ok]] = x[todo[ok]]
        todo = todo[~ok]
    return out.astype(np.int64)


def quotas(stats: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]], block: int, total_blocks: int | None = None) -> dict[str, int]:
    """Blocks to take of each source. ``stats``: blocks and tokens there are; ``targets``: weight and most repeats."""
    usable = {s: (w, m) for s, (w, m) in targets.items() if w and w > 0 and m and m > 0 and stats.get(s, (0, 0))[0]}
    if not usable:
        return {}
    scale = sum(w for w, _ in usable.values())
    most = min(stats[s][0] * m * scale / w for s, (w, m) in usable.items())
    total = int(most if total_blocks is None else min(most, total_blocks))
    exact = {s: total * w / scale for s, (w, _) in usable.items()}
    out = {s: min(int(x), stats[s][0] * usable[s][1]) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: total - sum(out.values())]:
        out[s] = min(out[s] + 1, stats[s][0] * usable[s][1])
    return out


def draw(quota: dict[str, int], shards: int, seed: int) -> pd.DataFrame:
    """``(shard, source, first, n)``: each shard's count of each source and its first slot of that source."""
    names = sorted(quota)
    left = np.array([quota[s] for s in names], np.int64)
    rng = np.random.default_rng(seed)
    first, rows = np.zeros(len(names), np.int64), []
    for k in range(shards):
        size = int(left.sum()) // (shards - k)
        n = np.zeros(len(names), np.int64)
        rest, need = int(left.sum()), size
        for i, have in enumerate(left.tolist()):  # one margin after another, each given those before
            rest -= have
            # The draw takes numbers under 1e9; beyond them its normal limit is as good.
            if have + rest < 1_000_000_000:
                n[i] = rng.hypergeometric(have, rest, need) if need else 0
            else:
                p = have / (have + rest)
                n[i] = np.clip(round(rng.normal(need * p, (need * p * (1 - p)) ** 0.5)), max(0, need - rest), min(have, need))
            need -= int(n[i])
        rows += [(k, s, int(f), int(x)) for s, f, x in zip(names, first, n) if x]
        first, left = first + n, left - n
    return pd.DataFrame(rows, columns=["shard", "source", "first", "n"])


def mix(blocks: DataFrame, targets: DataFrame, shards: int = SHARDS, seed: int = 0, block: int = BLOCK, total_blocks: int | None = None) -> DataFrame:
    """``(shard, place, source, block, epoch, n_tokens, tokens)``: the mixed output, a block to a slot."""
    if not 0 < shards <= MOST_SHARDS:
        raise ValueError(f"shards must be from 1 to {MOST_SHARDS}")
    spark = blocks.sparkSession
    want = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share"), F.min("max_repeats"))
    goal = {r[0]: (r[1], r[2]) for r in want.limit(MOST_SOURCES + 1).collect()}
    if len(goal) > MOST_SOURCES or len(goal) * shards > MOST_PLANNED:
        raise ValueError("too many target sources for so many shards")
    stats = {r[0]: (r[1], r[2]) for r in blocks.join(F.broadcast(want.select("source")), "source", "left_semi").groupBy("source").agg(F.count("*"), F.sum("n_tokens")).collect()}
    quota = quotas(stats, goal, block, total_blocks)
    plan = draw(quota, min(shards, max(1, sum(quota.values()))), seed)
    number = {s: i for i, s in enumerate(sorted(quota))}
    plan["size"] = [stats[s][0] for s in plan["source"]]
    plan["no"] = [number[s] for s in plan["source"]]
    counts = spark.createDataFrame(plan, "shard int, source string, first bigint, n bigint, size bigint, no int")

    def slots(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            epoch = pdf["slot"].to_numpy() // pdf["size"].to_numpy()
            at = permuted(pdf["slot"].to_numpy() % pdf["size"].to_numpy(), pdf["size"].to_numpy(), pdf["no"].to_numpy() * 1_000_003 + epoch * 31 + seed)
            yield pd.DataFrame({"shard": pdf["shard"], "source": pdf["source"], "block": at, "epoch": epoch})

    each = counts.repartition("shard", "source").select("shard", "source", "size", "no", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
    placed = each.mapInPandas(slots, "shard int, source string, block bigint, epoch bigint")
    mixed = placed.join(blocks.hint("merge"), ["source", "block"])
    # The order within a shard is a hash: sorting a shard by it shuffles its sources together.
    return mixed.select("shard", F.xxhash64(F.lit(seed), "shard", "source", "block", "epoch").alias("place"), "source", "block", "epoch", "n_tokens", "n_docs", "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: target share, actual share, tokens and epochs. Shares are of all tokens mixed."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_blocks"), (F.max("epoch") + 1).alias("epochs"))
    want = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    # One row to a source: the total over them is a sum of as few rows.
    df = want.join(got, "source", "left").na.fill(0, ["n_tokens", "n_blocks", "epochs"])
    return df.withColumn("actual_share", F.col("n_tokens") / F.expr("nullif(sum(n_tokens) OVER (), 0)")).na.fill(0.0, ["actual_share"])
