"""Items that appear together: pair counts and lift by heavy-light decomposition.

Items too rare for any pair that is asked for are dropped first; that is exact,
and with a share it bounds the number of items by ``incidences / least support``.
Without one every pair that occurs is counted. Items are numbered by frequency.
Records are dealt in blocks, enough that none makes more than about ``HASHED``
pairs, and within a block

* pairs of frequent (heavy) items are counted by popcounts over a bit matrix,
* pairs of a heavy and a rarer (light) item by probing the light item's list of
  records in the heavy items' bits,
* pairs of light items by hashing, summed within the block.

Only sums per pair leave a block. A record of more than ``MOST_ITEMS`` items is
split: its items are dealt into groups, and the pairs of each two groups are made
in a task of their own.

Defined results: an item counts once in a record. Null items and records are left
out. Ties are all kept. No records give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.plans.lineage import cut
from terrane.plans.ranks import running_total
from terrane.plans.skew import meet

#: An item in at least one of so many records is heavy: a word of its bit row then has a bit set on average.
HEAVY = 64
#: Incidences to a block.
BLOCK = 500_000
#: Pairs that the hash of light pairs takes up before it is summed.
HASHED = 4_000_000
#: Items of one record beyond which its pairs are made in several tasks.
MOST_ITEMS = 4_000


def _block(record: np.ndarray, item: np.ndarray, heavy: int, items: int) -> pd.DataFrame:
    """Counts of all pairs of a block; items are numbered by falling frequency, the first ``heavy`` are heavy."""
    row, seen = pd.factorize(record)
    n = len(seen)
    big = item < heavy
    bits = np.zeros((heavy, n), bool)
    bits[item[big], row[big]] = True
    words = np.zeros((heavy, -(-n // 64) * 8), np.uint8)
    packed = np.packbits(bits, axis=1)
    words[:, : packed.shape[1]] = packed
    words = words.view(np.uint64)
    out: dict[str, list] = {"a": [], "b": [], "n": []}

    def add(a, b, n) -> None:
        at = n > 0
        out["a"].append(a[at])
        out["b"].append(b[at])
        out["n"].append(n[at].astype(np.int64))

    for i in range(heavy - 1):
        n_ab = np.bitwise_count(words[i] & words[i + 1 :]).sum(axis=1)
        add(np.full(heavy - 1 - i, i), np.arange(i + 1, heavy), n_ab)
    light_item, light_row = item[~big], row[~big]
    order = np.lexsort((light_row, light_item))
    light_item, light_row = light_item[order], light_row[order]
    starts = np.flatnonzero(np.append(True, light_item[1:] != light_item[:-1])) if len(light_item) else np.array([], int)
    for s, e in zip(starts, np.append(starts[1:], len(light_item))):
        if heavy:
            add(np.arange(heavy), np.full(heavy, light_item[s]), bits[:, light_row[s:e]].sum(axis=1))
    order = np.lexsort((light_item, light_row))
    light_item, light_row = light_item[order].astype(np.int64), light_row[order]
    sums: dict[int, int] = {}
    pending: list[np.ndarray] = []
    held = 0

    def summed() -> None:
        nonlocal pending, held
        if pending:
            for code, k in zip(*(x.tolist() for x in np.unique(np.concatenate(pending), return_counts=True))):
                sums[code] = sums.get(code, 0) + k
        pending, held = [], 0

    # The k-th light item of each record with the items `step` places on: arrays over all records at once.
    step = 1
    while len(light_item) > step:
        same = light_row[:-step] == light_row[step:]
        if not same.any():
            break
        pending.append(light_item[:-step][same] * items + light_item[step:][same])
        held += len(pending[-1])
        if held > HASHED:
            summed()
        step += 1
    summed()
    code = np.fromiter(sums.keys(), np.int64, len(sums))
    add(code // items, code % items, np.fromiter(sums.values(), np.int64, len(sums)))
    return pd.DataFrame({k: np.concatenate(v) if v else np.array([], np.int64) for k, v in out.items()}).astype("int64")


def _sides(pdf: pd.DataFrame) -> pd.DataFrame:
    """All pairs of one record's items of two groups, or of one."""
    code, group = pdf["code"].to_numpy(), pdf["group"].to_numpy()
    low = group == pdf["i"].iloc[0]
    if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
        x, y = np.triu_indices(len(code), 1)
        x, y = code[x], code[y]
    else:
        x, y = np.repeat(code[low], (~low).sum()), np.tile(code[~low], low.sum())
    return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "n": np.ones(len(x), np.int64)})


def pairs(incidences: DataFrame, record: str, item: str, least: int, share: int | None, heavy_share: int = HEAVY, most_items: int = MOST_ITEMS) -> DataFrame:
    """``(item_a, item_b, n_a, n_b, n_ab, n_records, lift)`` of all pairs with ``n_ab >= least`` and, if there is a ``share``, ``share * n_ab >= N``; ``item_a < item_b``."""
    spark = incidences.sparkSession
    once = cut(incidences.select(F.col(record).alias("record"), F.col(item).alias("item")).na.drop().distinct())
    total = once.select("record").distinct().count()
    support = max(least, -(-total // share) if share else 1, 1)
    frequent = cut(once.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support))
    items, incident, heavy = frequent.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") * heavy_share >= total)).first()
    numbered = cut(running_total(frequent.withColumn("_one", F.lit(1).cast("bigint")), [-F.col("n"), F.col("item")], "_one", "code", items).select("item", "n", F.col("code").cast("bigint").alias("code")))
    codes = numbered.select("item", "code")
    coded = cut(meet(once, codes, ["item"]).select("record", "code"))
    each = cut(coded.groupBy("record").agg(F.count("*").alias("k")))
    large = each.where(F.col("k") > most_items)
    made = each.where(F.col("k") <= most_items).agg(F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0))).first()[0]
    # Blocks of few enough incidences, and of few enough pairs.
    blocks = max(1, -(-incident // BLOCK), -(-int(made) // HASHED), min(spark.sparkContext.defaultParallelism, -(-incident // 20_000)))
    width = max(1, items)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        return _block(pdf["record"].to_numpy(), pdf["code"].to_numpy(), int(heavy), int(width))

    split = not large.isEmpty()
    marked = meet(coded, cut(large), ["record"], "left") if split else coded.withColumn("k", F.lit(None).cast("bigint"))
    keyed = marked.where("k IS NULL").select(F.pmod(F.xxhash64("record"), F.lit(blocks)).cast("int").alias("block"), "record", "code")
    parts = keyed.groupBy("block").applyInPandas(count, "a bigint, b bigint, n bigint")
    if split:
        # A large record's items are dealt into groups; each two of them, and each with itself, are a task's work.
        groups = F.ceil(F.col("k") / most_items * 2).cast("int")
        dealt = marked.where("k IS NOT NULL").select("record", "code", groups.alias("g"), F.pmod(F.xxhash64("code"), groups).cast("int").alias("group"))
        met = dealt.select("record", "code", "group", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
        met = met.select("record", F.least("group", "o").alias("i"), F.greatest("group", "o").alias("j"), "code", "group")
        parts = parts.unionByName(met.groupBy("record", "i", "j").applyInPandas(_sides, "a bigint, b bigint, n bigint"))
    sums = parts.groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where((F.col("n_ab") >= least) & (F.col("n_ab") * share >= total if share else F.lit(True)))
    name = lambda x: numbered.select(F.col("code").alias(x), F.col("item").alias(f"i_{x}"), F.col("n").alias(f"m_{x}"))
    met = meet(meet(cut(sums), name("a"), ["a"]), name("b"), ["b"])
    first = F.col("i_a") < F.col("i_b")
    return met.select(
        F.when(first, F.col("i_a")).otherwise(F.col("i_b")).alias("item_a"), F.when(first, F.col("i_b")).otherwise(F.col("i_a")).alias("item_b"),
        F.when(first, F.col("m_a")).otherwise(F.col("m_b")).alias("n_a"), F.when(first, F.col("m_b")).otherwise(F.col("m_a")).alias("n_b"),
        "n_ab", F.lit(total).cast("bigint").alias("n_records"),
        (F.col("n_ab").cast("double") * total / (F.col("m_a").cast("double") * F.col("m_b"))).alias("lift"),
    )
