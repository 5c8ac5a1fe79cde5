"""Queries of problems 2, 5, 8, 9 and 10."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import bpe, frequency, mixing, together, truncation
from terrane.plans.lineage import cut
from terrane.plans.skew import meet
from terrane.sources.tables import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat("tag_key", F.lit("="), "tag_value")
    return table(spark, sf_dir, "feature_tags").select(F.concat("feature_type", F.lit("/"), F.col("feature_value").cast("string")).alias("record"), item.alias("item"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs that occur, with the number of features and the lift, however rare."""
    found = together.pairs(_items(spark, sf_dir), "record", "item", least=1, share=None)
    return found.withColumn("lift", F.round("lift", 6))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = together.pairs(_items(spark, sf_dir), "record", "item", least=3, share=2000)
    wide = F.col("n_ab").cast("decimal(38,0)") * F.col("n_records") >= F.lit(10) * F.col("n_a").cast("decimal(18,0)") * F.col("n_b")
    return found.where(wide).select("item_a", "item_b")


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "feature_tags")
    record = F.concat("feature_type", F.lit("/"), F.col("feature_value").cast("string"))
    having = tags.where("tag_key IS NOT NULL AND tag_value IS NOT NULL").select("feature_type", "feature_value").distinct().count()
    counts = frequency.term_counts(tags, ["tag_key", "tag_value"], record, "tag_ord")
    return frequency.marked(counts, having, least=3, common=20)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_terms(spark, sf_dir).where("mark <> 'keep'").select("tag_key", "tag_value")


#: Where the public vocabularies lie; only the driver reads them.
TOKENIZERS = os.environ.get("TERRANE_TOKENIZERS", "/opt/tokenizers")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    used = meet(docs, targets.select("source").distinct(), ["source"], "left_semi")
    ids = bpe.encode(used.select("doc_id", "text", "source").withColumn("doc", F.struct("doc_id", "source")), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", id="doc")
    blocks = cut(mixing.pack(ids.select("doc.doc_id", "doc.source", "ids"), "doc_id", "source", "ids"))
    return mixing.mix(blocks, targets), targets


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, targets = _mix(spark, sf_dir)
    return mixing.shares(mixed, targets)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"))


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return truncation.by_source(docs, truncation.truncated(docs))


_PAIRS = """
WITH i AS (SELECT DISTINCT feature_type AS t, feature_value AS v, tag_key || '=' || tag_value AS item FROM feature_tags WHERE tag_key IS NOT NULL AND tag_value IS NOT NULL),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT t, v FROM i)),
c AS (SELECT item, count(*) AS n FROM i GROUP BY item),
p AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM i x JOIN i y ON x.t = y.t AND x.v = y.v AND x.item < y.item GROUP BY ALL),
r AS (SELECT item_a, item_b, a.n AS n_a, b.n AS n_b, n_ab, n.n AS n_records FROM p JOIN c a ON item_a = a.item JOIN c b ON item_b = b.item, n)
"""
_TERMS = """
WITH o AS (SELECT tag_key, tag_value, feature_type, feature_value, count(DISTINCT tag_ord) AS n FROM feature_tags WHERE tag_key IS NOT NULL AND tag_value IS NOT NULL GROUP BY ALL),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT feature_type, feature_value FROM o)),
t AS (SELECT tag_key, tag_value, CAST(sum(o.n) AS BIGINT) AS n_occurrences, count(*) AS n_records FROM o GROUP BY ALL),
m AS (SELECT t.*, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records * 20 > n.n THEN 'common' ELSE 'keep' END AS mark FROM t, n)
"""
QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs, "p5_found": p5_found, "p5_terms": p5_terms, "p8_ids": p8_ids, "p9_shares": p9_shares, "p9_mix": p9_mix, "p10_found": p10_found, "p10_sources": p10_sources}
SQL = {
    "p2_found": _PAIRS + "SELECT item_a, item_b FROM r WHERE n_ab >= 3 AND 2000 * n_ab >= n_records AND n_ab * n_records >= 10 * n_a * n_b",
    "p2_pairs": _PAIRS + "SELECT *, round(n_ab * CAST(n_records AS DOUBLE) / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift FROM r",
    "p5_found": _TERMS + "SELECT tag_key, tag_value FROM m WHERE mark <> 'keep'",
    "p5_terms": _TERMS + "SELECT * FROM m",
}
