"""Keeping references and the state of their keys current from a stream of deliveries.

Both are kept in buckets. A micro-batch rewrites only the buckets that it
touches, as a new version, and then writes which version of each bucket is
current. A batch that is run again after a failure starts from the versions
before it and writes the same again, so nothing counts twice. Versions that the
batch before last replaced are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.orphans import REF, STATE, advance, first_deliveries

#: Buckets of each table; the list of versions has one entry to a bucket.
BUCKETS = 64
#: A delivery: a reference (``ref_table`` set), or a record (``ref_table`` null); ``gone`` withdraws or deletes it.
DELIVERY = "ref_table string, owner_id string, ref_ord bigint, key string, at timestamp, gone boolean"
_REFS = "ref_table string, owner_id string, ref_ord bigint, key string, at timestamp, gone bigint"
_STATE = "key string, refs bigint, exists bigint, deleted bigint, first_ref timestamp, first_seen timestamp"


class Kept:
    """The tables kept under a path in the shared storage."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(sc._jsc.hadoopConfiguration())

    def versions(self, n: int) -> dict[str, dict[str, int]]:
        """By table, the version of each bucket after batch ``n``."""
        if n < 0:
            return {"refs": {}, "state": {}}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{n}", wholetext=True).first()[0])

    def last(self) -> int:
        at, fs = self._fs(f"{self.path}/versions")
        return max((int(f.getPath().getName()) for f in fs.listStatus(at)), default=-1) if fs.exists(at) else -1

    def read(self, table: str, schema: str, versions: dict[str, int], only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{table}/version={v}/bucket={b}" for b, v in sorted(versions.items()) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self) -> tuple[DataFrame, DataFrame]:
        """``(references, state)`` after the last batch."""
        v = self.versions(self.last())
        return self.read("refs", _REFS, v["refs"]), self.read("state", _STATE, v["state"])

    def step(self, batch: DataFrame, n: int) -> None:
        """Takes batch ``n`` in."""
        batch = batch.persist()
        before = self.versions(n - 1)
        bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(self.buckets)).cast("int")
        touched = lambda df: [r[0] for r in df.distinct().collect()]  # noqa: E731  no more than there are buckets
        live = batch.where("key IS NOT NULL").withColumn("gone", F.coalesce("gone", F.lit(False)).cast("bigint"))
        refs = first_deliveries(live.where("ref_table IS NOT NULL"))
        recs = first_deliveries(live.where("ref_table IS NULL"), ["key"])
        known = self.read("refs", _REFS, before["refs"], touched(refs.select(bucket(*REF))))
        state = self.read("state", _STATE, before["state"], touched(live.select(bucket("key"))))
        refs, state = advance(refs, recs, known, state)
        after = {}
        for name, df, keys, columns in (("refs", refs, REF, (*REF, "at", "gone")), ("state", state, ("key",), STATE)):
            at = f"{self.path}/{name}/version={n}"
            df.select(*columns, bucket(*keys).alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
            folder, fs = self._fs(at)
            new = [s.getPath().getName().split("=")[1] for s in fs.listStatus(folder) if s.isDirectory()]
            after[name] = before[name] | dict.fromkeys(new, n)
        self.spark.createDataFrame([(json.dumps(after),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/versions/{n}")
        # Batch n - 1 may not run again once this one has: what it replaced is not read any more.
        older = self.versions(n - 2) if n > 1 else {"refs": {}, "state": {}}
        for name, buckets in older.items():
            for b, v in buckets.items():
                if before[name].get(b) != v:
                    gone, fs = self._fs(f"{self.path}/{name}/version={v}/bucket={b}")
                    fs.delete(gone, True)
        batch.unpersist()


def follow(deliveries: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """A query that takes a stream of deliveries (columns of ``DELIVERY``) into the tables of ``Kept`` under ``path``."""
    kept = Kept(deliveries.sparkSession, path, buckets)
    return deliveries.writeStream.foreachBatch(kept.step).option("checkpointLocation", checkpoint).start()
