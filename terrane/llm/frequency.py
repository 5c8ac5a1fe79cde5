"""Frequency of every distinct term: occurrences, records, and whether it is too rare or too common.

Tokens are hash-partitioned by term and ordered by record. A term's counter
holds its occurrences, its records and the last record it was seen in; a token
adds a record only when its record differs from that. No set of records is kept.

A term with very many tokens is spread over salts *by record*, so all tokens of
one record and term stay together and the counters of the salts add up. Counters
are flushed at a record's end when a task holds many terms, which is exact for
the same reason.

Defined results: tokens with a null part of the term or of the record are left
out. A token delivered again (same record, term and place) counts once. Empty
texts are terms. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts that the records of one term are spread over at most.
SALTS = 64
#: Terms that a task holds before it writes out its counters.
MOST_TERMS = 500_000


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def last_seen(batches: Iterator[pa.RecordBatch], terms: Sequence[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Counters of a partition whose rows ``(*terms, record, place)`` come ordered by record and place."""
    state: dict[tuple, list] = {}  # term: [occurrences, records, last record, its last place]

    def written() -> pa.RecordBatch:
        cols = list(zip(*state)) if state else [[] for _ in terms]
        out = [pa.array(c, t.type) for c, t in zip(cols, schema)]
        out += [pa.array([s[i] for s in state.values()], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(out, schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        coded = [pc.dictionary_encode(batch.column(t)) for t in terms]
        code = np.zeros(batch.num_rows, np.int64)
        for c in coded:
            code = code * len(c.dictionary) + c.indices.to_numpy(zero_copy_only=False)
        record = pc.dictionary_encode(batch.column("record"))
        names = record.dictionary
        rec = record.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = batch.column("place").to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")  # within a term still ordered by record and place
        code, rec, place = code[order], rec[order], place[order]
        starts = np.flatnonzero(_runs(code))
        ends = np.append(starts[1:], len(code)) - 1
        occ = np.add.reduceat(_runs(code, rec, place).astype(np.int64), starts)
        recs = np.add.reduceat(_runs(code, rec).astype(np.int64), starts)
        first = order[starts]
        keys = list(zip(*[c.take(pa.array(first)).to_pylist() for c in coded]))
        first_rec, last_rec = names.take(pa.array(rec[starts])).to_pylist(), names.take(pa.array(rec[ends])).to_pylist()
        for key, o, r, a, b, p, q in zip(keys, occ.tolist(), recs.tolist(), first_rec, last_rec, place[starts].tolist(), place[ends].tolist()):
            s = state.get(key)
            if s is None:
                state[key] = [o, r, b, q]
                continue
            same = s[2] == a
            s[0] += o - (same and s[3] == p)
            s[1] += r - same
            s[2], s[3] = b, q
        if len(state) > MOST_TERMS:
            # The record may go on in the next batch: its terms keep their counters.
            last = names[int(record.indices[batch.num_rows - 1].as_py())].as_py()
            kept = {k: s for k, s in state.items() if s[2] == last}
            state = {k: s for k, s in state.items() if s[2] != last}
            yield written()
            state = kept
    if state:
        yield written()


def term_counts(tokens: DataFrame, terms: Sequence[str], record: Column, place: str, salts: int = SALTS) -> DataFrame:
    """``(*terms, n_occurrences, n_records)`` of each distinct term."""
    rows = tokens.select(*[F.col(t).cast("string").alias(t) for t in terms], record.alias("record"), F.col(place).cast("bigint").alias("place")).na.drop(subset=[*terms, "record"]).na.fill(-1, ["place"])
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("record"), F.lit(salts)))
    rows = rows.repartition(*terms, "_salt").drop("_salt").sortWithinPartitions("record", "place")
    schema = pa.schema([(t, pa.string()) for t in terms] + [("occ", pa.int64()), ("recs", pa.int64())])
    out = T.StructType([T.StructField(t, T.StringType()) for t in terms] + [T.StructField("occ", T.LongType()), T.StructField("recs", T.LongType())])
    parts = rows.mapInArrow(lambda it: last_seen(it, terms, schema), out)
    return parts.groupBy(*terms).agg(F.sum("occ").alias("n_occurrences"), F.sum("recs").alias("n_records"))


def marked(counts: DataFrame, n_records: int, least: int, common: int) -> DataFrame:
    """``mark``: rare (in fewer than ``least`` records), common (in more than one of ``common`` records) or keep."""
    mark = F.when(F.col("n_records") < least, "rare").when(F.col("n_records") * common > n_records, "common").otherwise("keep")
    return counts.withColumn("mark", mark)
