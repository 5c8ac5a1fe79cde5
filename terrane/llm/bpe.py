"""Byte-level BPE of a public vocabulary, in two tiers.

Whole pre-tokens that are in the vocabulary are resolved by a minimal perfect
hash: one displacement per bucket sends every entry to its own slot of exactly
as many slots as entries, and the slot's bytes are compared. Misses are encoded
by merging linked bytes, the lowest-ranked pair first, from a heap.

The vocabulary has a fixed size, so it is read on the driver and broadcast; the
executors need no files. Texts stay where they are: encoding shuffles nothing.

Defined results: null and empty texts give empty arrays. Strings that look like
special tokens are ordinary text. Unpaired surrogates can't occur in Spark's
strings. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.plans.spread import spread

#: Fixed value: how this family of vocabularies splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers.
REMEMBERED = 400_000
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file: a base64 token and its rank a line, ranks 0, 1, ..."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(rows)
    for token, rank in rows:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


@dataclass
class PerfectHash:
    """Slots for a fixed set of keys: ``(h1 + shift[bucket] * h2) mod p`` for a prime ``p`` of at least as many slots as keys.

    The few slots past the last key are sent to those left free before it, so
    the keys map onto ``range(len(keys))``: the hash is minimal.
    """

    shift: np.ndarray
    prime: int
    past: dict[int, int]
    rank: list[int]
    tokens: list[bytes]

    @staticmethod
    def _hashes(key: bytes, n: int, buckets: int) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        low, high = h & _MASK, h >> 64
        # n is prime, so every step visits all slots.
        return (low >> 40) % buckets, (low & 0xFFFFFFFFFF) % n, 1 + high % (n - 1)

    @classmethod
    def build(cls, tokens: list[bytes]) -> PerfectHash:
        n = max(3, len(tokens))
        while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
            n += 1
        buckets = max(1, n // 3)
        members: list[list[tuple[int, int, int]]] = [[] for _ in range(buckets)]
        for rank, token in enumerate(tokens):
            b, h1, h2 = cls._hashes(token, n, buckets)
            members[b].append((h1, h2, rank))
        shift, of = np.zeros(buckets, np.int64), np.full(n, -1, np.int64)
        taken = bytearray(n)
        for b in sorted(range(buckets), key=lambda b: -len(members[b])):
            d = 0
            while True:
                slots = {(h1 + d * h2) % n for h1, h2, _ in members[b]}
                if len(slots) == len(members[b]) and not any(taken[s] for s in slots):
                    break
                d += 1
                if d > 50 * n:
                    raise ValueError("two tokens have one hash")
            shift[b] = d
            for h1, h2, rank in members[b]:
                s = (h1 + d * h2) % n
                taken[s] = 1
                of[s] = rank
        keys = len(tokens)
        free = iter(s for s in range(keys) if of[s] < 0)
        past = {s: next(free) for s in range(keys, n) if of[s] >= 0}
        for s, to in past.items():
            of[to] = of[s]
        return cls(shift, n, past, of[:keys].tolist(), tokens)

    def get(self, key: bytes) -> int:
        """The key's rank, or -1."""
        n = self.prime
        b, h1, h2 = self._hashes(key, n, len(self.shift))
        slot = (h1 + int(self.shift[b]) * h2) % n
        slot = self.past.get(slot, slot)
        if slot >= len(self.rank):
            return -1
        rank = self.rank[slot]
        return rank if self.tokens[rank] == key else -1


def merge(piece: bytes, rank) -> list[int]:
    """Tokens of a piece: the lowest-ranked adjacent pair is merged first, the leftmost of equals. ``rank(bytes)`` is -1 for no token."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r >= 0:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    alive = bytearray(b"\1" * n)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != to:
            continue  # one of the two has been merged since
        alive[j] = 0
        end[i] = to
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            r = rank(piece[i : end[k]])
            if r >= 0:
                heapq.heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0:
            r = rank(piece[h:to])
            if r >= 0:
                heapq.heappush(heap, (r, h, to))
    out, i = [], 0
    while i < n:
        out.append(rank(piece[i : end[i]]))
        i = after[i]
    return out


class Encoder:
    def __init__(self, table: PerfectHash, pattern: str = PATTERN):
        self.table = table
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def piece(self, word: str) -> list[int]:
        raw = word.encode()
        rank = self.table.get(raw)
        return [rank] if rank >= 0 else merge(raw, self.table.get)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for word in self.split(text):
            ids = known.get(word)
            if ids is None:
                ids = self.piece(word)
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = ids
            out += ids
        return out


_workers: dict[tuple, Encoder] = {}


def _encoder(key: tuple, shared) -> Encoder:
    """One encoder to a Python worker, kept between batches and tasks."""
    if key not in _workers:
        _workers[key] = Encoder(shared.value)
    return _workers[key]


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", name: str = "ids") -> DataFrame:
    """``(id, ids)``: every text by the vocabulary at ``path`` (read on the driver), without special tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(PerfectHash.build(read_ranks(path)))
    key = (path, docs.sparkSession.sparkContext.applicationId)

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(key, shared)
        for batch in it:
            yield pd.Series([np.array(encoder.encode(t), np.int32) for t in batch], dtype=object)

    # Not to be copied into filters: a predicate on the ids would encode every text twice.
    udf = F.pandas_udf(run, "array<int>").asNondeterministic()
    return spread(docs.select(id, text), id).select(id, udf(text).alias(name))
