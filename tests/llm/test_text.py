"""Text operators: the rule on small inputs, brute force, and the edge cases."""

import os
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import bpe, frequency, mixing, together, truncation
from terrane.llm.queries import TOKENIZERS, p2_pairs

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


# Pairs


def _pairs(spark, data, **kw):
    df = spark.createDataFrame(data, "record string, item string, a int, n int")
    return {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab, round(r.lift, 9)) for r in together.pairs(df, "record", "item", **kw).collect()}


def _brute(data, least, share):
    sets = {}
    for r, i, *_ in data:
        if r is not None and i is not None:
            sets.setdefault(r, set()).add(i)
    one = Counter(i for s in sets.values() for i in s)
    two = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    n = len(sets)
    return {(a, b): (one[a], one[b], k, round(k * n / (one[a] * one[b]), 9)) for (a, b), k in two.items() if k >= least and share * k >= n}


@pytest.mark.parametrize("heavy, most", [(2, 4_000), (16, 20), (1000, 7)])
def test_pairs_against_brute_force(spark, heavy, most):
    rnd = random.Random(heavy)
    data = [(f"r{rnd.randrange(300)}", f"i{min(rnd.randrange(60), rnd.randrange(60))}", 1, 1) for _ in range(2000)]
    data += [("giant", f"i{k}", 1, 1) for k in range(60)] * 3 + [(None, "i1", 1, 1), ("r1", None, 1, 1), ("long", "x" * 100_000, 1, 1), ("", "", 1, 1)]
    assert _pairs(spark, data, least=3, share=200, heavy_share=heavy, most_items=most) == _brute(data, 3, 200)


def test_pairs_empty_and_single(spark):
    assert _pairs(spark, [], least=3, share=2000) == {}
    assert _pairs(spark, [("r", "a", 1, 1)] * 5, least=1, share=10) == {}
    assert _pairs(spark, [("r", "a", 1, 1), ("r", "b", 1, 1)], least=1, share=10) == {("a", "b"): (1, 1, 1, 1.0)}


def test_pairs_without_a_floor(spark, monkeypatch):
    monkeypatch.setattr(together, "HASHED", 50)
    rnd = random.Random(3)
    data = [(f"r{rnd.randrange(300)}", f"i{min(rnd.randrange(90), rnd.randrange(90))}", 1, 1) for _ in range(900)] + [("only", "x", 1, 1), ("only", "y", 1, 1)]
    got = _pairs(spark, data, least=1, share=None)
    assert got == _brute(data, 1, 10**9) and got[("x", "y")][:3] == (1, 1, 1)


def test_query_of_pairs_has_rare_ones(spark, tmp_path):
    tags = [("point", i, 0, "k", "v") for i in range(4001)] + [("point", 0, 1, "a", "b"), ("point", 1, 1, "a", "b")]
    spark.createDataFrame(tags, "feature_type string, feature_value bigint, tag_ord int, tag_key string, tag_value string").write.parquet(f"{tmp_path}/feature_tags.parquet")
    assert [(r.item_a, r.item_b, r.n_a, r.n_b, r.n_ab, r.lift) for r in p2_pairs(spark, str(tmp_path)).collect()] == [("a=b", "k=v", 2, 4001, 2, 1.0)]


# Frequencies


def _terms(spark, data, salts=4):
    df = spark.createDataFrame(data, "rec string, term string, ord int, record string, place string, occ int")
    return {r.term: (r.n_occurrences, r.n_records) for r in frequency.term_counts(df, ["term"], F.col("rec"), "ord", salts).collect()}


def test_terms_against_sets(spark, monkeypatch):
    monkeypatch.setattr(frequency, "MOST_TERMS", 5)
    rnd = random.Random(2)
    data = [(f"r{rnd.randrange(40)}", f"t{min(rnd.randrange(30), rnd.randrange(30))}", rnd.randrange(6), "c", "p", 1) for _ in range(1500)]
    data += data[:200] + [("r1", None, 0, "", "", 0), (None, "t1", 0, "", "", 0), ("r1", "", 0, "", "", 0), ("r1", "x" * 200_000, 1, "", "", 0)]
    good = {(r, t, o) for r, t, o, *_ in data if r is not None and t is not None}
    want = {t: (sum(1 for x in good if x[1] == t), len({x[0] for x in good if x[1] == t})) for t in {x[1] for x in good}}
    assert _terms(spark, data) == want
    assert _terms(spark, []) == {}


def test_counters_flush_between_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(frequency, "MOST_TERMS", 1)
    cols = [("a", "r1", 0), ("b", "r1", 1), ("a", "r1", 2), ("a", "r2", 0), ("c", "r2", 1), ("a", "r3", 0)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([c[i] for c in part]) for i in range(3)], names=["t", "record", "place"])
    schema = pa.schema([("t", pa.string()), ("occ", pa.int64()), ("recs", pa.int64())])
    for cut in range(1, 6):
        total = {}
        for b in frequency.last_seen(iter([batch(cols[:cut]), batch(cols[cut:])]), ["t"], schema):
            for t, o, r in zip(*(c.to_pylist() for c in b.columns)):
                x = total.setdefault(t, [0, 0])
                x[0] += o
                x[1] += r
        assert total == {"a": [4, 3], "b": [1, 1], "c": [1, 1]}


def test_marks(spark):
    df = spark.createDataFrame([("a", 2), ("b", 3), ("c", 5), ("d", 6)], "t string, n_records long")
    assert {r.t: r.mark for r in frequency.marked(df, 100, 3, 20).collect()} == {"a": "rare", "b": "keep", "c": "keep", "d": "common"}


# Encoding

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public vocabulary here")
TEXTS = ["", None, "hello world", "Hello  world \n\n x", "<|endoftext|> is text", "привет 你好 👍🏽 naïve", " ", "\t\n", "a" * 5000, "I'll they've 12345", "x y z", "ab" * 20000 + "!" * 3000]


@needs_vocabulary
def test_encoding_against_a_library(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df, VOCABULARY).collect()}
    assert got == {i: library.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert bpe.encode(df.limit(0), VOCABULARY).count() == 0


@needs_vocabulary
def test_encoding_round_trip():
    tokens = bpe.read_ranks(VOCABULARY)
    e = bpe.Encoder(bpe.PerfectHash.build(tokens))
    rnd = random.Random(4)
    for _ in range(50):
        t = "".join(rnd.choice("abc de\n1é日👍'") for _ in range(rnd.randrange(200)))
        assert b"".join(tokens[i] for i in e.encode(t)).decode() == t


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(1000)]
    h = bpe.PerfectHash.build(keys)
    assert len(h.rank) == 1000 and sorted(h.rank) == list(range(1000))
    assert all(h.get(k) == i for i, k in enumerate(keys)) and h.get(b"other") == -1 and h.get(b"") == -1


# Mixing


def _mix(spark, sizes, targets, block=4, **kw):
    docs = [(i, s, list(range(n))) for i, (s, n) in enumerate(sizes)]
    blocks = mixing.pack(spark.createDataFrame(docs, "id bigint, source string, ids array<int>"), "id", "source", "ids", block=block, range_rows=4)
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return blocks, mixing.mix(blocks, t, block=block, shards=5, **kw), t


def test_packing_keeps_every_token(spark):
    rnd = random.Random(5)
    sizes = [(rnd.choice("ab"), rnd.randrange(30)) for _ in range(60)] + [("a", 300), (None, 5)]
    blocks, _, _ = _mix(spark, sizes, [("a", 1.0, 1)])
    got = Counter()
    for r in blocks.collect():
        got[r.source] += len(r.tokens)
        assert r.n_tokens == len(r.tokens) <= 4
    assert got == Counter({s: sum(n for x, n in sizes if x == s) for s in "ab"})


def test_mix_meets_shares_and_caps(spark):
    sizes = [("a", 400)] * 10 + [("b", 100)] * 4 + [("c", 50)]
    blocks, mixed, t = _mix(spark, sizes, [("a", 0.5, 1), ("b", 0.3, 5), ("c", 0.1, 3), ("none", 0.1, 9), ("z", None, 1), (None, 0.1, 1)])
    rows = mixed.collect()
    used = Counter((r.source, r.block) for r in rows)
    assert max(used.values()) <= 5 and max(v for (s, _), v in used.items() if s == "a") == 1 and max(v for (s, _), v in used.items() if s == "c") <= 3
    share = {r.source: r.actual_share for r in mixing.shares(mixed, t).collect()}
    assert abs(share["a"] - 5 / 9) < 0.02 and abs(share["b"] - 3 / 9) < 0.02 and share["none"] == 0 and share["z"] == 0
    shards = Counter(r.shard for r in rows)
    assert max(shards.values()) - min(shards.values()) <= 1
    # Each epoch of a source uses a block once.
    assert all(v == 1 for v in Counter((r.source, r.epoch, r.block) for r in rows).values())


def test_mix_without_texts(spark):
    _, mixed, t = _mix(spark, [], [("a", 1.0, 1)])
    assert mixed.count() == 0 and [r.actual_share for r in mixing.shares(mixed, t).collect()] == [0.0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    p = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 9))
    assert sorted(p) == list(range(n))


# Truncation

SENTENCES = ["The quick cache was cleared before the nightly build started.", "Nobody has looked at the broken index since last winter.", "We moved the old timetable to another folder yesterday."]


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("a", F.lit(1)).withColumn("kind", F.lit("x"))


def test_truncated_endings(spark):
    rnd = random.Random(6)
    whole = [" ".join(rnd.choice(SENTENCES) for _ in range(6)) + rnd.choice(["", "", "\n\nCheers"]) for _ in range(300)]
    ends = ["The quick cache was cle", "Nobody has looked at the", "We moved the old timeta...", "Nobody has looked at the broken index since", "Fine.\n```py\nfor x in"]
    texts = whole + [SENTENCES[0] + " " + e for e in ends] + [None, "", "  \n ", "Cheers", SENTENCES[1]]
    got = sorted(r.doc_id for r in truncation.truncated(_docs(spark, texts)).collect())
    assert got == list(range(300, 305))


def test_open_fences(spark):
    """Code may break off after a full stop; prose after a fence that nobody closed does not."""
    whole = ["Try this:\n```py\nfor s in stops:\n    print(s.name)\n```\nIt works for me."] * 40 + ["It works for me."] * 5
    texts = [*whole, "Try this:\n```py\nfor s in stops:\n    print(s.", "Try this:\n```py\nfor s in stops:\n    print(s.name)\n\nIt works for me."]
    assert [r.doc_id for r in truncation.truncated(_docs(spark, texts)).collect()] == [45]


def test_stumps_of_any_length(spark):
    """A long word cut short is a stump like any other."""
    word = "Feuerwehr" * 40
    texts = [f"Nobody has seen the {word} since last winter."] * 60 + ["Cheers"] * 3 + [f"Nobody has seen the {word[:200]}"]
    assert [r.doc_id for r in truncation.truncated(_docs(spark, texts)).collect()] == [63]


def test_beginning_with(spark, rows):
    rnd = random.Random(8)
    words = [("".join(rnd.choice("abß\U0010ffff") for _ in range(rnd.randint(0, 4))), rnd.choice("xy")) for _ in range(300)]
    stems = sorted({w[: rnd.randint(0, 3)] for w, _ in words})
    count = spark.createDataFrame(words, "core string, c string").groupBy("c", "core").agg(F.count("*").alias("n"))
    got = rows(truncation.beginning_with(count, spark.createDataFrame([(c, s) for c in "xyz" for s in stems], "c string, core string"), ["c"]).select("c", "core", "n"))
    assert got == sorted(((c, s, sum(w.startswith(s) and k == c for w, k in words)) for c in "xyz" for s in stems), key=repr)


def test_splitting_takes_linear_time(spark):
    blanks, tags = " \t" * 200_000, "<a " * 200_000
    got = truncation.split_texts(_docs(spark, ["a" + blanks + "b", tags, "<b>x</b>\n\n y" + "\n" * 300_000]), "doc_id", "text").select("doc_id", F.size(F.split("t", " ")).alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {0: 3, 1: 200_001, 2: 4}


def test_truncation_degenerate(spark):
    assert truncation.truncated(_docs(spark, [])).count() == 0
    assert truncation.truncated(_docs(spark, [None, "", " "])).count() == 0
    # By the rule a word repeated 50,000 times ends where it nearly always goes on.
    assert [r.doc_id for r in truncation.truncated(_docs(spark, ["x" * 200_000, "word " * 50_000])).collect()] == [1]
    docs = _docs(spark, ["a", None]).withColumn("source", F.lit("s"))
    assert [tuple(r) for r in truncation.by_source(docs, truncation.truncated(docs)).collect()] == [("s", 1, 0, 0.0)]
