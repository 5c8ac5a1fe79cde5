"""Texts that were cut off before their end, told from word statistics alone.

Words are counted by the two words before them, inside texts and at their ends
(trigrams). A text's final trigram is suspicious when it is frequent inside texts
but almost never ends one. The last word may itself be cut, so its evidence is
every word in that place that begins with it: a whole word at an ordinary end
makes up a good part of those, a stump next to none. Where a trigram has too
little evidence the bigram decides, then the kind of word (plain, quoted or
bracketed, followed by dots) after the same two words, then the word alone, then
the kind after one word. A text that ends in a sentence's final mark is whole.

Words within code fences are counted as well. A fence that is never closed is cut
unless texts end inside one as often as that makes up a good part of all words
there, or prose follows it to a final mark: a last word that occurs in prose more
often than in code.

Texts are split into words once. All of it is SQL over all texts: one count of
trigrams, and joins of the distinct final trigrams with its roll-ups. The words
that begin with a stump lie side by side in the order of words, so their number is
the difference of two running totals, whatever the length of words and stumps.

Defined results: null, empty and blank texts are whole. Runs of digits count as
one digit, so numbers do not thin the evidence. Texts without spaces in Chinese,
Japanese or Korean are taken character by character. A text of one word has no
words before it, as have all others of its kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.plans.lineage import cut
from terrane.plans.once import once
from terrane.plans.ranks import running_total
from terrane.plans.skew import meet, small
from terrane.plans.spread import spread

#: A final trigram is "almost never terminal" below this share of its evidence.
RARE = 0.02
#: Evidence that is enough to call something rare, and to call it common.
ENOUGH, SOME, COMMON = 50, 8, 0.1

LINE, STOP, FENCE = "⏎", "‖", "```"
#: What a regular expression calls white space.
BLANK = " \t\n\x0b\x0c\r"


def split_texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``(id, t, open)`` of each text with words: its words with one blank between them, after a mark for the start of a line, and whether a code fence stays open.

    There are marks for line starts and sentence ends. Every expression takes time in proportion to the text.
    """
    df = docs.select(id, F.col(text).alias("_t")).where("_t IS NOT NULL")
    # Markup, unspaced scripts and fences are looked for only where there can be any.
    df = once(df, _t1=F.when(F.col("_t").contains("<"), F.regexp_replace("_t", r"</?[A-Za-z][^<>\n]*+>", " ")).otherwise(F.col("_t"))).drop("_t")
    spaced = F.regexp_replace("_t1", r"([぀-ヿ㐀-鿿가-힯　-〠])", " $1 ")
    df = once(df, _t2=F.btrim(F.when(F.octet_length("_t1") > F.length("_t1"), spaced).otherwise(F.col("_t1")), F.lit(BLANK))).drop("_t1")
    t = F.regexp_replace("_t2", r"[0-9]++", "0")
    t = F.regexp_replace(t, r"([/?#&=])(?=\S)", "$1 ")
    t = F.regexp_replace(t, r"([.!?。！？…][\"')\]]{0,3})[ \t]++(?=\S)", f"$1 {STOP} ")
    df = once(df, _t3=F.regexp_replace(t, r"(?<![^\S\n])[^\S\n]*+\n\s*+", f" {LINE} ")).drop("_t2")
    fences = F.size(F.split("_t3", FENCE, -1)) - 1
    df = once(df, _t4=F.when(F.col("_t3").contains(FENCE), F.replace("_t3", F.lit(FENCE), F.lit(f" {FENCE} "))).otherwise(F.col("_t3")), open=F.when(F.col("_t3").contains(FENCE), fences % 2 == 1).otherwise(F.lit(False))).drop("_t3")
    df = once(df, _t5=F.trim(F.regexp_replace("_t4", r"[ \t\x0b\f\r]{2,}+|[\t\x0b\f\r]", " "))).where("_t5 <> ''")
    return df.select(id, F.concat(F.lit(f"{LINE} "), "_t5").alias("t"), "open")


def final_trigrams(split: DataFrame, id: str) -> DataFrame:
    """``(id, a, b, x, open)`` of each text; the first word has an empty one before its line."""
    last = once(split.select(id, "open", F.substring_index("t", " ", -3).alias("_l")), _w=F.split("_l", " "))
    return last.select(id, F.when(F.size("_w") > 2, F.element_at("_w", 1)).otherwise(F.lit("")).alias("a"), F.element_at("_w", -2).alias("b"), F.element_at("_w", -1).alias("x"), "open")


def trigram_counts(split: DataFrame) -> DataFrame:
    """``(a, b, x, n)``: how often a word follows two others. Counted before the shuffle, so no trigram is too frequent."""
    df = once(split.select("t"), w=F.concat(F.array(F.lit("")), F.split("t", " "))).drop("t")
    part = lambda i, name: F.slice("w", F.lit(i), F.size("w") - 2).alias(name)
    return df.select(F.inline(F.arrays_zip(part(1, "a"), part(2, "b"), part(3, "x")))).groupBy("a", "b", "x").agg(F.count("*").alias("n"))


def code_words(split: DataFrame) -> DataFrame:
    """``(x)``: every word within a code fence, of the texts that have one."""
    parts = split.where(F.col("t").contains(FENCE)).select(F.posexplode(F.split("t", FENCE, -1)).alias("i", "p")).where("i % 2 = 1")
    return parts.select(F.explode(F.split(F.trim("p"), " ")).alias("x")).where("x <> ''")


_KIND = r"""CASE WHEN {x} RLIKE '(\\.\\.\\.|…)$' THEN 'dots' WHEN {x} RLIKE '```$' THEN 'fence'
  WHEN {x} RLIKE '[.!?。！？]["”»)\\]*_\']*$' THEN 'stop' WHEN {x} RLIKE '[)\\]"\'`>:;]$' THEN 'close' ELSE 'word' END"""
_CORE = r"regexp_replace({x}, '(\\.\\.\\.|…)$', '')"


def beginning_with(words: DataFrame, stems: DataFrame, context: Sequence[str], rows: int | None = None) -> DataFrame:
    """``(*context, core, n)``: for each of the distinct ``stems`` ``(*context, core)`` the number ``n`` of ``words`` ``(*context, core, n)`` of its context that begin with it. ``rows`` bounds words and twice the stems, where a bound is known."""
    key = F.col("core").cast("binary")
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("bigint")
    marks = words.select(*context, key.alias("key"), F.lit(0).alias("side"), "n", none.alias("core"))
    # No byte of a text is greater than all that can follow.
    for side, at in ((-1, key), (1, F.concat(key, F.unhex(F.lit("FF"))))):
        marks = marks.unionByName(stems.select(*context, at.alias("key"), F.lit(side).alias("side"), zero.alias("n"), "core"))
    before = running_total(marks, [F.col(c) for c in (*context, "key", "side")], "n", "before", rows).where("side <> 0")
    return before.groupBy(*context, "core").agg(F.sum(F.col("side") * F.col("before")).alias("n"))


def _by_kind(ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, t)``: endings by kind. There are five kinds."""
    return ends.groupBy(*keys, "kind").agg(F.sum("final").alias("t")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("kind", "t"))).alias("t"))


def cut_endings(counts: DataFrame, finals: DataFrame) -> DataFrame:
    """Of ``final_trigrams``, the distinct ``(a, b, x)`` that are frequent in ``trigram_counts`` (cut) and almost never terminal."""
    core = F.expr(_CORE.format(x="x")).alias("core")
    ends = finals.groupBy("a", "b", "x").agg(F.count("*").alias("final"))
    ends = cut(ends.select("a", "b", "x", "final", F.expr(_KIND.format(x="x")).alias("kind"), core).where("kind <> 'stop'"))
    words = counts.select("a", "b", core, "n")
    two = cut(ends.select("a", "b").distinct())
    one = cut(two.select("b").distinct())
    near, next_ = meet(words, two, ["a", "b"], "left_semi"), meet(words, one, ["b"], "left_semi")
    rows = counts.count() + 2 * ends.count()
    # No level has more rows, or longer words in them, than the distinct endings.
    little = small(ends)
    met = ends
    # Contexts from the most to the least specific.
    for level, keys, own in ((0, ("a", "b", "core"), near), (1, ("b", "core"), next_), (2, ("a", "b"), near), (3, ("core",), words), (4, ("b",), next_)):
        t = _by_kind(ends, keys)
        own = own.groupBy(*keys).agg(F.sum("n").alias("n"))
        n = beginning_with(own, t.select(*keys), [k for k in keys if k != "core"], rows) if "core" in keys else own
        both = t.join(n.hint("shuffle_hash" if little else "merge"), list(keys)).withColumnsRenamed({"t": f"t{level}", "n": f"n{level}"})
        met = met.join(F.broadcast(both), list(keys), "left") if little else meet(met, cut(both), keys, "left")
    rare = F.lit(False)
    for level in (4, 3, 2, 1, 0):
        # Each ending is left out of its own evidence.
        t, n = F.col(f"t{level}")[F.col("kind")] - 1, F.col(f"n{level}") - 1
        common = (n >= SOME) & (t >= 2) & (t >= n * COMMON)
        rare = F.when(common, F.lit(False)).when(n >= ENOUGH, t < n * RARE).otherwise(rare)
    return met.where(rare).select("a", "b", "x")


def open_endings(split: DataFrame, counts: DataFrame, finals: DataFrame, id: str) -> DataFrame:
    """``(id)`` of the texts of ``final_trigrams`` whose fence stays open, none if many texts end in code; those that end in a prose word with a final mark are left out."""
    code = code_words(split)
    n = code.count()
    open_ = cut(finals.where("open").select(id, "x", F.expr(_KIND.format(x="x")).alias("kind")))
    if n >= ENOUGH and open_.count() - 1 >= n * RARE:
        return open_.where("false").select(id)
    asked = cut(open_.where("kind = 'stop'").select("x").distinct())
    within = meet(code, asked, ["x"], "left_semi").groupBy("x").agg(F.count("*").alias("code"))
    everywhere = meet(counts, asked, ["x"], "left_semi").groupBy("x").agg(F.sum("n").alias("n"))
    seen = cut(everywhere.join(within, "x", "left"))
    # Its own end counts as code.
    prose = (F.col("kind") == "stop") & (F.col("n") - F.col("code") > F.col("code") - 1)
    return meet(open_, seen, ["x"], "left").where(~F.coalesce(prose, F.lit(False))).select(id)


def truncated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id)`` of every text that breaks off before its end."""
    split = cut(split_texts(spread(docs.select(id, text), id), id, text))
    counts = cut(trigram_counts(split))
    finals = final_trigrams(split, id)
    found = meet(finals.where("NOT open"), cut(cut_endings(counts, finals)), ["a", "b", "x"], "left_semi").select(id)
    return found.unionByName(open_endings(split, counts, finals, id)).distinct()


def by_source(docs: DataFrame, found: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per source its texts, how many are truncated, and the share."""
    mark = found.select(id).withColumn("_cut", F.lit(1))
    df = docs.where(F.col(text).isNotNull()).select(id, source).join(mark, id, "left")
    return df.groupBy(source).agg(F.count("*").alias("n_texts"), F.count("_cut").alias("n_truncated")).withColumn("share", F.col("n_truncated") / F.col("n_texts"))
