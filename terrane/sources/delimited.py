"""Loading delimited lines, with the rows that fail to parse set apart and the reason for each.

Lines are read permissively under an explicit schema with the raw text of corrupt
ones kept, and those are reclassified: by quoting, by the number of columns and
by casts. The reader forgives stray quotes, so lines with quotes are reclassified
as well.

The quoting rule: a cell is either free of quotes or quoted from its first to
its last character, and then holds commas, line breaks and doubled quotes.
Splitting a line at its quotes decides that without backtracking: pieces at odd
places lie inside quotes, pieces at even places outside; an outer piece that
touches a quote must touch it with a comma, or be empty at the ends of the line
or between the two quotes of a doubled one.

Defined results: a null line and an unknown feed fail, an empty line has one
(empty) column, a line of ``ROOM`` commas or more fails even if they are all in
quotes (``reader``). Line ends at the end of a line are dropped. Lines of any length
take time in proportion to it. Repeated lines are separate rows. Input columns
named ``cells`` or ``reason`` are replaced by the result's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import bare, latitude, longitude
from terrane.plans.once import once

CORRUPT = "_corrupt"
#: Cells the reader has room for; a line of as many commas is not given to it.
ROOM = 20_000
READER = {"maxColumns": str(ROOM), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


@dataclass(frozen=True)
class Feed:
    """Columns of a feed in order, and the checks ``(reason, cells -> Column that is true when good)`` applied to its cells."""

    columns: Sequence[str]
    checks: Sequence[tuple[str, object]] = field(default_factory=tuple)


def pieces(line: Column) -> Column:
    return F.split(line, '"', -1)


def quoting_broken(parts: Column) -> Column:
    """Whether the pieces of a line, cut at its quotes, break the quoting rule."""
    n = F.size(parts)
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    # Outer pieces between the first and the last: empty (a doubled quote), or from one cell to the next.
    outer = F.filter(parts, lambda p, i: (i % 2 == 0) & (i > 0) & (i < n - 1) & (p != "") & ~(p.startswith(",") & p.endswith(",")))
    ends = ((first != "") & ~first.endswith(",")) | ((last != "") & ~last.startswith(","))
    return F.when(n == 1, F.lit(False)).otherwise((n % 2 == 0) | ends | (F.size(outer) > 0))


def column_count(parts: Column) -> Column:
    """Columns of a line whose quoting is good: the commas outside quotes, and one."""
    outer = F.filter(parts, lambda p, i: i % 2 == 0)
    return F.aggregate(outer, F.lit(1), lambda n, p: n + F.length(p) - F.length(F.replace(p, F.lit(","), F.lit(""))))


def read_lines(lines: DataFrame, feeds: Mapping[str, Feed], feed: str = "feed", line: str = "line") -> DataFrame:
    """``lines`` with ``reason`` (null for good rows: feed, null, quoting, columns, reader, or of a check) and ``cells``, a map of column to text.

    Every line is read permissively under its feed's schema. The raw text is kept
    of those that the reader rejects, and of those that it may have forgiven: it
    takes stray quotes and empty lines without complaint, and lines of more commas
    than it has room for are not given to it. Only lines whose raw text is kept are
    classified by quoting and column count; a rejected one in which those find
    nothing fails for ``reader``. Casts are checked on the cells that were read.
    """
    text = F.regexp_replace(F.col(line), r"[\r\n]+\z", "")
    # The result's own names win over columns that happen to have them.
    own = {"cells", "reason", "_text", "_raw", "_rejected", "_read", "_parts", "_shape", "_wide", *(f"_row{i}" for i in range(len(feeds)))}
    lines = lines.drop(*[c for c in lines.columns if c.lower() in own])
    df = once(lines, _text=text)
    df = df.withColumn("_wide", F.length("_text") - F.length(F.replace(F.col("_text"), F.lit(","), F.lit(""))) >= ROOM)
    mine = [F.col(feed) == name for name in feeds]
    rows, read, rejected, want = {}, F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (name, f) in enumerate(feeds.items()):
        schema = ", ".join(f"`{c}` STRING" for c in [*f.columns, CORRUPT])
        rows[f"_row{i}"] = F.from_csv(F.when(mine[i] & ~F.col("_wide"), F.col("_text")), schema, READER)
        # Unquoted empty cells, and all cells of an empty line, come back null from the reader.
        read = F.when(mine[i], F.array(*[F.coalesce(F.col(f"_row{i}")[c], F.lit("")) for c in f.columns])).otherwise(read)
        rejected = F.when(mine[i], F.col(f"_row{i}")[CORRUPT]).otherwise(rejected)
        want = F.when(mine[i], F.lit(len(f.columns))).otherwise(want)
    forgiven = F.col("_text").contains('"') | (F.col("_text") == "") | F.col("_wide") | F.coalesce(~F.col(feed).isin(*feeds), F.lit(True))
    df = once(once(df, **rows), _raw=F.coalesce(rejected, F.when(forgiven, F.col("_text"))), _rejected=rejected.isNotNull(), _read=read).drop(*rows)
    df = once(df, _parts=pieces(F.col("_raw")))
    broken = (
        F.when(F.col(line).isNull(), "null").when(F.col("_raw").isNull(), F.lit(None)).when(quoting_broken(F.col("_parts")), "quoting").when(want.isNull(), "feed")
        .when(column_count(F.col("_parts")) != want, "columns").when(F.col("_rejected") | F.col("_wide"), "reader")
    )
    df = once(df, _shape=broken)
    cells, checks = None, F.lit(None).cast("string")
    for i, (_, f) in enumerate(feeds.items()):
        good_shape = mine[i] & F.col("_shape").isNull()
        got = F.map_from_arrays(F.array(*[F.lit(c) for c in f.columns]), F.col("_read"))
        cells = F.when(good_shape, got) if cells is None else cells.when(good_shape, got)
        cell = lambda c, f=f: F.get("_read", f.columns.index(c))
        failed = F.coalesce(*[F.when(~F.coalesce(good(cell), F.lit(False)), F.lit(why)) for why, good in f.checks], F.lit(None).cast("string"))
        checks = F.when(good_shape, failed).otherwise(checks)
    df = once(df, cells=cells, reason=F.coalesce("_shape", checks))
    return df.drop(*own - {"cells", "reason"})


def good_rows(read: DataFrame, feed_name: str, feed: Feed, keep: Sequence[str], casts: Mapping[str, object] | None = None, by: str = "feed") -> DataFrame:
    """The good rows of one feed as columns; ``casts`` gives typed columns from text."""
    casts = casts or {}
    out = [casts.get(c, lambda x: x)(F.col("cells")[c]).alias(c) for c in feed.columns]
    return read.where((F.col(by) == feed_name) & F.col("reason").isNull()).select(*keep, *out)


def failures(read: DataFrame) -> DataFrame:
    return read.where(F.col("reason").isNotNull()).drop("cells")


def _coordinate(name, parse):
    def good(cell):
        empty = (bare(cell(name)) == "") & bare(cell("location_type")).isin("3", "4")
        return parse(cell(name)).isNotNull() | empty

    return (name, good)


def _postcode(cell):
    return F.replace(cell("postcode"), F.lit(" "), F.lit("")).rlike(r"\A[A-Za-z0-9]{5,7}\z")


#: The columns of the two feeds.
STOPS = Feed(
    ("stop_id", "stop_code", "stop_name", "stop_desc", "stop_lat", "stop_lon", "zone_id", "stop_url", "location_type", "parent_station", "stop_timezone", "wheelchair_boarding", "level_id", "platform_code"),
    (_coordinate("stop_lat", latitude), _coordinate("stop_lon", longitude)),
)
CODEPOINT = Feed(("postcode", "quality", "eastings", "northings", "country_code", "district_code"), (("postcode", _postcode),))
FEEDS = {"stops": STOPS, "codepoint": CODEPOINT}
