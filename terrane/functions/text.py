"""Numbers, coordinates and typed values in text.

Only the blank U+0020 is trimmed, digits are ASCII, and a text that does not
match gives null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"\A[+-]?[0-9]++(?:\.[0-9]++)?\z"


def bare(c: Column) -> Column:
    return F.btrim(c, F.lit(" "))


def is_number(c: Column) -> Column:
    return bare(c).rlike(NUMBER)


def number(c: Column) -> Column:
    """The number in ``c`` as double, null when there is none."""
    return F.when(is_number(c), bare(c).try_cast("double"))


def latitude(c: Column) -> Column:
    v = number(c)
    return F.when(v.between(-90.0, 90.0), v)


def longitude(c: Column) -> Column:
    v = number(c)
    return F.when(v.between(-180.0, 180.0), v)


def typed(c: Column, kind: str) -> Column:
    """``c`` as an int, double, bool, date or string value; null when it is not of that type."""
    v = bare(c)
    if kind == "int":
        return F.when(v.rlike(r"\A[+-]?[0-9]{1,9}\z"), v.try_cast("int"))
    if kind == "double":
        return number(c)
    if kind == "bool":
        low = F.lower(v)
        return F.when(low.isin("yes", "true", "1"), F.lit(True)).when(low.isin("no", "false", "0"), F.lit(False))
    if kind == "date":
        return F.when(v.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(v, "yyyy-MM-dd"))
    if kind == "string":
        return c
    raise ValueError(f"unknown value type {kind!r}")
