"""Arithmetic and comparison with the typing rules of the query language; types are checked when the plan is built."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT, FLOAT, STRING, ID = "int", "float", "string", "id"


def add(a: Column, b: Column, a_type: str = INT, b_type: str = INT) -> Column:
    """An integer only if both are."""
    return a + b if a_type == b_type == INT else a.cast("double") + b.cast("double")


def add_ints(a: Column, b: Column) -> Column:
    return a.cast("bigint") + b.cast("bigint")


def divide(a: Column, b: Column, a_type: str = INT, b_type: str = INT) -> Column:
    """Integers truncate toward zero and dividing by 0 is an error; floats give infinities and NaN."""
    if a_type == b_type == INT:
        return F.call_function("div", a.cast("bigint"), b.cast("bigint"))
    x, y = a.cast("double"), b.cast("double")
    inf = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, inf).otherwise(F.try_divide(x, y))


def divide_int(a: Column, b: Column) -> Column:
    return divide(a, b, INT, FLOAT)


def clamp(v: Column, low: Column, high: Column) -> Column:
    """The lower bound is tested first."""
    return F.when(v < low, low).when(v > high, high).otherwise(v)


def gt(a: Column, b: Column, a_type: str = INT, b_type: str = INT) -> Column:
    """Integers compare with integers, floats with numbers, texts with texts, ids with ids; an integer before a float is an error."""
    if a_type == INT and b_type == FLOAT or FLOAT != a_type != b_type or a_type == FLOAT and b_type not in (INT, FLOAT):
        raise TypeError(f"can't compare {a_type} with {b_type}")
    if a_type == ID:
        from terrane.ids import type_order, unsigned_order

        key = lambda x: F.struct(type_order(x["type"]), x["ns"], unsigned_order(x["value"]))
        return key(a) > key(b)
    return a > b


def to_str(a: Column) -> Column:
    return a.cast("string")
