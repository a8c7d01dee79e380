"""Contracts of nested rows: a tree of checks gives every issue with its path, as (path, message).

A part is a function of a value and its path's prefix that gives an array of issues; parts are put together to trees and
become one expression, so a row is checked where it is. A test that is null fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ISSUES = "array<struct<path:string,message:string>>"
Part = Callable[[Column, Column], Column]
Test = Callable[[Column], Column]


def _none() -> Column:
    return F.array().cast(_ISSUES)


def _issue(path: Column, message: Column | str) -> Column:
    return F.array(F.struct(path.alias("path"), (F.lit(message) if isinstance(message, str) else message).alias("message")))


def field(name: str, message: str, test: Test) -> Part:
    """A field that must meet a test."""
    return lambda v, at: F.when(F.coalesce(test(v[name]), F.lit(False)), _none()).otherwise(_issue(F.concat(at, F.lit(name)), message))


def rule(name: str, message: str, test: Test) -> Part:
    """A test of the whole value, named by one of its fields."""
    return lambda v, at: F.when(F.coalesce(test(v), F.lit(False)), _none()).otherwise(_issue(F.concat(at, F.lit(name)), message))


def all_of(*parts: Part) -> Part:
    return lambda v, at: F.concat(*(p(v, at) for p in parts))


def record(name: str, message: str, *parts: Part, optional: bool = False) -> Part:
    """A nested object; null is an issue unless it is optional."""
    inner = all_of(*parts)
    return lambda v, at: F.when(v[name].isNotNull(), inner(v[name], F.concat(at, F.lit(name + ".")))).otherwise(_none() if optional else _issue(F.concat(at, F.lit(name)), message))


def each(name: str, message: str, *parts: Part, empty: bool = True, unique: str | None = None, repeated: str = "contains duplicate ID ") -> Part:
    """A list whose items must meet all parts, with their places in the path; values of `unique` that come again are an issue
    of the list, once each."""
    inner = all_of(*parts)

    def check(v: Column, at: Column) -> Column:
        path = F.concat(at, F.lit(name))
        items = F.flatten(F.transform(v[name], lambda x, i: inner(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("].")))))
        if unique:
            ids = F.transform(v[name], lambda x: x[unique].cast("string"))
            twice = F.array_distinct(F.filter(ids, lambda i: F.size(F.filter(ids, lambda j: i == j)) > 1))
            items = F.concat(items, F.transform(twice, lambda i: F.struct(path.alias("path"), F.concat(F.lit(repeated), i).alias("message"))))
        there = v[name].isNotNull() if empty else F.coalesce(F.size(v[name]) > 0, F.lit(False))
        return F.when(there, items).otherwise(_issue(path, message))

    return check


def issues(df: DataFrame, key: str, *parts: Part) -> DataFrame:
    """(key, path, message) of all issues of all rows."""
    row = F.struct(*(F.col(c) for c in df.columns))
    found = df.select(key, F.get(F.transform(F.array(row), lambda v: all_of(*parts)(v, F.lit(""))), F.lit(0)).alias("i"))
    return found.select(key, F.explode("i").alias("i")).select(key, "i.path", "i.message")


def filled(c: Column) -> Column:
    return F.trim(c) != ""


def one_of(*values: str) -> Test:
    return lambda c: c.isin(*values)


def or_null(test: Test) -> Test:
    return lambda c: c.isNull() | test(c)


def address(c: Column) -> Column:
    return c.rlike(r"^https?://[^\s/]+")


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def whole(c: Column) -> Column:
    """A number from 0 on without fraction."""
    return finite(c) & (c >= 0) & (c == F.floor(c))
