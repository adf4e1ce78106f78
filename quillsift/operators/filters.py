"""Filters of a search request as column predicates.

A request is a mapping with ``field``, ``type`` and, by type, ``str`` or ``int``, ``begin``
and ``end``, ``sranges`` or ``iranges``.  All filters of a search must hold.  ``>`` and ``<``
include their bound.  A number that is the largest long or -1 counts as no value: only
``not in`` lets it pass.  An unknown type matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import present
from ..types import FieldSpec, TableSchema

NUMERIC_ONLY = (">", "<", "between")
STRING_ONLY = ("prefix", "suffix", "contain")
LISTS = ("in", "not in")
TYPES = ("=", "!=", *NUMERIC_ONLY, *LISTS, *STRING_ONLY)


def validate(schema: TableSchema, filters: Iterable[Mapping[str, Any]]) -> None:
    """Raise ValueError for a filter that can't apply to its field."""
    for f in filters:
        spec, kind = schema.get(f.get("field", "")), f.get("type")
        if spec is None:
            raise ValueError(f"no field {f.get('field')!r} to filter by")
        if kind in NUMERIC_ONLY and spec.type.is_string:
            raise ValueError(f"{kind} needs a number or time; {spec.name} is {spec.type.value}")
        if kind in STRING_ONLY and not spec.type.is_string:
            raise ValueError(f"{kind} needs a string; {spec.name} is {spec.type.value}")
        if kind in LISTS and f.get("sranges" if spec.type.is_string else "iranges") is None:
            raise ValueError(f"{kind} needs a list")


def _on_string(c: Column, f: Mapping[str, Any]) -> Column:
    s, kind = f.get("str") or "", f["type"]
    if kind == "=":
        return c == s
    if kind == "!=":
        return c != s
    if kind == "in":
        return c.isin(list(f["sranges"]))
    if kind == "not in":
        return ~c.isin(list(f["sranges"]))
    if kind == "prefix":
        return c.startswith(s)
    if kind == "suffix":
        return c.endswith(s)
    if kind == "contain":
        return c.contains(s)
    return F.lit(False)


def _on_number(c: Column, f: Mapping[str, Any]) -> Column:
    n, kind = int(f.get("int") or 0), f["type"]
    # The bounds come first and reach the Parquet scan; presence is tested on what they leave.
    if kind == "=":
        return (c == n) & present(c)
    if kind == "!=":
        return (c != n) & present(c)
    if kind == ">":
        return (c >= n) & present(c)
    if kind == "<":
        return (c <= n) & present(c)
    if kind == "between":
        return c.between(int(f.get("begin") or 0), int(f.get("end") or 0)) & present(c)
    if kind == "in":
        return c.isin([int(x) for x in f["iranges"]]) & present(c)
    if kind == "not in":
        return ~(c.isin([int(x) for x in f["iranges"]]) & present(c))
    return F.lit(False)


def predicate(spec: FieldSpec, f: Mapping[str, Any], column: Column | None) -> Column:
    """One filter; ``column`` None means the field is absent from the data, which matches nothing."""
    if column is None:
        return F.lit(False)
    return (_on_string if spec.type.is_string else _on_number)(column, f)


def conjunction(schema: TableSchema, filters: Iterable[Mapping[str, Any]], columns: Mapping[str, Column]) -> Column:
    """All filters; ``columns`` has those fields that the data has.  A null, a field missing from a row, matches nothing."""
    filters = list(filters)
    validate(schema, filters)
    each = [predicate(schema.get(f["field"]), f, columns.get(f["field"])) for f in filters]
    return reduce(lambda a, b: a & b, each, F.lit(True))
