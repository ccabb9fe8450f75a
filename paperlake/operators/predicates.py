"""Filter documents compiled to column expressions.

A filter is a dict: several keys mean AND; a plain value means equality, on an
array field containment; None matches null.  Null fields never satisfy an
ordering comparison, and `$ne`, `$nin` and `$not` match them.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _equals(column: Column, value: Any, is_array: bool) -> Column:
    if value is None:
        return column.isNull()
    if is_array and not isinstance(value, (list, tuple)):
        return F.coalesce(F.array_contains(column, F.lit(value)), F.lit(False))
    if isinstance(value, (list, tuple)):
        return column.eqNullSafe(F.array(*map(F.lit, value)) if value else F.array())
    return column.eqNullSafe(F.lit(value))


def _operator(name: str, column: Column, value: Any, is_array: bool) -> Column:
    compare = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
    if name in compare:
        return F.coalesce(getattr(column, compare[name])(F.lit(value)), F.lit(False))
    if name == "$eq":
        return _equals(column, value, is_array)
    if name == "$ne":
        return ~_equals(column, value, is_array)
    if name == "$in":
        return _any([_equals(column, v, is_array) for v in value])
    if name == "$nin":
        return ~_any([_equals(column, v, is_array) for v in value])
    if name == "$exists":
        return column.isNotNull() if value else column.isNull()
    if name == "$regex":
        return F.coalesce(column.rlike(value), F.lit(False))
    if name == "$not":
        return ~_condition(column, value, is_array)
    raise ValueError(f"unknown operator {name}")


def _condition(column: Column, value: Any, is_array: bool) -> Column:
    if isinstance(value, dict) and any(str(k).startswith("$") for k in value):
        return _all([_operator(k, column, v, is_array) for k, v in value.items()])
    return _equals(column, value, is_array)


def compile_filter(query: dict[str, Any] | None, schema: StructType) -> Column:
    """The predicate of a filter document; it is never null.  None and {} match every row.

    A field the schema doesn't have is missing everywhere, so it equals None only.
    """
    parts = []
    for key, value in (query or {}).items():
        if key in ("$and", "$or"):
            parts.append((_all if key == "$and" else _any)([compile_filter(q, schema) for q in value]))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        else:
            known = key.split(".")[0] in schema.fieldNames()
            column = F.col(key) if known else F.lit(None)
            is_array = key in schema.fieldNames() and isinstance(schema[key].dataType, ArrayType)
            parts.append(_condition(column, value, is_array))
    return _all(parts)
