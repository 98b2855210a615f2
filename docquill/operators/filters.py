"""Filter queries: JSON predicates compiled to one Column, so scans can prune and push down."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquill.errors import InvalidQuery
from docquill.functions import values
from docquill.functions.patterns import to_java

COMPARISONS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte")


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if len(parts) != 1 else parts[0]


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def _regex(column: Column, kind: T.DataType, pattern: Any, options: str) -> Column:
    if not isinstance(pattern, str):
        raise InvalidQuery("$regex takes a string")
    if isinstance(kind, T.VariantType):
        column = F.when(F.schema_of_variant(column) == "STRING", F.try_variant_get(column, "$", "string"))
    elif not isinstance(kind, T.StringType):
        return F.lit(False)
    return column.rlike(to_java(pattern, options))


def _field(schema: T.StructType, path: str, condition: Any) -> Column:
    found = values.resolve(schema, path)
    operators = isinstance(condition, dict) and any(k.startswith("$") for k in condition)
    parts: list[Column] = []
    for op, operand in (condition if operators else {"$eq": condition}).items():
        if op == "$options":
            if "$regex" not in condition:
                raise InvalidQuery("$options needs $regex")
            continue
        if op not in (*COMPARISONS, "$in", "$exists", "$regex"):
            raise InvalidQuery(f"unknown operator {op}")
        if op == "$in" and not isinstance(operand, list):
            raise InvalidQuery("$in takes an array")
        if op == "$exists" and not isinstance(operand, bool):
            raise InvalidQuery("$exists takes true or false")
        if found is None:  # no row has the field
            parts.append(F.lit(op == "$exists" and not operand))
        elif op == "$exists":
            parts.append(found[0].isNotNull() if operand else found[0].isNull())
        elif op == "$regex":
            parts.append(_regex(*found, operand, condition.get("$options", "")))
        elif op == "$in":
            column, kind = found
            plain = [v for v in operand if isinstance(v, str) and values.rank_of_literal(v) == values.STRING] if isinstance(kind, T.StringType) else []
            plain = [v for v in operand if isinstance(v, int | float) and not isinstance(v, bool)] if values.is_number(kind) else plain
            rest = [v for v in operand if not any(v is p for p in plain)]
            parts.append(_any(([column.isin(plain)] if plain else []) + [values.compare(column, kind, "$eq", v) for v in rest]))
        else:
            parts.append(values.compare(*found, op, operand))
    return _all(parts)


def compile_filter(schema: T.StructType, query: dict[str, Any] | None) -> Column:
    """The predicate of a query; several fields or operators in one object are AND-ed, ``{}`` matches all."""
    if query is None:
        query = {}
    if not isinstance(query, dict):
        raise InvalidQuery("a query is an object")
    parts = []
    for key, value in query.items():
        if key in ("$and", "$or"):
            if not isinstance(value, list):
                raise InvalidQuery(f"{key} takes an array")
            parts.append((_all if key == "$and" else _any)([compile_filter(schema, q) for q in value]))
        elif key.startswith("$"):
            raise InvalidQuery(f"unknown operator {key}")
        else:
            parts.append(_field(schema, key, value))
    return _all(parts)


def match(df: DataFrame, query: dict[str, Any] | None) -> DataFrame:
    return df.where(compile_filter(df.schema, query)) if query else df
