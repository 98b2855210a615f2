"""Pipeline expressions: field references, arithmetic, literals."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquill.errors import InvalidQuery
from docquill.functions import values

ARITHMETIC = {"$add", "$subtract", "$multiply", "$divide"}


def is_arithmetic(spec: Any) -> bool:
    return isinstance(spec, dict) and len(spec) == 1 and next(iter(spec)) in ARITHMETIC


def numeric(schema: T.StructType, spec: Any) -> Column:
    """An operand as a double; anything that is no number gives NULL."""
    if isinstance(spec, str) and spec.startswith("$"):
        found = values.resolve(schema, spec[1:])
        return values.number(*found) if found else F.lit(None).cast("double")
    if is_arithmetic(spec):
        return compile_expression(schema, spec)
    if isinstance(spec, int | float) and not isinstance(spec, bool):
        return F.lit(float(spec))
    return F.lit(None).cast("double")


def compile_expression(schema: T.StructType, spec: Any) -> Column:
    """A column of ``"$path"``, an arithmetic object, or any other JSON value as a literal."""
    if isinstance(spec, str) and spec.startswith("$"):
        found = values.resolve(schema, spec[1:])
        return found[0] if found else F.lit(None)
    if is_arithmetic(spec):
        op, args = next(iter(spec.items()))
        if not isinstance(args, list):
            raise InvalidQuery(f"{op} takes an array")
        terms = [numeric(schema, a) for a in args]
        if op in ("$subtract", "$divide"):
            if len(terms) != 2:
                raise InvalidQuery(f"{op} takes two arguments")
            a, b = terms
            return a - b if op == "$subtract" else F.try_divide(a, b)
        start = F.lit(0.0 if op == "$add" else 1.0)
        return reduce(lambda a, b: a + b if op == "$add" else a * b, terms, start)
    if isinstance(spec, dict) and not spec:
        return F.parse_json(F.lit("{}"))
    return values.literal(spec)
