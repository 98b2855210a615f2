"""Typed values: ranks, date-like strings, paths, and comparisons across types.

Values of different kinds never coerce. They order by rank: null, boolean, number, point in time, string.
A string that reads as a date counts as a point in time. Arrays and objects count as their JSON text.
A NULL cell of a typed column is a missing field; a VARIANT column can tell null from missing.
"""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquill.errors import InvalidQuery

NULL, BOOLEAN, NUMBER, TIME, STRING = range(5)

_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_CLOCK = r"[0-9]{2}:[0-9]{2}:[0-9]{2}"
_ZONED = rf"^{_DAY}[Tt ]{_CLOCK}(\.[0-9]+)?([Zz]|[+-][0-9]{{2}}:[0-9]{{2}})$"
_PLAIN = rf"^{_DAY}[T ]{_CLOCK}$"
_DATE = rf"^{_DAY}$"


def parse_ms(text: str) -> int | None:
    """Milliseconds since 1970 of a date-like string, else None; without a zone it is UTC."""
    if not any(re.match(p, text) for p in (_ZONED, _PLAIN, _DATE)):
        return None
    try:
        at = datetime.fromisoformat(text.upper().replace("Z", "+00:00"))
    except ValueError:
        return None
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return int(at.timestamp() * 1_000_000) // 1000


def ms_of(text: Column) -> Column:
    """Milliseconds of a date-like string column, NULL for all other strings."""
    text = F.when(F.substring(text, 5, 1) == "-", text)  # spares most strings the patterns
    whole = F.when(text.rlike(_ZONED), F.upper(text)).when(text.rlike(_PLAIN), F.concat(text, F.lit("Z"))).when(text.rlike(_DATE), F.concat(text, F.lit("T00:00:00Z")))
    return F.unix_millis(whole.try_cast("timestamp"))


def rank_of_literal(value: Any) -> int:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, int | float):
        return NUMBER
    if isinstance(value, datetime):
        return TIME
    if isinstance(value, str):
        return TIME if parse_ms(value) is not None else STRING
    return STRING


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType)


def resolve(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """The column of a dotted path and its type; None where no field has that name. Arrays aren't entered."""
    if path in schema.fieldNames():  # a flat column may have a dot in its name
        return F.col(f"`{path}`"), schema[path].dataType
    parts = path.split(".")
    if parts[0] not in schema.fieldNames():
        return None
    column, kind = F.col(f"`{parts[0]}`"), schema[parts[0]].dataType
    for k, part in enumerate(parts[1:], 1):
        if isinstance(kind, T.VariantType):
            rest = "".join(f"['{p}']" for p in parts[k:])
            return F.try_variant_get(column, f"${rest}", "variant"), kind
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return None
        column, kind = column.getField(part), kind[part].dataType
    return column, kind


def field(df: DataFrame, path: str) -> tuple[Column, T.DataType] | None:
    return resolve(df.schema, path)


def json_literal(value: Any, kind: T.DataType | None = None) -> str:
    """Compact JSON; an object's keys in the order of the struct it is held against."""

    def ordered(v: Any, k: T.DataType | None) -> Any:
        if isinstance(v, dict):
            names = k.fieldNames() if isinstance(k, T.StructType) else sorted(v)
            keys = [n for n in names if n in v] + [n for n in sorted(v) if n not in names]
            return {n: ordered(v[n], k[n].dataType if isinstance(k, T.StructType) and n in k.fieldNames() else None) for n in keys}
        if isinstance(v, list):
            return [ordered(x, k.elementType if isinstance(k, T.ArrayType) else None) for x in v]
        return v

    return json.dumps(ordered(value, kind), separators=(",", ":"), ensure_ascii=False)


def constant(op: str, left: int, right: int) -> bool:
    """What a comparison of values of two different ranks gives."""
    return {"$eq": False, "$ne": True, "$gt": left > right, "$gte": left > right, "$lt": left < right, "$lte": left < right}[op]


def apply(op: str, left: Column, right: Column) -> Column:
    return {
        "$eq": lambda: left == right, "$ne": lambda: left != right, "$gt": lambda: left > right,
        "$gte": lambda: left >= right, "$lt": lambda: left < right, "$lte": lambda: left <= right,
    }[op]()


# --- variant values -------------------------------------------------------------------------------

_NUMBERS = "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def variant_key(v: Column) -> Column:
    """struct(rank, num, whole, s) of a variant: sorts and groups as the values do; NULL where missing.

    whole settles ties of integers beyond the reach of doubles. For grouping, 1 and 1.0 stay apart by it.
    """
    kind = F.schema_of_variant(v)
    number, text = kind.rlike(_NUMBERS), kind == "STRING"
    s = F.when(text, F.try_variant_get(v, "$", "string"))
    ms = ms_of(s)
    rank = (
        F.when(kind == "VOID", NULL).when(kind == "BOOLEAN", BOOLEAN).when(number, NUMBER).when(ms.isNotNull(), TIME).otherwise(STRING)
    )
    num = (
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
        .when(number, F.try_variant_get(v, "$", "double")).when(ms.isNotNull(), ms.cast("double"))
    )
    whole = F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint"))
    words = F.when(text & ms.isNull(), s).when(~text & ~number & ~kind.isin("VOID", "BOOLEAN"), F.to_json(v))
    return F.when(v.isNotNull(), F.struct(rank.alias("rank"), num.alias("num"), whole.alias("whole"), words.alias("s")))


def _compare_variant(v: Column, op: str, value: Any) -> Column:
    key, rank = variant_key(v), rank_of_literal(value)
    have = key["rank"]
    order = F.when(have < rank, -1).when(have > rank, 1)
    sign = lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0)
    if rank == NULL:
        same = F.lit(0)
    elif rank == BOOLEAN:
        same = sign(key["num"], F.lit(float(value)))
    elif rank == NUMBER:
        same = sign(key["num"], F.lit(float(value)))
        if isinstance(value, int):
            same = F.when(key["whole"].isNotNull(), sign(key["whole"], F.lit(value))).otherwise(same)
    elif rank == TIME:
        same = sign(key["num"], F.lit(float(parse_ms(value) if isinstance(value, str) else int(value.timestamp() * 1000))))
    else:
        same = sign(key["s"], F.lit(value if isinstance(value, str) else json_literal(value)))
    return v.isNotNull() & apply(op, order.otherwise(same), F.lit(0))


def compare(column: Column, kind: T.DataType, op: str, value: Any) -> Column:
    """column op value by the order of values; never true where the column is missing."""
    rank = rank_of_literal(value)
    if isinstance(kind, T.VariantType):
        return _compare_variant(column, op, value)
    decided = lambda own: column.isNotNull() if constant(op, own, rank) else F.lit(False)
    if rank == NULL:  # no typed cell holds an explicit null
        return column.isNotNull() if op in ("$ne", "$gt", "$gte") else F.lit(False)
    if isinstance(kind, T.BooleanType):
        return apply(op, column, F.lit(value)) if rank == BOOLEAN else decided(BOOLEAN)
    if is_number(kind):
        return apply(op, column, F.lit(value)) if rank == NUMBER else decided(NUMBER)
    if is_time(kind):
        if rank != TIME:
            return decided(TIME)
        ms = parse_ms(value) if isinstance(value, str) else int(value.timestamp() * 1000)
        at = datetime.fromtimestamp(ms / 1000, timezone.utc)
        text = at.strftime("%Y-%m-%d %H:%M:%S.") + f"{ms % 1000:03d}"
        moment = F.lit(text).cast("timestamp_ntz") if not isinstance(kind, T.TimestampType) else F.lit(text + "Z").cast("timestamp")
        return apply(op, column if not isinstance(kind, T.DateType) else column.cast("timestamp_ntz"), moment)
    if isinstance(kind, T.StringType):
        if rank == TIME:
            ms = ms_of(column)
            other = F.lit(constant(op, STRING, TIME))
            found = F.when(ms.isNotNull(), apply(op, ms, F.lit(parse_ms(value) if isinstance(value, str) else int(value.timestamp() * 1000)))).otherwise(other)
            return column.isNotNull() & found
        if rank != STRING:
            return decided(STRING)
        plain = apply(op, column, F.lit(value if isinstance(value, str) else json_literal(value)))
        if op in ("$eq", "$ne"):  # a date-like string equals no other string, so this can reach the scan
            return plain
        return F.when(ms_of(column).isNotNull(), F.lit(constant(op, TIME, STRING))).otherwise(plain) & column.isNotNull()
    if rank != STRING:
        return decided(STRING)
    return apply(op, F.to_json(column), F.lit(value if isinstance(value, str) else json_literal(value, kind)))


def same_kind(kind: T.DataType, value: Any) -> bool:
    """Whether a column of a type can hold a JSON value as it is."""
    if value is None or isinstance(kind, T.VariantType):
        return True
    if isinstance(value, bool) or isinstance(kind, T.BooleanType):
        return isinstance(value, bool) and isinstance(kind, T.BooleanType)
    if isinstance(value, int | float) or is_number(kind):
        return isinstance(value, int | float) and is_number(kind)
    if isinstance(value, list) or isinstance(kind, T.ArrayType):
        return isinstance(value, list) and isinstance(kind, T.ArrayType) and all(same_kind(kind.elementType, v) for v in value)
    if isinstance(value, dict) or isinstance(kind, T.StructType):
        return isinstance(value, dict) and isinstance(kind, T.StructType) and all(k in kind.fieldNames() and same_kind(kind[k].dataType, v) for k, v in value.items())
    return isinstance(kind, T.StringType) or (is_time(kind) and rank_of_literal(value) == TIME)


def number(column: Column, kind: T.DataType) -> Column:
    """The value as a double where it is a number, else NULL; nothing else turns into a number."""
    if is_number(kind):
        return column.cast("double")
    if isinstance(kind, T.VariantType):
        return F.when(F.schema_of_variant(column).rlike(_NUMBERS), F.try_variant_get(column, "$", "double"))
    return F.lit(None).cast("double")


def sort_key(column: Column, kind: T.DataType) -> Column:
    """What a column sorts and groups by."""
    if isinstance(kind, T.VariantType):
        return F.coalesce(variant_key(column), variant_key(F.parse_json(F.lit("null"))))
    if isinstance(kind, T.StringType):
        ms = ms_of(column)
        return F.when(column.isNotNull(), F.struct(F.when(ms.isNotNull(), TIME).otherwise(STRING).alias("rank"), ms.alias("num"), F.when(ms.isNull(), column).alias("s")))
    if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
        return F.to_json(column)
    return column


def order_key(column: Column, kind: T.DataType) -> Column:
    """sort_key, but equal numbers of either kind tie."""
    key = sort_key(column, kind)
    if not isinstance(kind, T.VariantType):
        return key
    return F.struct(key["rank"], key["num"], F.coalesce(key["whole"], key["num"].try_cast("bigint")).alias("whole"), key["s"])


def _larger_first(text: Column) -> Column:
    """A string that sorts the other way round: its bytes' complements, then an end that no byte's digit reaches."""
    return F.concat(F.translate(F.hex(text), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def reversed_key(column: Column, kind: T.DataType) -> Column:
    """A struct that sorts opposite to order_key: larger values first, missing ones last."""
    key = order_key(column, kind)
    if isinstance(kind, T.VariantType):
        parts = [F.bitwise_not(key["rank"]), -key["num"], F.bitwise_not(key["whole"]), _larger_first(key["s"])]
    elif isinstance(kind, T.StringType):
        parts = [F.bitwise_not(key["rank"]), F.bitwise_not(key["num"]), _larger_first(key["s"])]
    elif isinstance(kind, T.BooleanType):
        parts = [F.bitwise_not(key.cast("int"))]
    elif is_number(kind):
        parts = [F.bitwise_not(key.cast("bigint"))] if isinstance(kind, T.IntegralType) else [-key]
    else:
        parts = [_larger_first(key.cast("string"))]
    return F.struct(*(c.alias(f"p{n}{m}") for n, part in enumerate(parts) for m, c in (("a", part.isNull()), ("b", part))))


def literal(value: Any) -> Column:
    """A column of a JSON value."""
    if isinstance(value, list):
        return F.array(*map(literal, value))
    if isinstance(value, dict):
        if not value:
            raise InvalidQuery("an empty object has no column type")
        return F.struct(*(literal(v).alias(k) for k, v in value.items()))
    return F.lit(value)
