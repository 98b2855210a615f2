"""Update operators as column expressions over the rows that match."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquill.errors import InvalidUpdate
from docquill.functions import values
from docquill.operators.filters import compile_filter
from docquill.operators.pipeline import with_field

NOW = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _like(value: Any, kind: T.DataType) -> Column:
    """A JSON value as a column of a type."""
    if value is None:
        return F.parse_json(F.lit("null")) if isinstance(kind, T.VariantType) else F.lit(None).cast(kind)
    if isinstance(kind, T.StructType | T.ArrayType | T.MapType):
        return F.from_json(F.lit(values.json_literal(value)), kind)
    if isinstance(kind, T.VariantType):
        return F.parse_json(F.lit(values.json_literal(value)))
    if isinstance(kind, T.LongType | T.IntegerType) and isinstance(value, float):
        return F.lit(value)  # the column widens
    return F.lit(value).cast(kind)


def _wanted(found: tuple[Column, T.DataType] | None, path: str, op: str, want: str) -> None:
    kinds = {"number": values.is_number, "array": lambda k: isinstance(k, T.ArrayType)}
    if found is not None and not kinds[want](found[1]):
        raise InvalidUpdate(f"{op} needs {path} to be of type {want}")


def _variant_number(old: Column, path: str, op: str, operand: int | float) -> Column:
    """$inc or $mul of a mixed field; rows whose value is no number fail the statement when it runs."""
    key = values.variant_key(old)
    whole, num, n = key["whole"], key["num"], F.lit(operand)
    act = (lambda x: x + n) if op == "$inc" else (lambda x: x * n)
    wrong = F.raise_error(F.lit(f"{op} needs {path} to be of type number")).cast("variant")
    return (
        F.when(old.isNull(), act(F.lit(0)).cast("variant")).when(key["rank"] != values.NUMBER, wrong)
        .when(whole.isNotNull(), act(whole).cast("variant")).otherwise(act(num).cast("variant"))
    )


def touched_by(update: dict[str, Any]) -> set[str]:
    """The paths that an update writes to."""
    out = set()
    for op, fields in update.items():
        if isinstance(fields, dict):
            out |= set(fields) | ({v for v in fields.values() if isinstance(v, str)} if op == "$rename" else set())
    return out


def _one(df: DataFrame, op: str, path: str, operand: Any, when: Column) -> DataFrame:
    found = values.field(df, path)
    old = found[0] if found else None
    kind = found[1] if found else None

    if op in ("$set", "$min", "$max") and kind is not None and not values.same_kind(kind, operand):
        raise InvalidUpdate(f"{path} holds {kind.simpleString()}; a value of another kind needs a variant column")

    def put(new: Column) -> DataFrame:
        kept = old if old is not None else F.lit(None)
        return with_field(df, path, F.when(when, new).otherwise(kept))

    if op == "$set":
        return put(_like(operand, kind if kind is not None else T.VariantType()) if kind is not None or operand is None or operand == {} else values.literal(operand))
    if op == "$unset":
        return put(F.lit(None).cast(kind)) if kind is not None else df
    if op in ("$inc", "$mul"):
        if not isinstance(operand, int | float) or isinstance(operand, bool):
            raise InvalidUpdate(f"{op} takes a number")
        if isinstance(kind, T.VariantType):
            return put(_variant_number(old, path, op, operand))
        _wanted(found, path, op, "number")
        base = F.coalesce(old, F.lit(0)) if old is not None else F.lit(0)
        return put(base + F.lit(operand) if op == "$inc" else base * F.lit(operand))
    if op in ("$min", "$max"):
        if old is None:
            return put(values.literal(operand))
        better = values.compare(old, kind, "$gt" if op == "$min" else "$lt", operand)
        return put(F.when(old.isNull() | better, _like(operand, kind)).otherwise(old))
    if op == "$rename":
        if not isinstance(operand, str):
            raise InvalidUpdate("$rename takes a new name")
        if old is None:
            return df
        target = values.field(df, operand)
        moved = F.when(when & old.isNotNull(), old).otherwise(target[0] if target else F.lit(None).cast(kind))
        return with_field(with_field(df, operand, moved), path, F.when(when, F.lit(None).cast(kind)).otherwise(old))
    if op == "$currentDate":
        return put(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), NOW))
    if op not in ("$push", "$pull", "$addToSet", "$pop"):
        raise InvalidUpdate(f"unknown operator {op}")
    _wanted(found, path, op, "array")
    if old is None:
        return put(F.array(values.literal(operand))) if op in ("$push", "$addToSet") else df
    item = kind.elementType
    if op == "$pop":
        if operand not in (1, -1):
            raise InvalidUpdate("$pop takes 1 or -1")
        rest = F.size(old) - 1
        return put(F.when(F.size(old) > 0, F.slice(old, 1, rest) if operand == 1 else F.slice(old, 2, F.greatest(rest, F.lit(0)))).otherwise(old))
    value = _like(operand, item)
    if op == "$push":
        return put(F.array_append(F.coalesce(old, F.array().cast(kind)), value))
    if op == "$pull":
        same = (lambda x: x.isNull()) if operand is None else (lambda x: F.coalesce(x == value, F.lit(False)))
        return put(F.filter(old, lambda x: ~same(x)))
    there = F.exists(old, (lambda x: x.isNull()) if operand is None else (lambda x: F.coalesce(x == value, F.lit(False))))
    return put(F.when(F.coalesce(there, F.lit(False)), old).otherwise(F.array_append(F.coalesce(old, F.array().cast(kind)), value)))


def apply_update(df: DataFrame, update: dict[str, Any], when: Column | None = None) -> DataFrame:
    """df with the operators applied, in the order given, to the rows where ``when`` holds (default: all)."""
    if not isinstance(update, dict) or not update:
        raise InvalidUpdate("an update is an object of operators")
    hit = "_hit"
    df = df.withColumn(hit, F.coalesce(when, F.lit(False)) if when is not None else F.lit(True))
    for op, fields in update.items():
        if not op.startswith("$") or not isinstance(fields, dict):
            raise InvalidUpdate(f"unknown operator {op}")
        for path, operand in fields.items():
            df = _one(df, op, path, operand, F.col(hit))
    return df.drop(hit)


def update_rows(df: DataFrame, query: dict[str, Any], update: dict[str, Any]) -> DataFrame:
    """All rows, those that match updated; ``_version``, where there is one, counts up."""
    when = compile_filter(df.schema, query)
    out = apply_update(df.withColumn("_when", F.coalesce(when, F.lit(False))), update, F.col("_when"))
    if "_version" in out.columns:
        out = out.withColumn("_version", F.when(F.col("_when"), F.col("_version") + 1).otherwise(F.col("_version")))
    return out.drop("_when")


def delete_rows(df: DataFrame, query: dict[str, Any]) -> DataFrame:
    return df.where(~F.coalesce(compile_filter(df.schema, query), F.lit(False)))
