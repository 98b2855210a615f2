"""Aggregation pipelines: a list of stages folded over a DataFrame, nothing runs before an action.

Three rewrites happen here, before Catalyst sees a plan: ``$lookup`` followed by ``$unwind`` of its result
is a plain join; ``$first``, ``$last`` and ``$push`` take their order from the last ``$sort`` (else the
key) as an argument of the aggregate, so a ``$sort`` right before a ``$group`` sorts nothing; missing keys
form a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquill.errors import InvalidQuery
from docquill.functions import values
from docquill.functions.expressions import compile_expression, is_arithmetic, numeric
from docquill.operators.filters import match
from docquill.operators.find import sort_columns

ACCUMULATORS = {"$sum", "$avg", "$min", "$max", "$count", "$first", "$last", "$push"}


@dataclass(frozen=True)
class State:
    df: DataFrame
    key: tuple[str, ...]
    sort: tuple[tuple[str, int], ...] = ()
    tables: Callable[[str], DataFrame] | None = None


def _count_of(n: Any, name: str) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise InvalidQuery(f"{name} takes a count")
    return n


def _position(state: State) -> tuple[Column, bool]:
    """(a struct that orders the rows as they come, whether it runs backwards)."""
    parts = [(p, d) for p, d in state.sort if values.field(state.df, p)]
    parts += [(k, 1) for k in state.key if k in state.df.columns and k not in {p for p, _ in parts}]
    if not parts:
        return F.struct(F.monotonically_increasing_id()), False
    directions = {d for _, d in parts}
    turned = (lambda d: d == -1) if len(directions) > 1 else (lambda d: False)
    fields = [(values.reversed_key if turned(d) else values.order_key)(*values.field(state.df, p)) for p, d in parts]
    return F.struct(*(f.alias(f"o{k}") for k, f in enumerate(fields))), directions == {-1}


def _accumulator(state: State, spec: Any) -> Column:
    if not isinstance(spec, dict) or len(spec) != 1:
        raise InvalidQuery("an accumulator is an object with one operator")
    op, operand = next(iter(spec.items()))
    if op not in ACCUMULATORS:
        raise InvalidQuery(f"unknown accumulator {op}")
    schema = state.df.schema
    if op == "$count":
        return F.count(F.lit(1))
    if op == "$sum":
        return F.coalesce(F.sum(numeric(schema, operand)), F.lit(0.0))
    if op == "$avg":
        return F.avg(numeric(schema, operand))
    column = compile_expression(schema, operand)
    kind = state.df.select(column.alias("x")).schema[0].dataType
    if op in ("$min", "$max"):
        least = op == "$min"
        if isinstance(kind, T.VariantType):
            key = values.variant_key(F.when(~F.coalesce(F.is_variant_null(column), F.lit(True)), column))
            return (F.min_by if least else F.max_by)(column, key)
        if isinstance(kind, T.StringType):
            return (F.min_by if least else F.max_by)(column, values.sort_key(column, kind))
        return (F.min if least else F.max)(column)
    order, backwards = _position(state)
    if op == "$push":
        rows = F.collect_list(F.struct(order.alias("o"), F.struct(column.alias("v")).alias("w")))
        if _has_variant(kind):  # variants have no order, so only the positions are compared
            way = -1 if backwards else 1
            rows = F.array_sort(rows, lambda a, b: F.when(a["o"] < b["o"], -way).when(a["o"] > b["o"], way).otherwise(0))
        else:
            rows = F.sort_array(rows, asc=not backwards)
        return F.transform(rows, lambda x: x["w"]["v"])
    first = (op == "$first") != backwards
    return (F.min_by if first else F.max_by)(F.struct(column.alias("v")), order)["v"]


def _group(state: State, spec: Any) -> State:
    if not isinstance(spec, dict) or "_id" not in spec:
        raise InvalidQuery("$group needs _id")
    key, schema = spec["_id"], state.df.schema

    def part(expression: Any) -> tuple[Column, bool]:
        column = compile_expression(schema, expression)
        kind = state.df.select(column.alias("x")).schema[0].dataType
        return (values.sort_key(column, kind), True) if isinstance(kind, T.VariantType) else (column, False)

    compound = isinstance(key, dict) and not is_arithmetic(key) and bool(key)
    names = {f"_g{k}": e for k, e in enumerate(key.values())} if compound else {"_g0": key}
    groups, shown = [], []
    for name, expression in names.items():
        column, mixed = part(expression)
        groups.append(column.alias(name))
        if mixed:  # variants can't be keys: group by the key, show the first spelling
            shown.append((name, F.min_by(compile_expression(schema, expression), _position(state)[0])))
    aggregates = [_accumulator(state, a).alias(n) for n, a in spec.items() if n != "_id"]
    extra = [c.alias(f"_shown{n}") for n, c in shown]
    # groupBy a constant, not agg(): no rows give no group
    out = state.df.groupBy(*groups).agg(*(aggregates + extra or [F.count(F.lit(1)).alias("_n")]))
    final = {n: F.col(f"_shown{n}") if n in dict(shown) else F.col(n) for n in names}
    ident = F.struct(*(c.alias(k) for k, c in zip(key, final.values(), strict=True))) if compound else final["_g0"]
    ordinary = [F.col(f"`{n}`") for n in spec if n != "_id"]
    return replace(state, df=out.select(ident.alias("_id"), *ordinary), key=("_id",) if not isinstance(out.select(ident.alias("x")).schema[0].dataType, T.VariantType) else (), sort=())


def _project(state: State, spec: Any) -> State:
    if not isinstance(spec, dict) or not spec:
        raise InvalidQuery("$project takes an object")
    df = state.df
    on = lambda v: v is True or (isinstance(v, int | float) and not isinstance(v, bool) and v == 1)
    off = lambda v: v is False or (isinstance(v, int | float) and not isinstance(v, bool) and v == 0)
    including = any(not off(v) and (k != "_id" or not on(v)) for k, v in spec.items())
    if not including:
        return replace(state, df=df.drop(*(k for k, v in spec.items() if off(v))))
    out = []
    if "_id" in df.columns and "_id" not in spec:
        out.append(F.col("_id"))
    for name, value in spec.items():
        if off(value):
            continue
        if on(value):
            found = values.field(df, name)
            if found:
                out.append(found[0].alias(name))
        else:
            out.append(compile_expression(df.schema, value).alias(name))
    return replace(state, df=df.select(*out))


def with_field(df: DataFrame, path: str, column: Column) -> DataFrame:
    """df with a field set; a dotted path creates or replaces the structs on its way."""
    head, _, rest = path.partition(".")
    if path in df.columns or not rest:
        return df.withColumn(path, column)

    def within(kind: T.DataType | None, old: Column, rest: str) -> Column:
        name, _, deeper = rest.partition(".")
        inner = kind[name].dataType if isinstance(kind, T.StructType) and name in kind.fieldNames() else None
        value = within(inner, old.getField(name) if inner is not None else F.lit(None), deeper) if deeper else column
        if not isinstance(kind, T.StructType):
            return F.struct(value.alias(name))
        fields = {n: old.getField(n) for n in kind.fieldNames()} | {name: value}
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    kind = df.schema[head].dataType if head in df.columns else None
    return df.withColumn(head, within(kind, F.col(f"`{head}`") if kind is not None else F.lit(None), rest))


def _add_fields(state: State, spec: Any) -> State:
    if not isinstance(spec, dict):
        raise InvalidQuery("$addFields takes an object")
    df = state.df
    for path, value in spec.items():  # later ones see earlier ones
        df = with_field(df, path, compile_expression(df.schema, value))
    return replace(state, df=df)


def _unwind_spec(spec: Any) -> tuple[str, bool]:
    path, keep = (spec.get("path"), spec.get("preserveNullAndEmptyArrays", False)) if isinstance(spec, dict) else (spec, False)
    if not isinstance(path, str) or not path.startswith("$"):
        raise InvalidQuery("$unwind takes a field path")
    return path[1:], bool(keep)


def _unwind(state: State, spec: Any) -> State:
    path, keep = _unwind_spec(spec)
    found = values.field(state.df, path)
    if found is None:
        return state if keep else replace(state, df=state.df.where(F.lit(False)))
    column, kind = found
    if isinstance(kind, T.VariantType):
        is_array = F.schema_of_variant(column).startswith("ARRAY")
        elements = F.when(is_array, F.try_variant_get(column, "$", "array<variant>"))
        elements = F.coalesce(elements, F.when(column.isNotNull() & ~F.is_variant_null(column), F.array(column)))
    elif isinstance(kind, T.ArrayType):
        elements = column
    else:  # a value that is no array passes, a missing one is dropped
        return state if keep else replace(state, df=state.df.where(column.isNotNull()))
    names = [c for c in state.df.columns if c != "_element"]
    rows = state.df.select(*(F.col(f"`{c}`") for c in names), (F.explode_outer if keep else F.explode)(elements).alias("_element"))
    return replace(state, df=with_field(rows, path, F.col("_element")).drop("_element"))


def _lookup_spec(spec: Any) -> tuple[str, str, str, str]:
    names = ("from", "localField", "foreignField", "as")
    if not isinstance(spec, dict) or any(not isinstance(spec.get(n), str) for n in names):
        raise InvalidQuery("$lookup takes from, localField, foreignField and as")
    return tuple(spec[n] for n in names)


def _sides(state: State, spec: Any) -> tuple[DataFrame, Column, Column, str]:
    table, local, foreign, name = _lookup_spec(spec)
    if state.tables is None:
        raise InvalidQuery("this pipeline has no other collections to look up")
    right = state.tables(table)
    a, b = values.field(state.df, local), values.field(right, foreign)
    # a field that no row has is missing in all, and a missing value matches nothing
    here, there = a[0] if a else F.lit(None).cast(b[1] if b else "string"), b[0] if b else F.lit(None).cast(a[1] if a else "string")
    if any(x and isinstance(x[1], T.VariantType) for x in (a, b)):  # mixed values match as they compare
        here, there = (F.to_json(values.order_key(c, x[1] if x else T.StringType())) for c, x in ((here, a), (there, b)))
    rows = right.select(there.alias("_foreign"), F.struct(*(F.col(f"`{c}`") for c in right.columns)).alias(name))
    return rows, here, there, name


def _lookup(state: State, spec: Any) -> State:
    rows, local, _, name = _sides(state, spec)
    order = F.array_sort(F.collect_list(name)) if not _has_variant(rows.schema[name].dataType) else F.collect_list(name)
    many = rows.where("_foreign is not null").groupBy("_foreign").agg(order.alias(name))
    left = state.df.drop(name).withColumn("_local", local)
    out = left.join(many, left["_local"] == many["_foreign"], "left").drop("_local", "_foreign")
    empty = F.array().cast(out.schema[name].dataType)
    return replace(state, df=out.withColumn(name, F.coalesce(F.col(f"`{name}`"), empty)))


def _has_variant(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_variant(f.dataType) for f in kind)
    return isinstance(kind, T.VariantType | T.MapType) or (isinstance(kind, T.ArrayType) and _has_variant(kind.elementType))


def _lookup_unwound(state: State, spec: Any, keep: bool) -> State:
    rows, local, _, name = _sides(state, spec)
    left = state.df.drop(name).withColumn("_local", local)
    out = left.join(rows, left["_local"] == rows["_foreign"], "left" if keep else "inner").drop("_local", "_foreign")
    return replace(state, df=out)


def _sorted(state: State, spec: Any, stages: Sequence[Any]) -> State:
    """stages are those that follow. Where the order only matters to a ``$group``, nothing is sorted: its accumulators have it as an argument."""
    pairs = tuple(spec.items() if isinstance(spec, dict) else spec)
    by = sort_columns(state.df, pairs, state.key)
    following = [next(iter(s), "") for s in stages if isinstance(s, dict)]
    unseen = next((op for op in following if op != "$match"), "") in ("$group", "$count")
    return replace(state, df=state.df if unseen else state.df.orderBy(*by), sort=pairs)


def aggregate(df: DataFrame, stages: Sequence[dict[str, Any]], tables: Callable[[str], DataFrame] | None = None, key: Sequence[str] = ("_id",)) -> DataFrame:
    """The result of a pipeline. key names the columns that settle ties of order."""
    if not isinstance(stages, list | tuple):
        raise InvalidQuery("a pipeline is an array of stages")
    state, k = State(df, tuple(key), tables=tables), 0
    while k < len(stages):
        stage = stages[k]
        if not isinstance(stage, dict) or len(stage) != 1:
            raise InvalidQuery("a stage is an object with one operator")
        op, spec = next(iter(stage.items()))
        after = stages[k + 1] if k + 1 < len(stages) and isinstance(stages[k + 1], dict) else {}
        if op == "$lookup" and "$unwind" in after and _unwind_spec(after["$unwind"])[0] == _lookup_spec(spec)[3]:
            state = _lookup_unwound(state, spec, _unwind_spec(after["$unwind"])[1])
            k += 2
            continue
        if op == "$match":
            state = replace(state, df=match(state.df, spec))
        elif op == "$group":
            state = _group(state, spec)
        elif op == "$sort":
            state = _sorted(state, spec, stages[k + 1 :])
        elif op == "$skip":
            state = replace(state, df=state.df.offset(_count_of(spec, op)))
        elif op == "$limit":
            state = replace(state, df=state.df.limit(_count_of(spec, op)))
        elif op == "$project":
            state = _project(state, spec)
        elif op == "$count":
            if not isinstance(spec, str) or not spec:
                raise InvalidQuery("$count takes a name")
            state = replace(state, df=state.df.agg(F.count(F.lit(1)).alias(spec)), sort=())
        elif op == "$unwind":
            state = _unwind(state, spec)
        elif op == "$addFields":
            state = _add_fields(state, spec)
        elif op == "$lookup":
            state = _lookup(state, spec)
        else:
            raise InvalidQuery(f"unknown stage {op}")
        k += 1
    return state.df
