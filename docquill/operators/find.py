"""find and its relatives: filter, sort, skip, limit in that order."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame

from docquill.errors import InvalidQuery
from docquill.functions import values
from docquill.operators.filters import match


def sort_columns(df: DataFrame, sort: dict[str, int] | Sequence[tuple[str, int]] | None, key: Sequence[str] = ()) -> list[Column]:
    """Sort expressions: missing first when ascending, last when descending; key columns settle ties."""
    pairs = list(sort.items() if isinstance(sort, dict) else sort or ())
    out = []
    for path, direction in pairs:
        if direction not in (1, -1) or isinstance(direction, bool):
            raise InvalidQuery("a sort direction is 1 or -1")
        found = values.field(df, path)
        if found:
            column = values.order_key(*found)
            out.append(column.asc_nulls_first() if direction == 1 else column.desc_nulls_last())
    named = {p for p, _ in pairs}
    return out + [df[f"`{k}`"].asc_nulls_first() for k in key if k in df.columns and k not in named]


def find(
    df: DataFrame, query: dict[str, Any] | None = None, sort: dict[str, int] | Sequence[tuple[str, int]] | None = None, skip: int | None = None, limit: int | None = None,
    key: Sequence[str] = ("_id",),
) -> DataFrame:
    """Rows that match, ordered and cut. A limit with a sort becomes a top-k, never a full sort."""
    for name, n in (("skip", skip), ("limit", limit)):
        if n is not None and (not isinstance(n, int) or isinstance(n, bool) or n < 0):
            raise InvalidQuery(f"{name} is a count")
    out = match(df, query)
    if sort or ((skip or limit is not None) and any(k in df.columns for k in key)):
        out = out.orderBy(*sort_columns(out, sort, key))
    if skip:
        out = out.offset(skip)
    return out if limit is None else out.limit(limit)


def find_one(df: DataFrame, query: dict[str, Any] | None = None, key: Sequence[str] = ("_id",)) -> DataFrame:
    return find(df, query, limit=1, key=key)


def count(df: DataFrame, query: dict[str, Any] | None = None) -> int:
    return match(df, query).count()
