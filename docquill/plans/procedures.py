"""Stored procedures: steps run on the driver, each data step an operator over DataFrames."""

from __future__ import annotations

from typing import Any, Protocol

from docquill.errors import Aborted, InvalidQuery
from docquill.functions.values import NUMBER, TIME, parse_ms, rank_of_literal


class Data(Protocol):
    """What steps need of a database or a transaction."""

    def find(self, collection: str, query: dict, **options: Any) -> list[dict]: ...
    def count(self, collection: str, query: dict) -> int: ...
    def aggregate(self, collection: str, pipeline: list) -> list[dict]: ...
    def insert(self, collection: str, doc: dict) -> Any: ...
    def update(self, collection: str, query: dict, update: dict) -> Any: ...
    def delete(self, collection: str, query: dict) -> Any: ...


class _Return(Exception):
    def __init__(self, value: Any):
        self.value = value


def resolve(value: Any, params: dict[str, Any], names: dict[str, Any]) -> Any:
    """value with ``$param.x`` and ``$name.path`` replaced; keys and unknown names are left alone."""
    if isinstance(value, dict):
        return {k: resolve(v, params, names) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, params, names) for v in value]
    if not isinstance(value, str) or not value.startswith("$"):
        return value
    head, *rest = value[1:].split(".")
    if head == "param":
        found: Any = params
    elif head in names:
        found = names[head]
    else:
        return value
    for part in rest:
        found = found.get(part) if isinstance(found, dict) else None
    return found


def _order(v: Any) -> tuple:
    rank = rank_of_literal(v)
    if rank == TIME:
        return rank, parse_ms(v) if isinstance(v, str) else v
    return (rank, float(v)) if rank in (NUMBER, 1) else (rank, str(v))


def holds(condition: Any, params: dict[str, Any], names: dict[str, Any]) -> bool:
    """A condition, bare or within ``$expr``: comparisons of two values, $and, $or, $not, or a truth value."""
    if isinstance(condition, dict) and len(condition) == 1:
        op, args = next(iter(condition.items()))
        if op == "$expr":
            return holds(args, params, names)
        if op in ("$and", "$or"):
            return (all if op == "$and" else any)(holds(c, params, names) for c in args)
        if op == "$not":
            return not holds(args[0] if isinstance(args, list) else args, params, names)
        if op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte"):
            if not isinstance(args, list) or len(args) != 2:
                raise InvalidQuery(f"{op} compares two values")
            a, b = (_order(resolve(x, params, names)) for x in args)
            return {"$eq": a == b, "$ne": a != b, "$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op]
        raise InvalidQuery(f"unknown condition {op}")
    return bool(resolve(condition, params, names))


def run(steps: list[dict[str, Any]], params: dict[str, Any], db: Data) -> Any:
    """The value of the return step, None without one; an abort step raises Aborted."""
    names: dict[str, Any] = {}

    def walk(steps: list[dict[str, Any]]) -> None:
        for step in steps:
            kind = step.get("step") or step.get("type")
            get = lambda k, step=step: resolve(step.get(k), params, names)
            if kind == "find":
                out = db.find(step["collection"], get("query") or {}, **{k: get(k) for k in ("sort", "skip", "limit") if k in step})
            elif kind == "find_one":
                out = next(iter(db.find(step["collection"], get("query") or {}, limit=1)), None)
            elif kind == "count":
                out = db.count(step["collection"], get("query") or {})
            elif kind == "aggregate":
                out = db.aggregate(step["collection"], step["pipeline"] if "pipeline" in step else step["stages"])
            elif kind == "insert":
                out = db.insert(step["collection"], get("doc") if "doc" in step else get("document"))
            elif kind == "update":
                out = db.update(step["collection"], get("query") or {}, get("update"))
            elif kind == "delete":
                out = db.delete(step["collection"], get("query") or {})
            elif kind == "set":
                names[step.get("name") or step.get("var") or step.get("as")] = get("value")
                continue
            elif kind == "if":
                walk(step.get("then", []) if holds(step.get("condition"), params, names) else step.get("else", []))
                continue
            elif kind == "abort":
                raise Aborted(str(get("message") or "aborted"))
            elif kind == "return":
                raise _Return(get("value"))
            else:
                raise InvalidQuery(f"unknown step {kind}")
            if "as" in step:
                names[step["as"]] = out

    try:
        walk(steps)
    except _Return as r:
        return r.value
    return None
