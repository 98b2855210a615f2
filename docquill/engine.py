"""The database object: collections, queries, SQL, transactions, search, objects, procedures, schedules.

Methods whose name ends in ``_df`` return DataFrames for work at scale; the others return Python values,
as a client of a document database expects, and collect their result.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.errors import DocquillError, InvalidQuery, TransactionConflict
from docquill.operators import find as finds
from docquill.operators.filters import match
from docquill.operators.pipeline import aggregate
from docquill.operators.search import METRICS, search_cells, search_index, vector_search
from docquill.plans import procedures, schedules, sql
from docquill.sources.blobs import BlobStore
from docquill.sources.collections import RETAIN, RETRIES, Collection, Draft, Files, Manifest
from docquill.streaming.changes import changes, watch, watch_all

PROCEDURES, SCHEDULES = "_procedures.json", "_schedules.json"
#: So many ids at most are listed in a filter; more are joined.
LISTED = 1_000


def plain(value: Any) -> Any:
    """JSON-like Python values of a row; missing fields are left out."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items() if v is not None}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value.toPython() if type(value).__name__ == "VariantVal" else value


class Transaction:
    """Writes wait for commit; commit fails if a row that was read, or that a write had matched, changed meanwhile.

    Writers of other rows don't matter: the changes are drafted again on top of theirs.
    """

    def __init__(self, engine: Engine, tx_id: str):
        self.engine, self.id, self.ops = engine, tx_id, []
        self.docs: dict[str, dict[int, int]] = {}  # versions of rows that a client got
        self.matched: list[tuple[str, Manifest, dict[str, Any]]] = []  # what writes matched, as of a version

    def insert(self, collection: str, doc: dict[str, Any]) -> None:
        self.ops.append(("insert", collection, [doc]))

    def insert_many(self, collection: str, docs: list[dict[str, Any]]) -> None:
        self.ops.append(("insert", collection, list(docs)))

    def find(self, collection: str, query: dict[str, Any] | None = None, **options: Any) -> list[dict[str, Any]]:
        docs = self.engine.find(collection, query, **options)
        own = self.docs.setdefault(collection, {})
        for d in docs:
            own.setdefault(d["_id"], d["_version"])
        return docs

    def count(self, collection: str, query: dict[str, Any] | None = None) -> int:
        return self.engine.count(collection, query)

    def aggregate(self, collection: str, pipeline: list[dict[str, Any]]) -> list[dict[str, Any]]:
        return self.engine.aggregate(collection, pipeline)

    def update(self, collection: str, query: dict[str, Any], update: dict[str, Any]) -> None:
        self.matched.append((collection, self.engine.collection(collection).manifest(), query))
        self.ops.append(("update", collection, query, update))

    def delete(self, collection: str, query: dict[str, Any]) -> None:
        self.matched.append((collection, self.engine.collection(collection).manifest(), query))
        self.ops.append(("delete", collection, query))

    def _validate(self, draft: Draft) -> None:
        """Rows read before must have the same version in the draft's base."""
        own, now = draft.own, draft.read().select("_id", "_version")
        lost = []
        if self.docs.get(own.name):
            lost.append(own.spark.createDataFrame(list(self.docs[own.name].items()), "_id bigint, _version bigint"))
        for name, then, query in self.matched:
            if name == own.name and then.version != draft.base.version:
                lost.append(match(own.read(then), query).select("_id", "_version"))
        if any(not rows.join(now, ["_id", "_version"], "left_anti").isEmpty() for rows in lost):
            raise TransactionConflict(f"rows of {own.name} were changed meanwhile")

    def _publish(self, drafts: list[Draft]) -> bool:
        if len(drafts) == 1:
            return drafts[0].own.publish(drafts[0])
        record = f"{self.id}-{uuid.uuid4().hex}"
        records = drafts[0].own.records
        try:
            if all(d.own.publish(d, record) for d in drafts) and records.create(b"committed", record):
                for d in drafts:
                    d.own.reveal(d.m)
                return True
        except BaseException:
            records.create(b"aborted", record)
            raise
        records.create(b"aborted", record)
        return False

    def commit(self) -> None:
        ops, self.ops = self.ops, []
        names = sorted({op[1] for op in ops} | set(self.docs)) if ops else []
        for _ in range(RETRIES):
            drafts: dict[str, Draft] = {}
            try:
                for name in names:
                    drafts[name] = Draft(self.engine.collection(name), self.id)
                    self._validate(drafts[name])
                for op, name, *args in ops:
                    getattr(drafts[name], op)(*args)
                # collections that were only read take part too, so that nobody changes them in between
                if all(d.m == d.base for d in drafts.values()) or self._publish(list(drafts.values())):
                    return
            except BaseException:
                for d in drafts.values():
                    d.discard()
                raise
            for d in drafts.values():
                d.discard()
        raise TransactionConflict(f"{', '.join(names)} were changed meanwhile, {RETRIES} times")

    def rollback(self) -> None:
        self.ops, self.docs, self.matched = [], {}, []


class Engine:
    """A database below one folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.files.make()
        self.blobs = BlobStore(spark, self.root)

    # --- collections ---

    def collection(self, name: str) -> Collection:
        if not name or "/" in name:
            raise DocquillError("a collection's name is a plain word")
        return Collection(self.spark, self.root, name)

    def create_collection(self, name: str) -> None:
        if self.files.exists(name):
            raise DocquillError(f"collection {name} exists")
        self.files.make(name)

    def list_collections(self) -> list[str]:
        return [n for n in self.files.names() if not n.startswith(("_", "."))]

    def drop_collection(self, name: str) -> None:
        self.files.remove(name)

    def compact(self, name: str, retain: float = RETAIN) -> dict[str, int]:
        return self.collection(name).compact(retain)

    def backup(self, target: str) -> None:
        out = Files(self.spark, target)
        if out.exists():
            raise DocquillError("the backup's folder exists")
        self.files.copy(self.root, target)

    @classmethod
    def restore(cls, spark: SparkSession, source: str, root: str) -> Engine:
        there = Files(spark, root)
        if there.exists() and there.names():
            raise DocquillError("the folder to restore to isn't empty")
        there.remove()
        there.copy(source, root)
        return cls(spark, root)

    # --- rows ---

    def table(self, name: str) -> DataFrame:
        return self.collection(name).read()

    def insert(self, name: str, doc: dict[str, Any]) -> int:
        return self.collection(name).insert([doc])[0]

    def insert_many(self, name: str, docs: Sequence[dict[str, Any]]) -> list[int]:
        return self.collection(name).insert(docs)

    def append_df(self, name: str, df: DataFrame) -> None:
        self.collection(name).insert(df)

    def find_df(self, name: str, query: dict[str, Any] | None = None, sort: Any = None, skip: int | None = None, limit: int | None = None) -> DataFrame:
        return finds.find(self.table(name), query, sort, skip, limit)

    def find(self, name: str, query: dict[str, Any] | None = None, sort: Any = None, skip: int | None = None, limit: int | None = None) -> list[dict[str, Any]]:
        return [plain(r) for r in self.find_df(name, query, sort, skip, limit).collect()]

    def find_one(self, name: str, query: dict[str, Any] | None = None) -> dict[str, Any] | None:
        return next(iter(self.find(name, query, limit=1)), None)

    def get(self, name: str, doc_id: int) -> dict[str, Any] | None:
        return self.find_one(name, {"_id": doc_id})

    def count(self, name: str, query: dict[str, Any] | None = None) -> int:
        return match(self.table(name), query).count()

    def update(self, name: str, query: dict[str, Any], update: dict[str, Any]) -> int:
        return self.collection(name).update(query, update)

    def update_one(self, name: str, query: dict[str, Any], update: dict[str, Any]) -> int:
        return self.collection(name).update(query, update, limit=1)

    def delete(self, name: str, query: dict[str, Any]) -> int:
        return self.collection(name).delete(query)

    def delete_one(self, name: str, query: dict[str, Any]) -> int:
        return self.collection(name).delete(query, limit=1)

    def aggregate_df(self, name: str, pipeline: list[dict[str, Any]]) -> DataFrame:
        return aggregate(self.table(name), pipeline, self.table)

    def aggregate(self, name: str, pipeline: list[dict[str, Any]]) -> list[dict[str, Any]]:
        return [plain(r) for r in self.aggregate_df(name, pipeline).collect()]

    # --- indexes: uniqueness is enforced; other entries tell what is searchable, scans prune by statistics ---

    def create_index(self, name: str, field: str) -> str:
        return self.collection(name).add_index("field", [field])

    def create_unique_index(self, name: str, field: str) -> str:
        return self.collection(name).add_index("field", [field], unique=True)

    def create_composite_index(self, name: str, fields: Sequence[str]) -> str:
        return self.collection(name).add_index("composite", fields)

    def create_text_index(self, name: str, fields: Sequence[str]) -> str:
        return self.collection(name).add_index("text", fields)

    def create_vector_index(self, name: str, field: str, dimension: int, metric: str = "cosine") -> str:
        if metric not in METRICS:
            raise InvalidQuery(f"unknown metric {metric}")
        return self.collection(name).add_index("vector", [field], dimension=dimension, metric=metric)

    def list_indexes(self, name: str) -> list[dict[str, Any]]:
        return [{k: v for k, v in i.items() if k != "centres"} for i in self.collection(name).manifest().indexes]

    def drop_index(self, name: str, index: str) -> None:
        self.collection(name).drop_index(index)

    def _text_hits(self, name: str, query: str, limit: int | None) -> tuple[DataFrame, DataFrame]:
        """(_id, _score) of the best rows, and all rows of the same version."""
        index = next((i for i in self.list_indexes(name) if i["index_type"] == "text"), None)
        if index is None:
            raise InvalidQuery(f"{name} has no text index")
        own = self.collection(name)
        m = own.manifest()
        return search_index(*own.postings(m), query, limit), own.read(m)

    def text_search_df(self, name: str, query: str, limit: int | None = None) -> DataFrame:
        """The rows with a word of a query and their ``_score``, the best first; without a limit all of them."""
        best, rows = self._text_hits(name, query, limit)
        return rows.join(best, "_id").orderBy(F.col("_score").desc(), "_id")

    def text_search(self, name: str, query: str, limit: int = 10) -> list[dict[str, Any]]:
        if limit > LISTED:
            return [plain(r) for r in self.text_search_df(name, query, limit).collect()]
        hits, rows = self._text_hits(name, query, limit)
        best = {r._id: r._score for r in hits.collect()}  # limit rows
        found = [plain(r) for r in rows.where(F.col("_id").isin(list(best))).collect()] if best else []
        return sorted(({**r, "_score": best[r["_id"]]} for r in found), key=lambda r: (-r["_score"], r["_id"]))

    def vector_search(self, name: str, field: str, vector: Sequence[float], limit: int = 10, ef_search: int | None = None) -> list[dict[str, Any]]:
        """The nearest rows, exactly; with ef_search only those in as many cells of the index, which may miss some."""
        index = next((i for i in self.collection(name).manifest().indexes if i["index_type"] == "vector" and i["fields"] == [field]), None)
        if index is None:
            raise InvalidQuery(f"{name} has no vector index on {field}")
        own = self.collection(name)
        m = own.manifest()
        cells, metric = own.cells(index, m), index["metric"]
        if cells is None:  # rows came before there were any to fit cells to: compact() fits them
            return [plain(r) for r in vector_search(own.read(m), field, vector, limit, metric, dimension=index["dimension"]).collect()]
        if len(vector) != index["dimension"]:
            raise InvalidQuery(f"the vector has {len(vector)} numbers, the index {index['dimension']}")
        best = dict(search_cells(cells[0], index["centres"], cells[1], vector, limit, metric, ef_search))  # limit rows
        rows = {r["_id"]: r for r in (plain(x) for x in own.read(m).where(F.col("_id").isin(list(best))).collect())} if best else {}
        near = {"cosine": lambda x: 1 - x / 2, "euclidean": lambda x: 1 / (1 + x), "dot_product": lambda x: 1 / (1 + math.exp(min(x, 700)))}[metric]
        return [{**rows[i], "_distance": d, "_similarity": near(d)} for i, d in best.items()]

    # --- SQL ---

    def sql_df(self, text: str) -> DataFrame:
        return sql.select(self.spark, text, self.table)

    def sql(self, text: str) -> Any:
        """Rows of a query, ``{ids}``, ``{modified}`` or ``{deleted}`` of a write, a message of other statements."""
        s = sql.parse(text)
        if s.kind == "select":
            return [plain(r) for r in self.sql_df(text).collect()]
        if s.kind == "insert":
            # a NULL of SQL is a missing field, as IS NULL asks for one
            docs = [{c: v for c, v in zip(s.columns, row, strict=True) if v is not None} for row in s.rows]
            return {"ids": self.insert_many(s.table, docs)}
        if s.kind in ("update", "delete"):
            where = F.expr(s.where) if s.where else F.lit(True)
            if s.kind == "delete":
                return {"deleted": self.collection(s.table).delete(where)}

            def assign(df: DataFrame, when: Any) -> DataFrame:
                fresh = {c: F.expr(e) for c, e in s.assignments}  # all see the row as it was
                kept = {c: F.col(f"`{c}`") if c in df.columns else F.lit(None) for c in fresh}
                return df.withColumns({c: F.when(when, e).otherwise(kept[c]) for c, e in fresh.items()})

            return {"modified": self.collection(s.table).update(where, assign, touched={c for c, _ in s.assignments})}
        if s.kind == "create_table":
            self.create_collection(s.table)
        elif s.kind == "drop_table":
            self.drop_collection(s.table)
        elif s.kind in ("create_index", "create_unique_index"):
            kind = "field" if len(s.columns) == 1 else "composite"
            self.collection(s.table).add_index(kind, s.columns, unique=s.kind == "create_unique_index")
        else:
            return [{"table": n} for n in self.list_collections()]
        return "ok"

    # --- transactions ---

    def begin_tx(self) -> Transaction:
        return Transaction(self, f"tx-{uuid.uuid4().hex}")

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        tx = self.begin_tx()
        try:
            yield tx
        except BaseException:
            tx.rollback()
            raise
        tx.commit()

    # --- change streams ---

    def watch(self, name: str | None = None, resume_after: int | dict[str, int] | None = None) -> DataFrame:
        """Events of one collection, or of all, those to come included; then resume_after has a token for each."""
        if name is None:
            return watch_all(self.spark, self.root, {n: self.collection(n) for n in self.list_collections()}, resume_after)
        return watch(self.collection(name), resume_after)

    def changes(self, name: str, after: int = 0) -> DataFrame:
        return changes(self.collection(name), after)

    # --- objects ---

    def __getattr__(self, name: str) -> Any:
        if name in ("create_bucket", "list_buckets", "delete_bucket", "put_object", "get_object", "head_object", "delete_object", "list_objects"):
            return getattr(self.blobs, name)
        raise AttributeError(name)

    def search(self, query: str, bucket: str | None = None, limit: int = 10) -> list[dict[str, Any]]:
        return [plain(r) for r in self.blobs.search(query, bucket, limit).collect()]

    # --- procedures and schedules ---

    def _stored(self, name: str) -> dict[str, Any]:
        return json.loads(self.files.read(name)) if self.files.exists(name) else {}

    def _store(self, name: str, entries: dict[str, Any]) -> None:
        self.files.put(json.dumps(entries).encode(), name)

    def create_procedure(self, name: str, definition: dict[str, Any]) -> None:
        if not isinstance(definition.get("steps"), list):
            raise InvalidQuery("a procedure has steps")
        self._store(PROCEDURES, self._stored(PROCEDURES) | {name: {**definition, "name": name}})

    def list_procedures(self) -> list[str]:
        return sorted(self._stored(PROCEDURES))

    def get_procedure(self, name: str) -> dict[str, Any]:
        found = self._stored(PROCEDURES).get(name)
        if found is None:
            raise DocquillError(f"no procedure {name}")
        return found

    def delete_procedure(self, name: str) -> None:
        self.get_procedure(name)
        self._store(PROCEDURES, {k: v for k, v in self._stored(PROCEDURES).items() if k != name})

    def call_procedure(self, name: str, params: dict[str, Any] | None = None) -> Any:
        """Runs in one transaction: a return commits, an abort or error leaves everything as it was."""
        definition = self.get_procedure(name)
        with self.transaction() as tx:
            return procedures.run(definition["steps"], params or {}, tx)

    def create_schedule(self, name: str, procedure: str, cron: str | None = None, every: str | None = None, params: dict[str, Any] | None = None, enabled: bool = True) -> None:
        self.get_procedure(procedure)
        entry = schedules.validated({"name": name, "procedure": procedure, "cron": cron, "every": every, "params": params or {}, "enabled": enabled})
        entry |= {"last_run": None, "last_status": None, "last_error": None, "run_count": 0}
        self._store(SCHEDULES, self._stored(SCHEDULES) | {name: entry})

    def list_schedules(self) -> list[dict[str, Any]]:
        return [v for _, v in sorted(self._stored(SCHEDULES).items())]

    def get_schedule(self, name: str) -> dict[str, Any]:
        found = self._stored(SCHEDULES).get(name)
        if found is None:
            raise DocquillError(f"no schedule {name}")
        return found

    def delete_schedule(self, name: str) -> None:
        self.get_schedule(name)
        self._store(SCHEDULES, {k: v for k, v in self._stored(SCHEDULES).items() if k != name})

    def _enabled(self, name: str, on: bool) -> None:
        self._store(SCHEDULES, self._stored(SCHEDULES) | {name: {**self.get_schedule(name), "enabled": on}})

    def enable_schedule(self, name: str) -> None:
        self._enabled(name, True)

    def disable_schedule(self, name: str) -> None:
        self._enabled(name, False)

    def run_schedule(self, entry: dict[str, Any]) -> None:
        """Calls the procedure and notes how it went."""
        now, error = datetime.now(timezone.utc).isoformat(), None
        try:
            self.call_procedure(entry["procedure"], entry["params"])
        except Exception as e:  # noqa: BLE001 - a schedule goes on after a failure, which it records
            error = str(e)
        done = {**self.get_schedule(entry["name"]), "last_run": now, "last_status": "error" if error else "ok", "last_error": error}
        self._store(SCHEDULES, self._stored(SCHEDULES) | {entry["name"]: {**done, "run_count": done["run_count"] + 1}})

    def scheduler(self, tick: float = 1.0) -> schedules.Scheduler:
        return schedules.Scheduler(self.list_schedules, self.run_schedule, tick)
