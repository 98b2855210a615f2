"""Versioned collections: Parquet folders under a manifest, replaced in one step.

A change is drafted against one version: its data, postings and change events go to folders with names of
their own, which nobody reads yet. One new manifest ``m-<n>.json`` that must not exist yet names them; that
write is the commit. Who comes second drops its folders, and tries again on the new version. Readers take
the newest committed manifest. Change events lie in a hidden folder until the commit, then they are moved to
where streams look.

A transaction over several collections publishes a manifest in each that names the transaction, then one
record that says ``committed``. Readers pass over manifests whose transaction has no such record, so either
all of its changes are seen or none.

Appends add a folder; updates and deletes replace the folders that hold rows they match.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquill.errors import DocquillError, TransactionConflict, UniqueViolation
from docquill.functions import values
from docquill.operators.filters import compile_filter
from docquill.operators.search import cell_index, row_postings, train_cells
from docquill.operators.updates import apply_update, touched_by

CHANGES = "token bigint, operation string, collection string, doc_id bigint, document string, tx_id string"
POSTINGS = "term string, _id bigint, tf bigint, doc_len int"
CELLS = "cell int, away double, _id bigint, vec array<double>"
RETRIES, PATIENCE, RETAIN = 10, 10.0, 86_400.0


class Files:
    """The few file operations that a catalog needs, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def fs(self):
        return self.path().getFileSystem(self.conf)

    def _listed(self, *parts: str) -> list[Any]:
        where = self.path(*parts)
        return list(self.fs().listStatus(where)) if self.fs().exists(where) else []

    def names(self, *parts: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._listed(*parts))

    def times(self, *parts: str) -> dict[str, float]:
        """When each entry was last written, in seconds."""
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self._listed(*parts)}

    def read(self, *parts: str) -> bytes:
        stream = self.fs().open(self.path(*parts))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, data: bytes, *parts: str) -> bool:
        """Writes a file that must not exist yet, whole or not at all; False where it exists.

        Of several writers at once one wins: object stores get a conditional put, local files an
        exclusive link, all others a rename, which there never replaces a file.
        """
        target, fs = self.path(*parts), self.fs()
        scheme = fs.getScheme()
        if scheme in ("s3a", "gs"):
            builder = fs.createFile(target).overwrite(False)
            if scheme == "s3a":
                builder = builder.must("fs.option.create.conditional.overwrite", True)
            try:
                stream = builder.build()
                stream.write(bytearray(data))
                stream.close()
            except Py4JJavaError as e:
                if "Exist" in e.java_exception.getClass().getName() or "412" in str(e.java_exception.getMessage()):
                    return False
                raise
            return True
        part = self.path(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}")
        stream = fs.create(part, False)
        stream.write(bytearray(data))
        stream.close()
        try:
            if scheme == "file":
                os.link(part.toUri().getPath(), target.toUri().getPath())
                return True
            return not fs.exists(target) and bool(fs.rename(part, target))
        except FileExistsError:
            return False
        finally:
            fs.delete(part, False)

    def put(self, data: bytes, *parts: str) -> None:
        stream = self.fs().create(self.path(*parts), True)
        stream.write(bytearray(data))
        stream.close()

    def move(self, source: str, target: str) -> None:
        """Renames a folder; nothing happens where it was renamed already."""
        if self.exists(source) and not self.exists(target):
            try:
                self.fs().rename(self.path(source), self.path(target))
            except Py4JJavaError:
                if not self.exists(target):
                    raise

    def exists(self, *parts: str) -> bool:
        return self.fs().exists(self.path(*parts))

    def size(self, *parts: str) -> int:
        return self.fs().getContentSummary(self.path(*parts)).getLength() if self.exists(*parts) else 0

    def make(self, *parts: str) -> None:
        self.fs().mkdirs(self.path(*parts))

    def remove(self, *parts: str) -> None:
        self.fs().delete(self.path(*parts), True)

    def copy(self, source: str, target: str) -> None:
        a, b = (self.jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(self.conf), a, b.getFileSystem(self.conf), b, False, self.conf)


@dataclass(frozen=True)
class Manifest:
    """postings: for each data folder, with a text index, its folder of postings and its number of rows with a token.
    vectors: for each vector index and data folder, its folder of cells and the radius of each cell."""

    version: int = 0
    schema: str = ""
    folders: tuple[str, ...] = ()
    next_id: int = 1
    token: int = 0
    first_token: int = 1
    changes: tuple[str, ...] = ()
    indexes: tuple[dict[str, Any], ...] = ()
    postings: dict[str, list[Any]] = field(default_factory=dict)
    vectors: dict[str, dict[str, list[Any]]] = field(default_factory=dict)
    tx: str | None = None

    def named(self) -> set[str]:
        return {*self.folders, *self.changes, *(p for p, _ in self.postings.values()), *(v for own in self.vectors.values() for v, _ in own.values())}


def _type_of(value: Any) -> T.DataType | None:
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType() if -(1 << 63) <= value < 1 << 63 else T.DoubleType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, list):
        item: T.DataType | None = None
        for v in value:
            item = merge_types(item, None if v is None else _type_of(v))  # arrays of any type hold nulls
        return T.ArrayType(item or T.StringType())
    if isinstance(value, dict):
        return T.StructType([T.StructField(k, _type_of(v)) for k, v in value.items()])
    raise DocquillError(f"not a JSON value: {type(value).__name__}")


def merge_types(a: T.DataType | None, b: T.DataType | None) -> T.DataType | None:
    """A type for values of both; values of different kinds, or an explicit null beside others, share only VARIANT."""
    if a is None or b is None or a == b:
        return b if a is None else a
    if values.is_number(a) and values.is_number(b):
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merge_types(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = list(dict.fromkeys([*a.fieldNames(), *b.fieldNames()]))
        pick = lambda s, n: s[n].dataType if n in s.fieldNames() else None
        return T.StructType([T.StructField(n, merge_types(pick(a, n), pick(b, n))) for n in names])
    return T.VariantType()


def storable(kind: T.DataType) -> T.DataType:
    """A type for Parquet: what held nothing but explicit nulls, or empty objects, is VARIANT."""
    if isinstance(kind, T.NullType) or (isinstance(kind, T.StructType) and not kind.fields):
        return T.VariantType()
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, storable(f.dataType)) for f in kind])
    return T.ArrayType(storable(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def convert(column: Column, old: T.DataType, new: T.DataType) -> Column:
    if old == new:
        return column
    if isinstance(old, T.NullType):
        return F.lit(None).cast(new)
    if isinstance(new, T.VariantType):
        return F.parse_json(F.to_json(column)) if isinstance(old, T.StructType | T.ArrayType | T.MapType) else column.cast("variant")
    if isinstance(old, T.StructType | T.ArrayType):
        return F.from_json(F.to_json(column), new)
    return column.cast(new)


def numbered(df: DataFrame, name: str, first: int, folder: str) -> DataFrame:
    """df with consecutive numbers from ``first`` in a column, in the order of its partitions.

    The rows are written once with Spark's own row ids, so that numbers don't change when a task is repeated;
    the count of each partition then gives the gaps to close.
    """
    save(df.withColumn("_at", F.monotonically_increasing_id()), folder)
    rows = df.sparkSession.read.parquet(folder)
    part = F.shiftright("_at", 33).alias("_part")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # a row per partition
    out = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.lit(first) + F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def save(df: DataFrame, folder: str) -> None:
    """Texts and postings are what takes most of the disk, several versions of them; zstd makes them smaller than Spark's default."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)


def _json_row(df: DataFrame) -> Column:
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))


class Draft:
    """Changes of one collection on top of one version; ``m`` is the manifest that publishing would make current."""

    def __init__(self, own: Collection, tx_id: str | None = None):
        self.own, self.spark, self.tx_id, self.made = own, own.spark, tx_id, []
        self.base, self.top = own.settled()
        self.m = self.base

    def _path(self, folder: str) -> str:
        return f"{self.own.files.root}/{folder}"

    def _new(self, kind: str) -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        self.made.append(folder)
        return folder

    def discard(self) -> None:
        for folder in self.made:
            self.own.files.remove(folder)
            self.own.files.remove(f".{folder}")
        self.made = []

    def read(self) -> DataFrame:
        return self.own.read(self.m)

    def _write(self, rows: DataFrame) -> str:
        """A new data folder, with its postings where there is a text index."""
        folder = self._new("d")
        save(rows, self._path(folder))
        self._index(folder, rows.schema)
        for index in self.m.indexes:
            if index["index_type"] == "vector":
                self._place(folder, rows.schema, index)
        return folder

    def _index(self, folder: str, schema: T.StructType) -> None:
        index = next((i for i in self.m.indexes if i["index_type"] == "text"), None)
        if index is None:
            return
        rows = self.spark.read.schema(schema).parquet(self._path(folder))
        name = self._new("p")
        # each file in order of terms, so that a search reads few pages of it
        save(row_postings(rows, index["fields"], ["_id"]).select("term", "_id", "tf", "doc_len").sortWithinPartitions("term"), self._path(name))
        n = self.spark.read.schema(POSTINGS).parquet(self._path(name)).agg(F.count_distinct("_id")).first()[0]
        self.m = replace(self.m, postings={**self.m.postings, folder: [name, n]})

    def _place(self, folder: str, schema: T.StructType, index: dict[str, Any]) -> None:
        """The cells of a vector index for a data folder, in their order, so that a search reads few row groups."""
        if not index.get("centres"):
            return
        rows = self.spark.read.schema(schema).parquet(self._path(folder))
        name = self._new("v")
        found = cell_index(rows, index["fields"][0], index["dimension"], index["metric"], index["centres"])
        save(found.repartitionByRange("cell", "_id").sortWithinPartitions("cell"), self._path(name))
        radius = self.spark.read.schema(CELLS).parquet(self._path(name)).groupBy("cell").agg(F.max("away").alias("r")).collect()  # a row per cell
        own = {**self.m.vectors.get(index["name"], {}), folder: [name, {str(r.cell): r.r for r in radius}]}
        self.m = replace(self.m, vectors={**self.m.vectors, index["name"]: own})

    def _train(self) -> None:
        """Fits the centres of vector indexes to the rows there are, and places all rows anew."""
        for k, index in enumerate(self.m.indexes):
            if index["index_type"] == "vector":
                fresh = {**index, "centres": train_cells(self.read(), index["fields"][0], index["dimension"], index["metric"])}
                vectors = {n: v for n, v in self.m.vectors.items() if n != index["name"]}
                self.m = replace(self.m, indexes=(*self.m.indexes[:k], fresh, *self.m.indexes[k + 1 :]), vectors=vectors)
                for folder in self.m.folders:
                    self._place(folder, self.own.schema(self.m), fresh)

    def _forget(self, folders: Sequence[str]) -> None:
        left = lambda d: {k: v for k, v in d.items() if k not in folders}
        self.m = replace(self.m, folders=tuple(f for f in self.m.folders if f not in folders), postings=left(self.m.postings), vectors={n: left(d) for n, d in self.m.vectors.items()})

    def _events(self, operation: str, rows: DataFrame, ready: bool = False) -> int:
        """Writes the change events of rows (doc_id, document, with ready also token); returns their number."""
        folder = self._new("c")
        events = rows if ready else numbered(rows, "token", self.m.token + 1, self._path(f".t-{folder}"))
        events = events.select("token", F.lit(operation).alias("operation"), F.lit(self.own.name).alias("collection"), "doc_id", "document", F.lit(self.tx_id).cast("string").alias("tx_id"))
        save(events, self._path(f".{folder}"))
        self.own.files.remove(f".t-{folder}")
        n = self.spark.read.schema(CHANGES).parquet(self._path(f".{folder}")).count()
        self.m = replace(self.m, token=self.m.token + n, changes=(*self.m.changes, folder))
        return n

    def insert(self, docs: Sequence[dict[str, Any]] | DataFrame) -> list[int]:
        m, own = self.m, self.own
        plain = T.StructType([f for f in own.schema(m) if f.name not in ("_id", "_version")])
        if isinstance(docs, DataFrame):
            fresh, ids = docs.drop("_id", "_version", *(f.name for f in docs.schema if isinstance(f.dataType, T.NullType))), None
            schema = merge_types(plain, fresh.schema)
        else:
            if any(not isinstance(d, dict) for d in docs):
                raise DocquillError("a document is an object")
            if not docs:
                return []
            docs = [{k: v for k, v in d.items() if k not in ("_id", "_version")} for d in docs]
            ids, schema = list(range(m.next_id, m.next_id + len(docs))), plain
            for d in docs:
                schema = merge_types(schema, _type_of(d))
        full = storable(T.StructType([T.StructField("_id", T.LongType()), T.StructField("_version", T.LongType()), *schema.fields]))
        staged = None
        if ids is None:
            staged = f".t-{uuid.uuid4().hex}"
            rows = numbered(fresh, "_id", m.next_id, self._path(staged)).withColumn("_version", F.lit(1).cast("bigint"))
        else:
            rows = own._rows([{"_id": i, "_version": 1, **d} for i, d in zip(ids, docs, strict=True)], full)
        rows = own._as(rows, full)
        rewrite = any(full[f.name].dataType != f.dataType for f in own.schema(m))
        before = own._as(own.read(m), full)
        self._check_new(before, rows)
        old = m.folders
        self.m = replace(m, schema=json.dumps(full.jsonValue()))
        if rewrite and old:  # a field changed its type: all folders are written anew
            again = self._write(before)
            self._forget(old)
            self.m = replace(self.m, folders=(again,))
        folder = self._write(rows)
        self.m = replace(self.m, folders=(*self.m.folders, folder))
        added = self.spark.read.schema(full).parquet(self._path(folder))
        if staged:
            own.files.remove(staged)
        # ids are consecutive, so tokens follow from them
        token = (F.col("_id") - m.next_id + m.token + 1).alias("token")
        n = self._events("insert", added.select(token, F.col("_id").alias("doc_id"), _json_row(added).alias("document")), ready=True)
        self.m = replace(self.m, next_id=m.next_id + n)
        return ids if ids is not None else []

    def _unique(self) -> list[dict[str, Any]]:
        return [i for i in self.m.indexes if i["unique"]]

    def _keys(self, df: DataFrame, index: dict[str, Any]) -> DataFrame | None:
        """The keys of the rows that have all fields of an index; None where no row can."""
        found = [values.field(df, f) for f in index["fields"]]
        if not all(found):
            return None
        for column, _ in found:
            df = df.where(column.isNotNull())
        return df.select(*(values.sort_key(*x).alias(f"k{n}") for n, x in enumerate(found)))

    def _twice(self, keys: DataFrame | None) -> bool:
        return keys is not None and not keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()

    def _check_new(self, before: DataFrame, rows: DataFrame) -> None:
        """Unique indexes against rows to add: only their keys are counted and looked up."""
        for index in self._unique():
            new = self._keys(rows, index)
            if new is None:
                continue
            there = self._keys(before, index)
            same = [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in new.columns]
            if self._twice(new) or (there is not None and not there.alias("old").join(new.alias("new"), same, "left_semi").isEmpty()):
                raise UniqueViolation(f"{self.own.name}: {index['name']}")

    def check_all(self, df: DataFrame, touched: set[str] | None = None) -> None:
        """Unique indexes of all rows; with touched, only those on a field that changed."""
        for index in self._unique():
            if touched is None or any(f == t or f.startswith(f"{t}.") or t.startswith(f"{f}.") for f in index["fields"] for t in touched):
                if self._twice(self._keys(df, index)):
                    raise UniqueViolation(f"{self.own.name}: {index['name']}")

    def _matched(self, query: dict[str, Any] | Column, limit: int | None) -> tuple[list[str], Column, DataFrame]:
        """(folders with a matching row, the condition, the matching rows' _id)."""
        df = self.read()
        when = F.coalesce(query if isinstance(query, Column) else compile_filter(df.schema, query), F.lit(False))
        if not self.m.folders:
            return [], when, df.select("_id")
        place = F.regexp_extract("_metadata.file_path", r"/(d-[0-9a-f]+)/[^/]+$", 1).alias("place")
        if limit is not None:
            chosen = df.where(when).select("_id", place).orderBy("_id").limit(limit).collect()  # limit rows
            when = F.col("_id").isin([r._id for r in chosen])
            return sorted({r.place for r in chosen}), when, df.where(when).select("_id")
        hit = df.where(when).select(place).groupBy("place").count().collect()  # a row per folder
        return sorted(r.place for r in hit), when, df.where(when).select("_id")

    def update(self, query: dict[str, Any] | Column, update: dict[str, Any] | Callable[[DataFrame, Column], DataFrame], limit: int | None = None, touched: set[str] | None = None) -> int:
        m, own = self.m, self.own
        hit, when, ids = self._matched(query, limit)
        if not hit:
            return 0

        def changed(df: DataFrame) -> DataFrame:
            marked = df.withColumn("_when", when)
            if isinstance(update, dict):  # a field that gets a value of another kind, or a null, becomes a variant
                for op, path, operand in ((op, p, v) for op in ("$set", "$min", "$max") for p, v in dict(update.get(op) or {}).items()):
                    if path in df.columns and (not values.same_kind(df.schema[path].dataType, operand) or (operand is None and op == "$set")):
                        marked = marked.withColumn(path, convert(F.col(f"`{path}`"), df.schema[path].dataType, T.VariantType()))
            after = apply_update(marked, update, F.col("_when")) if isinstance(update, dict) else update(marked, F.col("_when"))
            return after.withColumn("_version", F.when(F.col("_when"), F.col("_version") + 1).otherwise(F.col("_version"))).drop("_when")

        schema = storable(changed(own.read(m)).schema)
        names = {f.name: f.dataType for f in schema}
        whole = any(f.name not in names or names[f.name] != f.dataType for f in own.schema(m))
        replaced = list(m.folders) if whole else hit
        after = own._as(changed(own.read(replace(m, folders=tuple(replaced)))), schema)
        if touched is None and isinstance(update, dict):
            touched = touched_by(update)
        rest = own._as(own.read(replace(m, folders=tuple(f for f in m.folders if f not in replaced))), schema)
        self.check_all(rest.unionByName(after), touched)
        return self._replace("update", replaced, after, schema, ids)

    def delete(self, query: dict[str, Any] | Column, limit: int | None = None) -> int:
        m, own = self.m, self.own
        hit, when, ids = self._matched(query, limit)
        if not hit:
            return 0
        return self._replace("delete", hit, own.read(replace(m, folders=tuple(hit))).where(~when), own.schema(m), ids)

    def _replace(self, operation: str, old: list[str], after: DataFrame, schema: T.StructType, ids: DataFrame) -> int:
        n = self._events(operation, ids.select(F.col("_id").alias("doc_id"), F.lit(None).cast("string").alias("document")))
        self._forget(old)
        self.m = replace(self.m, schema=json.dumps(schema.jsonValue()))
        folder = self._write(after)
        self.m = replace(self.m, folders=(*self.m.folders, folder))
        return n

    def add_index(self, kind: str, fields: Sequence[str], unique: bool = False, **more: Any) -> str:
        name = {"text": "_text", "vector": f"_vec_{fields[0]}"}.get(kind, "_".join(fields))
        if any(i["name"] == name for i in self.m.indexes):
            return name
        self.m = replace(self.m, indexes=(*self.m.indexes, {"name": name, "index_type": kind, "fields": list(fields), "unique": unique, **more}))
        if unique:
            self.check_all(self.read())
        if kind == "text":
            for folder in self.m.folders:
                self._index(folder, self.own.schema(self.m))
        if kind == "vector":
            self._train()
        return name

    def drop_index(self, name: str) -> None:
        if not any(i["name"] == name for i in self.m.indexes):
            raise DocquillError(f"no index {name}")
        self.m = replace(self.m, indexes=tuple(i for i in self.m.indexes if i["name"] != name), postings={} if name == "_text" else self.m.postings, vectors={k: v for k, v in self.m.vectors.items() if k != name})

    def compact(self) -> None:
        df, old = self.read(), self.m.folders
        if old:
            folder = self._write(df)
            self._forget(old)
            self.m = replace(self.m, folders=(folder,))
            self._train()
        self.m = replace(self.m, changes=(), first_token=self.m.token + 1)


class Collection:
    """One collection below a database folder."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name, self.files, self.records = spark, name, Files(spark, f"{root}/{name}"), Files(spark, f"{root}/_tx")

    def decision(self, tx: str) -> str | None:
        """What became of a transaction over several collections; None while it is open."""
        return self.records.read(tx).decode() if self.records.exists(tx) else None

    def _load(self, name: str) -> Manifest:
        data = json.loads(self.files.read(name))
        return Manifest(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})

    def _latest(self) -> tuple[Manifest, int, str | None]:
        """(the newest committed version, the highest number taken, an open transaction on top of it)."""
        found, open_tx = [n for n in self.files.names() if n.startswith("m-")], None
        top = int(found[-1][2:-5]) if found else 0
        for name in reversed(found):
            m = self._load(name)
            decided = "committed" if m.tx is None else self.decision(m.tx)
            if decided == "committed":
                return m, top, open_tx
            open_tx = m.tx if decided is None else open_tx
        return Manifest(), top, open_tx

    def manifest(self) -> Manifest:
        return self._latest()[0]

    def settled(self) -> tuple[Manifest, int]:
        """(the newest version, the highest number taken), for a writer: open transactions come to their end first.

        Between its manifests and its record a transaction only writes a few bytes. One that stays open
        longer than PATIENCE has lost its client, and is aborted.
        """
        until = time.monotonic() + PATIENCE
        while True:
            m, top, open_tx = self._latest()
            if open_tx is None:
                return m, top
            if time.monotonic() > until:
                self.records.create(b"aborted", open_tx)
            time.sleep(0.05)

    def publish(self, draft: Draft, tx: str | None = None) -> bool:
        """Commits a draft, or, with tx, makes it wait for that transaction's record; False where another came first."""
        new = replace(draft.m, version=draft.top + 1, tx=tx)
        done = self.files.create(json.dumps(asdict(new)).encode(), f"m-{new.version:012d}.json")
        if done and tx is None:
            self.reveal(new)
        return done

    def reveal(self, m: Manifest) -> None:
        """Moves the events of a committed version to where streams look; who finds them still hidden does it."""
        hidden = set(self.files.names())
        for folder in m.changes:
            if f".{folder}" in hidden:
                self.files.move(f".{folder}", folder)

    def change(self, step: Callable[[Draft], Any], tx_id: str | None = None) -> Any:
        """Drafts and publishes; a writer that was overtaken tries again on the new version."""
        for _ in range(RETRIES):
            draft = Draft(self, tx_id)
            try:
                out = step(draft)
                if draft.m == draft.base or self.publish(draft):
                    return out
            except BaseException:
                draft.discard()
                raise
            draft.discard()
        raise TransactionConflict(f"{self.name} was changed meanwhile, {RETRIES} times")

    def schema(self, m: Manifest) -> T.StructType:
        base = [T.StructField("_id", T.LongType()), T.StructField("_version", T.LongType())]
        return T.StructType.fromJson(json.loads(m.schema)) if m.schema else T.StructType(base)

    def read(self, m: Manifest | None = None) -> DataFrame:
        """The rows of a version; a folder written before a field existed has it missing."""
        m = m or self.manifest()
        schema = self.schema(m)
        if not m.folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.files.root}/{f}" for f in m.folders))

    def postings(self, m: Manifest | None = None) -> tuple[DataFrame, int]:
        """(term, _id, tf, doc_len) of the text index, and the number of rows with a token."""
        m = m or self.manifest()
        if not m.postings:
            return self.spark.createDataFrame([], POSTINGS), 0
        return self.spark.read.schema(POSTINGS).parquet(*(f"{self.files.root}/{p}" for p, _ in m.postings.values())), sum(n for _, n in m.postings.values())

    def cells(self, index: dict[str, Any], m: Manifest) -> tuple[DataFrame, dict[int, float]] | None:
        """(cell, away, _id, vec) of a vector index and the radius of each cell; None where some rows are in no cell."""
        own = m.vectors.get(index["name"], {})
        if not m.folders or any(f not in own for f in m.folders):
            return None
        radius: dict[int, float] = {}
        for _, each in own.values():
            for cell, r in each.items():
                radius[int(cell)] = max(r, radius.get(int(cell), 0.0))
        return self.spark.read.schema(CELLS).parquet(*(f"{self.files.root}/{v}" for v, _ in own.values())), radius

    def _rows(self, docs: Sequence[dict[str, Any]], schema: T.StructType) -> DataFrame:
        text = [(json.dumps(d),) for d in docs]
        return self.spark.createDataFrame(text, "j string").select(F.from_json("j", schema).alias("d")).select("d.*")

    def _as(self, df: DataFrame, schema: T.StructType) -> DataFrame:
        have = {f.name: f.dataType for f in df.schema}
        return df.select(*((convert(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))

    def insert(self, docs: Sequence[dict[str, Any]] | DataFrame, tx_id: str | None = None) -> list[int]:
        """Appends all or nothing; ids count on from the last one and replace any that documents bring along.

        A DataFrame is appended without passing the driver; then no ids are returned.
        """
        return self.change(lambda d: d.insert(docs), tx_id)

    def update(
        self, query: dict[str, Any] | Column, update: dict[str, Any] | Callable[[DataFrame, Column], DataFrame], limit: int | None = None, tx_id: str | None = None,
        touched: set[str] | None = None,
    ) -> int:
        """Updates matching rows (the first ``limit`` by _id); an error leaves the collection as it was."""
        return self.change(lambda d: d.update(query, update, limit, touched), tx_id)

    def delete(self, query: dict[str, Any] | Column, limit: int | None = None, tx_id: str | None = None) -> int:
        return self.change(lambda d: d.delete(query, limit), tx_id)

    def add_index(self, kind: str, fields: Sequence[str], unique: bool = False, **more: Any) -> str:
        return self.change(lambda d: d.add_index(kind, fields, unique, **more))

    def drop_index(self, name: str) -> None:
        self.change(lambda d: d.drop_index(name))

    def compact(self, retain: float = RETAIN) -> dict[str, int]:
        """One folder for the current rows, without earlier change events.

        Versions that were current within the last ``retain`` seconds keep their folders, for readers and
        streams that still use them; what only older ones name goes.
        """
        m = self.manifest()
        before = sum(self.files.size(f) for f in m.folders)
        self.change(lambda d: d.compact())
        new = self.manifest()
        self.collect_garbage(retain)
        return {"old_size": before, "new_size": sum(self.files.size(f) for f in new.folders), "docs_kept": self.read(new).count()}

    def collect_garbage(self, retain: float = RETAIN) -> None:
        """Removes versions that were replaced more than ``retain`` seconds ago, and all folders that no other names."""
        now, times = time.time(), self.files.times()
        found, current = sorted(n for n in times if n.startswith("m-")), self.manifest().version
        kept, old, named, unnamed = set(), set(), set(), set()
        for name, after in zip(found, [*found[1:], None], strict=True):
            stays = int(name[2:-5]) >= current or after is None or times[after] > now - retain
            (kept if stays else old).add(name)
            (named if stays else unnamed).update(self._load(name).named())
        for name, at in times.items():
            bare = name.lstrip(".")
            if name in old or (name not in kept and bare not in named and (bare in unnamed or at < now - retain)):
                self.files.remove(name)
