"""Shared pieces: where intermediate tables go, files of tasks, worker caches, connected components."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import docquill.llm

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
BATCH_BYTES = 4 << 20


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor must be able to reach.

    Only for a session on one machine (master ``local``) that lacks the setting, a local folder is made; on a
    cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="docquill-"))
        base = _LOCAL[0]
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return f"{whole.rstrip('/')}/docquill-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet and reads it back: lineage ends at files that outlive any executor."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def result(df: DataFrame, work: str) -> DataFrame:
    """Saves an operator's result beside its work folder, then removes that: only the result stays."""
    out = saved(df, f"{work}-out")
    remove(df.sparkSession, work)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that shared_dir gave."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checked_broadcast(ids: DataFrame, most: int = 400_000) -> DataFrame:
    """ids, one column of 8 bytes, marked for broadcast only if it has at most ``most`` rows."""
    return F.broadcast(ids) if ids.count() <= most else ids


def connected_components(edges: DataFrame, work: str) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    Alternates the large-star and small-star steps: the number of rounds grows with the logarithm of
    the number of nodes, and each round keeps at most as many edges as it was given. Each round is
    written to ``work``.
    """
    spark = edges.sparkSession
    now = saved(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{work}/cc-0"
    )
    nodes = now.select(F.explode(F.array("u", "v")).alias("node")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    step, last = 0, mark(now)
    while last[0]:
        step += 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        root = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(small.union(root.select("u", F.col("m").alias("v"))).distinct(), f"{work}/cc-{step}")
        was, last = last, mark(after)
        now = after
        if was == last:
            break
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Rows reach Python in Arrow batches of about ``most`` bytes, however long their texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not (now.isdigit() and int(now) <= most):  # its default has a unit
        spark.conf.set(key, str(most))


def worker_cache(owner: str) -> dict[str, Any]:
    """A dictionary that outlives a task in its Python worker. It has one owner: what another one left is freed."""
    state = sys.modules.setdefault("_docquill_worker_state", types.ModuleType("_docquill_worker_state")).__dict__
    if state.get("owner") != owner:
        state.clear()
        state.update(owner=owner, cache={})
        trim()
    return state["cache"]


def trim() -> None:
    """Gives memory that is free back to the machine, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker keeps no more memory than its cache."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return task


@dataclass(frozen=True)
class Store:
    """A folder that tasks read and write without a session, with the settings that its object store needs."""

    uri: str
    options: dict[str, Any] = field(default_factory=dict)

    def open(self) -> tuple[fs.FileSystem, str]:
        if self.options:
            return fs.S3FileSystem(**self.options), self.uri.split("://", 1)[1]
        if self.uri.startswith(("file:", "/")):
            return fs.LocalFileSystem(), "/" + self.uri.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(self.uri)

    def put(self, name: str, data: bytes) -> None:
        """Writes a file whole: object stores show it when it is complete, elsewhere it gets its name then. A repeated task replaces it by equal bytes."""
        there, path = self.open()
        whole = isinstance(there, fs.S3FileSystem | fs.GcsFileSystem)
        part = f"{path}/{name}" if whole else f"{path}/{name}.{uuid.uuid4().hex}"
        with there.open_output_stream(part) as f:
            f.write(data)
        if not whole:
            there.move(part, f"{path}/{name}")

    def get(self, name: str) -> bytes:
        there, path = self.open()
        with there.open_input_stream(f"{path}/{name}") as f:
            return f.read()

    def make(self) -> None:
        there, path = self.open()
        there.create_dir(path, recursive=True)


# settings of the session's object store, and what they are called where tasks open files
S3_SETTINGS = {
    "fs.s3a.access.key": "access_key", "fs.s3a.secret.key": "secret_key", "fs.s3a.session.token": "session_token", "fs.s3a.endpoint": "endpoint_override",
    "fs.s3a.endpoint.region": "region", "fs.s3a.assumed.role.arn": "role_arn",
}


def store(spark: SparkSession, uri: str) -> Store:
    """The folder of a URI. ``s3a`` and ``s3n`` take the session's Hadoop settings along; without keys, those of the machine count."""
    scheme = uri.split("://", 1)[0]
    if scheme not in ("s3", "s3a", "s3n"):
        return Store(uri)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    options = {name: conf.get(key) for key, name in S3_SETTINGS.items() if conf.get(key)}
    if str(conf.get("fs.s3a.connection.ssl.enabled")).lower() == "false":
        options["scheme"] = "http"
    if options.get("endpoint_override") and str(conf.get("fs.s3a.path.style.access")).lower() != "true":
        options["force_virtual_addressing"] = True
    return Store("s3://" + uri.split("://", 1)[1], options or {"anonymous": False})


# Functions of this subpackage travel to executors by value, so that these need not have it installed.
cloudpickle.register_pickle_by_value(docquill.llm)
