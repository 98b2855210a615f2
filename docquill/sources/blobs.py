"""The object store: buckets of binary objects, their metadata, and search over their text."""

from __future__ import annotations

import io
import json
import re
import urllib.parse
import zipfile
import zlib
from datetime import datetime, timezone
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.errors import DocquillError
from docquill.functions.pdf import pdf_text
from docquill.operators.search import text_search
from docquill.sources.collections import Files

META = "key string, bucket string, size bigint, content_type string, etag string, created_at string, metadata map<string,string>"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"


def _strings(value: Any) -> list[str]:
    if isinstance(value, str):
        return [value]
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [s for v in parts for s in _strings(v)]


def _office(data: bytes, kind: str) -> str | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        wanted = r"word/document\.xml" if kind == DOCX else r"xl/(sharedStrings|worksheets/sheet\d+)\.xml"
        parts = [n for n in z.namelist() if re.fullmatch(wanted, n)]
        words = []
        for name in sorted(parts):
            for e in ElementTree.fromstring(z.read(name)).iter():
                tag = e.tag.rpartition("}")[2]
                if e.text and (tag == "t" or (tag == "v" and kind == XLSX)):
                    words.append(e.text)
        return " ".join(words) or None


def extract_text(data: bytes, content_type: str) -> str | None:
    """The text of an object, None where its type has none that can be read. Images aren't supported."""
    kind = content_type.lower()
    try:
        if kind.startswith("text/html") or kind in ("text/xml", "application/xml"):
            return re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", data.decode("utf-8", "replace"))).strip()
        if kind.startswith("text/"):
            return data.decode("utf-8")
        if kind == "application/json":
            return " ".join(_strings(json.loads(data))) or None
        if kind == "application/pdf":
            return pdf_text(data)
        if kind in (DOCX, XLSX):
            return _office(data, kind)
    except (UnicodeDecodeError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
        return None
    return None


class BlobStore:
    """Each object is a data file and a JSON file of its metadata, below a folder per bucket."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, f"{root}/_blobs")

    @staticmethod
    def _file(key: str) -> str:
        return urllib.parse.quote(key, safe="").replace("_", "%5F")

    def create_bucket(self, bucket: str) -> None:
        if self.files.exists(bucket):
            raise DocquillError(f"bucket {bucket} exists")
        self.files.make(bucket, "data")
        self.files.make(bucket, "meta")

    def list_buckets(self) -> list[str]:
        return self.files.names()

    def delete_bucket(self, bucket: str) -> None:
        self.files.remove(bucket)

    def put_object(self, bucket: str, key: str, data: bytes, content_type: str = "application/octet-stream", metadata: dict[str, str] | None = None) -> dict[str, Any]:
        meta = {
            "key": key, "bucket": bucket, "size": len(data), "content_type": content_type, "etag": f"{zlib.crc32(data):08x}",
            "created_at": datetime.now(timezone.utc).isoformat(), "metadata": metadata or {},
        }
        self.files.put(data, bucket, "data", f"{self._file(key)}.bin")
        self.files.put(json.dumps(meta).encode(), bucket, "meta", f"{self._file(key)}.json")
        return meta

    def head_object(self, bucket: str, key: str) -> dict[str, Any]:
        if not self.files.exists(bucket, "meta", f"{self._file(key)}.json"):
            raise DocquillError(f"no object {bucket}/{key}")
        return json.loads(self.files.read(bucket, "meta", f"{self._file(key)}.json"))

    def get_object(self, bucket: str, key: str) -> tuple[bytes, dict[str, Any]]:
        meta = self.head_object(bucket, key)
        return self.files.read(bucket, "data", f"{self._file(key)}.bin"), meta

    def delete_object(self, bucket: str, key: str) -> None:
        self.head_object(bucket, key)
        self.files.remove(bucket, "meta", f"{self._file(key)}.json")
        self.files.remove(bucket, "data", f"{self._file(key)}.bin")

    def objects(self, bucket: str | None = None) -> DataFrame:
        """Metadata of all objects, read in parallel."""
        buckets = [b for b in (self.list_buckets() if bucket is None else [bucket]) if self.files.names(b, "meta")]
        if not buckets:
            return self.spark.createDataFrame([], META)
        return self.spark.read.schema(META).json([f"{self.files.root}/{b}/meta" for b in buckets])

    def list_objects(self, bucket: str, prefix: str | None = None, limit: int = 1000) -> list[dict[str, Any]]:
        rows = self.objects(bucket)
        rows = rows.where(F.col("key").startswith(prefix)) if prefix else rows
        return [{**r.asDict(), "metadata": dict(r.metadata or {})} for r in rows.orderBy("key").limit(limit).collect()]

    def texts(self) -> DataFrame:
        """(bucket, key, text) of all objects that have a text."""
        meta = self.objects()
        buckets = [b for b in self.list_buckets() if self.files.names(b, "data")]
        if not buckets:
            return self.spark.createDataFrame([], "bucket string, key string, text string")
        data = self.spark.read.format("binaryFile").load([f"{self.files.root}/{b}/data" for b in buckets])
        part = F.split("path", "/")
        data = data.select(F.element_at(part, -3).alias("bucket"), F.regexp_replace(F.element_at(part, -1), r"\.bin$", "").alias("file"), "content")
        names = meta.select("bucket", "key", "content_type")

        @F.pandas_udf("string")
        def text(content: pd.Series, kind: pd.Series) -> pd.Series:
            return pd.Series([extract_text(bytes(c), k) for c, k in zip(content, kind, strict=True)])

        as_file = F.url_encode("key")  # as _file names it
        for was, then in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("_", "%5F")):
            as_file = F.replace(as_file, F.lit(was), F.lit(then))
        names = names.withColumn("file", as_file)
        both = data.join(names, ["bucket", "file"])
        return both.select("bucket", "key", text("content", "content_type").alias("text")).where("text is not null")

    def search(self, query: str, bucket: str | None = None, limit: int = 10) -> DataFrame:
        """(bucket, key, _score); counts span all buckets, a bucket only narrows the result."""
        scope = F.col("bucket") == bucket if bucket else None
        return text_search(self.texts(), ["text"], query, limit, ("bucket", "key"), scope).select("bucket", "key", "_score")
