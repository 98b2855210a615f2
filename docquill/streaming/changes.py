"""Change streams: the change logs of collections as a Structured Streaming source.

A folder of events gets the name that streams look for after its commit, so a stream sees no events of
commits under way, refused or rolled back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.errors import TokenTooOld
from docquill.sources.collections import CHANGES, Collection


def _token(collection: Collection, after: int | None) -> int:
    """The token to start behind; events whose commit's client was lost before it could show them are shown."""
    m = collection.manifest()
    collection.reveal(m)
    after = m.token if after is None else after
    if after + 1 < m.first_token:
        raise TokenTooOld(f"events from {m.first_token} on are kept")
    return after


def changes(collection: Collection, after: int = 0) -> DataFrame:
    """The events after a token that are still kept, oldest first."""
    _token(collection, after)
    m = collection.manifest()
    if not m.changes:
        return collection.spark.createDataFrame([], CHANGES)
    log = collection.spark.read.schema(CHANGES).parquet(*(f"{collection.files.root}/{c}" for c in m.changes))
    return log.where(log.token > after).orderBy("token")


def _stream(spark: SparkSession, folders: str, max_files: int) -> DataFrame:
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "part-*").parquet(folders)


def watch(collection: Collection, resume_after: int | None = None, max_files: int = 64) -> DataFrame:
    """An unbounded DataFrame of change events; start it with writeStream, stop it by query.stop().

    Without a token only events after this call count, with one those after it. maxFilesPerTrigger bounds
    a batch, so a slow consumer lags and loses nothing; a checkpoint resumes where it stopped.
    """
    after = _token(collection, resume_after)
    return _stream(collection.spark, f"{collection.files.root}/c-*", max_files).where(f"token > {int(after)}")


def watch_all(spark: SparkSession, root: str, collections: dict[str, Collection], resume_after: dict[str, int] | None = None, max_files: int = 64) -> DataFrame:
    """watch() over all collections of a database, also those created later; tokens count by collection."""
    after = F.lit(0)
    for name, collection in collections.items():
        after = F.when(F.col("collection") == name, _token(collection, (resume_after or {}).get(name))).otherwise(after)
    return _stream(spark, f"{root}/*/c-*", max_files).where(F.col("token") > after)
