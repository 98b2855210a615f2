"""Ranked search: TF-IDF over text fields, nearest neighbours over vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquill.errors import InvalidQuery
from docquill.functions import values
from docquill.functions.text import tokens

METRICS = ("cosine", "euclidean", "dot_product")


def searchable(df: DataFrame, fields: Sequence[str]) -> Column:
    """Strings, and strings in arrays, of some fields, joined by blanks."""
    parts = []
    for path in fields:
        found = values.field(df, path)
        if found and isinstance(found[1], T.StringType):
            parts.append(found[0])
        elif found and isinstance(found[1], T.ArrayType) and isinstance(found[1].elementType, T.StringType):
            parts.append(F.array_join(found[0], " "))
    return F.concat_ws(" ", *parts) if parts else F.lit("")


def text_index(df: DataFrame, fields: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Postings (key..., term, tf, doc_len), to be stored and searched often."""
    rows = df.select(*key, tokens(searchable(df, fields)).alias("_tokens"))
    rows = rows.select(*key, F.size("_tokens").alias("doc_len"), F.explode("_tokens").alias("term"))
    return rows.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))


def row_postings(df: DataFrame, fields: Sequence[str], key: Sequence[str]) -> DataFrame:
    """text_index() of rows whose keys differ: each row's words are sorted and counted where it lies, so nothing is exchanged."""

    def counted(words: Column) -> Column:
        n = F.size(words)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        run = lambda at: F.transform(at, lambda i, k: F.struct(F.get(words, i).alias("term"), (F.coalesce(F.get(at, k + 1), n) - i).cast("bigint").alias("tf"), n.alias("doc_len")))
        return F.when(n > 0, F.get(F.transform(F.array(starts), run), F.lit(0)))

    # a lambda's variable holds what is computed once for all of its uses
    found = F.get(F.transform(F.array(F.sort_array(tokens(searchable(df, fields)))), counted), F.lit(0))
    return df.select(*key, F.explode(found).alias("_p")).select(*key, "_p.term", "_p.tf", "_p.doc_len")


def _query_terms(df: DataFrame, query: str) -> dict[str, int]:
    one = df.sparkSession.range(1).select(tokens(F.lit(query)).alias("t")).first().t
    return {t: one.count(t) for t in one}


def _weighted(tf: Column, doc_len: Column, n: Column, df: Column, times: int) -> Column:
    """What a term adds to a row's score; a repeated query term counts as often."""
    return tf / doc_len * (F.log(n.cast("double") / df) + 1) * times


def text_search(df: DataFrame, fields: Sequence[str], query: str, limit: int = 10, key: Sequence[str] = ("_id",), scope: Column | None = None) -> DataFrame:
    """The rows that score best for a query, with ``_score``.

    score = sum over query terms of tf / doc_len * (ln(N / df) + 1); N counts rows with a token. scope, if
    given, narrows the result but not N and df. Each text is cut once: its length and the counts of the
    query's terms, a few bytes a row, pass one exchange that both the sums over all rows and the scores read.
    Rows join their score after the top-k.
    """
    terms = _query_terms(df, query)
    found = [f"_n{i}" for i in range(len(terms))]
    inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    cut = df.select(*key, inside.alias("_in"), tokens(searchable(df, fields)).alias("_tokens"))
    counts = cut.select(*key, "_in", F.size("_tokens").alias("_len"), F.filter("_tokens", lambda t: t.isin(list(terms))).alias("_own"))
    counts = counts.select(*key, "_in", "_len", *((F.size("_own") - F.size(F.array_remove("_own", t))).alias(c) for c, t in zip(found, terms, strict=True)))
    counts = counts.repartition(*key)
    # both readers of the exchange take all its columns, and filter only above it, so it runs once
    each = [F.count(F.when(F.col(c) > 0, 1)).alias(f"_df{c}") for c in found]
    sums = counts.agg(F.count(F.when(F.col("_len") > 0, 1)).alias("_rows"), F.count(F.struct(*key, "_in")).alias("_every"), *each)  # one row
    score = F.lit(0.0)
    for c, times in zip(found, terms.values(), strict=True):
        score = score + F.when(F.col(c) > 0, _weighted(F.col(c), F.col("_len"), F.col("_rows"), F.col(f"_df{c}"), times)).otherwise(0.0)
    scored = counts.join(F.broadcast(sums), F.col("_every") > 0).select(*key, F.when(F.col("_in"), score).otherwise(0.0).alias("_score"))
    best = scored.where("_score > 0").orderBy(F.col("_score").desc(), *key).limit(limit)
    return df.join(F.broadcast(best), list(key)).orderBy(F.col("_score").desc(), *key)  # best has limit rows


def search_index(index: DataFrame, n: int, query: str, limit: int | None = 10, key: Sequence[str] = ("_id",)) -> DataFrame:
    """text_search over stored postings (key..., term, tf, doc_len) of n rows: (key..., _score); without a limit all, in no order."""
    terms = _query_terms(index, query)
    hits = index.where(F.col("term").isin(list(terms)))
    df_counts = {r.term: r.df for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row per query term
    score = F.lit(0.0)
    for t, times in terms.items():
        if t in df_counts:
            score = F.when(F.col("term") == t, _weighted(F.col("tf"), F.col("doc_len"), F.lit(n), F.lit(df_counts[t]), times)).otherwise(score)
    scores = hits.groupBy(*key).agg(F.sum(score).alias("_score"))
    if limit is None:
        return scores
    return scores.orderBy(F.col("_score").desc(), *key).limit(limit)


def _sum(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def distance(column: Column, vector: Sequence[float], metric: str) -> Column:
    """The distance of an array column to a vector, in double precision."""
    v = F.array(*(F.lit(float(x)) for x in vector))
    wide = column.cast("array<double>")
    dot = _sum(F.zip_with(wide, v, lambda a, b: a * b))
    if metric == "cosine":
        norms = F.sqrt(_sum(F.transform(wide, lambda a: a * a))) * F.lit(float(sum(float(x) ** 2 for x in vector) ** 0.5))
        return F.when(norms == 0, 1.0).otherwise(1 - dot / norms)
    if metric == "euclidean":
        return F.sqrt(_sum(F.zip_with(wide, v, lambda a, b: (a - b) * (a - b))))
    if metric == "dot_product":
        return -dot
    raise InvalidQuery(f"unknown metric {metric}")


def similarity(dist: Column, metric: str) -> Column:
    if metric == "cosine":
        return 1 - dist / 2
    return 1 / (1 + dist) if metric == "euclidean" else 1 / (1 + F.exp(dist))


def vector_search(df: DataFrame, field: str, vector: Sequence[float], limit: int = 10, metric: str = "cosine", key: Sequence[str] = ("_id",), dimension: int | None = None) -> DataFrame:
    """The nearest rows, exactly, with ``_distance`` and ``_similarity``; rows of another length are left out.

    One scan with a top-k per task: only ``limit`` rows of each task reach the merge.
    """
    found = values.field(df, field)
    if found is None or not isinstance(found[1], T.ArrayType):
        raise InvalidQuery(f"{field} holds no vectors")
    if metric not in METRICS:
        raise InvalidQuery(f"unknown metric {metric}")
    if dimension is not None and len(vector) != dimension:
        raise InvalidQuery(f"the vector has {len(vector)} numbers, the index {dimension}")
    rows = df.where((F.size(found[0]) == len(vector)) & ~F.exists(found[0], lambda x: x.isNull()))
    rows = rows.withColumn("_distance", distance(found[0], vector, metric)).withColumn("_similarity", similarity(F.col("_distance"), metric))
    return rows.orderBy("_distance", *(F.col(k) for k in key if k in df.columns)).limit(limit)


# --- cells: an index for exact nearest neighbours without a scan ---------------------------------

SAMPLE_ROWS, CELL_ROWS, MOST_CELLS, ROUNDS = 20_000, 1_000, 1_024, 8


def _vectors(df: DataFrame, field: str, dimension: int) -> DataFrame:
    """(_id, vec) of the rows with a whole vector of that length."""
    found = values.field(df, field)
    if found is None or not isinstance(found[1], T.ArrayType):
        return df.sparkSession.createDataFrame([], "_id bigint, vec array<double>")
    column, _ = found
    return df.where((F.size(column) == dimension) & ~F.exists(column, lambda x: x.isNull())).select("_id", column.cast("array<double>").alias("vec"))


def _placed(x: np.ndarray, metric: str) -> np.ndarray:
    """Where vectors stand: for cosine on the unit sphere, a zero vector in its centre."""
    if metric != "cosine":
        return x
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def train_cells(df: DataFrame, field: str, dimension: int, metric: str, seed: int = 5) -> list[list[float]]:
    """Centres of k-means on at most SAMPLE_ROWS vectors, those of smallest hash; one for each CELL_ROWS rows or so."""
    rows = _vectors(df, field, dimension)
    n = rows.count()
    if n == 0:
        return []
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS).toPandas()
    x, rng = _placed(np.array(sample["vec"].tolist(), np.float64), metric), np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(len(x), MOST_CELLS, -(-n // CELL_ROWS)), replace=False)]
    for _ in range(ROUNDS):
        home = _squares(x, centres).argmin(1)
        sums, size = np.zeros_like(centres), np.bincount(home, minlength=len(centres))[:, None]
        np.add.at(sums, home, x)
        centres = np.where(size > 0, sums / np.maximum(size, 1), centres)
    return centres.tolist()


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T)


def cell_index(df: DataFrame, field: str, dimension: int, metric: str, centres: list[list[float]]) -> DataFrame:
    """(cell, away, _id, vec): each vector by its nearest centre, and how far it is from it."""
    middle = np.array(centres, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _placed(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1), metric)
                home = _squares(x, middle).argmin(1)
                away = np.linalg.norm(x - middle[home], axis=1)
                yield pa.record_batch([pa.array(home.astype(np.int32)), pa.array(away), batch.column(0), batch.column(1)], names=["cell", "away", "_id", "vec"])

    return _vectors(df, field, dimension).mapInArrow(run, "cell int, away double, _id bigint, vec array<double>")


def _least(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, metric: str) -> np.ndarray:
    """The least distance that a vector of each cell can have, by the triangle inequality (dot product: by Cauchy's)."""
    if metric == "dot_product":
        return -(centres @ q) - np.linalg.norm(q) * radius
    gap = np.maximum(0, np.linalg.norm(centres - _placed(q[None], metric), axis=1) - radius)
    return gap**2 / 2 if metric == "cosine" else gap


def search_cells(index: DataFrame, centres: list[list[float]], radius: dict[int, float], vector: Sequence[float], limit: int, metric: str, ef_search: int | None = None) -> list[tuple[int, float]]:
    """The nearest (_id, distance) of a cell index, exactly: after the most promising cells only those are read that could hold a nearer vector.

    With ef_search the most promising cells alone are read, as many of them; then a nearer vector may be missed.
    """
    q, cells = np.array(vector, np.float64), np.array(sorted(radius))
    if not len(cells) or not limit:
        return []
    if metric == "cosine" and not q.any():
        least = np.full(len(cells), -1.0)  # everything is at distance 1
    else:
        least = _least(q, np.array(centres)[cells], np.array([radius[c] for c in cells]), metric) - 1e-9
    order, best = np.argsort(least, kind="stable"), []
    first = min(len(cells), ef_search or max(1, round(len(cells) ** 0.5)))
    for chosen in (order[:first], order[first:]):
        if len(best) >= limit:
            chosen = chosen[least[chosen] <= best[-1][1]]
        if len(chosen):
            rows = index.where(F.col("cell").isin([int(c) for c in cells[chosen]])).select("_id", distance(F.col("vec"), vector, metric).alias("d"))
            best = sorted([*best, *((r._id, r.d) for r in rows.orderBy("d", "_id").limit(limit).collect())], key=lambda x: (x[1], x[0]))[:limit]
        if ef_search:
            break
    return best
