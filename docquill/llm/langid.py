"""Language identification by Bayesian fusion of evidence.

log P(language | row) = text + declared + suffix + prior, up to a constant:

* text: mean log likelihood of the text's byte trigrams (whole text) times ``WEIGHT``, or their number
  where that is less: trigrams overlap, so a long text must not drown all else. The trigram tables are
  fitted on a bounded sample of rows per declared language.
* declared: P(declared | language), a confusion table counted over all rows against the text's verdict.
* suffix: P(address suffix | language), counted over all rows in the same way.
* prior: of the host, smoothed towards its site, that towards all rows (grouped counts, Dirichlet weights).

This only compares the declared languages. Whether a text is in any of them is judged by absolute fit, whatever its
length: under its best language its mean log likelihood must reach that under a model of unknown text, which gives
a trigram the product of its bytes' frequencies in the same sample, or one of BUCKETS equal shares if that is more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquill.llm.common import bounded_batches, result, saved, shared_dir, trimmed, worker_cache

BUCKETS, WEIGHT, SMOOTH, PER_LANGUAGE, MIN_ROWS, MIN_SCORE = 1 << 16, 40.0, 20.0, 4_000, 5, 0.5
BROADCAST_BYTES = 8 << 20

# letters stay, ASCII ones in lower case; all else is blank
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _bucket(code: np.ndarray) -> np.ndarray:
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every trigram with a letter in its middle, number of them in each text)."""
    joined = np.frombuffer(b" " + b"  ".join(t.translate(_FOLD) for t in texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    code = joined[:-2].astype(np.uint32) << 16 | joined[1:-1].astype(np.uint32) << 8 | joined[2:]
    middle = joined[1:-1] != 32
    bucket = _bucket(code[middle])
    before = np.concatenate([[0], np.cumsum(middle)])
    starts = np.cumsum(sizes + 2) - sizes - 2
    return bucket, before[starts + sizes] - before[starts]


def _texts(column: pa.Array, most: int = 1 << 20) -> Iterator[list[bytes]]:
    own, size = [], 0
    for x in column.cast(pa.binary()):
        own.append(x.as_py() or b"")
        size += len(own[-1])
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("langid")  # frees what other operators left
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            own = counts.setdefault(lang, np.zeros(BUCKETS + 256, np.int64))  # trigrams, then single bytes
            own[:BUCKETS] += np.bincount(trigrams([text or b""])[0], minlength=BUCKETS)
            own[BUCKETS:] += np.bincount(np.frombuffer((text or b"").translate(_FOLD), np.uint8), minlength=256)
    for lang, own in counts.items():
        seen = np.flatnonzero(own)
        yield pa.record_batch([pa.array([lang] * len(seen)), pa.array(seen.astype(np.int32)), pa.array(own[seen])], names=["lang", "bucket", "n"])


def unknown_table(counts: np.ndarray) -> np.ndarray:
    """Log likelihoods of all buckets for text in no known language, from the counts of single bytes."""
    used = np.array(sorted(set(_FOLD)), np.uint32)
    share = (counts[used] + 0.5) / (counts[used] + 0.5).sum()
    middle = used != 32
    code = used[:, None, None] << np.uint32(16) | used[middle][None, :, None] << np.uint32(8) | used[None, None, :]
    chance = share[:, None, None] * share[middle][None, :, None] * share[None, None, :]
    table = np.bincount(_bucket(code.ravel()), chance.ravel(), BUCKETS)
    return np.log(np.maximum(table / table.sum(), 1 / BUCKETS))


def _scorer(tables: np.ndarray, unknown: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("langid")
        for batch in batches:
            means, sizes, fits = [], [], []
            for texts in _texts(batch.column(batch.num_columns - 1)):
                bucket, n = trigrams(texts)
                ends = np.cumsum(n)
                out = np.zeros((len(texts), len(tables)))
                for k, table in enumerate(tables):
                    total = np.concatenate([[0.0], np.cumsum(table[bucket])])
                    out[:, k] = (total[ends] - total[ends - n]) / np.maximum(n, 1)
                means += list(out)
                total = np.concatenate([[0.0], np.cumsum(unknown[bucket])])
                fits.append(out.max(1) - (total[ends] - total[ends - n]) / np.maximum(n, 1))
                sizes.append(n)
            n = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
            fit = np.concatenate(fits) if fits else np.empty(0)
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(n), pa.array(fit), pa.array(means, pa.list_(pa.float64()))], names=["id", "declared", "suffix", "host", "site", "n", "fit", "means"]
            )

    return trimmed(run)


def primary(tag: Column) -> Column:
    """The primary part of a language tag, in lower case; null where empty."""
    out = F.lower(F.regexp_extract(F.trim(tag), "^[A-Za-z]+", 0))
    return F.when(out != "", out)


def markup_language(html: Column) -> Column:
    """The language that a page's html element declares."""
    return F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, declared: Column | None = None, host: Column | None = None,
    accept: tuple[str, ...] | None = None, min_score: float = MIN_SCORE, per_language: int = PER_LANGUAGE, min_rows: int = MIN_ROWS,
) -> DataFrame:
    """One row per row of docs: id, declared, lang, score, accepted.

    text, declared and host default to the columns text, lang and source. Languages are those declared by
    at least ``min_rows`` rows (a rarer tag says nothing that trigrams could be fitted on, and counts as no
    declaration); of languages that tie, the alphabetically first is taken. The trigram tables look at about per_language rows of each. A row is
    accepted when its text has a letter, its best language is in ``accept`` (default: all) and reaches
    min_score. Null or letterless texts and those that fit no language better than the model of unknown text
    are rejected with lang null and score 0, as is everything where no language is declared often enough. Null hosts and declarations give no evidence. Repeated rows
    each count; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    work = shared_dir(spark)
    text = F.col("text") if text is None else text
    declared = F.col("lang") if declared is None else declared
    host = F.lower(F.col("source") if host is None else host)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), primary(declared).alias("declared"), host.alias("host"), text.alias("text"))
    rows = rows.withColumn("suffix", F.when(F.contains("host", F.lit(".")), F.substring_index("host", ".", -1)))
    rows = rows.withColumn("site", F.when(F.contains("host", F.lit(".")), F.substring_index("host", ".", -2)))
    often = {r.declared: r.n for r in rows.where("declared is not null").groupBy("declared").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows).collect()}
    langs = sorted(often)
    if not langs:
        return rows.select(F.col("id").alias(id_col), "declared", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))

    # a row is in the sample by its own hash, so no shuffle and no driver choice is needed
    u = F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1_000_000))
    quota = F.lit(0)
    for lang, n in often.items():
        quota = F.when(F.col("declared") == lang, math.ceil(1_000_000 * min(1.0, per_language / n))).otherwise(quota)
    sample = rows.where(u < quota).select("declared", "text").mapInArrow(_count, "lang string, bucket int, n bigint")
    table = sample.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most languages x (BUCKETS + 256) rows
    single = table["bucket"] >= BUCKETS
    counts = np.bincount(table["bucket"][single] - BUCKETS, table["n"][single], 256)
    table = table[~single]
    tables = np.full((len(langs), BUCKETS), 0.5)
    number = {x: k for k, x in enumerate(langs)}
    tables[table["lang"].map(number).to_numpy(np.int64), table["bucket"].to_numpy(np.int64)] += table["n"].to_numpy()
    tables = np.log(tables / tables.sum(1, keepdims=True))

    # one pass over whole texts; all that follows works on a few bytes a row
    scored = rows.select("id", "declared", "suffix", "host", "site", "text").mapInArrow(
        _scorer(tables, unknown_table(counts)), "id bigint, declared string, suffix string, host string, site string, n bigint, fit double, means array<double>"
    )
    known_text = (F.col("n") > 0) & (F.col("fit") >= 0)
    best = F.array_position("means", F.array_max("means")).cast("int") - 1
    scored = saved(scored.withColumn("guess", F.when(known_text, best)), f"{work}/scored")
    certain = scored.where("guess is not null")

    total = np.zeros(len(langs))
    for r in certain.groupBy("guess").agg(F.count(F.lit(1)).alias("c")).collect():
        total[r.guess] = r.c
    overall = (total + 1) / (total + 1).sum()
    known = certain.where(F.col("declared").isin(langs))
    said = np.full((len(langs), len(langs)), 1.0)  # P(declared | language): a uniform pseudo-row each
    for r in known.groupBy("declared", "guess").agg(F.count(F.lit(1)).alias("c")).collect():
        said[number[r.declared], r.guess] += r.c
    said = np.log(said / said.sum(0, keepdims=True))

    def vector(values) -> Column:
        return F.array(*(F.lit(float(v)) for v in values))

    def grouped(*keys: str) -> DataFrame:
        """The number of rows of each key by their text's verdict, in columns g0, g1, ..."""
        sums = (F.sum((F.col("guess") == k).cast("double")).alias(f"g{k}") for k in range(len(langs)))
        return certain.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(*sums)

    def smoothed(parent: Column) -> Column:
        many = sum((F.col(f"g{k}") for k in range(1, len(langs))), F.col("g0"))
        return F.array(*((F.col(f"g{k}") + SMOOTH * F.get(parent, k)) / (many + SMOOTH) for k in range(len(langs))))

    flat = vector(overall)
    site = grouped("site").select("site", smoothed(flat).alias("site_prior"))
    by_host = grouped("host", "site").join(site, "site", "left").select("host", smoothed(F.coalesce("site_prior", flat)).alias("prior"))
    suffix = grouped("suffix")
    like = F.array(*(F.log((F.col(f"g{k}") + SMOOTH * F.lit(float(overall[k]))) / F.lit(float(total[k] + SMOOTH))) for k in range(len(langs))))
    suffix = suffix.select("suffix", like.alias("suffix_like"))
    # few hosts and suffixes go to every task; more are joined by shuffle, where AQE parts a hot host
    df = scored
    for key, side in (("host", by_host), ("suffix", suffix)):
        side = saved(side, f"{work}/{key}")
        df = df.join(F.broadcast(side) if side.count() * 8 * (len(langs) + 8) <= BROADCAST_BYTES else side, key, "left")
    zero = vector([0.0] * len(langs))
    claim = zero
    for lang, k in number.items():
        claim = F.when(F.col("declared") == lang, vector(said[k])).otherwise(claim)
    df = df.withColumn("claim", claim).withColumn("prior", F.coalesce("prior", flat)).withColumn("suffix_like", F.coalesce("suffix_like", zero))
    weight = F.least(F.col("n").cast("double"), F.lit(WEIGHT))
    logs = F.array(*(weight * F.get("means", k) + F.get("claim", k) + F.get("suffix_like", k) + F.log(F.get("prior", k)) for k in range(len(langs))))
    df = df.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    score = 1 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    lang = F.when(known_text, F.get(F.array(*map(F.lit, langs)), F.array_position("logs", F.col("top")).cast("int") - 1))
    out = df.select(F.col("id").alias(id_col), "declared", lang.alias("lang"), F.when(known_text, score).otherwise(0.0).alias("score"))
    good = F.col("lang").isNotNull() & (F.col("score") >= min_score)
    out = out.withColumn("accepted", good & F.col("lang").isin(*accept) if accept is not None else good)
    return result(out.withColumn("accepted", F.coalesce("accepted", F.lit(False))), work)
