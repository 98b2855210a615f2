"""Benchmark decontamination: an FM-index per shard of training text, searched backward for test windows.

A shard is some tens of megabytes of documents of one task. Words outside the benchmark's vocabulary can't
be part of an occurrence, nor can a run of its words that is shorter than the shortest window; the index is
built over all other runs, each closed by a separator, so it loses no occurrence. Windows are found by
backward search through the ranks of a wavelet matrix; occurrences are located by walking to sampled suffix
positions; overlapping occurrences merge into removal spans.

The benchmark is never collected: blocks of bounded size lie in the shared folder as windows ready for the
search, and each task reads one block after another; a worker keeps as many as fit into ``CACHE_BYTES``.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquill.llm.common import Store, bounded_batches, result, saved, shared_dir, store, trimmed, worker_cache

WINDOW, SAMPLE, BLOCK_BYTES, SHARD_BYTES, CACHE_BYTES = 10, 8, 2 << 20, 6 << 20, 48 << 20

_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Words after lower-casing A-Z: runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.translate(_TO_WORDS).split()


class Windows:
    """The distinct windows of some items, over a vocabulary of their words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items if i is not None})
        number, seen, owner = {x: k for k, x in enumerate(self.items)}, {}, []
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                n = seen.setdefault(tuple(ids[k : k + window]), len(seen))
                if item is not None:
                    owner.append((n, number[item]))
        self.size = np.fromiter(map(len, seen), np.int64, len(seen))
        self.by_size = {}
        flat = list(seen)
        for size in np.unique(self.size):
            own = np.flatnonzero(self.size == size)
            self.by_size[int(size)] = own, np.array([flat[k] for k in own], np.int32)
        self.owner = np.array(sorted(set(owner)), np.int64).reshape(-1, 2)
        self.shortest = int(self.size.min()) if len(self.size) else 0

    def pack(self) -> bytes:
        return pickle.dumps(({**self.__dict__, "vocab": b" ".join(self.vocab)}), protocol=5)

    @classmethod
    def unpack(cls, data: bytes) -> Windows:
        out = cls.__new__(cls)
        out.__dict__.update(pickle.loads(data))
        out.vocab = {w: k for k, w in enumerate(out.vocab.split(), 1)}
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of the suffixes of seq; each 0 closes its suffix, and zeros rank by position."""
    closed = seq == 0
    many = int(closed.sum())
    rank = np.where(closed, np.cumsum(closed) - 1, seq + many - 1).astype(np.int64)
    n, h = len(seq), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - h)] = rank[h:] + 1
        order = np.argsort(rank * np.int64(rank.max() + 3) + ahead, kind="stable")
        a, b = rank[order], ahead[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank = fresh
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        h *= 2


class FMIndex:
    """Counts and locates patterns without 0 in a sequence that ends with 0; all symbols are at most ``largest``."""

    def __init__(self, seq: np.ndarray, largest: int, sample: int = SAMPLE):
        order = suffix_array(seq)
        before = seq[order - 1]  # position 0 follows the last separator
        self.levels, self.bits = [], max(1, largest.bit_length())
        own = before
        for level in reversed(range(self.bits)):
            bit = (own >> level) & 1
            self.levels.append((level, np.concatenate([[0], np.cumsum(bit)]), int(len(bit) - bit.sum())))
            own = np.concatenate([own[bit == 0], own[bit == 1]])
        counts = np.bincount(seq, minlength=(1 << self.bits) + 1)
        self.first = np.cumsum(counts) - counts
        kept = (order % sample == 0) | (before == 0)
        self.kept, self.kept_rank, self.position = kept, np.cumsum(kept) - 1, order[kept]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each row."""
        low = np.zeros_like(at)
        for level, ones, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            at = np.where(one, zeros + ones[at], at - ones[at])
            low = np.where(one, zeros + ones[low], low - ones[low])
        return at - low

    def symbol(self, row: np.ndarray) -> np.ndarray:
        """The symbol that precedes each row's suffix."""
        out = np.zeros_like(row)
        for _, ones, zeros in self.levels:
            bit = ones[row + 1] - ones[row]
            row = np.where(bit == 1, zeros + ones[row], row - ones[row])
            out = out << 1 | bit
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that start with each row of patterns; patterns leave the search with their last suffix."""
        low, high = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        left, a, b = np.arange(len(patterns)), np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.kept), np.int64)
        for k in reversed(range(patterns.shape[1])):
            c = patterns[left, k].astype(np.int64)
            a, b = self.first[c] + self.rank(c, a), self.first[c] + self.rank(c, b)
            on = b > a
            left, a, b = left[on], a[on], b[on]
        low[left], high[left] = a, b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row's suffix."""
        out, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            here = self.kept[rows]
            out[todo[here]] = self.position[self.kept_rank[rows[here]]] + steps
            todo, rows = todo[~here], rows[~here]
            c = self.symbol(rows)
            rows, steps = self.first[c] + self.rank(c, rows), steps + 1
        return out


def occurrences(texts: list[bytes], windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(position in the documents' words one after another, window) of each occurrence."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not windows.shortest:
        return none
    get, parts, nothing = windows.vocab.get, [], itertools.repeat(0)
    for t in texts:  # a text's words don't outlive it, only their numbers do
        own = words_of(t)
        parts.append(np.fromiter(map(get, own, nothing), np.int32, len(own)))
        parts.append(np.zeros(1, np.int32))
    ids = np.concatenate(parts)  # one separator after each document
    closes = np.cumsum([len(own) for own in parts]).reshape(-1, 2)[:, 1] if parts else np.empty(0, np.int64)
    inside = np.diff((ids > 0).astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    long = stop - start >= windows.shortest
    start, size = start[long], stop[long] - start[long] + 1  # with the separator behind
    if not len(start):
        return none
    ends = np.cumsum(size)
    source = np.repeat(start - ends + size, size) + np.arange(ends[-1])
    seq = ids[source].astype(np.int64)
    seq[ends - 1] = 0
    index = FMIndex(seq, len(windows.vocab))
    positions, found = [], []
    for which, patterns in windows.by_size.values():
        low, high = index.search(patterns)
        many = high - low
        reached = np.cumsum(many)
        rows = np.repeat(low - reached + many, many) + np.arange(reached[-1])
        positions.append(source[index.locate(rows)])
        found.append(np.repeat(which, many))
    at = np.concatenate(positions)
    # back to positions without the documents' separators
    return at - np.searchsorted(closes, at, "right"), np.concatenate(found)


def _merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals joined where they overlap; those that merely touch join too."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(_TO_WORDS))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def _blocks(where: Store, parts: list[int]) -> Iterator[Windows]:
    cache = worker_cache("decontam")
    for k in parts:
        found = cache.get((where.uri, k))
        if found is None:
            data = where.get(f"block-{k:05d}")
            found = Windows.unpack(data), len(data)
            while cache and sum(n for _, n in cache.values()) + len(data) > CACHE_BYTES:
                cache.pop(next(iter(cache)))
            if len(data) <= CACHE_BYTES:
                cache[where.uri, k] = found
        yield found[0]


def _scanner(where: Store, blocks: list[int], cut: bool):
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def shard(ids: pa.Array, raw: list[bytes | None]) -> pa.RecordBatch:
        texts = [t or b"" for t in raw]
        size = np.fromiter((len(words_of(t)) for t in texts), np.int64, len(texts))
        ends = np.cumsum(size)
        starts, stops, items = [], [], [set() for _ in texts]
        for w in _blocks(where, blocks):
            at, which = occurrences(texts, w)
            starts.append(at)
            stops.append(at + w.size[which])
            pair = np.unique(np.stack([np.searchsorted(ends, at, "right"), which], 1), axis=0)
            low, high = np.searchsorted(w.owner[:, 0], pair[:, 1], "left"), np.searchsorted(w.owner[:, 0], pair[:, 1], "right")
            for d, a, b in zip(pair[:, 0], low, high, strict=True):
                items[d].update(w.items[i] for i in w.owner[a:b, 1])
        if starts:
            start, stop = _merged(np.concatenate(starts), np.concatenate(stops))
        else:
            start = stop = np.empty(0, np.int64)
        doc = np.searchsorted(ends, start, "right")
        # spans that touch across two documents part again at the boundary
        spans, hit = [[] for _ in texts], np.zeros(len(texts), np.int64)
        for d, a, b in zip(doc.tolist(), start.tolist(), stop.tolist(), strict=True):
            while a < b:
                low, high = int(ends[d] - size[d]), int(ends[d])
                if high > a:
                    spans[d].append((a - low, min(b, high) - low))
                    hit[d] += min(b, high) - a
                a, d = max(a, high), d + 1
        columns = [ids, pa.array(size), pa.array(hit), pa.array([sorted(i) for i in items], pa.list_(pa.string())), pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], span)]
        names = ["id", "n_words", "n_hit", "items", "spans"]
        if cut:
            clean = [t if not s else _cut(t, s) for t, s in zip(raw, spans, strict=True)]
            columns.append(pa.array(clean, pa.binary()).cast(pa.string()))
            names.append("clean_text")
        return pa.record_batch(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, total = [], [], 0
        for batch in batches:  # a shard takes texts of as many batches as it needs
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(i)
                own.append(x.as_py())
                total += len(own[-1] or b"")
                if total >= SHARD_BYTES:
                    yield shard(pa.array(ids, pa.int64()), own)
                    ids, own, total = [], [], 0
        if own:
            yield shard(pa.array(ids, pa.int64()), own)

    return trimmed(run)


def _write_blocks(where: Store, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("decontam")
        items, size, n, part = [], 0, 0, TaskContext.get().partitionId()

        def write() -> pa.RecordBatch:
            where.put(f"block-{part * 1000 + n:05d}", Windows(items, window).pack())
            return pa.record_batch([pa.array([part * 1000 + n], pa.int32())], names=["part"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                items.append((i, t.as_py() or b""))
                size += len(items[-1][1])
                if size >= BLOCK_BYTES:
                    yield write()
                    items, size, n = [], 0, n + 1
        if items:
            yield write()

    return trimmed(run)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, cut: bool = False,
) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, items, spans and, with cut, clean_text.

    An item's windows are its runs of ``window`` words; a shorter item is one window, one without words
    has none. n_hit counts the words inside any occurrence, items are the ids (as strings, sorted) with an
    occurring window, spans are word ranges (start, stop) of joined occurrences, clean_text is the text
    without them. Null texts have no words (clean_text null). Rows that repeat an id are judged one by
    one; windows of an item without an id hit words but name no item. Other columns are ignored; an
    empty table on either side gives no hits.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = shared_dir(spark)
    where = store(spark, folder)
    where.make()
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    written = items.repartition(-(-size // BLOCK_BYTES) or 1, "item", "text").mapInArrow(_write_blocks(where, window), "part int")
    blocks = sorted(r.part for r in saved(written, f"{folder}/written").collect())  # a number for each block
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    schema = "id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, stop: bigint>>"
    found = rows.mapInArrow(_scanner(where, blocks, cut), schema + ", clean_text string" * cut)
    return result(found.withColumnRenamed("id", id_col), folder)
