"""Token ids of whole texts, written as Huffman-coded binary files in ascending id order, and read back.

Writing takes two passes over partitions that a range shuffle put in order. The first tokenizes, stages
the ids in files of at most about ``FILE_TOKENS`` ids and counts them; the counts of all make one code. The
second codes each staged file. So no task holds more than one file's ids, however large its partition is. A
file is complete or absent, named by its partition and number, and equal when a task is repeated, so
executors may be lost at any time.

A file: the magic bytes, the length of a JSON header, the header, then its parts: zlib-packed code lengths,
the documents as an Arrow stream (doc_id, n_tokens), block starts, checkpoints, payload. Documents are never
parted, so only one that is itself longer makes a file longer.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docquill.llm import huffman
from docquill.llm.common import Store, bounded_batches, remove, saved, shared_dir, store, trimmed, worker_cache

MAGIC = b"DQTOK001"
WORD_LIMIT, PIECE_LIMIT = 150_000, 150_000  # words and pieces that a worker remembers
FILE_TOKENS, PARTITION_BYTES = 4 << 20, 128 << 20

# The normaliser and pre-tokenizer that WordEncoder reproduces word by word; others are run on whole texts.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# Words of these characters alone are cut here: composed already, each lower-cased to one character.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_LETTERS = "a-zß-öø-ÿ"
_PIECES = re.compile(f"\n|\0|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\n\0]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(_HIDDEN)}
_AS_BYTES = {chr(c): "".join(_BYTE_CHARS[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
_TO_BYTES = str.maketrans(_AS_BYTES)


class _Numbered(dict):
    """Numbers its keys as they come and keeps those that are new."""

    def __missing__(self, key):
        self.new.append(key)
        self[key] = n = len(self)
        return n

    def __init__(self):
        super().__init__()
        self.new = []


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[s:s + n] for all s, n, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class WordEncoder:
    """Token ids of texts, each distinct word tokenized once while the caches last.

    No token of this kind of vocabulary crosses white space, and none depends on a neighbouring word.
    Words beyond ``_PLAIN``, or with a special token's opening, go to the library's whole encoder; the
    rest are cut into pieces here and each piece goes to the library's model.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        pre = (config["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        added = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in config["added_tokens"])
        self.by_word = config["normalizer"] == _NORMALIZER and len(pre) == 2 and added
        self.by_word = self.by_word and pre[0].get("pattern") == {"Regex": _SPLIT} and pre[1].get("type") == "ByteLevel"
        self.by_word = self.by_word and not pre[1].get("add_prefix_space")
        self.model = self.tokenizer.model
        self._forget_words()
        self._forget_pieces()

    def _forget_words(self) -> None:
        self.words, self.flat, self.start, self.size = _Numbered(), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _forget_pieces(self) -> None:
        self.pieces, self.piece_flat = _Numbered(), np.empty(0, np.uint32)
        self.pieces.update({"\n": 0, "\0": 1})
        self.piece_start, self.piece_size = np.zeros(2, np.int64), np.zeros(2, np.int64)

    def _learn_pieces(self, ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.piece_start = np.concatenate([self.piece_start, len(self.piece_flat) + np.cumsum(size) - size])
        self.piece_size = np.concatenate([self.piece_size, size])
        self.piece_flat = np.concatenate([self.piece_flat, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))])

    def _learn(self) -> None:
        """Adds the tokens of all words that are new."""
        new, self.words.new = self.words.new, []
        if not new:
            return
        if len(self.pieces) > PIECE_LIMIT:
            self._forget_pieces()
        texts = b"\n".join(new).decode("utf-8", "replace").split("\n")
        rare = [w for w in texts if not _PLAIN.fullmatch(w) or "<|" in w]
        if rare:
            odd = set(rare)
            texts = ["\0" if w in odd else w for w in texts]
        found = _PIECES.findall("\n".join(texts).lower())
        found.append("\n")
        piece = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        fresh, self.pieces.new = self.pieces.new, []
        tokenize = self.model.tokenize
        self._learn_pieces([[t.id for t in tokenize(p.translate(_TO_BYTES))] for p in fresh])
        if rare:
            base = len(self.pieces)
            for k in range(len(rare)):
                self.pieces["\0", base + k] = base + k
            self._learn_pieces([e.ids for e in self.tokenizer.encode_batch(rare, add_special_tokens=False)])
            piece[piece == 1] = np.arange(base, base + len(rare))
        size = self.piece_size[piece]
        ends = np.cumsum(size)[piece == 0]
        sizes = np.diff(ends, prepend=0)
        self.start = np.concatenate([self.start, len(self.flat) + ends - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, _gather(self.piece_flat, self.piece_start[piece], size)])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if not self.by_word:
            ids = [e.ids for e in self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
            return np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        if len(self.words) > WORD_LIMIT:
            self._forget_words()
        number, parts = self.words.__getitem__, []
        for t in texts:
            words = t.split()
            parts.append(np.fromiter(map(number, words), np.int32, len(words)))
        self._learn()
        index = np.concatenate(parts) if parts else np.empty(0, np.int32)
        size = self.size[index]
        ends = np.concatenate([[0], np.cumsum(size)])
        words = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return _gather(self.flat, self.start[index], size), np.diff(ends[words])


def encoder(path: str) -> WordEncoder:
    cache = worker_cache("token_files")
    if cache.get("path") != path:
        cache["encoder"], cache["path"] = WordEncoder(path), path
    return cache["encoder"]


def _chunks(column: pa.ChunkedArray | pa.Array, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """A string column as lists of bytes of about ``most`` bytes; null is empty."""
    own, size = [], 0
    for x in column.cast(pa.binary()):
        own.append(x.as_py() or b"")
        size += len(own[-1])
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


DOCS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


class _Stage:
    """Ids as they come, flushed to a file of their own before there are more than ``most``."""

    def __init__(self, where: Store, part: int, kind: type, most: int):
        self.where, self.part, self.kind, self.most, self.files = where, part, np.dtype(kind), most, 0
        self.codec = pa.Codec("zstd", 1)
        self._clear()

    def _clear(self) -> None:
        self.packed, self.docs, self.total = [], [], 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Takes documents; yields what each flush gives."""
        while len(sizes):
            fit = int(np.searchsorted(np.cumsum(sizes), self.most - self.total, "right"))
            if not fit and self.total:
                yield self.flush()
                continue
            fit = max(fit, 1)
            own = ids[: sizes[:fit].sum()].astype(self.kind)
            self.packed.append((len(own), self.codec.compress(own.tobytes(), asbytes=True)))
            self.docs.append(pa.record_batch([doc_ids.slice(0, fit), pa.array(sizes[:fit].astype(np.int64))], schema=DOCS))
            self.total += len(own)
            doc_ids, ids, sizes = doc_ids.slice(fit), ids[len(own) :], sizes[fit:]

    def flush(self) -> tuple[int, int, int]:
        """(number of the file, its documents, its ids)."""
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, DOCS) as out:
            for d in self.docs:
                out.write_batch(d)
        table = sink.getvalue().to_pybytes()
        head = json.dumps({"kind": self.kind.name, "docs": len(table), "parts": [(n, len(b)) for n, b in self.packed]}).encode()
        self.where.put(f"stage-{self.part:06d}-{self.files:06d}", len(head).to_bytes(8, "little") + head + table + b"".join(b for _, b in self.packed))
        done = self.files, sum(map(len, self.docs)), self.total
        self.files += 1
        self._clear()
        return done


def _stager(where: Store, tokenizer: str, end_id: int, vocab: int, most: int):
    kind = np.uint16 if vocab <= 1 << 16 else np.uint32
    names = ["part", "file", "n_docs", "n_tokens", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = TaskContext.get().partitionId(), np.zeros(vocab, np.int64)
        enc, stage = encoder(tokenizer), _Stage(where, part, kind, most)
        none = pa.array([[]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.int64()))

        def row(file: int, n_docs: int, n_tokens: int, ids: pa.Array = none[0], n: pa.Array = none[1]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64()), ids, n], names=names)

        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(1)):
                ids, n = enc.encode(texts)
                full = np.insert(ids, np.cumsum(n), end_id)
                counts += np.bincount(full, minlength=vocab)
                for done in stage.add(batch.column(0).slice(at, len(texts)), full, n + 1):
                    yield row(*done)
                at += len(texts)
        if stage.docs:
            yield row(*stage.flush())
        seen = np.flatnonzero(counts)
        if len(seen):  # a row without a file: what occurred in this partition
            yield row(-1, 0, 0, pa.array([seen.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts[seen]], pa.list_(pa.int64())))

    return trimmed(run)


def _coder(stage: Store, out: Store, packed_lengths: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("token_files")
        lengths = np.frombuffer(zlib.decompress(packed_lengths), np.uint8)
        codes = huffman.canonical_codes(lengths)
        codec = pa.Codec("zstd")
        for batch in batches:
            for k, part, file in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                data = memoryview(stage.get(f"stage-{part:06d}-{file:06d}"))
                at = 8 + int.from_bytes(data[:8], "little")
                head = json.loads(bytes(data[8:at]))
                kind, table = np.dtype(head["kind"]), bytes(data[at : at + head["docs"]])
                at, ids = at + head["docs"], []
                for n, size in head["parts"]:
                    ids.append(np.frombuffer(codec.decompress(data[at : at + size], n * kind.itemsize), kind))
                    at += size
                ids = np.concatenate(ids)
                payload, starts, marks = huffman.encode(ids, lengths, codes)
                pieces = [packed_lengths, table, starts.astype("<i8").tobytes(), marks.astype("<u4").tobytes(), payload]
                header = json.dumps({"tokens": len(ids), "block": huffman.BLOCK, "step": huffman.STEP, "parts": list(map(len, pieces))}).encode()
                out.put(f"tokens-{k:08d}.dqt", MAGIC + len(header).to_bytes(8, "little") + header + b"".join(pieces))
                yield pa.record_batch([pa.array([k], pa.int64()), pa.array([len(ids)], pa.int64())], names=["file", "n_tokens"])

    return trimmed(run)


def _partitions(docs: DataFrame) -> int:
    """The session's number of shuffle partitions, or one for each PARTITION_BYTES of input where that is known and more."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, -(-size // PARTITION_BYTES)) if size < 1 << 60 else usual


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes all texts to ``folder``; returns its manifest (file, n_docs, n_tokens), also kept there.

    Each text's ids (add_special_tokens off) are followed by end_id. Rows go in ascending id order, ties
    by a hash of the text, rows without an id first; a null text is empty. Repeated rows are written as often
    as they occur, other columns of docs are ignored, an empty table gives no files. Ids may be repeated, or
    missing, in any number of rows: ranges part within one id, too. A text is read whole by one task.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    vocab = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    work = shared_dir(spark)
    stage, out = store(spark, f"{work}/stage"), store(spark, folder)
    stage.make()
    out.make()
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.asc_nulls_first("id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(_partitions(docs), *order).sortWithinPartitions(*order, "text")
    schema = "part int, file int, n_docs bigint, n_tokens bigint, ids array<int>, counts array<bigint>"
    staged = saved(rows.mapInArrow(_stager(stage, tokenizer, end_id, vocab, file_tokens), schema), f"{work}/counts")
    # as many rows as the vocabulary has ids
    sums = staged.select(F.explode(F.arrays_zip("ids", "counts")).alias("z")).groupBy("z.ids").agg(F.sum("z.counts").alias("n")).collect()
    counts = np.zeros(vocab, np.int64)
    for i, c in sums:
        counts[i] = c
    packed = zlib.compress(huffman.code_lengths(counts).tobytes(), 9)
    files = numbered_files(staged.where("file >= 0").select("part", "file", "n_docs", "n_tokens"), work)
    done = files.select("k", "part", "file").mapInArrow(_coder(stage, out, packed), "file bigint, n_tokens bigint")
    done.write.mode("overwrite").parquet(f"{work}/done")
    manifest = saved(files.select(F.col("k").alias("file"), "n_docs", "n_tokens", "before"), f"{folder}/manifest")
    remove(spark, work)
    return manifest


def numbered_files(files: DataFrame, work: str) -> DataFrame:
    """files with k, their numbers in order, and before, the ids of all files before them.

    Sums by partition come first; only these, a row for each partition, pass one window.
    """
    parts = files.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("k0"), F.coalesce(F.sum("t").over(past), F.lit(0)).alias("t0"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    out = files.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    out = out.select((F.col("k0") + F.col("file")).alias("k"), "part", "file", "n_docs", "n_tokens", (F.col("t0") + F.col("own")).alias("before"))
    # coding goes on in parallel, a few files a task
    return saved(out.repartition(F.col("k")), f"{work}/files")


def read_file(data: bytes) -> tuple[pa.Table, np.ndarray]:
    """(documents: doc_id and n_tokens, all ids) of one file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    at = 16 + int.from_bytes(data[8:16], "little")
    header, parts = json.loads(data[16:at]), []
    for size in header["parts"]:
        parts.append(data[at : at + size])
        at += size
    lengths = np.frombuffer(zlib.decompress(parts[0]), np.uint8)
    ids = huffman.decode(parts[4], header["tokens"], np.frombuffer(parts[2], "<i8"), np.frombuffer(parts[3], "<u4"), lengths)
    return pa.ipc.open_stream(parts[1]).read_all(), ids


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files alone; ids are little-endian unsigned 32-bit integers."""
    where = store(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("token_files")
        for batch in batches:
            for k, before in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
                docs, ids = read_file(where.get(f"tokens-{k:08d}.dqt"))
                raw, size, doc_ids = ids.astype("<u4", copy=False), docs["n_tokens"].to_numpy(), docs["doc_id"].combine_chunks()
                ends = np.cumsum(size)
                starts, low = ends - size, 0
                while low < len(ends):  # batches of bounded size
                    high = max(low + 1, int(np.searchsorted(ends, starts[low] + (1 << 20), "right")))
                    own = [raw[a:b].tobytes() for a, b in zip(starts[low:high], ends[low:high], strict=True)]
                    yield pa.record_batch(
                        [doc_ids.slice(low, high - low), pa.array(starts[low:high] + before), pa.array(size[low:high]), pa.array(own, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"]
                    )
                    low = high

    files = spark.read.parquet(f"{folder}/manifest").select("file", "before")
    return files.mapInArrow(trimmed(run), "doc_id bigint, start bigint, n_tokens bigint, ids binary")
