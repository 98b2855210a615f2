"""Canonical, length-limited Huffman codes over integer symbols, coded and decoded with numpy.

A block holds up to ``BLOCK`` symbols and starts at a byte of its own, so blocks decode independently.
Every ``STEP`` symbols a block notes the bit offset reached. Decoding runs all checkpoints of a file
side by side: each step looks the next bits of every lane, as many as the longest code has, up in one table.
"""

from __future__ import annotations

import numpy as np

LIMIT, BLOCK, STEP = 16, 1 << 16, 256


def width_of(lengths: np.ndarray) -> int:
    """Bits that one look-up takes: LIMIT, or the longest code where a large alphabet needs more."""
    return max(LIMIT, int(lengths.max(initial=0)))


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; 0 for symbols that never occur.

    The limit is LIMIT by default, and for more than a quarter of 2 ** LIMIT symbols two bits more than they take.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if limit is None:
        limit = max(LIMIT, (max(len(used), 1) - 1).bit_length() + 2 if len(used) > 1 << LIMIT - 2 else LIMIT)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit into codes of {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(leaves))
        ranked = both[rank]
        even = len(ranked) // 2 * 2
        packages = ranked[0:even:2] + ranked[1:even:2]
    take, total = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        total[:own] += 1
        take = 2 * (take - own)
    lengths[order] = total
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        long, most = lengths[order].astype(np.int64), width_of(lengths)
        width = np.int64(1) << (most - long)
        codes[order] = ((np.cumsum(width) - width) >> (most - long)).astype(np.uint32)
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(payload, first 32-bit word of each block, bit offset in its block of each checkpoint)."""
    parts, starts, marks, at = [], [], [], 0
    for low in range(0, len(ids), BLOCK):
        own = ids[low : low + BLOCK]
        size = lengths[own].astype(np.int64)
        end = np.cumsum(size)
        start = end - size
        word, shift = start >> 5, start & 31
        value = codes[own].astype(np.uint64) << (64 - shift - size).astype(np.uint64)
        many = int(end[-1] >> 5) + 2
        # the bits of different codes never meet, so the sums are exact and stand for bitwise or
        out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), many)
        out += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), many)
        parts.append(out.astype(np.uint64).astype(">u4").tobytes())
        starts.append(at)
        marks.append(start[::STEP].astype(np.uint32))
        at += many
    none = np.empty(0, np.uint32)
    return b"".join(parts), np.array(starts, np.int64), np.concatenate(marks) if marks else none


def decode(payload: bytes, total: int, starts: np.ndarray, marks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that encode() was given."""
    out = np.empty(total, np.uint32)
    if not total:
        return out
    codes, used, width = canonical_codes(lengths), np.flatnonzero(lengths), width_of(lengths)
    symbol, size = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    order = used[np.argsort(codes[used].astype(np.int64) << (width - lengths[used].astype(np.int64)))]
    spread = np.int64(1) << (width - lengths[order].astype(np.int64))
    symbol[: spread.sum()] = np.repeat(order, spread)
    size[: spread.sum()] = np.repeat(lengths[order], spread)
    words = np.frombuffer(payload, ">u4").astype(np.uint64)
    pair = (words << np.uint64(32)) | np.append(words[1:], np.uint64(0))
    first = np.arange(len(marks), dtype=np.int64) * STEP  # BLOCK is a multiple of STEP
    position = marks.astype(np.int64) + (starts[first // BLOCK] << 5)
    count = np.minimum(STEP, total - first)
    for k in range(min(STEP, total)):
        if k == count[-1]:  # only the last lane may be shorter
            first, position = first[:-1], position[:-1]
        if not len(first):
            break
        bits = (pair[position >> 5] >> (64 - width - (position & 31)).astype(np.uint64)) & np.uint64((1 << width) - 1)
        bits = bits.astype(np.int64)
        out[first + k] = symbol[bits]
        position = position + size[bits]
    return out
