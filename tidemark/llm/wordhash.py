"""Words and word hashes of whole Arrow batches of text, in numpy.

A word is a maximal run of ASCII digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII. In UTF-8 that is a
class of bytes, so a batch is cut into words without decoding it. Null texts and texts without a word have no words.
Work goes in chunks of about ``CHUNK`` bytes, cut between words, so memory doesn't follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
#: Bytes of text that one slice of an Arrow batch holds at most, unless a single text is longer.
SLICE = 4 << 20
ROWS = 1024

_LOWER = np.zeros(256, np.uint8)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        _LOWER[_b] = _b
    elif 65 <= _b <= 90:
        _LOWER[_b] = _b + 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds); uint64 in and out."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its rows; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batches, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds ROWS rows and about SLICE bytes of text, or one text, at most."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = text_buffers(column)
        at, n = 0, batch.num_rows
        while at < n:
            to = min(n, at + ROWS, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to


def _powers(n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = _BASE
        out = np.multiply.accumulate(out)
    return out


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first byte and end byte of each word in order, and the lower-cased bytes (0 between words)."""
    raw, offsets = text_buffers(column)
    low = _LOWER[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True  # a word ends where its text ends
    hashes, starts, ends, at = [], [], [], 0
    while at < len(low):
        to = min(len(low), at + CHUNK)
        while to < len(low) and low[to - 1] and not first[to]:
            gap = np.flatnonzero((low[to : to + CHUNK] == 0) | first[to : to + CHUNK][: len(low[to : to + CHUNK])])
            to = to + int(gap[0]) + 1 if len(gap) else min(len(low), to + CHUNK)
            to = min(to, len(low))
            if len(gap) and low[to - 1] and not first[to]:
                to -= 1
                break
        part, is_word = low[at:to], low[at:to] != 0
        opens = is_word & first[at:to]
        opens[0] |= is_word[0]
        opens[1:] |= is_word[1:] & ~is_word[:-1]
        begin = np.flatnonzero(opens)
        if len(begin):
            kept = np.flatnonzero(is_word)
            where = np.searchsorted(kept, begin)
            length = np.diff(np.append(where, len(kept)))
            exponent = np.arange(len(kept)) - np.repeat(where, length)
            value = (part[kept].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[exponent]
            hashes.append(mix(np.add.reduceat(value, where)))
            starts.append(begin + at)
            ends.append(begin + at + length)
        at = to
    none = np.zeros(0, np.int64)
    begin = np.concatenate(starts) if starts else none
    end = np.concatenate(ends) if ends else none
    row = np.searchsorted(offsets, begin, "right") - 1
    return np.concatenate(hashes) if hashes else none.astype(np.uint64), row, begin, end, low


def windows(hashes: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of k words of one row; a row of fewer words, but not none, has one run of them all."""
    n = len(hashes)
    count = np.bincount(row, minlength=rows)
    total = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[j : n - k + 1 + j] if len(total) else total
    inside = row[: len(total)] == row[k - 1 :] if len(total) else np.zeros(0, bool)
    value, where = mix(total[inside]), row[: len(total)][inside]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(count)])
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            at = begin[short] + j
            extra[has] = extra[has] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[at[has]]
        extra = mix(extra + count[short].astype(np.uint64))
        value, where = np.concatenate([value, extra]), np.concatenate([where, short])
        order = np.argsort(where, kind="stable")
        value, where = value[order], where[order]
    return value, where
