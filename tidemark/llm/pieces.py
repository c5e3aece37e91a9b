"""SentencePiece encoding and decoding by suffix-array matching.

The vocabulary of a byte-pair model file is read, not trained. A batch's distinct segments (blanks with the run that follows
them) are concatenated and indexed by a suffix array as deep as the longest piece; every piece is binary-searched for its range of
occurrences. Each occurrence is an edge between two places of the text. Edges are sorted by segment, merge order and
position and relaxed: the first edge of a segment whose ends are both still borders with exactly one border between is
taken, until none is left, which is what merging the best pair first comes to. A segment over ``LONG`` bytes goes
through the same edges with a heap. Characters without a piece become byte pieces.

Null texts give null ids, empty texts none. Text is kept as it is (the model normalises nothing but blanks); a literal U+2581
reads as a blank, as in the model itself, so such texts decode with a blank there and their round_trip is false; a null's is true. Repeated rows are
encoded each; extra columns are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import mix, text_buffers

SLICE_BYTES = 3 << 20
#: Bytes of new distinct segments that are indexed at once, unless a single segment is longer.
INDEX_BYTES = 384 << 10
LONG = 96
#: Distinct segments that a Python worker remembers, about.
REMEMBERED = 600_000
BLANK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, n_pieces long, ids array<int>, ids_sha256 string, decoded string, round_trip boolean"


class Pieces:
    """The pieces of a model file, with what search and decoding need."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)}
        self.byte_id = np.full(256, model.unk_id(), np.int32)
        self.bytes: list[bytes] = []
        self.by_text: dict[bytes, int] = {}
        search = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif i in self.special or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(BLANK, " ").encode())
                self.by_text[self.bytes[i]] = i
                search.append((-model.get_score(i), i))
        self.rank = np.full(n, np.iinfo(np.int32).max, np.int64)
        worst = None
        for place, (loss, i) in enumerate(sorted(search)):
            if worst is None or loss != worst[0]:
                worst = (loss, place)
            self.rank[i] = worst[1]  # pieces of one score are merged by position
        several = [(t, i) for t, i in self.by_text.items() if len(t.decode()) > 1]
        self.search_ids = np.array([i for _, i in several], np.int64)
        self.search_len = np.array([len(t) for t, _ in several], np.int64)
        self.depth = int(-(-self.search_len.max() // 8))
        self.search_keys = _keys(np.frombuffer(b"".join(t.ljust(8 * self.depth, b"\0") for t, _ in several), np.uint8).reshape(-1, self.depth, 8))
        chars = sorted((int.from_bytes(t, "big"), i) for t, i in self.by_text.items() if len(t.decode()) == 1)
        self.char_keys, self.char_ids = np.array([k for k, _ in chars], np.int64), np.array([i for _, i in chars], np.int32)
        self.lengths = np.array([len(t) for t in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]


def _keys(x: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte numbers of (..., 8) bytes."""
    return np.ascontiguousarray(x).view(">u8")[..., 0].astype(np.uint64)


def find_edges(text: np.ndarray, segment_end: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and piece of every occurrence in ``text`` that stays inside its segment (``segment_end``: for each byte)."""
    n, depth = len(text), pieces.depth
    padded = np.concatenate([text, np.zeros(8 * depth + 8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    left = segment_end - np.arange(n)

    def level(at: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k+7 of the suffixes, 0 beyond the segment."""
        keep = np.clip(left[at] - 8 * k, 0, 8).astype(np.uint64)
        key = _keys(eight[np.minimum(at + 8 * k, len(eight) - 1)])
        shift = (np.uint64(8) - keep) * np.uint64(8)
        return np.where(keep == 0, np.uint64(0), (key >> np.minimum(shift, np.uint64(63))) << np.minimum(shift, np.uint64(63)))

    opens = np.flatnonzero((text & 0xC0) != 0x80)
    first = level(opens, 0)
    order = np.argsort(first, kind="stable")
    suffix, keys = opens[order], [first[order]]
    group = np.concatenate([[True], keys[0][1:] != keys[0][:-1]]) if len(keys[0]) else np.zeros(0, bool)
    for k in range(1, depth):  # sort only what earlier levels left equal and unended
        keys.append(np.zeros(len(suffix), np.uint64))
        start = np.maximum.accumulate(np.where(group, np.arange(len(suffix)), 0)) if len(suffix) else np.zeros(0, np.int64)
        tied = np.flatnonzero((~group | np.append(~group[1:], False)) & (left[suffix] > 8 * k)) if len(suffix) else np.zeros(0, np.int64)
        single = np.flatnonzero(group & np.append(group[1:], True) & (left[suffix] > 8 * k)) if len(suffix) else np.zeros(0, np.int64)
        keys[k][single] = level(suffix[single], k)
        if len(tied):
            whole = np.flatnonzero(~group | np.append(~group[1:], False))
            key = level(suffix[whole], k)
            again = np.lexsort((key, start[whole]))
            suffix[whole], keys[k][whole] = suffix[whole][again], key[again]
            for j in range(1, k):
                keys[j][whole] = keys[j][whole][again]
            group = group | np.concatenate([[True], keys[k][1:] != keys[k][:-1]])
    low = np.searchsorted(keys[0], pieces.search_keys[:, 0], "left")
    top = np.where(pieces.search_len < 8, pieces.search_keys[:, 0] | (np.uint64(2**64 - 1) >> np.minimum(pieces.search_len * 8, 63).astype(np.uint64)), pieces.search_keys[:, 0])
    high = np.searchsorted(keys[0], top, "right")
    for k in range(1, depth):
        deep = np.flatnonzero((pieces.search_len > 8 * k) & (low < high))
        if len(deep):
            need = pieces.search_len[deep] - 8 * k
            bottom = pieces.search_keys[deep, k]
            upto = np.where(need < 8, bottom | (np.uint64(2**64 - 1) >> np.minimum(need * 8, 63).astype(np.uint64)), bottom)
            low[deep], high[deep] = _between(keys[k], low[deep], high[deep], bottom, False), _between(keys[k], low[deep], high[deep], upto, True)
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    at = suffix[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    size = pieces.search_len[which]
    ok = left[at] >= size
    return at[ok], at[ok] + size[ok], pieces.search_ids[which[ok]]


def _between(key: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """searchsorted within key[low:high], for each value."""
    low, high = low.copy(), high.copy()
    while (live := low < high).any():
        middle = (low + high) // 2
        seen = key[np.minimum(middle, len(key) - 1)]
        goes = live & ((seen <= value) if right else (seen < value))
        low, high = np.where(goes, middle + 1, low), np.where(live & ~goes, middle, high)
    return low


def relax(n: int, first: np.ndarray, segment: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray, border: np.ndarray) -> np.ndarray:
    """``border`` (whether a piece begins at a byte) after all merges of short segments, which begin at ``first``."""
    order = np.argsort((segment.astype(np.uint64) << np.uint64(40)) | (rank.astype(np.uint64) << np.uint64(8)) | (start - first[segment]).astype(np.uint64))
    segment, start, end = segment[order].astype(np.int32), start[order].astype(np.int32), end[order].astype(np.int32)
    active = np.zeros(int(segment.max()) + 1 if len(segment) else 0, bool)
    while len(start):
        inside = np.concatenate([[0], np.cumsum(border, dtype=np.int32)])
        between = inside[end] - inside[np.minimum(start + 1, n)]
        ends_on = border[np.minimum(end, n - 1)] | (end == n)
        alive = border[start] & ends_on & (between > 0)
        segment, start, end, ready = segment[alive], start[alive], end[alive], between[alive] == 1
        at = np.flatnonzero(ready)
        if not len(at):
            break
        of = segment[at]
        best = at[np.concatenate([[True], of[1:] != of[:-1]])]
        length = end[best] - start[best] - 1
        inner = np.repeat(start[best] + 1, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        border[inner] = False
        active[:] = False
        active[of] = True
        going = active[segment]  # a segment without an edge that is ready is done
        segment, start, end = segment[going], start[going], end[going]
    return border


def _heap(start: list[int], end: list[int], rank: list[int], border: np.ndarray, first: int, last: int) -> None:
    """The same for one long segment: best edge first."""
    edge = {(a, b): r for a, b, r in zip(start, end, rank)}
    places = [p for p in range(first, last) if border[p]] + [last]
    following, before = dict(zip(places, places[1:])), dict(zip(places[1:], places))
    queue = []

    def offer(a):
        b = following.get(a)
        c = following.get(b) if b is not None else None
        if c is not None and (a, c) in edge:
            heapq.heappush(queue, (edge[a, c], a, b, c))

    for p in places[:-1]:
        offer(p)
    while queue:
        _, a, b, c = heapq.heappop(queue)
        if following.get(a) == b and following.get(b) == c:
            following[a], before[c] = c, a
            del following[b]
            border[b] = False
            offer(a)
            if a in before:
                offer(before[a])


def encode_segments(text: np.ndarray, begin: np.ndarray, end: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments text[begin:end] in order, and where each segment's ids start (one more at the end)."""
    total = np.cumsum(end - begin)
    ids, cuts, at = [], [np.zeros(1, np.int64)], 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + INDEX_BYTES, "right")))
        part, cut = _encode_part(text, begin[at:to], end[at:to], pieces)
        ids.append(part)
        cuts.append(cut[1:] + cuts[-1][-1])
        at = to
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate(cuts)


def _encode_part(text: np.ndarray, begin: np.ndarray, end: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    length = end - begin
    own = np.concatenate([[0], np.cumsum(length)])
    joined = text[np.repeat(begin - own[:-1], length) + np.arange(own[-1])]
    n = len(joined)
    segment = np.repeat(np.arange(len(begin)), length)
    start, stop, piece = find_edges(joined, own[1:][segment], pieces)
    rank = pieces.rank[piece]
    border = (joined & 0xC0) != 0x80
    of = segment[start]
    long = length[of] > LONG
    border = relax(n, own, of[~long], start[~long], stop[~long], rank[~long], border)
    if long.any():
        a, b, r, s = start[long], stop[long], rank[long], of[long]
        order = np.argsort(s, kind="stable")
        a, b, r, s = a[order], b[order], r[order], s[order]
        cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
        for i, j in zip(cut[:-1], cut[1:]):
            _heap(a[i:j].tolist(), b[i:j].tolist(), r[i:j].tolist(), border, int(own[s[i]]), int(own[s[i] + 1]))
    return _ids(joined, segment, len(begin), border, start, stop, piece, pieces)


def _ids(joined, segment, segments, border, start, stop, piece, pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces between borders: the edges that were taken, single characters, and bytes of those without a piece."""
    n = len(joined)
    at = np.flatnonzero(border)
    size = np.diff(np.append(at, n))
    inside = np.concatenate([[0], np.cumsum(border, dtype=np.int32)])
    taken = border[start] & (inside[stop] - inside[start] == 1)
    taken[taken] &= (stop[taken] == n) | border[np.minimum(stop[taken], n - 1)]
    ids = np.full(len(at), -1, np.int32)
    ids[inside[start[taken]]] = piece[taken]
    single = np.flatnonzero(ids < 0)
    key = np.zeros(len(single), np.int64)
    for k in range(4):
        has = size[single] > k
        key[has] = key[has] * 256 + joined[at[single[has]] + k]
    where = np.minimum(np.searchsorted(pieces.char_keys, key), len(pieces.char_keys) - 1)
    known = pieces.char_keys[where] == key
    ids[single[known]] = pieces.char_ids[where[known]]
    count = np.where(ids < 0, size, 1)
    flat = np.repeat(ids, count)
    loose = np.flatnonzero(flat < 0)
    own = np.cumsum(count) - count
    flat[loose] = pieces.byte_id[joined[np.repeat(at, count)[loose] + loose - np.repeat(own, count)[loose]]]
    per = np.bincount(segment[at], weights=count, minlength=segments).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(per)])


#: By model file; a Python worker keeps them for its later tasks.
_ENCODERS: dict = {}


class Encoder:
    """Encodes batches, remembering the segments it has seen, a bounded number of them."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.hashes, self.first, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def alone(self, text: str) -> np.ndarray:
        """Ids of one text without what is remembered."""
        raw, _ = text_buffers(pa.array([" " + text.replace(BLANK, " ")], pa.large_string()))
        blank = raw == 32
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        opens[0] = True
        begin = np.flatnonzero(opens)
        return encode_segments(raw, begin, np.append(begin[1:], len(raw)), self.pieces)[0]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids of all texts in order, the n+1 offsets of the texts in them, and the texts that they decode to.

        Segments are remembered by a hash. Pieces spell the text, bytes included, so a text whose ids don't spell it has met the hash of another segment, and is encoded alone."""
        ids, offsets = self._encode(column)
        texts, back = column.to_pylist(), decode(ids, offsets, self.pieces)
        wrong = [k for k, (a, b) in enumerate(zip(texts, back.to_pylist())) if a and a.replace(BLANK, " ") != b]
        if wrong:
            parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            for k in wrong:
                parts[k] = self.alone(texts[k])
            ids, offsets = np.concatenate(parts).astype(np.int32), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            back = decode(ids, offsets, self.pieces)
        return ids, offsets, back

    def _encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = pa.array([None if t is None or t == "" else " " + t.replace(BLANK, " ") for t in column.to_pylist()], pa.large_string())
        raw, offsets = text_buffers(column)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        blank = raw == 32
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        opens[offsets[:-1][offsets[:-1] < len(raw)]] = True
        begin = np.flatnonzero(opens)
        end = np.append(begin[1:], len(raw))
        hashes = _hash(raw, begin, end)
        distinct, example, of = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        known = np.searchsorted(self.hashes, distinct)
        new = self.hashes[np.minimum(known, len(self.hashes) - 1)] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if new.any():
            ids, cut = encode_segments(raw, begin[example[new]], end[example[new]], self.pieces)
            together = np.concatenate([self.hashes, distinct[new]])
            order = np.argsort(together, kind="stable")
            self.first = np.concatenate([self.first, cut[:-1] + len(self.ids)])[order]
            self.count = np.concatenate([self.count, np.diff(cut)])[order]
            self.hashes, self.ids = together[order], np.concatenate([self.ids, ids])
        known = np.searchsorted(self.hashes, distinct)[of]
        count = self.count[known]
        total = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.repeat(self.first[known] - total[:-1], count) + np.arange(total[-1])]
        return flat, total[np.searchsorted(begin, offsets)]


def _hash(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each segment, in parts of about a million bytes."""
    out = np.zeros(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + (1 << 20))))
        length = end[i:j] - begin[i:j]
        own = np.cumsum(length) - length
        exponent = np.arange(length.sum()) - np.repeat(own, length)
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64)]))
        out[i:j] = mix(np.add.reduceat((raw[begin[i] : end[j - 1]].astype(np.uint64) + np.uint64(1)) * power[exponent], own) + length.astype(np.uint64))
        i = j
    return out


def decode(ids: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> pa.Array:
    """Texts of the ids between the offsets, without the blank that encoding puts before each."""
    length = pieces.lengths[ids]
    total = np.concatenate([[0], np.cumsum(length)])
    flat = pieces.flat[np.repeat(pieces.starts[ids] - total[:-1], length) + np.arange(total[-1])].tobytes()
    cut = total[offsets]
    return pa.array([flat[a + (flat[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.string())


def encode_decode(docs: DataFrame, path: str = MODEL, decoded: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_pieces, ids, ids_sha256 (of little-endian 32-bit ids), decoded (if asked for), round_trip."""

    def run(batches):
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(Pieces(path))
        encoder = _ENCODERS[path]
        for batch in _cut(batches):
            texts = batch.column("text")
            ids, offsets, back = encoder.encode(texts)
            null = np.array(texts.is_null())
            same = [a is None or a == b for a, b in zip(texts.to_pylist(), back.to_pylist())]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(null)) if null.any() else pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            raw = memoryview(ids.astype("<i4").tobytes())
            digest = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), lists, pa.array(digest), back if decoded else pa.nulls(len(null), pa.string()), pa.array(same)],
                names=["doc_id", "n_pieces", "ids", "ids_sha256", "decoded", "round_trip"],
            )

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
    return out if decoded else out.drop("decoded")


def _cut(batches):
    for batch in batches:
        _, offsets = text_buffers(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = min(batch.num_rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to
