"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Symbols are words (ASCII lower-cased), patterns are the benchmark's windows of ``size`` consecutive words; an item with
fewer words, but not none, is one shorter pattern, searched in a pass of its length. A block is two words (one, for
patterns of one word). The shift table, indexed by a block's hash, says how far a position may advance without missing
a pattern; where it says 0, the block's hash bucket gives the patterns that end in it, and their words are compared one by
one, first by hash and then by their bytes.

Null texts have no words; such documents come out with zeros. Repeated rows come out as often as they go in. Items with a
null id or without words never occur. Extra columns of either table are ignored. Whole texts are searched.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shared
from .rows import packed, unpacked
from .wordhash import mix, slices, words

WINDOW = 10
#: Benchmark characters whose patterns are broadcast at once; a larger benchmark takes several passes over the documents.
BROADCAST_CHARS = 16_000_000
_TABLE = 1 << 18
_LANE = 256
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_RAW = "doc_id long, row long, n_words long, item_ids array<string>, hit_from array<long>, hit_to array<long>"


class Patterns:
    """The windows of one length: their words' hashes and bytes, the items that have them, shift table and buckets."""

    def __init__(self, length: int, found: dict[tuple[bytes, ...], set[str]]):
        keys = list(found)
        self.length, self.texts, self.items = length, keys, [sorted(found[k]) for k in keys]
        flat = pa.array([b" ".join(k).decode("utf-8", "surrogatepass") for k in keys])
        self.hashes = words(flat)[0].reshape(len(keys), length)
        self.block = min(2, length)
        self.shift = np.full(_TABLE, length - self.block + 1, np.int32)
        for end in range(self.block - 1, length):
            part = self.hashes[:, end] if self.block == 1 else _pair(self.hashes[:, end - 1], self.hashes[:, end])
            np.minimum.at(self.shift, (part & np.uint64(_TABLE - 1)).astype(np.int64), length - 1 - end)
        last = self.hashes[:, -1] if self.block == 1 else _pair(self.hashes[:, -2], self.hashes[:, -1])
        self.order = np.argsort(last, kind="stable")
        self.bucket = last[self.order]

    def ends(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates (position of the last word, pattern) whose word hashes agree."""
        n, m = len(hashes), self.length
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        block = hashes if self.block == 1 else np.concatenate([[np.uint64(0)], _pair(hashes[:-1], hashes[1:])])
        slot = (block & np.uint64(_TABLE - 1)).astype(np.int32)
        at = np.arange(m - 1, n, _LANE)
        stop = np.minimum(at + _LANE, n)
        stops = []
        while len(at):
            move = self.shift[slot[at]]
            stops.append(at[move == 0])
            at = at + np.maximum(move, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        at = np.sort(np.concatenate(stops)) if stops else np.zeros(0, np.int64)
        at = at[row[at] == row[at - m + 1]]
        low, high = np.searchsorted(self.bucket, block[at], "left"), np.searchsorted(self.bucket, block[at], "right")
        count = high - low
        at, which = np.repeat(at, count), np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        which = self.order[which]
        for back in range(m):
            same = hashes[at - back] == self.hashes[which, m - 1 - back]
            at, which = at[same], which[same]
        return at, which


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + b)


def compile_patterns(items: list[tuple[str, str]], size: int = WINDOW) -> list[Patterns]:
    found: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        _, _, begin, end, low = words(pa.array([text], pa.string()))
        tokens = [low[a:b].tobytes() for a, b in zip(begin, end)]
        length = min(size, len(tokens))
        for i in range(len(tokens) - length + 1 if length else 0):
            found.setdefault(length, {}).setdefault(tuple(tokens[i : i + length]), set()).add(item)
    return [Patterns(n, found[n]) for n in sorted(found)]


def _scan(batch: pa.RecordBatch, patterns: list[Patterns]):
    """Per row: number of words, items, and the disjoint runs of hit words (first, last) in order."""
    hashes, row, begin, end, low = words(batch.column("text"))
    n = batch.num_rows
    first = np.searchsorted(row, np.arange(n + 1))
    cover = np.zeros(len(hashes) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for p in patterns:
        at, which = p.ends(hashes, row)
        for a, k in zip(at.tolist(), which.tolist()):
            here = range(a - p.length + 1, a + 1)
            if all(low[begin[i] : end[i]].tobytes() == t for i, t in zip(here, p.texts[k])):
                cover[here.start] += 1
                cover[a + 1] -= 1
                items.setdefault(int(row[a]), set()).update(p.items[k])
    hit = np.cumsum(cover[:-1]) > 0
    return np.diff(first), items, hit, first


def _result(ids, n_words, n_hit, items, row=None) -> pa.RecordBatch:
    names = [sorted(items.get(i, ())) for i in range(len(ids))]
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
    n_hit = np.asarray(n_hit, np.int64)
    columns = [ids, pa.array(np.asarray(n_words, np.int64)), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array(digest, pa.string()), pa.array(n_hit > 0)]
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return pa.RecordBatch.from_arrays(columns + ([] if row is None else [row]), names=names + ([] if row is None else ["_row"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, chars: int = BROADCAST_CHARS, whole: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with ``whole`` the row itself too, as _row."""
    spark: SparkSession = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(total / chars))
    carried = ["_row"] if whole else []
    docs = packed(docs, "doc_id", "text") if whole else docs
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    schema = StructType.fromDDL(SCHEMA)
    schema = StructType(schema.fields + [f for f in texts.schema.fields if f.name == "_row"])
    if passes == 1:
        sent = spark.sparkContext.broadcast(compile_patterns([tuple(r) for r in items.collect()], size))

        def search(batches):
            for batch in slices(batches):
                n_words, found, hit, first = _scan(batch, sent.value)
                total = np.concatenate([[0], np.cumsum(hit)])
                yield _result(batch.column("doc_id"), n_words, total[first[1:]] - total[first[:-1]], found, batch.column("_row") if whole else None)

        return texts.mapInArrow(search, schema)
    return _in_passes(spark, texts, items, passes, size)


def _in_passes(spark, texts, items, passes, size) -> DataFrame:
    """As many scans as the benchmark has bounded parts, each part's hits written to the shared folder, then merged per row."""
    folder = shared.folder(spark)
    texts = shared.written(texts.withColumn("row", F.monotonically_increasing_id()))
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        sent = spark.sparkContext.broadcast(compile_patterns([tuple(r) for r in part.collect()], size))

        def search(batches, sent=sent):
            for batch in slices(batches):
                n_words, found, hit, first = _scan(batch, sent.value)
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                cut = np.zeros(len(hit) + 1, bool)
                cut[first] = True
                opens = np.flatnonzero((edge[:-1] == 1) | (hit & cut[:-1]))
                closes = np.flatnonzero((edge[1:] == -1) | (hit & cut[1:]))
                at = np.searchsorted(opens, first)
                rows = range(batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("row"), pa.array(n_words.astype(np.int64)), pa.array([sorted(found.get(i, ())) for i in rows], pa.list_(pa.string()))]
                    + [pa.array([(x[at[i] : at[i + 1]] - first[i]).tolist() for i in rows], pa.list_(pa.int64())) for x in (opens, closes)],
                    names=["doc_id", "row", "n_words", "item_ids", "hit_from", "hit_to"],
                )

        texts.mapInArrow(search, _RAW).write.mode("append").parquet(f"{folder}/hits")
        sent.destroy()
    found = spark.read.parquet(f"{folder}/hits")
    hits = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("names"),
        F.array_distinct(F.flatten(F.collect_list(F.flatten(F.transform("hit_from", lambda a, i: F.sequence(a, F.element_at("hit_to", (i + 1).cast("int")))))))).alias("at"),
    )
    if "_row" in texts.columns:
        hits = hits.join(texts.select("row", "_row"), "row")
    return hits.select("doc_id", "n_words", F.size("at").cast("long").alias("n_hit"), F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"), (F.size("at") > 0).alias("contaminated"), *[c for c in hits.columns if c == "_row"])


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window."""
    return unpacked(decontaminate(docs, benchmark, whole=True).where("not contaminated"))


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(lower_az, '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
            FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
       FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
pat AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM pat),
occ AS (SELECT d.rid, d.i, d.n, p.item_id
        FROM (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
              FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)) d
        JOIN pat p ON p.n = d.n AND p.gram = d.gram),
hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS at FROM occ) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT rid, item_id FROM occ) GROUP BY rid)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)
"""
