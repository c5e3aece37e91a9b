"""N-gram Jaccard join by chosen paths.

A document is the set of its runs of five words (fewer words: one run of them all). Documents with equal sets are one class from the
start. Each set gets ``COORDINATES`` min-hashes, a sample of its tokens in random orders. A run splits the sets on two sampled
coordinates: sets that hold the same token there go to one node. A node that holds over ``SMALL`` sets is split again by
two coordinates of its own that no node above it used, unless its sets are alike already (estimated from its tokens' frequencies) or all such nodes
together have no more than ``WORK`` pairs a set; what stays is brute-forced.
All runs draw from the same coordinates, so a pair's chance is a mixture: of 64 coordinates it agrees in Bin(64, s), and given a share x of them a
run loses it with a chance of at most ((1 - x) / x)². ``runs(recall)`` averages over that mixture and repeats runs until the target recall, at any depth.

Brute force is exact and in two steps: min-hashes select which sets of a node may have a partner, then their whole sets are
compared. A node of many sets or long ones is cut into blocks, each pair of blocks is a piece of work of its own, and no pair of sets
is ever a row: a piece of work returns for each set its number of links and a root it hangs from. A pair that meets in
several nodes counts in the first of them only. Classes are the connected components of the links. Joins on nodes, classes and copies
go by ``join_hot``, so none of them is a single task's.

``n_links`` never counts a pair that isn't a link, and may miss one with the chance that the recall leaves: it is a lower bound.
Null texts and texts without words have no partners. Repeated rows are copies of each other. A null doc_id gets the class of its
copies, or null. Empty tables give empty tables. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .rows import packed, unpacked
from .shared import join_hot, written
from .wordhash import mix, slices, windows, words

WORDS, SIMILARITY = 5, (4, 5)  # the similarity as a fraction
COORDINATES, SMALL, BLOCK, DEPTH = 64, 64, 512, 12
#: Of COORDINATES equal min-hashes, fewer than this rule a pair out (a pair of similarity 0.8 is below it once in a million).
AGREE = 35
#: So many pairs a set are compared rather than split further.
WORK = 1024
#: Tokens of a block of sets, about.
BLOCK_TOKENS = 1 << 20
#: Longs of the filter that tells which sets to fetch: four bits a set wanted, 64 MB at most; beyond its capacity more are fetched than needed.
LEAST_WORDS, MOST_WORDS = 1 << 12, 1 << 23


def lost(runs: int, similarity: float = 0.8) -> float:
    """The chance that so many runs miss a pair: over the coordinates it agrees in, a branching process with two tries a node in each run."""
    out = 0.0
    for agree in range(COORDINATES + 1):
        x = agree / COORDINATES
        chance = math.comb(COORDINATES, agree) * similarity**agree * (1 - similarity) ** (COORDINATES - agree)
        out += chance * (1.0 if x <= 0.5 else ((1 - x) / x) ** (2 * runs))
    return out


def runs(recall: float = 0.9999, similarity: float = 0.8) -> int:
    """The fewest runs with the recall."""
    return next((r for r in range(1, COORDINATES // 2) if lost(r, similarity) <= 1 - recall), COORDINATES // 2)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Sorted distinct shingles of each row."""
    hashes, row, *_ = words(batch.column("text"))
    value, where = windows(hashes, row, batch.num_rows, WORDS)
    cut = np.searchsorted(where, np.arange(batch.num_rows + 1))
    return [np.unique(value[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def _key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sketch(batches):
    times, plus = _seeds()
    for batch in slices(batches):
        sets = _sets(batch)
        flat = np.concatenate(sets)
        size = np.array([len(s) for s in sets], np.int64)
        some = np.flatnonzero(size)
        low = np.zeros((len(sets), COORDINATES), np.int32)
        if len(some):
            at = (np.cumsum(size) - size)[some]
            for c in range(COORDINATES):
                x = flat * times[c] + plus[c]
                low[some, c] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), at).view(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES), pa.array(low.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_key(s) for s in sets], pa.binary()), pa.array(size), lists], names=["doc_id", "key", "size", "low"])


def _grouped(batches, columns: list[str]):
    """Tables that hold whole groups; the rows come sorted by the columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([np.asarray(batch.column(batch.schema.get_field_index(c))) for c in columns])
        new = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
        first = ids[:, 0]
        if held and (first != last).any():
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))])
            held, batch = [], batch.slice(int(new[-1]))
        held.append(batch)
        last = ids[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, columns: list[str]) -> np.ndarray:
    ids = np.stack([np.asarray(table.column(c)) for c in columns])
    return np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1, [table.num_rows]])


def _first_common(leaves: np.ndarray, a: np.ndarray, b: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Whether the smallest node that both sets are in is this one. ``leaves``: sorted, padded rows."""
    least = np.full(len(a), np.iinfo(np.int64).max)
    for c in range(leaves.shape[1]):
        x = leaves[a, c]
        found = (leaves[b] == x[:, None]).any(1) & (x != np.iinfo(np.int64).max)
        least = np.where(found & (x < least), x, least)
    return least == node


def _apart(leaves: np.ndarray, node: int) -> np.ndarray:
    """The same for all pairs of a group of one node: which have no smaller node in common."""
    row, col = np.nonzero(leaves < node)
    _, which, count = np.unique(leaves[row, col], return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    ok = count[which] > 1
    m = np.zeros((len(leaves), int((count > 1).sum())), np.float32)
    m[row[ok], shared[which[ok]]] = 1
    return (m @ m.T) == 0


def _padded(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.to_pylist()
    width = max(map(len, lists), default=1)
    return np.array([sorted(x) + [np.iinfo(np.int64).max] * (width - len(x)) for x in lists], np.int64)


def _pairs(begin: np.ndarray, end: np.ndarray, block: np.ndarray, i: np.ndarray, j: np.ndarray, most: int = 1 << 18):
    """Pairs (a, b) of rows of the same group, of its two blocks, in parts."""
    left, right = [], []
    held = 0
    for a, b in zip(begin.tolist(), end.tolist()):
        at = np.arange(a, b)
        if i[a] == j[a]:
            sides = [(at[k : k + 256], at[k:]) for k in range(0, len(at), 256)]
        else:
            mine, other = at[block[a:b] == i[a]], at[block[a:b] == j[a]]
            sides = [(mine[k : k + 256], other) for k in range(0, len(mine), 256)]
        for x, y in sides:
            p, q = np.repeat(x, len(y)), np.tile(y, len(x))
            if i[a] == j[a]:
                ok = p < q
                p, q = p[ok], q[ok]
            left.append(p)
            right.append(q)
            held += len(p)
            if held >= most:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


_GROUP = ["node", "i", "j"]


def _alike(low: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) may be similar, by their sizes and min-hashes."""
    ok = np.flatnonzero(np.minimum(size[a], size[b]) * SIMILARITY[1] >= np.maximum(size[a], size[b]) * SIMILARITY[0])
    a, b = a[ok], b[ok]
    same = np.zeros(len(a), np.uint8)
    for c in range(COORDINATES):
        same += low[a, c] == low[b, c]
    return ok[same >= AGREE]


def _select(batches):
    """Which sets of a group may have a partner there, by their min-hashes and sizes."""
    for table in _grouped(batches, _GROUP):
        node, i, j = (np.asarray(table.column(c)) for c in _GROUP)
        block, size = np.asarray(table.column("block")), np.asarray(table.column("size"))
        low = np.asarray(table.column("low").combine_chunks().flatten()).reshape(-1, COORDINATES)
        leaves = _padded(table.column("leaves"))
        chosen, bounds = np.zeros(table.num_rows, bool), _bounds(table, _GROUP)
        large = np.flatnonzero(np.diff(bounds) > SMALL)
        for a, b in _pairs(np.delete(bounds[:-1], large), np.delete(bounds[1:], large), block, i, j):
            ok = _alike(low, size, a, b)
            for k in range(0, len(ok), 1 << 16):
                x, y = a[ok[k : k + (1 << 16)]], b[ok[k : k + (1 << 16)]]
                first = _first_common(leaves, x, y, node[x])
                chosen[x[first]] = chosen[y[first]] = True
        for a, b in zip(bounds[large].tolist(), bounds[large + 1].tolist()):
            pairs = _apart(leaves[a:b], node[a])
            pairs = np.triu(pairs, 1) if i[a] == j[a] else pairs & (block[a:b, None] == i[a]) & (block[None, a:b] == j[a])
            for k in range(0, b - a, 32):  # a set with a partner needs no other
                x, y = np.nonzero(pairs[k : k + 32] & ~(chosen[a + k : min(a + k + 32, b), None] & chosen[None, a:b]))
                x, y = x + a + k, y + a
                ok = _alike(low, size, x, y)
                chosen[x[ok]] = chosen[y[ok]] = True
        at = np.flatnonzero(chosen)
        if len(at):
            yield from table.select(["node", "i", "j", "block", "key", "copies", "leaves"]).take(pa.array(at)).combine_chunks().to_batches()


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a group's sets, by products of 0-1 matrices over the tokens that occur twice."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.append(start, len(flat)))
    token = np.cumsum(count > 1) - 1
    per = np.repeat(token, count)
    ok = np.repeat(count > 1, count)
    owner, per = owner[ok], per[ok]
    n, out = len(sets), np.zeros((len(sets), len(sets)), np.float32)
    step = max(64, (1 << 22) // n)
    for at in range(0, int(per[-1]) + 1 if len(per) else 0, step):
        a, b = np.searchsorted(per, [at, at + step])
        width = min(step, int(per[b - 1]) - at + 1)
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], per[a:b] - at] = 1
        out += m @ m.T
    return out


def _verify(batches):
    """For each set of a group its links there (in documents) and a root, from whole sets."""
    for table in _grouped(batches, _GROUP):
        bounds = _bounds(table, _GROUP)
        node, i, j = (np.asarray(table.column(c)) for c in _GROUP)
        block, copies = np.asarray(table.column("block")), np.asarray(table.column("copies"))
        leaves, keys = _padded(table.column("leaves")), table.column("key").to_pylist()
        raw = table.column("shingles").to_pylist()
        links, root = np.zeros(table.num_rows, np.int64), np.arange(table.num_rows)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in raw[a:b]]
            size = np.array([len(s) for s in sets], np.float64)
            both = _intersections(sets).astype(np.float64)
            near = both * SIMILARITY[1] >= SIMILARITY[0] * (size[:, None] + size[None, :] - both)
            if i[a] != j[a]:
                near &= (block[a:b, None] == i[a]) & (block[None, a:b] == j[a])
            x, y = np.nonzero(np.triu(near, 1) if i[a] == j[a] else near)
            ok = _apart(leaves[a:b], node[a])[x, y]
            links[a:b] += np.bincount(x[ok], weights=copies[a + y[ok]], minlength=b - a).astype(np.int64) + np.bincount(y[ok], weights=copies[a + x[ok]], minlength=b - a).astype(np.int64)
            label = np.arange(b - a)
            while len(x):
                low = label.copy()
                np.minimum.at(low, x, label[y])
                np.minimum.at(low, y, label[x])
                low = low[low]
                if (low == label).all():
                    break
                label = low
            root[a:b] = label + a
        at = np.flatnonzero((links > 0) | (root != np.arange(table.num_rows)))
        yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in at], pa.binary()), pa.array(links[at]), pa.array([keys[k] for k in root[at]], pa.binary())], names=["key", "links", "root"])


def _fetcher(wanted, bits: int):
    """Whole sets of the documents whose key the filter holds, each key once a task at most while it is remembered."""

    def fetch(batches):
        seen: set[bytes] = set()
        for batch in slices(batches):
            keys, values = [], []
            for shingles in _sets(batch):
                key = _key(shingles)
                if key is None or key in seen:
                    continue
                bit = int.from_bytes(key[:7], "big") % bits
                if int(wanted.value[bit // 64]) >> (bit % 64) & 1:
                    keys.append(key)
                    values.append(shingles.tobytes())
                    if len(seen) < 100_000:
                        seen.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["key", "shingles"])

    return fetch


def _leaves(sets: DataFrame, size: int, recall: float) -> DataFrame:
    """(node, key, size, n, tokens): the nodes of two sets or more that are brute-forced."""
    tries = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(runs(recall)) for c in _two(r)])
    nodes = sets.select("key", "size", "low", F.explode(tries).alias("t")).select("key", "size", F.array("t.c").alias("used"), F.xxhash64("t.r", "t.c", F.element_at("low", F.col("t.c") + 1)).alias("node"))
    kept, done, total = ["node", "key", "size", "n", "tokens"], None, size * 2 * runs(recall)
    for depth in range(DEPTH + 1):
        counts = nodes.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("tokens")).where("n > 1")
        met = written(join_hot(nodes, counts, "node", "n", total).select(*kept, "used"))
        small, big = met.where(F.col("n") <= SMALL).select(*kept), met.where(F.col("n") > SMALL)
        done = small if done is None else done.union(small)
        work = big.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count("*").alias("rows")).first()  # twice the pairs of the nodes that could be split
        if depth == DEPTH or work.pairs <= WORK * size:
            done = done.union(big.select(*kept))
            break
        free = F.array_except(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), "used")
        pick = lambda salt: F.element_at("free", (F.pmod(F.xxhash64("node", F.lit(salt)), F.size("free")) + 1).cast("int"))
        split = big.withColumn("free", free).withColumn("one", pick("one")).withColumn("free", F.array_remove("free", F.col("one"))).withColumn("two", pick("two")).drop("free")
        split = _join(split, sets.select("key", "low"), "key").withColumn("c", F.explode(F.array("one", "two")))
        split = written(split.select("key", "size", "n", "tokens", F.col("node").alias("parent"), F.concat("used", F.array("c")).alias("used"), F.xxhash64("node", "c", F.element_at("low", F.col("c") + 1)).alias("node")))
        # the chance that two sets of a parent hold one token at a split coordinate is their mean similarity
        alike = split.groupBy("parent", "n", "node").agg(F.count("*").alias("m")).groupBy("parent", "n").agg((F.sum(F.col("m") * F.col("m") / F.col("n") / F.col("n")) / 2).alias("alike"))
        dense = written(alike.where("alike >= 0.5").select(F.col("parent").alias("node"), F.col("n").alias("rows")))
        done = done.union(join_hot(big, dense, "node", "rows", total).select(*kept))
        total = 2 * work.rows
        nodes = written(join_hot(split, dense.withColumnRenamed("node", "parent"), "parent", "rows", total, "left_anti").select("key", "size", "used", "node"))
    return done


def _join(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that never broadcasts: neither side has a bound."""
    return a.join(b.hint("merge"), on, how)


def _two(run: int) -> list[int]:
    """The coordinates that a run's first split samples; no two runs share one while there are enough."""
    order = np.random.default_rng(99).permutation(COORDINATES).tolist()
    return [order[(2 * run) % COORDINATES], order[(2 * run + 1) % COORDINATES]]


def near_duplicates(docs: DataFrame, recall: float = 0.9999) -> DataFrame:
    """One row per document row: doc_id, class_id (smallest doc_id of its class), n_links (documents of similarity 0.8 or more to it, a lower bound), class_size."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(texts.mapInArrow(_sketch, "doc_id long, key binary, size long, low array<int>"))
    sets = written(rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("low").alias("low")))
    n_rows, n_sets = rows.count(), sets.count()
    leaves = written(_leaves(sets, n_sets, recall))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    mine = leaves.groupBy("key").agg(F.collect_set("node").alias("leaves"))
    placed = leaves.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key")
    placed = _join(placed, _join(sets, mine, "key").select("key", "copies", "size", "low", "leaves"), "key")
    picked = written(
        placed.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_select, "node long, i int, j int, block int, key binary, copies long, leaves array<long>")
    )
    words, n_picked = LEAST_WORDS, picked.count()
    while words < MOST_WORDS and words * 16 < n_picked:
        words *= 4
    bits = picked.select(F.pmod(F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long"), F.lit(words * 64)).alias("bit"))
    bits = bits.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(bit, 64) AS int)))").alias("bits")).toArrow()
    wanted = np.zeros(words, np.int64)
    wanted[np.array(bits["word"].to_pylist(), np.int64)] = np.array(bits["bits"].to_pylist(), np.int64)
    sent = spark.sparkContext.broadcast(wanted)  # 64 MB at most

    fetched = texts.mapInArrow(_fetcher(sent, words * 64), "key binary, shingles binary").dropDuplicates(["key"])
    work = _join(picked, fetched, "key").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    found = written(work.mapInArrow(_verify, "key binary, links long, root binary"))
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    info = _join(_join(sets.select("key", "least", "copies"), links, "key", "left"), roots.withColumnRenamed("a", "key"), "key", "left")
    info = written(info.where("copies > 1 or links > 0 or root is not null").withColumn("root", F.coalesce("root", "key")))
    classes = written(info.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("sets")))
    info = join_hot(info, classes, "root", "sets", n_sets)
    info = info.select("key", "copies", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = join_hot(rows.where("key is not null").select("doc_id", "key"), written(info), "key", "copies", n_rows, "left")
    out = out.select("doc_id", "class_id", "n_links", "class_size").union(rows.where("key is null").select("doc_id", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long")))
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class: its smallest doc_id, once. Rows without a doc_id can't be told apart and stay."""
    classes = near_duplicates(docs)
    kept = classes.where("doc_id = class_id").select("doc_id").distinct()
    rows = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), "text")
    one = rows.where("doc_id is not null").join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return unpacked(one.select("_row").union(rows.where("doc_id is null").select("_row")))
