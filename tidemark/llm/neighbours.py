"""Approximate nearest neighbours by collision counting over query-centred windows, on two levels.

Vectors are scaled to length 1, so the largest cosine is the smallest distance. Rows go to the block of their nearest
representative (a bounded sample of rows); a block is cut into slices of bounded bytes, whatever its size, so a hot block or a vector that
a third of the rows repeat is many slices. A slice keeps one sorted array for each of ``PROJECTIONS`` random projections. A query of radius R
has a window of half ``WIDTH`` times R around its own place in each array, found by binary search; a row at distance R or
less lies in ``_axes``' threshold of windows with a chance of 1 - ``MISS``, whatever the dimension, and rows with so many collisions are verified by their exact
cosine, in double precision on the original vectors.

First a query searches its home block: the radius grows by ``WIDEN`` (virtual rehashing) until k verified rows lie inside it, so the stop is right for
any data. The k-th distance found is the radius of a single look into the other blocks that it visits, the nearest representatives'
first. How many are visited is measured: up to ``PILOT`` queries are answered by brute force over all rows (a pass linear in the table), and as
many blocks are taken as hold ``COVER`` of their true neighbours. Data with clusters needs few, so the work grows with the rows; data without any
structure needs most of them, and then the work grows with queries times rows, as it must for a fixed recall.
Every row is indexed, no bucket is capped.

Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of another length aren't
compared. Ties go to the smaller vec_id. Rows with the query's vec_id are its own. Repeated queries are asked once, with their smallest vector; each
repeated row is a candidate of its own. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

PROJECTIONS, WIDTH, MISS, START, WIDEN = 96, 1.7, 0.02, 0.5, 1.3
#: Bounds: bytes of a slice as doubles, queries of a piece of work, representatives of a dimension, queries answered by brute force.
SLICE_BYTES, CHUNK, MOST_BLOCKS, PILOT = 1 << 24, 8192, 1024, 128
COVER = 0.985
SCHEMA = "query_id long, vec_id long, score double"


@lru_cache(maxsize=8)
def _axes(dim: int) -> tuple[np.ndarray, int]:
    """Axes, orthogonal in groups of ``dim``, and how many of their windows hold 1 - MISS of the rows at just the window's radius."""
    rng = np.random.default_rng(1)
    groups = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
    axes = np.concatenate(groups, axis=1)[:, :PROJECTIONS] * math.sqrt(dim)
    step = rng.normal(size=(4000, dim))
    inside = (np.abs(_unit(step) @ axes) <= WIDTH).sum(1)
    return axes, max(1, int(np.quantile(inside, MISS)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled by their largest part first so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(rows, -1)


def _cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact cosines of rows with one query; equal rows give equal bits. Powers of two keep squares from overflowing and change no bit."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) if len(x) else x
    q = np.ldexp(q, -np.frexp(np.abs(q).max())[1])
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * math.sqrt((q * q).sum()))


def _best(x, unit, ids, q, unit_q, own, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the rows, largest cosine first, ties to the smaller id."""
    ok = np.flatnonzero(ids != own)
    if len(ok) > k:
        rough = unit[ok] @ unit_q
        ok = ok[rough >= np.partition(rough, len(ok) - k)[len(ok) - k] - 1e-9]
    score = _cosines(x[ok], q)
    order = np.lexsort((ids[ok], -score))[:k]
    return ids[ok[order]], score[order]


def _search(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not queries.num_rows or not rows.num_rows:
        return none
    q, x = _matrix(queries.column("v"), queries.num_rows), _matrix(rows.column("v"), rows.num_rows)
    qid, ids = np.asarray(queries.column("vec_id")), np.asarray(rows.column("vec_id"))
    near = np.asarray(queries.column("near").to_pandas(), np.float64)
    unit, unit_q = _unit(x), _unit(q)
    axes, need = _axes(x.shape[1])
    n, places = len(x), np.uint16 if len(x) < 65535 else np.uint32
    at_x, at_q = unit @ axes, unit_q @ axes
    line, place = np.empty((PROJECTIONS, n)), np.empty((PROJECTIONS, n), places)
    for p in range(PROJECTIONS):
        order = np.argsort(at_x[:, p], kind="stable")
        line[p] = at_x[order, p]
        place[p, order] = np.arange(n, dtype=places)
    out = []
    together = max(1, (1 << 18) // n)
    for first in range(0, len(q), together):
        left = np.arange(first, min(len(q), first + together))
        known = ~np.isnan(near[left])
        radius = np.where(known, np.sqrt(np.maximum(0.0, 2 - 2 * np.where(known, near[left], 0.0))) + 1e-6, START)
        while len(left):
            hits = np.zeros((len(left), n), np.uint8)
            for p in range(PROJECTIONS):
                half = WIDTH * radius
                low = np.searchsorted(line[p], at_q[left, p] - half)
                wide = np.searchsorted(line[p], at_q[left, p] + half, side="right") - low
                hits += (place[p][None, :] - low.astype(places)[:, None]) < wide.astype(places)[:, None]
            stays = np.zeros(len(left), bool)
            for i, w in enumerate(left):
                whole = radius[i] > 2  # wider than any distance: all rows
                found = np.arange(n) if whole else np.flatnonzero(hits[i] >= need)
                best, score = _best(x[found], unit[found], ids[found], q[w], unit_q[w], qid[w], k)
                stays[i] = not (known[i] or whole or (len(best) == k and 2 - 2 * score[-1] <= radius[i] ** 2))
                if not stays[i]:
                    out.append((np.full(len(best), qid[w]), best, score))
            left, radius, known = left[stays], radius[stays] * WIDEN, known[stays]
    return pa.table({"query_id": np.concatenate([o[0] for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})


def _numbered(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray]]:
    """Row numbers of the batch by dimension."""
    dims = np.asarray(batch.column("dim"))
    return [(int(d), np.flatnonzero(dims == d)) for d in np.unique(dims)]


def _ranks(x: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """For each row the representatives, nearest first."""
    return np.argsort(-(_unit(x) @ spots.T), axis=1, kind="stable")


def _blocker(spots: dict[int, np.ndarray]):
    """Adds the block: the nearest representative."""

    def run(batches):
        for batch in batches:
            block = np.zeros(batch.num_rows, np.int32)
            for dim, at in _numbered(batch):
                if len(spots.get(dim, ())) > 1:
                    block[at] = (_unit(_matrix(batch.column("v").take(pa.array(at)), len(at))) @ spots[dim].T).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("dim"), pa.array(block)], names=["vec_id", "v", "dim", "block"])

    return run


def _router(spots: dict[int, np.ndarray], visits: dict[int, int]):
    """Adds the blocks that a query visits, its home first."""

    def run(batches):
        for batch in batches:
            lists = [[0]] * batch.num_rows
            for dim, at in _numbered(batch):
                if len(spots.get(dim, ())) > 1:
                    ranks = _ranks(_matrix(batch.column("v").take(pa.array(at)), len(at)), spots[dim])[:, : visits[dim]]
                    for i, row in zip(at.tolist(), ranks.tolist()):
                        lists[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("dim"), pa.array(lists, pa.list_(pa.int32()))], names=["vec_id", "v", "dim", "blocks"])

    return run


def _brute(pilot: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Each batch's k best rows of every pilot query, with their blocks."""

    def run(batches):
        for batch in batches:
            ids, block, found = np.asarray(batch.column("vec_id")), np.asarray(batch.column("block")), []
            for dim, at in _numbered(batch):
                if dim in pilot:
                    own, q = pilot[dim]
                    score = q @ _unit(_matrix(batch.column("v").take(pa.array(at)), len(at))).T
                    score[own[:, None] == ids[at][None, :]] = -2
                    for i in range(len(q)):
                        best = np.argsort(-score[i], kind="stable")[:k]
                        found.append((np.full(len(best), own[i]), block[at[best]], score[i, best]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found])) for c in range(3)], names=["query_id", "block", "score"])

    return run


def _sample(rows: DataFrame, most: dict[int, int], counts: dict[int, int], salt: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """At most so many (ids, unit vectors) of each dimension, those with the smallest hashes; fetched by a bound on the hash that few more pass."""
    bound = F.lit(0)
    for dim, wanted in most.items():
        bound = F.when(F.col("dim") == dim, F.lit(min(1 << 31, math.ceil((2 * wanted + 20) / counts[dim] * (1 << 31))))).otherwise(bound)
    some = rows.withColumn("h", F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1 << 31))).where(F.col("h") < bound)
    table = some.groupBy("dim", "vec_id", "h").agg(F.min("v").alias("v")).collect()  # about twice the bound
    out = {}
    for dim, wanted in most.items():
        mine = sorted((r for r in table if r.dim == dim), key=lambda r: (r.h, r.vec_id))[:wanted]
        if mine:
            out[dim] = (np.array([r.vec_id for r in mine], np.int64), _unit(np.array([r.v for r in mine], np.float64)))
    return out


def _lookup(values: dict[tuple[int, int], int]) -> F.Column:
    """The number of (dim, block), 1 where there is none."""
    if not values:
        return F.lit(1)
    table = F.create_map(*[F.lit(v) for (d, b), n in values.items() for v in (f"{d}:{b}", n)])
    return F.coalesce(F.try_element_at(table, F.concat_ws(":", F.col("dim").cast("string"), F.col("block").cast("string"))), F.lit(1))


def _looked(queries: DataFrame, rows: DataFrame, slices: dict, k: int) -> DataFrame:
    """The k best of each (query, slice) for queries with columns vec_id, v, dim, block, near."""
    asked = {(r.dim, r.block): math.ceil(r.n / CHUNK) for r in queries.groupBy("dim", "block").agg(F.count("*").alias("n")).collect()}  # one row a block
    chunks = {key: n for key, n in asked.items() if n > 1}
    chunk = F.pmod(F.xxhash64("vec_id", F.lit("chunk")), _lookup(chunks)).cast("int")
    left = queries.withColumn("chunk", chunk).withColumn("slice", F.explode(F.sequence(F.lit(0), _lookup(slices) - 1)))
    right = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), _lookup(chunks) - 1)))
    keys = ["dim", "block", "slice", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _search(a, b, k), SCHEMA)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, slice_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    kind = "array<double>" if vectors.schema["embedding"].dataType.simpleString() == "array<double>" else "array<float>"
    fit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fit = fit.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    counts = fit.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).collect()  # one row a length
    if not any(r.q for r in counts):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = {r.dim: r.n for r in counts}
    tasks = 2 * spark.sparkContext.defaultParallelism
    per = {d: slice_rows or max(4096, min(SLICE_BYTES // (8 * d), math.ceil(n / tasks))) for d, n in size.items()}
    wanted = {d: min(MOST_BLOCKS, math.ceil(n / per[d])) for d, n in size.items()}
    spots = {d: v for d, (_, v) in _sample(fit, {d: b for d, b in wanted.items() if b > 1}, size, "spot").items()} if max(wanted.values()) > 1 else {}
    rows = written(fit.mapInArrow(_blocker(spots), f"vec_id long, v {kind}, dim int, block int"))
    held = {(r.dim, r.block): math.ceil(r.n / per[r.dim]) for r in rows.groupBy("dim", "block").agg(F.count("*").alias("n")).collect()}  # one row a block
    slices = {key: n for key, n in held.items() if n > 1}
    rows = rows.withColumn("slice", F.pmod(F.monotonically_increasing_id(), _lookup(slices)).cast("int"))

    queries = rows.where(is_query).groupBy("dim", "vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", "dim")
    visits = _visits(rows, queries, spots, {r.dim: r.q for r in counts if r.q}, k)
    routed = queries.mapInArrow(_router(spots, visits), f"vec_id long, v {kind}, dim int, blocks array<int>")
    home = routed.withColumn("block", F.element_at("blocks", 1)).withColumn("near", F.lit(None).cast("double")).drop("blocks")
    first = _looked(home, rows, slices, k)
    if max(visits.values(), default=1) > 1:
        first = written(first)
        radius = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("near"))
        away = routed.join(radius, "vec_id", "left").withColumn("block", F.explode(F.slice("blocks", 2, MOST_BLOCKS))).drop("blocks")
        first = _ranked(first.select("query_id", "vec_id", "score").union(_looked(away, rows, slices, k).select("query_id", "vec_id", "score")), k)
    return first.select("query_id", "rank", "vec_id", "score")


def _visits(rows: DataFrame, queries: DataFrame, spots: dict[int, np.ndarray], asked: dict[int, int], k: int) -> dict[int, int]:
    """How many blocks hold COVER of the true neighbours of the pilot queries, of each dimension."""
    out = {d: 1 for d in asked if d not in spots}
    most = {d: PILOT for d in asked if d in spots}
    if not most:
        return out
    pilot = _sample(queries, most, asked, "pilot")
    schema = "query_id long, block int, score double"
    true = rows.select("vec_id", "v", "dim", "block").mapInArrow(_brute(pilot, k), schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "block"))
    table = true.withColumn("place", place).where(F.col("place") <= k).collect()  # k rows a pilot query
    for dim, (ids, q) in pilot.items():
        order = {i: {int(b): p for p, b in enumerate(row)} for i, row in zip(ids.tolist(), _ranks(q, spots[dim]))}
        found = sorted(order[r.query_id][r.block] for r in table if r.query_id in order)
        out[dim] = found[math.ceil(COVER * len(found)) - 1] + 1 if found else len(spots[dim])
    return {d: out.get(d, len(spots[d]) if d in spots else 1) for d in asked}
