"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

A token is a word, any word written in capitals, any word that repeats the one before, or a single ASCII symbol, folded by hash into ``BUCKETS`` buckets. Every bucket has
a fixed sparse index vector of +-1 and 0; a bucket's word vector is the sum of the index vectors of the tokens within two
places of its occurrences in all documents, scaled to length 1. The sums are whole numbers, so they don't depend on
the order of rows. A document is the mean and the spread of its tokens' vectors, the length of that mean, the
mean product of neighbouring vectors, and the log of
its number of tokens. The network (tanh, then logistic) is fitted on a bounded sample of labelled rows; a temperature fitted
on every fifth row of that sample calibrates its probabilities.

Null and empty texts have no tokens and get the score of a document of zeros. Labels of ids that aren't in documents are unused;
null labels too; of an id with several labels or texts the smallest are learned. Without labels of both kinds every score is the share of label 1 (0.5 without any). Repeated rows are
scored each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import chosen, remainder, texts_of
from .wordhash import slices, text_buffers, words

#: Labelled rows that the network is fitted on, at most.
SAMPLE_ROWS = 6000
BUCKETS, DIMS, NONZERO = 1 << 14, 16, 3
THRESHOLD = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors."""
    rng = np.random.default_rng(20240229)
    places = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1, 1]), (BUCKETS, NONZERO))


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each token, in order."""
    column = batch.column("text")
    hashes, row, begin, end, low = words(column)
    raw, offsets = text_buffers(column)
    upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90), dtype=np.int32)])
    caps = (upper[end] - upper[begin] == end - begin) & (end - begin > 1)
    bucket = (hashes % np.uint64(BUCKETS - 130)).astype(np.int32) + 130
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    bucket[caps] = 128
    bucket[again] = 129
    mark = np.flatnonzero((low == 0) & (raw > 32) & (raw < 127))
    at = np.concatenate([begin, mark])
    order = np.argsort(at, kind="stable")
    mark_row = np.searchsorted(offsets, mark, "right") - 1
    return np.concatenate([bucket, raw[mark].astype(np.int32)])[order], np.concatenate([row, mark_row])[order]


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIMS numbers, from the co-occurrences in all documents."""
    names = [f"v{k}" for k in range(DIMS)]

    def count(batches):
        places, signs = _index()
        sums = np.zeros(BUCKETS * DIMS)
        for batch in slices(batches):
            bucket, row = tokens(batch)
            for gap in (1, 2):
                near = row[gap:] == row[:-gap]
                for a, b in ((bucket[gap:][near], bucket[:-gap][near]), (bucket[:-gap][near], bucket[gap:][near])):
                    for k in range(NONZERO):
                        sums += np.bincount(a * DIMS + places[b, k], weights=signs[b, k], minlength=BUCKETS * DIMS)
        sums = sums.reshape(BUCKETS, DIMS).astype(np.int64)
        used = np.flatnonzero(np.any(sums != 0, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used)] + [pa.array(sums[used, k]) for k in range(DIMS)], names=["bucket", *names])

    partial = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, " + ", ".join(f"{n} long" for n in names))
    table = partial.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # BUCKETS rows at most
    out = np.zeros((BUCKETS, DIMS), np.float32)
    at = np.array(table["bucket"].to_pylist(), np.int64)
    for k, n in enumerate(names):
        out[at, k] = np.array(table[n].to_pylist(), np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(batch: pa.RecordBatch, vectors: np.ndarray) -> np.ndarray:
    bucket, row = tokens(batch)
    n = batch.num_rows
    count = np.bincount(row, minlength=n).astype(np.float64)
    mean, square = np.zeros((n, DIMS)), np.zeros((n, DIMS))
    for k in range(DIMS):
        x = vectors[bucket, k]
        mean[:, k] = np.bincount(row, weights=x, minlength=n)
        square[:, k] = np.bincount(row, weights=x * x, minlength=n)
    near = np.zeros(n)
    same = row[1:] == row[:-1]
    for k in range(DIMS):
        x = vectors[bucket, k]
        near += np.bincount(row[1:][same], weights=(x[1:] * x[:-1])[same], minlength=n)
    some = np.maximum(count, 1)[:, None]
    mean, square = mean / some, square / some
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    return np.hstack([mean, spread, np.linalg.norm(mean, axis=1, keepdims=True), near[:, None] / some, np.log1p(count)[:, None] / 10]).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 600) -> dict:
    """A two-layer network by Adam on all rows but every fifth, and a temperature on those."""
    if not len(y) or y.min() == y.max():
        return {"prior": float(y.mean()) if len(y) else 0.5}
    rng = np.random.default_rng(7)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    a, b = z[~held], y[~held]
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    for step in range(1, steps + 1):
        h = np.tanh(a @ p[0] + p[1])
        d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - b) / len(b)
        back = np.outer(d, p[2]) * (1 - h * h)
        for k, g in enumerate((a.T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = {"centre": centre, "scale": scale, "p": p, "temperature": 1.0}
    if held.any():
        logit = _logit(model, x[held])
        losses = {t: np.mean(np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * logit / t)) for t in np.geomspace(0.5, 8, 33)}
        model["temperature"] = float(min(losses, key=losses.get))
    return model


def _logit(model: dict, x: np.ndarray) -> np.ndarray:
    p = model["p"]
    return np.tanh(((x - model["centre"]) / model["scale"]) @ p[0] + p[1]) @ p[2] + p[3]


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    if "prior" in model:
        return np.full(len(x), model["prior"])
    return 1 / (1 + np.exp(-np.clip(_logit(model, x) / model["temperature"], -40, 40)))


def train(docs: DataFrame, labels: DataFrame, vectors, most: int = SAMPLE_ROWS) -> dict:
    """Fitted on labels whose crc32(doc_id) mod 5 isn't 0."""
    picked = chosen(labels.where(remainder("doc_id", 5) != 0), "doc_id", "quality", most)
    texts = texts_of(docs, picked, "doc_id", "quality")  # ``most`` rows

    def make(batches):
        for batch in slices(batches):
            x = pooled(batch, vectors.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    rows = texts.mapInArrow(make, "doc_id long, quality int, x binary").toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, 2 * DIMS + 3)
    return fit(x, np.array(rows["quality"].to_pylist(), np.float64))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))  # 1 MB, whatever the corpus
    model = train(docs, labels, vectors)

    def make(batches):
        for batch in slices(batches):
            p = probability(model, pooled(batch, vectors.value))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(make, SCHEMA)
