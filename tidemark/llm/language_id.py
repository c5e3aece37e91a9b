"""Hierarchical language identification.

Features are hashed counts of three-byte grams inside words (ASCII lower-cased), square-rooted and scaled to length 1, over
the whole text. A first level tells language families apart, a second level the languages of one family; both are
one-versus-one linear support vector machines (squared hinge, full-batch descent in numpy on a bounded sample of labelled rows).
Decisions are votes, ties go to the larger summed margin, then to the name that sorts first. The score is the product
of a sigmoid of the smallest winning margin of each level.

Null texts and texts without a letter come out as ``und`` with score 0, without a model too. Labels that are null are
never learned. With no label at all every document is ``und``. Repeated rows are predicted each; of a repeated id the smallest label and
text are learned. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .rows import packed, unpacked
from .sampling import chosen, remainder, texts_of
from .wordhash import _LOWER, CHUNK, slices, text_buffers

#: Rows that the model is fitted on, at most.
SAMPLE_ROWS = 3000
DIMS = 2048
#: The score when both levels are undecided.
CHANCE = 0.25
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
#: Families of languages by ISO 639-1 code; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa si ur",
    "turkic": "az kk ky tr tk uz",
    "semitic": "ar he mt am",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def features(column: pa.Array, dims: int = DIMS) -> np.ndarray:
    """A row of ``dims`` numbers per text, in parts of CHUNK bytes."""
    raw, offsets = text_buffers(column)
    rows = len(offsets) - 1
    counts = np.zeros((rows, dims), np.float32)
    for at in range(0, len(raw), CHUNK):
        low = _LOWER[raw[at : at + CHUNK + 2]].astype(np.uint32)
        if len(low) < 3:
            break
        where = np.searchsorted(offsets, np.arange(at, at + len(low)), "right") - 1
        ok = (where[:-2] == where[2:]) & (low[1:-1] > 0)
        code = ((low[:-2] << 16) | (low[1:-1] << 8) | low[2:])[ok]
        slot = ((code * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(dims)
        first, last = where[0], where[-1]
        index = (where[:-2][ok] - first) * dims + slot
        counts[first : last + 1] += np.bincount(index, minlength=(last - first + 1) * dims).reshape(-1, dims)
    counts = np.sqrt(counts)
    return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 150, c: float = 10.0) -> np.ndarray:
    """Weights and bias of a linear machine for y in -1, 1: squared hinge, accelerated full-batch descent, classes weighted alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    y, w = y.astype(np.float32), np.zeros(x.shape[1], np.float32)  # of x's own type, or each step would copy x
    v = w
    rate = 1.0 / (1.0 + 4 * c)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = v - 2 * c * (x.T @ (share * y * slack))
        new = v - rate * grad
        w, v = new, new + k / (k + 3) * (new - w)
    return w


def _pairs(x: np.ndarray, label: np.ndarray) -> dict:
    names = sorted(set(label))
    return {"names": names, "w": {(a, b): _svm(x[(m := (label == names[a]) | (label == names[b]))], np.where(label[m] == names[a], 1.0, -1.0)) for a, b in combinations(range(len(names)), 2)}}


def _vote(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winner among the names, and a sigmoid of its smallest margin."""
    k = len(model["names"])
    margin = np.full((len(x), k, k), np.inf)
    for (a, b), w in model["w"].items():
        m = x @ w[:-1] + w[-1]
        margin[:, a, b], margin[:, b, a] = m, -m
    wins = (margin > 0).sum(2) + 1e-6 * np.tanh(np.where(np.isinf(margin), 0, margin).sum(2))
    best = wins.argmax(1)
    least = margin[np.arange(len(x)), best].min(1) if k else np.zeros(len(x))
    return best, 1 / (1 + np.exp(-3 * np.minimum(least, 20)))


def fit(x: np.ndarray, label: np.ndarray) -> dict:
    kind = np.array([family(v) for v in label])
    return {"top": _pairs(x, kind), "within": {f: _pairs(x[kind == f], label[kind == f]) for f in sorted(set(kind))}}


def predict(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top, score = _vote(model["top"], x)
    lang = np.full(len(x), None, object)
    for i, f in enumerate(model["top"]["names"]):
        if len(at := np.flatnonzero(top == i)):
            best, sure = _vote(model["within"][f], x[at])
            lang[at] = np.array(model["within"][f]["names"], object)[best]
            score[at] *= sure
    return lang, score


def train(docs: DataFrame, most: int = SAMPLE_ROWS) -> dict | None:
    """Fitted on documents whose crc32(doc_id) mod 4 isn't 2 and whose lang isn't null."""
    picked = chosen(docs.select("doc_id", "lang").where(remainder("doc_id", 4) != 2), "doc_id", "lang", most)
    texts = texts_of(docs, picked, "doc_id", "lang")  # ``most`` rows

    def make(batches):
        for batch in slices(batches):
            x = features(batch.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "x"])

    rows = texts.select("doc_id", "text", "lang").mapInArrow(make, "doc_id long, lang string, x binary").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return None
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float16).reshape(-1, DIMS).astype(np.float32)
    return fit(x, np.array(rows["lang"].to_pylist(), object))


def identify(docs: DataFrame, model: dict | None = None, whole: bool = False) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score; with ``whole`` the row itself too, as _row."""
    carried = packed(docs).schema if whole else None
    docs = (packed(docs, "doc_id", "text", "lang") if whole else docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), *(["_row"] if whole else [])
    )
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))  # DIMS numbers for each pair of languages

    def make(batches):
        for batch in slices(batches):
            lettered = np.array(batch.column("lettered").to_pylist(), bool)
            if shared.value is None:
                lang, score = np.full(batch.num_rows, None, object), np.zeros(batch.num_rows)
            else:
                lang, score = predict(shared.value, features(batch.column("text")))
            lang[~lettered | (lang == None)] = "und"  # noqa: E711
            score = np.where(lang == "und", 0.0, score)
            columns, names = [batch.column("doc_id"), batch.column("held_out"), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays(columns + ([batch.column("_row")] if whole else []), names=names + (["_row"] if whole else []))

    schema = StructType.fromDDL(SCHEMA)
    if whole:
        schema = StructType(schema.fields + carried.fields)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    return docs.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), letters, "text", *(["_row"] if whole else [])).mapInArrow(make, schema)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is told better than by chance: not ``und``, and a score over CHANCE."""
    return unpacked(identify(docs, whole=True).where((F.col("lang_pred") != "und") & (F.col("score") > CHANCE)))
