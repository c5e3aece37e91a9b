"""The trained operators against plain Python, and samples that don't depend on the order of rows."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import language_id, neighbours, pieces, quality, sampling

TEXTS = [None, "", "  ", "Straße für ÜBER the cat", "the the CAT sat. On it; on it", "aé😀 b", "123 ###", "la maison est très belle et la mer", "x" * 5000, "der Hund und die Katze sind im Haus"]
SCHEMA = "doc_id long, text string, lang string"


def words(text):
    """Words as bytes with A-Z lower-cased, and what stands between them."""
    raw = (text or "").encode()
    out, at = [], 0
    is_word = lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    while at < len(raw):
        end = at
        while end < len(raw) and is_word(raw[end]):
            end += 1
        if end > at:
            out.append((at, raw[at:end]))
        at = max(end, at + 1)
    return raw, out


def lower(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def grams(text):
    """Counts of three-byte grams whose middle byte is in a word, square-rooted, of length 1."""
    raw, found = words(text)
    low = bytearray(len(raw))
    for at, w in found:
        low[at : at + len(w)] = lower(w)
    counts = np.zeros(language_id.DIMS)
    for i in range(len(low) - 2):
        if low[i + 1]:
            code = (low[i] << 16 | low[i + 1] << 8 | low[i + 2]) * 2654435761 % 2**32
            counts[(code >> 16) % language_id.DIMS] += 1
    counts = np.sqrt(counts)
    return counts / max(np.linalg.norm(counts), 1e-9)


def vote(model, x):
    """Winner and its smallest margin, by counting duels."""
    k = len(model["names"])
    margin = {}
    for (a, b), w in model["w"].items():
        m = float(x @ w[:-1] + w[-1])
        margin[a, b], margin[b, a] = m, -m
    rank = lambda a: (sum(margin[a, b] > 0 for b in range(k) if b != a), sum(margin[a, b] for b in range(k) if b != a), -a)
    best = max(range(k), key=rank)
    return model["names"][best], 1 / (1 + math.exp(-3 * min([margin[best, b] for b in range(k) if b != best] + [20])))


def test_languages_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    some = spark.createDataFrame([(i + 10**6, t, None) for i, t in enumerate(TEXTS)], SCHEMA).union(docs.where("doc_id % 4 = 1"))
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in language_id.identify(some, model).collect():
        text = texts[r.doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0), text
            continue
        x = grams(text)
        family, sure = vote(model["top"], x)
        lang, surer = vote(model["within"][family], x)
        assert r.lang_pred == lang and r.score == pytest.approx(sure * surer, abs=1e-4), text
        assert r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2)


def stream(text):
    """Buckets of the tokens of a text, in order."""
    from tidemark.llm.wordhash import words as hashed
    import pyarrow as pa

    raw, found = words(text)
    hashes = hashed(pa.array([text or ""]))[0]
    out, inside, before = [], set(), None
    for (at, w), h in zip(found, hashes.tolist()):
        inside |= set(range(at, at + len(w)))
        bucket = h % (quality.BUCKETS - 130) + 130
        if len(w) > 1 and all(65 <= c <= 90 for c in w):
            bucket = 128
        if lower(w) == before:
            bucket = 129
        before = lower(w)
        out.append((at, bucket))
    out += [(i, c) for i, c in enumerate(raw) if i not in inside and 32 < c < 127]
    return [b for _, b in sorted(out)]


def test_quality_by_hand(spark):
    rng = random.Random(5)
    good, bad = "river house garden water stone tree light morning".split(), "BUY now $$$ free free WIN !!! click".split()
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randint(3, 60))), "en") for i in range(120)] + [(200 + i, t, None) for i, t in enumerate(TEXTS)]
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(1, 0), (2, None), (999, 1), (None, 1)], "doc_id long, quality int")
    places, signs = quality._index()
    sums = np.zeros((quality.BUCKETS, quality.DIMS))
    for _, text, _ in rows:
        b = stream(text)
        for i in range(len(b)):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(b):
                    sums[b[i], places[b[j]]] += signs[b[j]]
    vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    got = quality.word_vectors(docs)
    assert np.allclose(got, vectors, atol=1e-6)
    model = quality.train(docs, labels, spark.sparkContext.broadcast(got))
    texts = {i: t for i, t, _ in rows}
    found = quality.score(docs, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        v = vectors[stream(texts[r.doc_id])]
        n = max(len(v), 1)
        mean = v.sum(0) / n
        x = np.concatenate([mean, np.sqrt(np.maximum((v * v).sum(0) / n - mean**2, 0)), [np.linalg.norm(mean)], [(v[1:] * v[:-1]).sum() / n], [np.log1p(len(v)) / 10]])
        hidden = np.tanh(((x - model["centre"]) / model["scale"]) @ model["p"][0] + model["p"][1])
        p = 1 / (1 + np.exp(-(hidden @ model["p"][2] + model["p"][3][0]) / model["temperature"]))
        assert r.score == pytest.approx(p, abs=2e-3) and r.predicted == (r.score >= 0.3)


def test_samples_are_the_same_rows(spark):
    rows = [(i % 40, "abc"[i % 3], f"text {i % 7}" if i % 5 else None) for i in range(200)]
    seen = []
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3 + seed)
        picked = sampling.chosen(docs, "doc_id", "lang", 25)
        seen.append(sorted(map(tuple, sampling.texts_of(docs, picked, "doc_id", "lang").collect())))
    assert seen[0] == seen[1] and len(seen[0]) == 25 and len({r[0] for r in seen[0]}) == 25
    want = {k: min(r[1] for r in rows if r[0] == k) for k in range(40)}
    assert all(want[k] == lang for k, lang, _ in seen[0])


def test_round_trip_is_exact(spark):
    frame = spark.createDataFrame([(1, "a▁b"), (2, "a b"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.round_trip for r in pieces.encode_decode(frame).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_hashes_that_meet_are_told_apart(monkeypatch):
    import pyarrow as pa

    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    monkeypatch.setattr(pieces, "_hash", lambda raw, begin, end: (end - begin).astype(np.uint64))
    texts = ["one two six", "a bc de", "one", None, "nation stone"]
    ids, offsets, back = pieces.Encoder(pieces.Pieces(pieces.MODEL)).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [model.encode(t) if t else [] for t in texts]
    assert back.to_pylist() == [t or "" for t in texts]


@pytest.mark.parametrize("n, dim, clusters", [(4000, 64, 0), (2500, 384, 0), (6000, 64, 60)])
def test_neighbour_recall(spark, n, dim, clusters):
    rng = np.random.default_rng(n + dim)
    x = rng.normal(size=(n, dim))
    if clusters:
        x += (1.5 * rng.normal(size=(clusters, dim)))[rng.integers(0, clusters, n)]
    x = x.astype(np.float32).astype(np.float64)
    frame = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(frame, slice_rows=700).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, n, 50):
        s = unit @ unit[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & {v for v, _ in got[q].values()})
        assert all(abs(s[v] - score) < 1e-12 for v, score in got[q].values()) and sorted(got[q]) == [1, 2, 3, 4, 5]
    assert hits >= 0.95 * 5 * len(range(0, n, 50))


def test_neighbours_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, score double, rank int, v string"
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [1e300, 1e299]), (None, [1.0, 1.0]), (3, [1.0]), (50, [2.0, 0.0]), (100, None), (150, [float("inf"), 0.0]), (200, [0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 0.0, 1, "x") for i, v in rows], schema)
    got = sorted(map(tuple, neighbours.nearest(frame).collect()))
    assert [(q, r, v) for q, r, v, _ in got if q == 50] == [(50, 1, 0), (50, 2, 1), (50, 3, 1), (50, 4, 2), (50, 5, 0)]
    assert {q for q, *_ in got} == {0, 50} and [v for q, _, v, _ in got if q == 0][:1] != [0]
    assert neighbours.nearest(frame.limit(0)).count() == 0
    assert neighbours.nearest(frame.where("vec_id = 1")).count() == 0
