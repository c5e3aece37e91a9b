"""Added spans against a plain Python form of the same rule, redaction, and texts with very many spans."""

import random
import re

import pytest

from tidemark.llm import personal_data as pd


def features(kind, value, before, near):
    """The numbers of FEATURES, by hand."""
    digits = re.sub("[^0-9]", "", value)
    luhn = kind == "card" and 12 <= len(digits) <= 19 and pd._sum(digits) % 10 == 0
    tests = [bool(re.search(pd.CUES[kind], near)), bool(re.search(pd.CUES["against"], near)), bool(re.search(r"[(\[{] ?dot", value)), bool(re.search(pd.TOP_DOMAINS, value)), bool(re.search(pd.BESIDE.replace("$", r"\Z"), before[-12:]))]
    return [float(kind == k) for k in pd.KINDS] + [float(len(digits)), float(len(re.findall("[A-Za-z]", value))), float(len(value)), float(luhn), *map(float, tests), float(len(near)), float(bool(re.search(pd.DIALLED, value)))]


def added_by_hand(text, model):
    trees, (slope, offset), thresholds = model
    base, loose = pd.base_by_hand(text), []
    for kind, pattern, _ in pd.LOOSE:
        found = list(re.finditer(pattern, text))
        for n, m in enumerate(found):
            before = text[max(found[n - 1].end() if n else 0, m.start() - 30) : m.start()].lower()
            after = text[m.end() : min(found[n + 1].start() if n + 1 < len(found) else len(text), m.end() + 30)].lower()
            score = pd.total(trees, features(kind, m.group(), before, before + m.group().lower() + after))
            p = round(1 / (1 + 2.718281828459045 ** -(slope * score + offset)), 9)
            if p >= thresholds[pd.KINDS.index(kind)] - 1e-6 and not any(a < m.end() and m.start() < b for a, _, b in base):
                loose.append((m.start(), pd.KINDS.index(kind), m.end(), p))
    kept = [s for s in loose if not any(o[0] < s[2] and s[0] < o[2] and (o[3] > s[3] or (o[3] == s[3] and o[:2] < s[:2])) for o in loose)]
    return sorted((a, k, b) for a, k, b, _ in kept)


@pytest.fixture(scope="module")
def model(spark):
    return pd.trained(spark)


def test_table_is_large_and_thresholds_are_kept(model):
    rows = pd.labelled()
    assert len(rows) == 8 * pd.ROWS and len({t for t, _, _ in rows}) > 300
    assert all(0.5 <= t < 1 for t in model[2].values())


def test_added_spans_by_hand(spark, model):
    rng = random.Random(7)
    bits = [t for t, _, _ in pd.labelled()] + ["\n", ". ", "a@b.cc", " +1 (212) 555-0142 ", "4111 1111 1111 1111", "1.2.3.4", "😀é "]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n", ", "]) for _ in range(rng.randint(1, 12))) for _ in range(250)]
    texts += [t for t, _, _ in pd.labelled()[::3]] + ["", "212-555-0142.212-555-0143[at]example[dot]com"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = 0
    for r in pd.find(frame).collect():
        want = added_by_hand(texts[r.doc_id], model)
        n += len(want)
        assert sorted((s.start, s.kind, s.end) for s in r.added) == want, texts[r.doc_id]
        assert [(s.start, pd.KINDS[s.kind], s.end) for s in r.base] == pd.base_by_hand(texts[r.doc_id])
    assert n > 200


def test_held_out_values(spark):
    """Values and frames that aren't in the table."""
    real = ["Fragen an mia.k [at] klinik [dot] de bitte", "ring 312-555-0188 after six", "card used: 4539.5787.6362.1486", "ssh root 2a00:1450:4001:081b:0000:0000:0000:200e"]
    other = ["lengths 120 240 4800 were cut", "at the door (at) ten. Nobody came", "model 1234.5678.9012.3456 of the part"]
    frame = spark.createDataFrame(list(enumerate(real + other)), "doc_id long, text string")
    got = {r.doc_id: len(r.added) for r in pd.find(frame).collect()}
    assert [got[k] for k in range(len(real) + len(other))] == [1] * len(real) + [0] * len(other)


def test_redaction_by_hand(spark):
    texts = ["mail a@b.cc, b@c.dd; +1 212 555 0142", "x" * 10 + " 4111 1111 1111 1111 1.2.3.4 é😀 k@l.mm", "none", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [(s.start, pd.KINDS[s.kind], s.end) for s in r.spans] for r in pd.find(frame).collect()}
    for r in pd.redact(frame).collect():
        text, out, at = texts[r.doc_id], "", 0
        for a, kind, b in spans[r.doc_id]:
            if b > at:
                out, at = out + text[at : max(a, at)] + f"<{kind}>", b
        assert r.text == (None if text is None else out + text[at:])


def test_very_many_spans(spark):
    text = " ".join(f"user{k}@mail.example tel 212-555-{k % 10000:04d}" for k in range(20000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pd.digests(pd.find(frame)).first()
    assert found.n_email == 20000 and found.spans.count(",") + 1 == found.n_email + found.n_added + found.n_phone + found.n_card
    clean = pd.redact(frame).first().text
    assert clean.count("<email>") == 20000 and "@" not in clean
