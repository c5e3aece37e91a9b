"""Edge cases and brute-force comparisons of the training-data operators, on small fixtures."""

import hashlib
import random

import numpy as np
import pytest

from tests.oracle import differs
from tidemark.llm import chat, chosen_path, decontaminate, html_text, language_id, license_scan, neighbours, personal_data, pieces, quality, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
ODD = [None, "", " \n", "a", "aé😀 b", "word " * 3000, "x" * 50000, "!!! ### 123", "same text here again and again", "same text here again and again"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", "s", None, 0.5) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + [rows[3]], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_oracles(spark, sf_dir):
    for name, sql in queries.oracle_sql().items():
        assert differs(queries.queries()[name](spark, sf_dir), sql, sf_dir) is None, name


def test_odd_rows_come_out_once_each(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "same text here again"), (2, None), (None, "a"), (3, "!!")], "item_id long, text string")
    operators = {
        "op2": lambda d: personal_data.digests(personal_data.find(d)), "op3": chosen_path.near_duplicates, "op4": lambda d: decontaminate.decontaminate(d, bench), "op5": lambda d: quality.score(d, labels),
        "op8": pieces.encode_decode, "op9": language_id.identify, "op10": license_scan.scan,
    }
    for name, run in operators.items():
        assert sorted(r.doc_id for r in run(docs).collect()) == sorted([*range(len(ODD)), 3]), name
        assert run(empty).count() == 0, name


def test_html_blocks(spark):
    page = "<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><article><h1>One &amp; two</h1><p>First   long paragraph with words.<p>Second<br>line</article><div class='comments'><p>me too</p></div><script>var a='</p>'</script><footer>c</footer>"
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>unclosed <b"), (1, "u", page)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(rows).collect()}
    assert got[1] == "One & two First long paragraph with words. Second line"
    assert got[2] == got[3] == ""


def test_base_spans_by_hand(spark):
    rng = random.Random(4)
    bits = list("1259. -@ab+()é😀_%\n") + ["4111 1111 1111 1111", "1.2.3.4", "x@y.zz", "+1 (212) 555-0142"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 50))) for _ in range(400)] + [None, "a@b.c@d.e", "1 " * 5000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal_data.digests(personal_data.find(frame)).collect():
        want = ",".join(f"{k}:{a}:{b}" for a, k, b in personal_data.base_by_hand(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]


def test_added_spans_and_redaction(spark):
    frame = spark.createDataFrame([(1, "mail jo [at] ex [dot] com now"), (2, "order 123-456-7890 sent"), (3, "write a@b.cc, +1 212 555 0142"), (4, None)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in personal_data.digests(personal_data.find(frame)).collect()}
    assert spans == {1: "email:5:25", 2: "", 3: "email:6:12,phone:14:29", 4: ""}
    clean = {r.doc_id: r.text for r in personal_data.redact(frame).collect()}
    assert clean == {1: "mail <email> now", 2: "order 123-456-7890 sent", 3: "write <email>, <phone>", 4: None}


def _shingles(text):
    w = __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_join_against_all_pairs(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [None, "", texts[0]]
    sets = [_shingles(t) for t in texts]
    link = [[j for j in range(len(texts)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(texts))]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min([root[i], *(root[j] for j in link[i])]) for i in range(len(texts))]
    got = {r.doc_id: r for r in chosen_path.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].class_id for i in range(len(texts))] == root
    assert [got[i].n_links for i in range(len(texts))] == [len(x) for x in link]


def test_dense_group_in_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(150)]
    got = chosen_path.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and {r.class_size for r in got} == {150}
    sets = [_shingles(t) for t in texts]
    want = [sum(5 * len(a & b) >= 4 * len(a | b) for b in sets) - 1 for a in sets]
    assert abs(sum(r.n_links for r in got) - sum(want)) <= 0.001 * sum(want)


def test_several_passes_equal_one(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = sorted(map(tuple, decontaminate.decontaminate(docs, bench).collect()))
    assert sorted(map(tuple, decontaminate.decontaminate(docs, bench, chars=3000).collect())) == one


def test_pieces_equal_the_model(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(3)
    texts = ["Hello world", "  a  b\n\tc　d ﬁ é ￼", "", " ", "a" * 300, "   " * 60 + "x", "日本語" * 60, "😀😀 a😀"] + ["".join(rng.choice("abcde  \n\té漢tion") for _ in range(rng.randint(1, 150))) for _ in range(100)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pieces.encode_decode(frame, decoded=True).collect():
        assert r.ids == (model.encode(texts[r.doc_id]) if texts[r.doc_id] else []) and r.decoded == texts[r.doc_id] and r.round_trip


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nno"), (1, 1, "assistant", "a <\\| b <|im_end|>"), (2, 0, None, None), (None, 5, "assi\nstant", "<|nl|>"), (3, 1, "user", "x"), (3, 1, "user", "x")]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: [("user", turns[0][3]), ("assistant", turns[1][3])], 2: [("", "")], None: [("assi\nstant", "<|nl|>")], 3: [("user", "x")] * 2}


def test_neighbour_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[40:60] = x[0]
    rows = [(i, x[i].tolist(), 0) for i in range(600)] + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [], 0), (1050, [None] * 16, 0)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), slice_rows=250).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.lexsort((np.arange(600), -s.round(12)))[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits >= 0.9 * 60 and len(got) == 60
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)] == [40, 41, 42, 43, 44]


def test_held_out_languages_and_quality(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = language_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.score(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.9 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_licences_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in license_scan.scan(docs).collect():
        assert (r.n_license, r.families, r.paragraphs) == license_scan.scan_text(texts[r.doc_id])


def test_pipeline_keeps_what_it_should(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out.cache()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).where("not round_trip").count() == 0
