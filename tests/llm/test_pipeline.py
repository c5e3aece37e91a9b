"""The pipeline's rows on a small table with nulls, copies and planted passages, against plain Python."""

import re

import corpus_pipeline
from tests.llm.test_operators import _shingles
from tidemark.llm import language_id, personal_data, pieces


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_pipeline_by_hand(spark, sf_dir, tmp_path):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in given.orderBy("doc_id").limit(120).collect()]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    passage = max((r.text for r in bench.collect() if r.text), key=len)
    lang, source = given.schema.names.index("lang"), given.schema.names.index("source")
    assert given.schema.names[:2] == ["doc_id", "text"]

    def made(k, text):
        r = list(rows[0])
        r[0], r[1], r[lang], r[source] = k, text, None, None
        return tuple(r)

    clean = rows[5][1]
    rows += [made(9001, None), made(9002, ""), made(9003, clean), made(9003, clean), made(9004, f"{clean} {passage}"), made(9005, "Write to jo@mail.example or +1 212 555 0142 about the house and the garden"), made(9006, "12 34 !!")]
    folder = str(tmp_path)
    spark.createDataFrame(rows, given.schema).write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    told = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    kept = {d for d, lang_pred, score in told if lang_pred != "und" and score > language_id.CHANCE}
    assert not kept & {9001, 9002, 9006}
    text = {r[0]: r[1] for r in rows if r[0] in kept}
    sets = {d: _shingles(t) for d, t in text.items()}
    root = {d: d for d in sets}
    for _ in sets:
        new = {a: min(root[b] for b in sets if b == a or (sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))) for a in sets}
        if new == root:
            break
        root = new
    items = [_words(r.text) for r in bench.collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in items if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def hit(t):
        w = _words(t)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    want = {d for d in text if root[d] == d and not hit(text[d])}
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(want) and 9004 not in want and 9005 in want
    clean_text = {r.doc_id: r.text for r in personal_data.redact(docs.where("doc_id = 9005")).collect()}
    assert clean_text[9005].startswith("Write to <email> or <phone>")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert next(r.ids for r in got if r.doc_id == 9005) == model.encode(clean_text[9005]) and all(r.round_trip for r in got)
