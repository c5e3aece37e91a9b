"""Stand-ins: shapes case by case, names, numbering over partitions, and exact restoration."""

import random
import re

import pyarrow as pa
import pytest

from tidemark.operators import pseudonyms as ps
from tidemark.operators.numbering import numbered

DOCS = "doc_id long, text string, stand_in string"

SHAPES = [
    ("see https://acme.example/x?y=1, now", "see URL_1, now"), ("git@host.acme:team/repo.git", "URL_1"), ("www.acme.io.", "URL_1."), ("mail A.b+c@x-y.co.uk!", "mail EMAIL_1!"),
    ("at 10.1.2.3 or 300.1.2.3", "at HOST_1 or 300.1.2.3"), ("2001:db8::1, 12:30:45, f64::MAX", "HOST_1, 12:30:45, f64::MAX"), ("::1 and fe80:: x", "HOST_1 and HOST_2 x"),
    ("config.local window.app acme.dev ACME.LOCAL", "config.local window.app HOST_1 HOST_2"), ("db7.acme-fin.corpnet foo.bar Class.method", "HOST_1 foo.bar Class.method"),
    ("node.js README.md Dockerfile.prod v1.2.3 e.g.", "node.js PATH_1.md PATH_2 v1.2.3 e.g."), ("src/app/main.py and/or n/a 1/2 I/O ./x", "PATH_1.py and/or n/a 1/2 PATH_2 ./x"), (r"C:\Users\x.txt;", "PATH_1.txt;"),
    ("PROJ-12 utf-8 python-3 build_ABC-7 abc-1 [x1-2] ABC-12x", "TICKET_1 utf-8 python-3 build_TICKET_2 TICKET_3 [x1-2] ABC-12x"), ("H1234 RFC3339 AB12345", "ID_1 RFC3339 ID_2"),
    ("3f9c2a7 decade 20261006 deadbeef v1.2-3-g3f9c2a7", "ID_1 decade 20261006 deadbeef v1.2-3-gID_1"), ("123e4567-e89b-12d3-a456-426614174000", "ID_1"), ("hi @octo-cat. a@b @x/y", "hi @PERSON_1. a@b @PERSON_2"),
    ("PERSON_7 stays", "PERSON_7 stays"), ("Merge branch 'feat/zap' into main", "Merge branch 'BRANCH_1' into main"), ("Merge pull request #3 from o/fix-it", "Merge pull request #3 from BRANCH_1"),
]


def run(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], DOCS)
    out = ps.pseudonymise(frame, **how)
    assert sorted(map(repr, ps.restored(out.texts, out.replaced).collect())) == sorted(map(repr, frame.select("doc_id", "text").collect()))
    return out


def test_shapes(spark):
    """Each case alone, so that its numbers start at 1: all in one table, told apart by what precedes the digits."""
    rows = [(k, text) for k, (text, _) in enumerate(SHAPES)]
    got = {r.doc_id: r.text for r in run(spark, rows).texts.collect()}

    def from_one(text):
        seen = {}
        return re.sub(rf"\b({'|'.join(ps.KINDS)})_([0-9]+)", lambda m: f"{m[1]}_{seen.setdefault((m[1], m[2]), 1 + sum(k == m[1] for k, _ in seen))}", text)

    for k, (text, want) in enumerate(SHAPES):
        assert from_one(got[k]) == from_one(want), text


def test_names(spark):
    people = spark.createDataFrame([("Jane Doe",), ("Frank Miller",), ("Mary-Jane O'Brien",), ("deploy-bot",), ("test",), ("jroe",)], "name string")
    others = spark.createDataFrame([("Blue Falcon", "TERM"), ("acme/billing", "REPO"), ("jroe", "TERM")], "name string, kind string")
    rows = [(1, "jane  DOE met Jane; janet didn't. doe"), (2, "ask Frank, frank or Miller. Frank said"), (3, "O’Brien and Mary of Mary-Jane"), (4, "blue\nfalcon acme/billing jroe deploy-bot test"), (5, "Reviewed-by: Zoe Quark <z.quark@a.bc>\nzoe z.quark")]
    out = run(spark, rows, people=people, others=others)
    got = {r.doc_id: r.text for r in out.texts.collect()}
    kinds = lambda t: re.sub("_[0-9]+", "", t)
    assert kinds(got[1]) == "PERSON met PERSON; janet didn't. PERSON" and got[1].split()[0] != got[1].split()[2]
    assert kinds(got[2]) == "ask PERSON, frank or PERSON. Frank said" and kinds(got[3]) == "PERSON and PERSON of PERSON"
    assert kinds(got[4]) == "TERM REPO TERM deploy-bot test" and kinds(got[5]) == "Reviewed-by: PERSON <EMAIL>\nPERSON PERSON"
    assert {r.original for r in out.keys.where("kind = 'TERM'").collect()} == {"blue\nfalcon", "jroe"}


def test_same_stand_in_everywhere(spark):
    rng = random.Random(3)
    bits = ["Mail a@b.cd", "MAIL A@B.CD", "x@y.zz", "10.0.0.1", "src/a.py", "PROJ-7", "proj-7 é😀", "plain words", "PERSON_1", "\n"]
    rows = [(k, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for k in range(300)] + [(None, "a@b.cd"), (7, None), (8, None), (5, "x@y.zz")]
    rows += [rows[3]] * 3
    out = run(spark, rows)
    assert out.texts.count() == len(rows)
    keys = {r.stand_in: r for r in out.keys.collect()}
    assert len(keys) == out.keys.count() and {k.split("_")[0] for k in keys} == {"EMAIL", "HOST", "PATH", "TICKET"}
    assert {k for k in keys if k.startswith("EMAIL")} == {"EMAIL_1", "EMAIL_2"}
    for r in out.texts.where("text is not null").collect():
        assert "@" not in r.text and "10.0" not in r.text and "src/" not in r.text
    again = ps.pseudonymise(spark.createDataFrame([(*r, "") for r in rows], DOCS).repartition(11))
    assert sorted(map(tuple, again.keys.collect())) == sorted(map(tuple, out.keys.collect()))


def test_long_and_empty(spark):
    assert run(spark, []).texts.count() == 0
    long = [(1, "a-" * 100_000), (2, "x.y." * 50_000), (3, "mail a@b.cc " * 20_000), (4, "w" * 300_000), (5, "a/b " * 50_000)]
    got = {r.doc_id: r.text for r in run(spark, long).texts.collect()}
    assert got[3] == "mail EMAIL_1 " * 20_000 and got[4] == long[3][1]
    names = spark.createDataFrame([(" ".join(["word"] * 20),)], "name string")
    with pytest.raises(Exception, match="too many tokens"):
        ps.pseudonymise(spark.createDataFrame([(1, "x", "")], DOCS), people=names).texts.collect()


def test_names_that_share_their_first_token(spark):
    """A run of tokens meets the names that it equals, not all that begin like it: no more candidates than places where a name is."""
    people = spark.createDataFrame([(f"jan.{k}",) for k in range(300)], "name string")
    text = "jan " * 500 + "jan.7 JAN.250 jan.300 jan 7"
    docs = spark.createDataFrame([(1, text, "")], DOCS)
    names = ps.names_of(docs, people).persist()
    batch = pa.RecordBatch.from_pydict({"k": [b"x"], "doc_id": [1], "text": [text]})
    met = [r for b in ps._scan([batch], *ps._bitmaps(names), ps.VOCABULARY, []) for r in b.to_pylist()]
    assert names.count() == 301 and len(met) <= 500 + 5 + 2 + 2  # one false hit of the filter would still do
    got = run(spark, [(1, text)], people=people).texts.first().text
    assert got == "PERSON_1 " * 500 + "PERSON_2 PERSON_3 PERSON_1.300 PERSON_1 7"


def test_only_lively_parts_are_cut(spark, monkeypatch):
    """Plain prose isn't cut into tokens; what is found, also around white space and marks, is what cutting all of a text finds."""
    rng = random.Random(7)
    terms = ["jane doe", "' foo", "(x) y", "o’brien", "a-b c", "été", "foo: bar", "blue falcon of the north"]
    docs, others = spark.createDataFrame([(1, "x", "")], DOCS), spark.createDataFrame([(t, "TERM") for t in terms], "name string, kind string")
    maps = ps._bitmaps(ps.names_of(docs, others=others).persist())

    def found(texts, maps):
        batch = pa.RecordBatch.from_pydict({"k": [str(k).encode() for k in range(len(texts))], "doc_id": list(range(len(texts))), "text": texts})
        return sorted((repr(r) for b in ps._scan([batch], *maps, ps.VOCABULARY, []) for r in b.to_pylist() if r["kind"] or r["name"][2:].replace("\0", "") in terms + ["o'brien"]))

    bits = ["jane", "DOE", "Jane  doe", "jane\ndoe", "' foo", "a' foo", "(x) y", "O'Brien,", "a-b", "c", "ÉTÉ.", "foo:", "foo", "bar", "::1", "ab::", "10.0.0.1", "x@y.zz", "utf-8", "e.g.", "PROJ-1", "[x1-2]", "node.js", "blue falcon of", "the north", "w" * 40, "plain", "\xa0", "\r\n", ")", ".", ":", "/", "-"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    assert len(found(texts, maps)) > 1000 and found(texts, maps) == found(texts, (*maps[:2], " ", *maps[3:]))

    cut, tokens = [], ps.tokens
    monkeypatch.setattr(ps, "tokens", lambda text, *how: cut.append(len(text)) or tokens(text, *how))
    assert len(found(["Plain words, and (more) of them. " * 1000 + "mail x@y.zz " + "and so on; " * 1000], maps)) == 1
    assert sum(cut) < 500


def test_dense_names(spark, monkeypatch):
    """Names that are every second word: nothing is cut into tokens for them, what is found goes on as one row a text and one a spelling, and it is what cutting every text finds."""
    rng = random.Random(11)
    terms = ["est", "jan", "jan.7", "jan doe", "jan. est", "ab (c", "été", "x-y", "for", "ΟΔΟΣ", "doe's", "naïve ab"]
    others = spark.createDataFrame([(t, "TERM") for t in terms], "name string, kind string")
    people = spark.createDataFrame([("Frank Grace Jan",)], "name string")
    names = ps.names_of(spark.createDataFrame([(1, "x", "")], DOCS), people, others).persist()
    maps = ps._bitmaps(names)
    bits = ["est", "Est,", "(JAN)", "jan.", "jan", "doe", "Doe:", "7", "jan.7", "ab", "(c", "ab (c", "ÉTÉ", "été.", "x-y", "For", "οδος", "ΟΔΟΣ", "doe's", "Frank", "Grace,", "grace", "frank", "plain", "words", ":", "a@b.cd", "PROJ-1", "Naïve", "\xa0", "😀est", "w" * 40, ".", "..", "e.g."]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", " ", "", "\n", "\t", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    known = {r.name: r.kind for r in names.collect()}

    def spans(text):
        """By all tokens and the names themselves."""
        whole = [r for b in ps._scan([pa.RecordBatch.from_pydict({"k": [b"x"], "doc_id": [1], "text": [text]})], *maps[:2], " ", *maps[3:], ps.VOCABULARY, []) for r in b.to_pylist()]
        reach, rows = -1, [(r["start"], r["rank"], -r["end"], r["kind"] or known[r["name"]], r["core"], r["ext"]) for r in whole if r["kind"] or r["name"] in known]
        for start, _, end, kind, core, ext in sorted(rows):
            if start >= reach:
                reach = -end
                yield start, -end, kind, core, ext

    uses, want = {}, []
    for text in texts:
        new, at = "", 0
        for start, end, kind, core, ext in spans(text):
            new, at = new + text[at:start] + f"{kind}_{ext}", end
            uses[kind] = uses.get(kind, 0) + 1
        want.append(new + text[at:])
    out = run(spark, [*enumerate(texts), *enumerate(texts)], people=people, others=others)
    got = {r.doc_id: re.sub(f"({'|'.join(ps.KINDS)})_[0-9]+", r"\1_", r.text) for r in out.texts.collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert {r.kind: r.n for r in out.keys.groupBy("kind").agg({"n_uses": "sum"}).withColumnRenamed("sum(n_uses)", "n").collect()} == uses and uses["TERM"] > 2000 and uses["PERSON"] > 50

    cut, tokens = [], ps.tokens
    monkeypatch.setattr(ps, "tokens", lambda text, *how: cut.append(len(text)) or tokens(text, *how))
    text = "Plain est, and (for) some jan. The est for more " * 1000
    assert sum(b.num_rows for b in ps._scan([pa.RecordBatch.from_pydict({"k": [b"x"], "doc_id": [1], "text": [text]})], *ps._bitmaps(names.where("name not like '%jan%doe' and name not like '%jan%est'")), ps.VOCABULARY, [])) >= 5000
    assert sum(cut) == 0


def test_numbers_along_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), k, rng.random()) for k in range(2000)]
    got = numbered(spark.createDataFrame(rows, "g string, k long, v double").repartition(7), ["g"], ["v", "k"]).collect()
    want = {}
    for g in ("a", "b", None):
        want |= {r[1]: n for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])), 1)}
    assert {r.k: r.n for r in got} == want
    assert sorted(r.n for r in numbered(spark.range(50), [], ["id"]).collect()) == list(range(1, 51))
