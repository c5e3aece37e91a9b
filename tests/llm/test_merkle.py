"""The manifest against a plain recursive tree, at several partitionings; the monoid; proofs folded from listed siblings."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest

from tests.oracle import differs
from tidemark.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def tree(nodes):
    """(root, the siblings of each node as (left, right) a level)."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
    root, above = tree([H(*run) for run in runs])
    return root, [[(run[:k], run[k + 1 :]), *above[j]] for j, run in enumerate(runs) for k in range(len(run))]


def by_hand(rows):
    key = lambda r: (r[3] is not None, (r[3] or "").encode())
    ordered = sorted(rows, key=lambda r: (key(r), r[0] is not None, r[0] or 0, leaf(r, r[1])))
    groups = [list(g) for _, g in groupby(ordered, key=key)]
    trees = [tree([leaf(r, r[1]) for r in g]) for g in groups]
    if not groups:
        return []
    root, tops = tree([t[0] for t in trees])
    out = []
    for group, (subroot, paths), top in zip(groups, trees, tops):
        for r, path in zip(group, paths):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            now = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if changed else r[1])
            for a, b in path + top:
                now = H(*a, now, *b)
            out.append((-1 if r[0] is None else r[0], leaf(r, r[1]), subroot, root, H(*(d for a, b in path + top for d in a + b)), now, now == root))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for k in range(1500):
        source = "hot" if rng.random() < 0.4 else None if rng.random() < 0.05 else rng.choice(["a", "é", "z", "😀", f"one {k}", f"s{rng.randint(0, 40)}"])
        out.append((k if rng.random() < 0.97 else None, rng.choice([None, "", "Mixed É Case", f"text {k}"]), rng.choice([None, "en"]), source, rng.choice([None, k]), "clash"))
    return [*out, *[out[7]] * 60, out[3], out[3]]


def got(frame, **how):
    return sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in merkle.proofs(merkle.manifest(merkle.leaves(frame), **how)).drop("source").collect())


@pytest.mark.parametrize("how", [{}, {"per_part": 50, "merged": 2}, {"per_part": 7, "merged": 16}])
def test_rows_by_hand(spark, rows, how):
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    assert got(frame, **how) == by_hand(rows)


def test_small_tables(spark, rows):
    assert got(spark.createDataFrame([], DOCS)) == []
    for n in (1, 2, 16, 17):
        some = [(k, f"T{k}", "en", "s", 1, "") for k in range(n)]
        assert got(spark.createDataFrame(some, DOCS)) == by_hand(some)
    each = [(k, "Abc", None, f"s{k:03d}", None, "") for k in range(40)]
    assert got(spark.createDataFrame(each, DOCS)) == by_hand(each)


def test_fragments_are_associative():
    """Any grouping and order of the leaves gives one root and makes each node once."""
    rng = random.Random(2)
    sizes = {merkle.TOP: 3, 0: 300, 1: 1, 2: 17}
    leaves = {(t, 0, k): H(str(t), str(k)).encode() for t, n in sizes.items() if t != merkle.TOP for k in range(n)}
    want_left, want_made = merkle.settle(leaves, sizes)
    assert [k[:2] for k in want_left] == [(merkle.TOP, 1)]
    for _ in range(20):
        keys = list(leaves)
        rng.shuffle(keys)
        parts = [{}] + [{k: leaves[k] for k in keys[j::9]} for j in range(9)]
        made, seen = {}, 0
        while len(parts) > 1:
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            left, new = merkle.settle(a | b, sizes)
            seen += len(new)
            made |= new
            parts.append(left)
        assert parts[0] == want_left and made == want_made and seen == len(made)


def test_listed_siblings_fold_to_the_root(spark, rows):
    m = merkle.manifest(merkle.leaves(spark.createDataFrame(rows, DOCS)), per_part=100)
    root, subroots = m.root(), {r.source: (r.n, r.subroot) for r in m.sources_table().collect()}
    for r in merkle.proofs(m, siblings=True).collect():
        assert H(*r.siblings) == r.proof_sha256 and r.root == root and subroots[r.source][1] == r.subroot
    assert sum(n for n, _ in subroots.values()) == len(rows)


def test_equals_its_sql_at_some_thousand_rows(spark):
    d = "/root/testdata/sf0.01"
    assert differs(merkle.digests(spark.read.parquet(f"{d}/documents.parquet")), merkle.ORACLE_SQL, d) is None
