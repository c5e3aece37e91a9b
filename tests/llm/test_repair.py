"""Repair of conversations against a search over all edits, and odd rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tests.oracle import differs
from tidemark.llm import repair

TURNS = "conv_id long, turn long, role string, text string, audit string"


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def faults_by_hand(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Dijkstra over (row, roles so far as a state), with whole audits compared: no recursion, no states of the operator."""
    ok = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, at, last, out = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        if (at, last) in done:
            continue
        done[at, last] = True
        for role in ("user", "assistant"):
            if role[0] in ok[last]:
                heapq.heappush(heap, (cost + 3, audit + "I", at, role[0], (*out, (role, ""))))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, out))
            if faults[at] not in ("blank", "duplicate"):
                extra = 3 if faults[at] == "truncated" else 0
                if role[:1] and role[0] in ok[last]:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, role[0], (*out, (role, text))))
                for new in ("user", "assistant"):
                    if new[0] in ok[last]:
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", at + 1, new[0], (*out, (new, text))))


def by_hand(rows):
    after, out = damaged_by_hand(rows), []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = faults_by_hand(mine)
        turns = {r[1] for r in mine if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, text = cheapest(mine, faults)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def same(spark, rows):
    got = repair.digests(repair.damaged(spark.createDataFrame([(*r, "clash") for r in rows], TURNS).repartition(3)))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    order = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(by_hand(rows), key=order)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ultra"], ["One. ", "Two!", "three", " \t\n", "", None, "é…", "Four?　", "Five. x", "six.\x0b\x0c"]
    return [(conv if conv else None, rng.choice([None, *range(8)]) if rng.random() < 0.1 else turn, rng.choice(roles), rng.choice(texts)) for conv in range(400) for turn in range(rng.randint(1, 9))]


def test_rows_by_hand(spark, rows):
    same(spark, rows)


def test_every_short_signature():
    """All signatures of up to five rows: cost and audit as by search."""
    signs = {"s": ("system", ""), "u": ("user", ""), "a": ("assistant", ""), "o": ("tool", ""), "S": ("system", "truncated"), "U": ("user", "truncated"), "A": ("assistant", "truncated"), "x": ("user", "blank")}
    for n in range(5):
        for signature in itertools.product(signs, repeat=n):
            rows = [(0, 0, signs[c][0], "") for c in signature]
            assert repair.solve("".join(signature)) == cheapest(rows, [signs[c][1] for c in signature])[:2], signature


def test_odd_tables(spark, rows):
    assert repair.digests(repair.damaged(spark.createDataFrame([], TURNS))).count() == 0
    gone = next((c, t) for c in range(1, 100) for t in range(10) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    same(spark, [(*gone, "user", "all of it goes.")])
    same(spark, [(1, 1, "user", "x.")] * 40 + [(1, None, "user", "x.")] * 3 + [(2, 5, None, None)])
    same(spark, [(3, 2**40 + k, "assistant" if k % 2 else "user", "long " * 20000 + ".") for k in range(4)])


def test_one_very_long_conversation(spark):
    rng = random.Random(1)
    rows = [(5, k, rng.choice(["user", "assistant"]), rng.choice([f"t{k}.", f"t{k}", ""])) for k in range(20000)]
    r = repair.digests(repair.rows_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert len(r.audit) >= 20000 and r.blank == sum(t == "" for *_, t in rows) and r.gaps == 0


def test_repaired_rows_alternate(spark, rows):
    frame = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    chats = {}
    for r in repair.repaired(frame).orderBy("conv_id", "position").collect():
        if r.edit != "D":
            chats.setdefault(r.conv_id, []).append((r.role, r.text))
    shas = {r.conv_id: r.repaired_sha256 for r in repair.digests(frame).collect()}
    for conv, chat in chats.items():
        assert re.fullmatch("s?(ua)+", "".join(r[0] for r, _ in chat))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in chat).encode()).hexdigest() == shas[conv]


def test_equals_its_sql_at_some_hundred_conversations(spark):
    d = "/root/testdata/sf0.1"
    assert differs(repair.digests(repair.damaged(spark.read.parquet(f"{d}/conversations.parquet"))), repair.ORACLE_SQL, d) is None
