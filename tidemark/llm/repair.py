"""Repair of conversation structure: faults of turns, and the cheapest edits that give the roles ``(s?(ua)+)?``.

Each row is one symbol of its conversation's signature: the initial of its role (``o``: any other), in upper case if its text is truncated, or ``x`` if it has to go.
Conversations of one signature have the same cheapest edits, so each distinct signature is solved once: a memoised recursion over (row, state), where the
state is the last role kept. Its four edits lead to different states and have different initials, so of equally cheap edits the ASCII-least is taken at
once, without comparing rests, and the memo is a byte per row and state. The audits are joined back (signatures that many conversations share without a
shuffle) and the edits replayed over the rows.

A null role or text is one space, so such a text is blank. Rows go by turn (null first), then role, then text. The first fault of a row counts: blank (only
white space), duplicate (role and text stood before in its conversation), truncated (its last visible character isn't one of ``.!?``). A null conv_id is a
conversation of its own. An empty table has no conversations; extra columns are ignored; repeated rows are repeated turns. A conversation's rows stream
through one task in order, as its digest is sequential: none of them are gathered, only a byte per row is.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .merkle import CRC_TABLE, crc_sql
from .shared import join_hot, written

SPACE = " \t\n\x0b\x0c\r"
#: Cost of the edits; a truncated row that isn't deleted costs TRUNCATED more.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after a system row, after a user row, after an assistant row. By a state, what may come next: the role and its state.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
_INF = 1 << 60


def damaged(turns: DataFrame) -> DataFrame:
    """The rows after damage by crc32(conv_id:turn) % 20; a dropped row stays as a mark of its conversation (``gone``)."""
    space = F.lit(" ")
    conv_id, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    key = F.concat(F.coalesce(conv_id.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    fate = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    hit = turns.select(conv_id.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), fate.alias("fate"))
    hit = hit.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return hit.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fate") == 0).alias("gone"))


def rows_of(turns: DataFrame) -> DataFrame:
    """Conversations as they are, in the form of ``damaged``."""
    space = F.lit(" ")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), F.lit(False).alias("gone"))


def solve(signature: str) -> tuple[int, str]:
    """(cost, edits) of a signature: K keep, R rerole, D delete, I insert."""
    memo = [bytearray(len(signature) + 1) for _ in range(4)]  # the first edit of the best repair of the rows from here on, by state; 0: nothing is left to do

    def relaxed(at: int, costs: list[int], firsts: list[int]) -> list[int]:
        """Costs with insertions: after two of them the state is one that was left, so more are never cheaper."""
        for state, source in ((USER, list(costs)), (ASSISTANT, list(costs)), (EMPTY, costs), (SYSTEM, costs)):
            more = INSERT + source[NEXT[state][1]]
            if (more, ord("I")) < (costs[state], firsts[state]):
                costs[state], firsts[state] = more, ord("I")
        for state in range(4):
            memo[state][at] = firsts[state]
        return costs

    best = relaxed(len(signature), [0, _INF, _INF, 0], [0] * 4)
    for at in range(len(signature) - 1, -1, -1):
        sign = signature[at]
        role, extra = sign.lower(), TRUNCATED if sign.isupper() else 0
        costs, firsts = [DELETE + c for c in best], [ord("D")] * 4
        if sign != "x":
            for state in range(4):
                keeps = SYSTEM if role == "s" and state == EMPTY else NEXT[state][1] if role == NEXT[state][0][0] else None
                if keeps is not None:
                    costs[state], firsts[state] = min((costs[state], firsts[state]), (extra + best[keeps], ord("K")))
                costs[state], firsts[state] = min((costs[state], firsts[state]), (REROLE + extra + best[NEXT[state][1]], ord("R")))
        best = relaxed(at, costs, firsts)
    edits, at, state = bytearray(), 0, EMPTY
    while first := memo[state][at]:
        edits.append(first)
        if first == ord("K") and signature[at] in "sS":
            state = SYSTEM
        elif first != ord("D"):
            state = NEXT[state][1]
        at += first != ord("I")
    return best[EMPTY], edits.decode()


def _stream(batches, *names):
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _packed(records, schema: pa.Schema, size):
    """Arrow batches of at most some thousand records or some megabytes of ``size``."""
    held, weight = [], 0
    for r in records:
        held.append(r)
        weight += size(r)
        if len(held) >= 4096 or weight > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


_SIGNED = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("signature", pa.string())])


def _sign(batches):
    def records():
        for conv_id, group in itertools.groupby(_stream(batches, "conv_id", "turn", "initial", "fault", "gone"), lambda r: r[0]):
            n, signs, turns, low, high, last, before = dict.fromkeys(_COUNTS, 0), bytearray(), 0, None, None, None, None
            for _, turn, initial, fault, gone in group:
                if gone:
                    continue
                if turn is not None and turn != last:
                    turns, low, high, last = turns + 1, turn if low is None else low, turn, turn
                if fault:
                    n[fault] += 1
                if before is not None and before + initial not in ("su", "ua", "au"):
                    n["illegal"] += 1
                before = initial
                sign = "x" if fault in ("blank", "duplicate") else initial if initial in ("s", "u", "a") else "o"
                signs += (sign.upper() if fault == "truncated" else sign).encode()
            if turns:
                n["gaps"] = high - low + 1 - turns
            yield {"conv_id": conv_id, **n, "signature": signs.decode()}

    yield from _packed(records(), _SIGNED, lambda r: len(r["signature"]))


def signatures(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, counts of faults and of illegal neighbours, and its signature."""
    body = F.rtrim("text", F.lit(SPACE))
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")) > 1  # the rows are already dealt by conversation
    fault = F.when(body == "", "blank").when(F.col("again"), "duplicate").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated")
    ordered = rows.repartition("conv_id").withColumn("again", again).sortWithinPartitions("conv_id", "turn", "role", "text", "again")
    faults = ordered.select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"), "gone")
    return faults.mapInArrow(_sign, ", ".join(["conv_id long", *(f"{c} long" for c in _COUNTS), "signature string"]))


def _solve(batches):
    for batch in batches:
        found = [solve(s) for s in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("signature"), batch.column("n"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], ["signature", "n", "cost", "audit"])


def audits(signed: DataFrame) -> DataFrame:
    """The signed conversations with cost and audit (the initials of their edits)."""
    solved = written(signed.groupBy("signature").agg(F.count("*").alias("n")).mapInArrow(_solve, "signature string, n long, cost long, audit string"))
    return join_hot(signed, solved, "signature", "n", signed.count()).drop("n")


def replayed(rows):
    """(edit, role, text) of a repaired conversation's rows, and of deleted ones; ``rows`` starts with (audit, ...) and goes on with (role, text)."""
    edits, state = iter(next(rows)), EMPTY
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "K" and role[:1] == "s":
            state = SYSTEM
        elif edit != "D":
            role, state = role if edit == "K" else NEXT[state][0], NEXT[state][1]
        yield edit, role, text


def _replay(batches):
    """(first record, its rows' iterator) of each conversation: the audit row leads."""
    names = ("conv_id", "part", "role", "text", *_COUNTS, "cost")
    for _, group in itertools.groupby(_stream(batches, *names), lambda r: r[0]):
        head = next(group)
        yield head, replayed(itertools.chain([head[3]], ((r[2], r[3]) for r in group)))


_DIGESTS = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in [*_COUNTS, "cost"]), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digest(batches):
    def records():
        for head, rows in _replay(batches):
            sha, between = hashlib.sha256(), b""
            for edit, role, text in rows:
                if edit != "D":
                    sha.update(between + f"{role}:{text}".encode())
                    between = b"\n"
            yield {"conv_id": head[0], **dict(zip([*_COUNTS, "cost"], head[4:])), "audit": head[3], "repaired_sha256": sha.hexdigest()}

    yield from _packed(records(), _DIGESTS, lambda r: len(r["audit"]))


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _rewrite(batches):
    def records():
        for head, rows in _replay(batches):
            for position, (edit, role, text) in enumerate(rows):
                yield {"conv_id": head[0], "position": position, "edit": edit, "role": role, "text": text}

    yield from _packed(records(), _REPAIRED, lambda r: len(r["text"]))


def _led(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """Each conversation's audit row, then its rows in order, in one partition."""
    nothing = [F.lit(None).cast("long").alias(c) for c in [*_COUNTS, "cost"]]
    lead = audited.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), *_COUNTS, "cost")
    both = lead.unionByName(rows.where("not gone").select("conv_id", F.lit(1).alias("part"), "turn", "role", "text", *nothing))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "text")


def audited(rows: DataFrame) -> DataFrame:
    return audits(written(signatures(rows)))


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, edit, role, text; deleted rows are listed with edit D."""
    return _led(rows, audited(rows)).mapInArrow(_rewrite, "conv_id long, position long, edit string, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and the digest of the repaired rows, per conversation."""
    columns = ", ".join(["conv_id long", *(f"{c} long" for c in [*_COUNTS, "cost"]), "audit string", "repaired_sha256 string"])
    return _led(rows, audited(rows)).mapInArrow(_digest, columns)


def _oracle() -> str:
    """The same in SQL: the recursion goes from the last row to the first with (cost, audit, rows) for each of the four states."""
    blanks = " || ".join(f"chr({ord(c)})" for c in SPACE)
    pick = lambda *options: f"list_sort([{', '.join(options)}])[1]"
    more = lambda of, cost, edit, row="NULL": f"{{'c': {of}.c + {cost}, 'a': '{edit}' || {of}.a, 'r': " + (f"list_prepend({row}, {of}.r)" if row != "NULL" else f"{of}.r") + "}"
    never = "{'c': 1000000000, 'a': '', 'r': []::VARCHAR[]}"
    done = "{'c': 0, 'a': '', 'r': []::VARCHAR[]}"
    plain = []
    for state in range(4):
        role, then = NEXT[state]
        kept = f"CASE WHEN NOT gone_row AND initial = '{role[0]}' THEN {more(f's{then}', 'extra', 'K', 'line')} ELSE {never} END"
        system = [f"CASE WHEN NOT gone_row AND initial = 's' THEN {more('s1', 'extra', 'K', 'line')} ELSE {never} END"] if state == EMPTY else []
        changed = more(f"s{then}", f"{REROLE} + extra", "R", f"'{role}:' || text")
        plain.append(pick(more(f"s{state}", DELETE, "D"), kept, *system, f"CASE WHEN NOT gone_row THEN {changed} ELSE {never} END") + f" AS n{state}")
    return f"""WITH RECURSIVE {CRC_TABLE},
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate FROM conversations, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM h, range(CASE WHEN fate = 3 THEN 2 ELSE 1 END) WHERE fate <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {blanks}) AS body, left(role, 1) AS initial FROM d),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o),
f AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM e),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
             count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
g AS (SELECT conv_id, i, initial, role || ':' || text AS line, text, fault IN ('b', 'd') AS gone_row, CASE WHEN fault = 't' THEN {TRUNCATED} ELSE 0 END AS extra FROM f),
r AS (SELECT conv_id, n AS i, {done} AS s0, {{'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}} AS s1, {{'c': 3, 'a': 'I', 'r': ['assistant:']}} AS s2, {done} AS s3 FROM c
      UNION ALL
      SELECT conv_id, i, {pick("n0", more("m2", INSERT, "I", "'user:'"))}, {pick("n1", more("m2", INSERT, "I", "'user:'"))}, m2, {pick("n3", more("n2", INSERT, "I", "'user:'"))}
      FROM (SELECT *, {pick("n2", more("n3", INSERT, "I", "'assistant:'"))} AS m2
            FROM (SELECT r.conv_id, r.i - 1 AS i, {', '.join(plain)} FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i)))
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN (SELECT conv_id, s0 FROM r WHERE i = 0) z ON z.conv_id IS NOT DISTINCT FROM k.conv_id"""


ORACLE_SQL = _oracle()
