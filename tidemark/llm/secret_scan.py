"""Secrets in texts: three fixed formats, and strings that a battery of randomness tests tells from ordinary ones.

Base spans: assignments to names of secrets, access keys and long hex runs (``BASE``). Other candidates are maximal runs of LEAST or more base-64 characters, of
either alphabet. A candidate's encoding is the smallest alphabet that holds it; digits alone and the 8-4-4-4-12 shape of identifiers have none. Three statistics are
taken: chi-squared against a uniform alphabet (as the number of coincident pairs, which determines it), runs of character classes, and serial correlation
of neighbouring positions in the alphabet (equality at longer distances rules out repeated patterns). Each has a law under two hypotheses, both of which know the length: uniform characters, by formula; and
ordinary strings, by formula with moments fitted on ORDINARY generated strings, for each way of writing them (names in the usual spellings, paths,
dates, counters, repeated patterns). A candidate that any test tells from uniform at VETO is ordinary. Else its p-value is Fisher's combination of the three tail
probabilities of ordinary strings, towards random ones, the largest over the ways of writing.

All candidates of the table are tested at once, so false discoveries are controlled by Benjamini and Hochberg's step-up rule at RATE, within strata of encoding and
doubling length: long words are many and random-looking ones rare, so short candidates face a sterner threshold. The rule needs only counts of p-values on a grid,
at most STRATA x BINS numbers, whatever the size of the table; p-values are rounded up to the grid, so the rate holds.

A null text is empty and has no spans; every row comes out once, repeated rows as often as they stand; extra columns are ignored; an empty table has no rows. Offsets are
code points. An added span that overlaps a base span isn't tested.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

KINDS = ("assign", "access", "hex", "random")
#: The formats, and the least length of what has to be long.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS, _HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{32,}")
_VALUE, _KEY = 8, 16
LEAST = 20
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST)
_IDENTIFIER = re.compile("[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")

RATE, VETO = 0.01, 3.3  # of false discoveries; standard deviations from uniform
LAGS, REPEAT = 64, 14.0  # distances at which repeats are sought; logarithm of the chance that is too small
#: p-values by GRID-th parts of a decade, down to 10 ** (-BINS / GRID).
GRID, BINS = 8, 400
#: Generated ordinary strings, and the least of them that a law is fitted on.
ORDINARY, FEW = 6000, 25

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings by size of alphabet.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef"), ("hex upper", _DIGITS + "ABCDEF"), ("lower", _LOWER), ("upper", _UPPER), ("base32", _UPPER + "234567"), ("base36", _LOWER + _DIGITS),
    ("base36 upper", _UPPER + _DIGITS), ("letters", _UPPER + _LOWER), ("base62", _UPPER + _LOWER + _DIGITS), ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64 url", _UPPER + _LOWER + _DIGITS + "-_"), ("mixed", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
STRATA = len(ENCODINGS) * 32
_PLACES = [{c: k for k, c in enumerate(alphabet)} for _, alphabet in ENCODINGS]
_SETS = [frozenset(alphabet) for _, alphabet in ENCODINGS]
_CLASS = str.maketrans({c: "v" if c in "aeiouAEIOU" else "c" for c in _LOWER + _UPPER})


def encoding(text: str) -> int | None:
    chars = set(text)
    if chars <= set(_DIGITS) or _IDENTIFIER.fullmatch(text):
        return None
    return next(k for k, alphabet in enumerate(_SETS) if chars <= alphabet)


def _classes(text: str, code: int) -> str:
    """The class of each character: vowels and consonants where all are letters of one case, else cases, digits and signs."""
    if ENCODINGS[code][0] in ("lower", "upper"):
        return text.translate(_CLASS)
    return "".join("d" if c in _DIGITS else "u" if c in _UPPER else "l" if c in _LOWER else "s" for c in text)


def statistics(text: str, code: int) -> tuple[float, float, float]:
    """Coincident pairs, changes of class, serial correlation."""
    n, place, classes = len(text), _PLACES[code], _classes(text, code)
    pairs = sum(c * (c - 1) for c in Counter(text).values()) / 2
    changes = sum(a != b for a, b in zip(classes, classes[1:]))
    at = [place[c] for c in text]
    mean = sum(at) / n
    spread = sum((x - mean) ** 2 for x in at)
    return pairs, changes, sum((x - mean) * (y - mean) for x, y in zip(at, at[1:])) / spread if spread else 1.0


def _law(n: int, s2: float, s3: float, change: float, serial: float) -> tuple:
    """(mean, standard deviation) of the three statistics of n characters with these moments of their frequencies, share of changes and correlation."""
    pairs = n * (n - 1) / 2
    spread = pairs * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * max(0.0, s3 - s2 * s2)
    return (pairs * s2, math.sqrt(spread + 1e-9)), ((n - 1) * change, math.sqrt((n - 1) * change * (1 - change) + 1e-9)), (serial - 1 / n, 1 / math.sqrt(n))


def _uniform(code: int) -> tuple:
    name, alphabet = ENCODINGS[code]
    shares = Counter(_classes(alphabet, code))
    size = len(alphabet)
    return 1 / size, 1 / size**2, 1 - sum((m / size) ** 2 for m in shares.values()), 0.0


_WORDS = "user name list item value count index table query report change commit author branch merge handle request server client config option window stream output input file path data time date hour week month total average first last next open close read write load save start stop build test check parse format render version number record field schema batch event state context model train score label token page text line word block section chapter summary image video audio public private static final return default factory service manager controller repository interface abstract component provider listener adapter".split()


def ordinary(rng: random.Random) -> tuple[str, str]:
    """A way of writing and a string of it that is no secret, of LEAST to some 120 characters."""
    words = [rng.choice(_WORDS) for _ in range(rng.randint(3, 14))]
    titles, number = [w.title() for w in words], str(rng.randint(0, 10 ** rng.randint(1, 4)))
    period, digits = rng.choice([1, 2, 3, 4, 6, 8]), rng.choice(["0123456789abcdef", "0123456789ABCDEF", _LOWER, _LOWER + _DIGITS])
    day = f"{rng.randint(1990, 2030)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}"
    ways = {
        "camel": words[0] + "".join(titles[1:]), "camel, number": "".join(titles) + number, "numbered": "".join(w + number for w in words), "snake": "_".join(words),
        "kebab": "-".join([*words, number]), "path": "/".join(["", *words, words[0] + "_" + number]), "plain": "".join(words), "plus": "+".join(words),
        "capitals": "".join(words).upper(), "capital snake": "_".join(words).upper(), "capitals, number": "".join(words).upper() + number,
        "shouted": "".join(rng.choice([w.title(), w.upper()]) for w in words) + number, "padded": f"{rng.randint(0, 16 ** rng.randint(2, 6)):0{rng.randint(LEAST, 40)}x}",
        f"period {period}": ("".join(rng.sample(digits, period)) * 64)[: rng.randint(LEAST, 64)], "date": f"{day}T{rng.randint(0, 23):02d}{rng.randint(0, 59):02d}00Z-{words[0]}-{words[1]}",
    }
    way = rng.choice(list(ways))
    return (way, ways[way]) if len(ways[way]) >= LEAST else ordinary(rng)


def _fit(texts: list[str], code: int) -> tuple:
    """(moments of these strings, and mean and deviation of their standardised statistics)."""
    seen = [(len(t), *statistics(t, code)) for t in texts]
    triples = sum(c * (c - 1) * (c - 2) for t in texts for c in Counter(t).values())
    moments = (
        sum(s[1] for s in seen) / sum(s[0] * (s[0] - 1) / 2 for s in seen), triples / sum(s[0] * (s[0] - 1) * (s[0] - 2) for s in seen),
        sum(s[2] for s in seen) / sum(s[0] - 1 for s in seen), sum(s[3] + 1 / s[0] for s in seen) / len(seen),
    )
    scores = [[(x - mean) / sd for x, (mean, sd) in zip(s[1:], _law(s[0], *moments))] for s in seen]
    means = [sum(z[k] for z in scores) / len(scores) for k in range(3)]
    return moments, [(m, max(1.0, math.sqrt(sum((z[k] - m) ** 2 for z in scores) / len(scores)))) for k, m in enumerate(means)]


@functools.cache
def fitted() -> tuple:
    """Per encoding, the laws of the ways of writing that it is inferred for, or if there are none, of those that its alphabet holds."""
    rng = random.Random(12)
    table = [ordinary(rng) for _ in range(ORDINARY)]
    out = []
    for code, alphabet in enumerate(_SETS):
        exact, held = defaultdict(list), defaultdict(list)
        for way, text in table:
            if set(text) <= alphabet:
                held[way].append(text)
                if encoding(text) == code:
                    exact[way].append(text)
        groups = [g for g in exact.values() if len(g) >= FEW] or [g for g in held.values() if len(g) >= FEW]
        out.append([_fit(g, code) for g in groups])
    return tuple(out)


def _tail(z: float) -> float:
    """P(a standard normal is at most z)."""
    return max(0.5 * math.erfc(-z / math.sqrt(2)), 1e-300)


def repeats(text: str, size: int) -> bool:
    """Whether neighbours at some distance up to LAGS are equal far more often than uniform characters would be, by Chernoff's bound."""
    for lag in range(1, min(len(text) // 2, LAGS) + 1):
        pairs = len(text) - lag
        share = sum(a == b for a, b in zip(text, text[lag:])) / pairs
        if share > 1 / size:
            excess = share * math.log(share * size) + ((1 - share) * math.log((1 - share) / (1 - 1 / size)) if share < 1 else 0.0)
            if pairs * excess > REPEAT:
                return True
    return False


def p_value(text: str, code: int) -> float:
    """The chance that an ordinary string of this encoding and length looks as random: the largest over the ways of writing."""
    found = statistics(text, code)
    uniform = _law(len(text), *_uniform(code))
    if any(abs(x - mean) > VETO * sd for x, (mean, sd) in zip(found, uniform)) or repeats(text, len(ENCODINGS[code][1])):
        return 1.0
    most = 0.0
    for moments, scale in fitted()[code]:
        logs = 0.0
        for x, (mean, sd), (shift, stretch), (aim, _) in zip(found, _law(len(text), *moments), scale, uniform):
            z = ((x - mean) / sd - shift) / stretch
            logs -= math.log(_tail(z if aim < mean else -z))
        most = max(most, math.exp(-logs) * (1 + logs + logs * logs / 2))  # chi-squared with six degrees of freedom
    return min(1.0, most)


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats, by start, then kind."""
    low, out = text.lower(), []
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):  # as every match has
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _KEY]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, known: list) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, bin) of the runs that no base span overlaps."""
    out, k, reach = [], 0, 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        while k < len(known) and known[k][0] < b:
            reach, k = max(reach, known[k][2]), k + 1
        code = encoding(m.group()) if reach <= a else None
        if code is not None:
            p = p_value(m.group(), code)
            out.append((a, b, code * 32 + (b - a).bit_length(), min(BINS, int(-math.log10(max(p, 1e-60)) * GRID))))
    return out


_SPAN, _TEST = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]), pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("bin", pa.int32())])


def _scan(batches):
    for batch in batches:
        spans, tests = [], []
        for text in batch.column("text").to_pylist():
            found = base(text or "")
            spans.append([{"start": a, "kind": k, "end": b} for a, k, b in found])
            tests.append([{"start": a, "end": b, "stratum": s, "bin": n} for a, b, s, n in candidates(text or "", found)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(_SPAN)), pa.array(tests, pa.list_(_TEST))], ["doc_id", "base", "tests"])


def thresholds(counts: list[tuple[int, int, int]]) -> dict[int, int]:
    """The least bin that is a discovery, by stratum, from (stratum, bin, count)."""
    out = {}
    for stratum in {s for s, _, _ in counts}:
        found = Counter({b: n for s, b, n in counts if s == stratum})
        tests, beyond = found.total(), 0
        for level in sorted(found, reverse=True):
            beyond += found[level]
            if tests * 10 ** (-level / GRID) <= RATE * beyond:
                out[stratum] = level
    return out


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and added spans (start, kind, end), each by start; ``spans`` has both."""
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scan, "doc_id long, base array<struct<start:long,kind:int,end:long>>, tests array<struct<start:long,end:long,stratum:int,bin:int>>"
    )
    scanned = written(scanned)
    counted = scanned.select(F.explode("tests").alias("t")).groupBy("t.stratum", "t.bin").agg(F.count("*").alias("n"))
    least = thresholds([tuple(r) for r in counted.collect()])  # at most STRATA x BINS rows
    bound = F.create_map(*[F.lit(x) for pair in least.items() for x in pair]) if least else F.lit(None).cast("map<int,int>")
    found = F.filter("tests", lambda t: F.coalesce(t["bin"] >= F.element_at(bound, t["stratum"]), F.lit(False)))
    added = F.transform(found, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))
    return scanned.select("doc_id", "base", added.alias("added")).withColumn("spans", F.sort_array(F.concat("base", "added")))


def _text(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of found spans."""
    counts = [F.size(F.array_compact(F.transform("base", lambda s: F.when(s["kind"] == code, 1)))).cast("long").alias(f"n_{KINDS[code]}") for code in range(3)]
    return found.select("doc_id", *counts, F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"), F.size("added").cast("long").alias("n_random"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by ``<secret>``, spans that overlap or touch by one; a null text stays null. Rows of one doc_id must have one text."""
    spans = find(docs).groupBy("doc_id").agg(F.first("spans").alias("_spans")).where(F.size("_spans") > 0)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    held = docs.select(F.col("doc_id").cast("long").alias("_id"), whole).join(spans.withColumnRenamed("doc_id", "_id"), "_id", "left")
    start = F.struct(F.lit("").alias("text"), F.lit(1).cast("long").alias("at"))
    text = F.col("_row.text")
    cut = F.aggregate(
        "_spans", start,
        lambda state, s: F.struct(
            F.concat(state["text"], F.when(s["start"] + 1 > state["at"], F.substr(text, state["at"], s["start"] + 1 - state["at"])).otherwise(""), F.when((s["start"] + 1 > state["at"]) | (state["text"] == ""), "<secret>").otherwise("")).alias("text"),
            F.greatest(state["at"], s["end"] + 1).alias("at"),
        ),
        lambda state: F.concat(state["text"], F.substr(text, state["at"])),
    )
    clean = F.when(F.col("_spans").isNotNull(), cut).otherwise(text)
    return held.select(*[clean.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
