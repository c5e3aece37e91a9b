"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose spans that may overlap: the four base patterns, and looser forms of e-mail (spelled-out at and dot),
IP (eight groups of hexadecimal digits), card (groups of four with other separators) and phone (without a country code). Base spans that
pass their rule are always kept. The other candidates are scored by boosted trees over format and context features; the
trees are fitted, when the plan is built, on the table that ``labelled`` makes of short lists of frames and values; its features come from the same
generators and expressions. Held-out scores of folds of frames are calibrated by a logistic curve (Platt), and the threshold of a kind
is the smallest probability, 0.5 at least, above which ``PRECISION`` of its held-out rows are personal data.
A candidate is selected when it reaches the threshold of its kind, overlaps no base span, and overlaps no candidate that reaches its own and is
more probable (or as probable and earlier). Candidates of one kind never overlap.

Offsets count code points, the end is exclusive. Null texts are empty: no spans. Repeated rows are scanned each; extra columns are
ignored. Empty tables give empty tables. Whole texts are scanned, by patterns that don't backtrack over long runs, in time about linear in the text and its spans.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import packed

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written without backtracking: a run is entered at its start, or where the last match ended.
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]+\."),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", None),
    "card": (r"(?<![0-9])(?<![0-9][ -])(?=(?:[0-9][ -]?){11}[0-9])[0-9]++(?:[ -][0-9]++)*+", None),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
#: The looser generators: kind, pattern, and a cheap pattern that any text with a match has.
LOOSE = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[{] ?at ?[)\]}] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[{] ?dot ?[)\]}]|\.) ?[A-Za-z0-9-]{1,63}){1,6}", r"[(\[{] ?at ?[)\]}]"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"),
    ("card", r"(?<![0-9])[0-9]{4}[./_·][0-9]{4}[./_·][0-9]{4}[./_·][0-9]{1,7}(?![0-9])", r"[0-9]{4}[./_·][0-9]{4}[./_·]"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}[ .-][0-9]{4}"),
]
#: Words that stand near personal data, by kind, and words that speak against it.
CUES = {
    "email": r"mail|contact|write to|reach|address",
    "ip": r"\bip\b|ipv6|host|server|client|logged in|address",
    "card": r"card|visa|master|amex|credit|debit|pay",
    "phone": r"phone|\btel\b|\bcall\b|mobile|\bcell\b|\bfax\b|dial|contact|whatsapp|\bsms\b",
    "against": r"isbn|issn|order|invoice|serial|version|part no|model|sku|ticket|figure|score|ratio|total|id[:#]",
}
#: Frames around personal data ({} is the value), and around what looks alike.
FRAMES = {
    "email": (
        ["write to {} for details", "contact: {}", "mail me at {} please", "my address is {}", "reach us: {}", "e-mail {} today", "{}", "or {} now", "Please send the form to {}.", "Jane Doe, {}, Berlin", "questions? {}", "author: {} (2019)"],
        ["the room {} is big", "meet me {} and go", "values {} are sampled", "we stop {} late", "the array {} holds it", "price {} each", "they arrived {} as planned", "{}"],
    ),
    "ip": (
        ["ip {} logged in", "client address {} seen", "host {} is up", "ipv6 {} on server", "connect to {} now", "{}", "from {} port 22", "user bob came from {}", "server={}"],
        ["total {} ratio", "figure {} shows it", "score {} of the set", "the times {} were run", "mac table {} of serial", "version {} built"],
    ),
    "card": (
        ["visa card {} was charged", "pay with {} credit", "my credit card: {}", "debit card {} ok", "mastercard {} exp 10/27", "card no. {}", "he paid with amex {}", "{}", "billing: {}, cvv 123"],
        ["serial {} part no", "version {} of the model", "order id: {}", "isbn {}", "invoice {} total", "sku {} in stock", "years {} in the table", "ticket {} closed"],
    ),
    "phone": (
        ["call me: {} any time", "phone {}", "tel {} or fax", "my mobile is {}", "contact {}", "dial {} for help", "my cell: {}", "{}", "Reception: {}", "Jane Doe, {}", "text {} (sms)", "office {}, ask for Kim", "at {} until six", "leave word at {}", "Kim is on {} today"],
        ["order {} was sent", "invoice {} total", "serial {} model", "the numbers {} are round", "ticket {} closed", "figure {} values", "isbn {}", "sku {}", "scores {} were counted", "part no {}", "id: {} in the list"],
    ),
}
NAMES, HOSTS, DOMAINS = "jane.doe john bob.smith kim mara_k lee ann.li x7 info+news o.k-93".split(), "mail example post.example my-shop uni-berlin ex".split(), "com org net edu de io co.uk fr".split()
BRACKETS = ["[]", "()", "{}"]
ROWS = 60  # of each kind and label


def _sum(digits: str) -> int:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))


def _value(kind: str, real: bool, k: int, rng) -> str:
    """A value that the kind's looser generator finds, as personal data has it or as other text does."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(str(v) for v in rng.integers(0, 10, n))
    if kind == "email":
        a, gap = BRACKETS[k % 3], " " if k % 2 else ""
        at = f"{gap}{a[0]}at{a[1]}{gap}"
        if not real:
            return pick(["a", "day", "x", "meet", "f"]) + at + pick(["noon. Then", "five. It", "y.z", "i.j", "home. We", "hall [dot] b", "n.k", "the end. So"])
        dot = f"{gap}{a[0]}dot{a[1]}{gap}" if k % 4 else "."
        return pick(NAMES) + at + (pick(HOSTS) + "." + pick(DOMAINS)).replace(".", dot)
    if kind == "ip":
        if real:
            return ":".join(f"{int(v):x}" if k % 2 else f"{int(v):04x}" for v in [0x2001, *rng.integers(0, 65536, 7) * (rng.random(7) < 0.7)])
        return ":".join(f"{int(v):02d}" if k % 2 else str(v) for v in rng.integers(0, 60, 8))
    if kind == "card":
        one = pick("45") + digits(14)
        if real:
            one += str(-_sum(one + "0") % 10)
        else:
            one = pick(["2019202020212022", "1000200030004000", "9780" + digits(12), digits(16)])
            one = one if _sum(one) % 10 else one[:-1] + str((int(one[-1]) + 1) % 10)
        return pick("./_").join(one[i : i + 4] for i in range(0, 16, 4))
    area = str(rng.integers(201, 990)) if real else pick(["111", "123", "100", "250", digits(3)])
    middle, last = (str(rng.integers(200, 999)), digits(4)) if real else pick([("456", "7890"), ("500", "1000"), ("200", "3000"), ("222", "3333"), (digits(3), digits(4))])
    return f"({area}) {middle}-{last}" if real and k % 3 == 0 else pick([" ", ".", "-"]).join([area, middle, last])


def labelled() -> list[tuple[str, int, int]]:
    """Texts with one candidate each, whether it is personal data, and the fold of their frame."""
    rng, out = np.random.default_rng(11), []
    for kind, sides in FRAMES.items():
        for real, frames in ((1, sides[0]), (0, sides[1])):
            out += [(frames[k % len(frames)].replace("{}", _value(kind, bool(real), k, rng), 1), real, k % len(frames) % FOLDS) for k in range(ROWS)]
    return out


TOP_DOMAINS = r"(?i)[.)\]} ](?:com|org|net|edu|gov|int|info|biz|io|ai|app|dev|eu|uk|de|fr|es|it|nl|ch|at|be|pl|se|us|ca|au|jp|cn|in|br|mx|ru)$"
#: Right before a value: a colon, a bracket, or the start of a line.
BESIDE = r"(?:[:(<\n] ?|^)$"
#: What numbers of the North American plan start with.
DIALLED = r"^\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-]"
FEATURES = ["is_email", "is_ip", "is_card", "is_phone", "digits", "letters", "length", "luhn", "cue", "against", "dot", "top_domain", "beside", "wide", "dialled"]
TREES, RATE, FOLDS, PRECISION = 40, 0.3, 5, 0.97
#: Candidates to either side that one may overlap: its longest form has room for fewer.
NEAR, PART = 48, 128


def _found(text: Column, pattern: str, cheap: str | None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    none = F.array().cast("array<string>")
    return F.when(text.rlike(cheap), found).otherwise(none) if cheap else found


def _let(value: Column, use) -> Column:
    """What ``use`` makes of the value, worked out once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(values: Column, zero: int, merge) -> Column:
    """For each of an array of numbers what ``merge`` makes of all before it, in parts, so that no long array is copied at every step."""
    return _let(values, lambda v: _scanned(v, zero, merge))


def _scanned(values: Column, zero: int, merge) -> Column:
    number = lambda c: c.cast("int")
    start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / PART).cast("int")), lambda c: F.slice(values, c * PART + 1, PART))
    inner = F.transform(parts, lambda p: F.aggregate(p, start, lambda acc, v: F.struct(number(merge(acc["at"], v)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))))
    outer = F.struct(F.lit(zero).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    whole = F.aggregate(inner, outer, lambda acc, p: F.struct(number(merge(acc["at"], p["at"])).alias("at"), F.concat(acc["out"], F.array(F.transform(p["out"], lambda v: number(merge(acc["at"], v))))).alias("out")))
    return F.flatten(whole["out"])


def _starts(gaps: Column, found: Column) -> Column:
    """Start of each match, from the gaps before them."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(F.coalesce(g, F.lit(""))) + F.length(F.coalesce(m, F.lit(""))))
    return F.zip_with(_scan(steps, 0, lambda a, v: a + v), F.slice(gaps, 1, F.size(found)), lambda at, g: at + F.length(F.coalesce(g, F.lit(""))))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc, i):
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add) % 10 == 0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _passes(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return x.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(x))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _spans(kind: str, starts: Column, found: Column) -> Column:
    order = KINDS.index(kind)
    return F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), F.lit(order).alias("kind"), (s + F.length(m)).alias("end"), m.alias("value")))


def _text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds base: the spans of the four base patterns that pass, by start, then kind as listed."""
    out = docs
    for kind, (pattern, cheap) in BASE.items():
        out = out.withColumn(f"_{kind}", _found(F.col("text"), pattern, cheap))
    for kind, (pattern, _) in BASE.items():
        none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
        spans = F.filter(_spans(kind, _starts(F.split("text", pattern, -1), F.col(f"_{kind}")), F.col(f"_{kind}")), _check(kind))
        out = out.withColumn(f"_{kind}", F.when(F.size(f"_{kind}") > 0, spans).otherwise(none))
    return out.withColumn("base", F.array_sort(F.concat(*[F.col(f"_{k}") for k in KINDS]))).drop(*[f"_{k}" for k in KINDS])


def _check(kind: str):
    return lambda s: _passes(kind, s["value"])


def candidates(docs: DataFrame) -> DataFrame:
    """Adds loose: spans of the looser generators with what stands around them, up to 30 characters or the next candidate of the kind."""
    out, names = docs, []
    for k, (_, pattern, cheap) in enumerate(LOOSE):
        out = out.withColumn(f"_{k}", _found(F.col("text"), pattern, cheap))
    for k, (kind, pattern, _) in enumerate(LOOSE):
        none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,before:string,near:string>>")
        gaps = F.split("text", pattern, -1)
        sides = F.zip_with(F.slice(gaps, 1, F.size(f"_{k}")), F.slice(gaps, 2, F.size(f"_{k}")), lambda a, b: F.struct(F.lower(F.right(a, F.lit(30))).alias("a"), F.lower(F.left(b, F.lit(30))).alias("b")))
        around = F.zip_with(_spans(kind, _starts(gaps, F.col(f"_{k}")), F.col(f"_{k}")), sides, _with_sides)
        out = out.withColumn(f"_{k}", F.when(F.size(f"_{k}") > 0, around).otherwise(none))
        names.append(f"_{k}")
    return out.withColumn("loose", F.array_sort(F.concat(*names))).drop(*names)


def _with_sides(s: Column, around: Column) -> Column:
    return F.struct(*[s[c].alias(c) for c in ("start", "kind", "end", "value")], around["a"].alias("before"), F.concat(around["a"], F.lower(s["value"]), around["b"]).alias("near"))


def features(s: Column) -> list[Column]:
    """The numbers of FEATURES for a candidate."""
    value, near = s["value"], s["near"]
    number = lambda c: c.cast("int").cast("double")
    digits = F.length(_digits(value))
    cue = F.lit(False)
    for k, kind in enumerate(KINDS):
        cue = F.when(s["kind"] == k, near.rlike(CUES[kind])).otherwise(cue)
    luhn = F.when((s["kind"] == 2) & digits.between(12, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    return [number(s["kind"] == k) for k in range(4)] + [
        digits.cast("double"), F.length(F.regexp_replace(value, "[^A-Za-z]", "")).cast("double"), F.length(value).cast("double"), number(luhn), number(cue), number(near.rlike(CUES["against"])),
        number(value.rlike(r"[(\[{] ?dot")), number(value.rlike(TOP_DOMAINS)), number(F.right(s["before"], F.lit(12)).rlike(BESIDE)), F.length(near).cast("double"), number(value.rlike(DIALLED)),
    ]


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> list:
    """Trees of depth two by second-order gradient boosting of the logistic loss: (feature, bound, left, right) with numbers at the leaves."""
    score, out = np.zeros(len(y)), []
    orders = [np.argsort(x[:, f], kind="stable") for f in range(x.shape[1])]

    def grow(inside, depth, slope, curve):
        down, bend = slope[inside].sum(), curve[inside].sum()
        best = (1e-9, None, None)
        for f in range(x.shape[1]) if depth else ():
            order = orders[f][inside[orders[f]]]
            values = x[order, f]
            last = np.flatnonzero(values[1:] != values[:-1])  # the last row of each value but the largest
            left, bent = np.cumsum(slope[order])[last], np.cumsum(curve[order])[last]
            gains = left**2 / (bent + 1.0) + (down - left) ** 2 / (bend - bent + 1.0) - down**2 / (bend + 1.0)
            for g, bound in zip(gains.tolist(), ((values[last] + values[last + 1]) / 2).tolist()):
                if g > best[0] + 1e-9:
                    best = (g, f, bound)
        _, f, bound = best
        if f is None:
            return float(RATE * down / (bend + 1.0))
        low = x[:, f] <= bound
        return f, bound, grow(inside & low, depth - 1, slope, curve), grow(inside & ~low, depth - 1, slope, curve)

    def values(tree):
        return np.where(x[:, tree[0]] <= tree[1], values(tree[2]), values(tree[3])) if isinstance(tree, tuple) else np.full(len(y), tree)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        out.append(tree := grow(np.ones(len(y), bool), 2, y - p, p * (1 - p)))
        score += values(tree)
    return out


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits labels to scores best, by Newton steps with a light ridge."""
    x, w = np.stack([score, np.ones(len(y))], 1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), x.T @ (p - y) + 0.01 * (w - [1.0, 0.0]))
    return float(w[0]), float(w[1])


def total(trees: list, row) -> float:
    out = 0.0
    for tree in trees:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        out += tree
    return out


def fit(rows: list[tuple[int, list[float], int, int]]) -> tuple[list, tuple[float, float], dict[int, float]]:
    """Trees, calibration and each kind's threshold, from (kind, features, label, fold)."""
    kind, x, y, folds = (np.array([r[c] for r in rows], float if c else int) for c in range(4))
    held = np.zeros(len(y))
    for fold in range(FOLDS):
        out = folds == fold
        trees = boost(x[~out], y[~out])
        held[out] = [total(trees, row) for row in x[out]]
    slope, offset = platt(held, y)
    p = 1 / (1 + np.exp(-(slope * held + offset)))
    thresholds = {}
    for k in range(4):
        mine, good = p[kind == k], y[kind == k]
        fine = [t for t in np.unique(np.append(mine[mine >= 0.5], 0.5)) if (mine >= t).any() and good[mine >= t].mean() >= PRECISION]
        thresholds[k] = float(min(fine)) if fine else 1.0
    return boost(x, y), (slope, offset), thresholds


_FITTED: dict[str, tuple] = {}


def trained(spark) -> tuple[list, tuple[float, float], dict[int, float]]:
    """Fitted once a process, from the fixed lists."""
    if "model" not in _FITTED:
        table = spark.createDataFrame([(k, *row) for k, row in enumerate(labelled())], "at int, text string, label int, fold int").coalesce(1)
        one = candidates(table).where(F.size("loose") > 0).withColumn("s", F.element_at("loose", 1))
        rows = one.select("at", "s.kind", "label", "fold", F.array(*features(F.col("s"))).alias("x")).collect()  # of labelled()
        _FITTED["model"] = fit([(r.kind, list(r.x), r.label, r.fold) for r in sorted(rows, key=lambda r: r.at)])
    return _FITTED["model"]


def _expression(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(x[tree[0]] <= tree[1], _expression(tree[2], x)).otherwise(_expression(tree[3], x))


def find(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, text, base and spans, arrays of (start, kind, end, value) by start, then kind."""
    trees, (slope, offset), thresholds = trained(docs.sparkSession)
    docs = docs.select("doc_id", "text", *[c for c in docs.columns if c in ("_row", "_null")])
    out = candidates(base_spans(_text(docs)))
    plain = ("start", "kind", "end", "value")

    def scored(s):
        return F.struct(*[s[c].alias(c) for c in plain], F.array(*features(s)).alias("x"))

    def judged(s):
        score = F.lit(0.0)
        for tree in trees:
            score = score + _expression(tree, s["x"])
        limit = F.lit(1.0)
        for k, v in thresholds.items():
            limit = F.when(s["kind"] == k, F.lit(v)).otherwise(limit)
        return F.struct(*[s[c].alias(c) for c in plain], F.round(1 / (1 + F.exp(-(slope * score + offset))), 9).alias("p"), (limit - 1e-6).alias("limit"))

    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,p:double,limit:double>>")
    likely = F.filter(F.transform(F.transform("loose", scored), judged), lambda s: s["p"] >= s["limit"])
    out = out.withColumn("loose", F.when(F.size("loose") > 0, likely).otherwise(none))
    out = out.withColumn("loose", F.when((F.size("loose") > 0) & (F.size("base") > 0), _free(F.col("base"), F.col("loose"))).otherwise(F.col("loose")))

    def ahead(s, i):
        first = F.greatest(i - NEAR, F.lit(0))
        return ~F.exists(F.slice("loose", first + 1, 2 * NEAR + 1), lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & ((o["p"] > s["p"]) | ((o["p"] == s["p"]) & (F.struct(o["start"], o["kind"]) < F.struct(s["start"], s["kind"])))))

    added = F.transform(F.filter("loose", ahead), lambda s: F.struct(*[s[c].alias(c) for c in plain]))
    out = out.withColumn("added", F.when(F.size("loose") > 0, added).otherwise(empty))
    return out.withColumn("spans", F.array_sort(F.concat("base", "added"))).drop("loose")


def _free(base: Column, loose: Column) -> Column:
    """Candidates that overlap no base span: none before ends behind their start, none starts before their end. Both by start."""
    far = 2**31 - 1
    marks = F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(-1).alias("at"), s["end"].alias("end"))), F.transform(loose, lambda s, i: F.struct(s["start"].alias("start"), i.alias("at"), s["end"].alias("end"))))
    marks = F.array_sort(marks)  # at one start, the base spans first
    before = _scan(F.transform(marks, lambda m: F.when(m["at"] < 0, m["end"]).otherwise(0)), 0, lambda a, v: F.greatest(a, v))
    after = F.reverse(_scan(F.reverse(F.transform(marks, lambda m: F.when(m["at"] < 0, m["start"]).otherwise(far))), far, lambda a, v: F.least(a, v)))
    ok = F.filter(F.zip_with(marks, F.zip_with(before, after, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda m, s: F.struct(m["at"].alias("at"), ((m["at"] >= 0) & (s["a"] <= m["start"]) & (s["b"] >= m["end"])).alias("ok"))), lambda m: m["ok"])
    return F.transform(ok, lambda m: F.element_at(loose, m["at"] + 1))


def _joined(spans: str) -> Column:
    names = F.split(F.lit(" ".join(KINDS)), " ")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """The digest columns: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, n_added."""
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("added").cast("long").alias("n_added"))


def _is(k: int):
    return lambda s: s["kind"] == k


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; n_chars follows the text. A null text stays null."""
    names = F.split(F.lit(" ".join(f"<{k}>" for k in KINDS)), " ")
    out = find(packed(docs, "doc_id", F.col("text").cast("string").alias("text"), F.col("text").isNull().alias("_null")))
    # a cut: where the text before it starts, where it ends, what it is replaced by; spans inside of earlier ones go
    told = F.zip_with("spans", _scan(F.transform("spans", lambda s: s["end"]), 0, lambda a, v: F.greatest(a, v)), lambda s, at: F.struct(at.alias("at"), F.greatest(s["start"], at).alias("cut"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("name")))
    out = out.withColumn("cuts", F.when(F.size("spans") > 0, F.filter(told, lambda c: c["end"] > c["at"])))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("cuts") - 1) / PART).cast("int")), lambda g: F.slice("cuts", g * PART + 1, PART))

    def written_group(cuts):
        first, text = F.element_at(cuts, 1)["at"], F.substr("text", F.element_at(cuts, 1)["at"] + 1, F.element_at(cuts, -1)["cut"] - F.element_at(cuts, 1)["at"])
        return F.aggregate(F.array(F.struct(text.alias("t"), first.alias("f"))), F.lit(""), lambda acc, g: F.concat(acc, F.array_join(F.transform(cuts, lambda c: F.concat(F.substr(g["t"], c["at"] - g["f"] + 1, c["cut"] - c["at"]), c["name"])), "")))

    clean = F.concat(F.array_join(F.transform(groups, written_group), ""), F.substr("text", F.element_at("cuts", -1)["end"] + 1, F.length("text")))
    out = out.withColumn("text", F.when(F.col("_null"), F.lit(None).cast("string")).when(F.size("spans") > 0, clean).otherwise(F.col("text")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def base_by_hand(text: str | None) -> list[tuple[int, str, int]]:
    """The base spans by the plain patterns, for tests."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))
