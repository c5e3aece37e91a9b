"""Stand-ins for names, addresses, hosts, paths, tickets and ids in texts, the same everywhere, and the way back.

A text is cut into tokens by one pattern (addresses and paths whole, else words and what is between them). A token's shape says whether it is a URL, e-mail
address, id, host, path, ticket or mention. Names of people, repositories, branches and an operator's terms are a table of any size: runs of tokens meet it in a join by
the whole name, so the longest name counts, and a first token that many names share costs nothing; bitmaps of fixed size over the hashes of names
and of their beginnings keep nearly all other runs from being joined at all. Texts are dealt into parts, and each distinct spelling of a part is joined once, however
often it is there: places stay packed, a row a text, so names that are common words cost little. At one place addresses and hashes go before names, names before other shapes; leftmost first,
without overlaps. Stand-ins are numbered by kind in order of first
sight over the whole table (``PERSON_1``); case does not tell names, addresses, hosts and tickets apart, nor does white space tell names. A file
keeps its extension. ``Pseudonymised.replaced`` leads back to the very text, spelling by spelling; ``keys`` to the first spelling of a stand-in.

A null text stays null. Rows that agree in id and text have the same stand-ins; extra columns are ignored; an empty table has no keys. Local parts of addresses
count up to 64 characters, names of files and hosts up to 255, names up to NAME_TOKENS tokens; longer names are an error, not skipped.
"""

from __future__ import annotations

import functools
import ipaddress
import re
import zlib
from bisect import bisect_left, bisect_right
from itertools import accumulate, compress, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import model
from ..sources.rounds import stored
from . import rule_engine
from .numbering import numbered

KINDS = ("EMAIL", "PERSON", "TICKET", "URL", "HOST", "PATH", "BRANCH", "REPO", "TERM", "ID")
SAME = "SAME"  # what looks like a stand-in already; it stands for itself
NAME_TOKENS = 15
#: Tokens that a task remembers.
MARKS = 200_000
IN_CONTEXT = object()  # a shape that depends on what is before and after a token
#: Bits of each of the two filters, of names and of their beginnings: 1 MB.
SLOTS = 1 << 23

# fmt: off
#: File extensions; names of build files; file-like names of frameworks; labels that end or don't end host names.
EXTENSIONS = ["bash", "bat", "c", "cc", "cfg", "cjs", "conf", "cpp", "cs", "css", "csv", "cxx", "dart", "dockerfile", "env", "ex", "exs", "gif", "go", "gradle", "gz", "h", "hpp", "htm", "html", "ini", "ipynb", "java", "jpeg", "jpg", "js", "json", "jsx", "kt", "kts", "lock", "log", "lua", "md", "mjs", "pdf", "php", "pl", "png", "proto", "ps1", "py", "r", "rb", "rs", "rst", "sass", "scala", "scss", "sh", "sql", "svelte", "svg", "swift", "tar", "tf", "tfvars", "toml", "ts", "tsx", "txt", "vue", "wasm", "xml", "yaml", "yml", "zip", "zsh", "adoc", "avro", "bzl", "cfm", "cmake", "csproj", "cts", "editorconfig", "ejs", "erb", "gemspec", "gql", "graphql", "haml", "hbs", "hcl", "j2", "jinja", "jsonc", "jsonl", "less", "mdx", "mk", "mts", "ndjson", "nix", "njk", "parquet", "plist", "properties", "rake", "rego", "sbt", "sln", "sol", "styl", "tmpl", "tpl", "tsv", "vbs", "vcxproj", "xaml", "xsd", "xsl", "zig"]
FILE_STEMS = ["brewfile", "caddyfile", "containerfile", "dockerfile", "gemfile", "jenkinsfile", "justfile", "makefile", "procfile", "rakefile", "vagrantfile"]
NOT_FILES = ["node.js", "vue.js", "next.js", "nuxt.js", "react.js", "three.js", "d3.js", "chart.js", "express.js", "ember.js", "backbone.js"]
HOST_SUFFIXES = ["ad", "ai", "au", "aws", "biz", "br", "ca", "ch", "cluster", "cn", "co", "com", "corp", "cz", "de", "dk", "edu", "es", "eu", "example", "fi", "fm", "fr", "gg", "gov", "hk", "ie", "il", "infra", "internal", "intra", "intranet", "invalid", "io", "jp", "kr", "lan", "localdomain", "localhost", "ly", "mil", "mx", "net", "nl", "nz", "org", "priv", "pt", "ru", "se", "sg", "svc", "tv", "tw", "uk", "vpn", "xyz", "za"]
WORD_SUFFIXES = ["app", "at", "be", "cloud", "dev", "global", "home", "in", "info", "int", "it", "local", "me", "no", "office", "online", "private", "prod", "qa", "site", "so", "stage", "staging", "tech", "test", "to", "uat", "us"]
CODE_LABELS = ["app", "args", "config", "console", "context", "ctx", "data", "dev", "document", "e2e", "env", "exports", "item", "local", "module", "obj", "options", "opts", "package", "params", "process", "prod", "props", "req", "request", "res", "response", "result", "self", "settings", "spec", "state", "test", "this", "unit", "user", "value", "window"]
#: Standards and ordinary words before a number, which make no ticket; words that are given or family names too; branches that name nobody; pairs with a slash that are prose.
NOT_TICKETS = ["UTF", "UCS", "SHA", "MD", "ISO", "RFC", "CVE", "CWE", "GHSA", "HTTP", "TLS", "SSL", "AES", "RSA", "ECDSA", "IPV", "X", "PEP", "ES", "ECMA", "IEEE", "WCAG", "PKCS", "ANSI", "BASE"]
TICKET_STOPS = ["alpine", "android", "angular", "arm", "attempt", "batch", "case", "centos", "chapter", "chrome", "claude", "clang", "covid", "day", "debian", "django", "dotnet", "ecma", "fedora", "firefox", "gcc", "gemini", "gpt", "grade", "ios", "item", "iteration", "java", "jdk", "jre", "k8s", "level", "line", "llama", "llvm", "log4j", "macos", "month", "mysql", "next", "node", "npm", "option", "opus", "page", "part", "pg", "phase", "php", "postgres", "python", "rails", "rc", "react", "redis", "rev", "rhel", "round", "ruby", "run", "rust", "safari", "section", "sonnet", "spring", "sprint", "stage", "step", "table", "tier", "top", "try", "ubuntu", "version", "vue", "wave", "week", "win", "windows", "year"]
NAME_STOPS = ["account", "actions", "admin", "and", "april", "archer", "art", "august", "baker", "bell", "best", "bill", "bin", "bishop", "black", "bot", "brown", "build", "butler", "carter", "case", "chase", "cliff", "cook", "cooper", "dawn", "day", "dean", "del", "den", "der", "dev", "drew", "early", "faith", "field", "fine", "fisher", "for", "frank", "gene", "github", "gitlab", "glass", "grace", "grant", "gray", "green", "grey", "guy", "hall", "hand", "hill", "hope", "hunter", "jack", "joy", "june", "key", "king", "knight", "lane", "law", "little", "long", "los", "love", "major", "mark", "mason", "max", "may", "miles", "miller", "name", "nice", "noble", "page", "park", "parker", "pat", "penny", "porter", "power", "price", "rain", "ray", "rich", "rob", "rod", "root", "rose", "sandy", "service", "sharp", "short", "sky", "small", "snow", "spring", "steel", "stone", "storm", "summer", "swift", "system", "team", "temple", "test", "the", "turner", "user", "van", "von", "walker", "ward", "white", "will", "winter", "wolf", "wood", "young", "your"]
PUBLIC_BRANCHES = ["main", "master", "develop", "development", "dev", "trunk", "staging", "production", "release", "head"]
PROSE_PAIRS = ["and/or", "read/write", "client/server", "input/output", "true/false", "yes/no", "on/off", "pass/fail"]
# fmt: on
#: Words of the classification, which are no names by themselves.
VOCABULARY = sorted({word for rule in rule_engine.RULES for text in (rule[1], rule[2] or "", *rule[5]) for word in text.lower().replace("-", " ").replace(":", " ").split() if word.isalpha()})

# Patterns without groups that repeat, of bounded starts, so that long texts take linear time and no stack.
_SPACE, _WORDY, _END = r" \t\n\x0b\f\r", r"\w", ".,;:!?)]}'\""
URL = rf"[A-Za-z][A-Za-z0-9+.-]{{0,30}}://[^{_SPACE}<>\"'`]+|[gG][iI][tT]@[^{_SPACE}:/]{{1,255}}:[^{_SPACE}<>\"'`]+|[wW][wW][wW]\.[^{_SPACE}<>\"'`]+"
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,255}\.[A-Za-z0-9-][A-Za-z0-9.-]*"
UUID = rf"[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}[{_WORDY}]*"
IPV6 = r"[0-9a-fA-F]{0,4}:[0-9a-fA-F]{0,4}:[0-9a-fA-F:.]*"
PATH = r"(?:[A-Za-z]:\\|~/|\.\.?/|/)?[A-Za-z0-9_.@+-]{1,255}[/\\][A-Za-z0-9_.@+-][A-Za-z0-9_.@+/\\-]*"
DOTTED = r"[A-Za-z0-9_][A-Za-z0-9_-]{0,254}\.[A-Za-z0-9_-][A-Za-z0-9_.-]*"
TICKET = r"[A-Za-z][A-Za-z0-9_]{1,19}-[0-9]+"
MENTION = r"@[A-Za-z0-9_][A-Za-z0-9_./-]*(?:\[bot\])?"
WORD = rf"[{_WORDY}]+"
OTHER = rf"[^{_WORDY}@/~.\\%+-]+|(?s:.)"
TOKEN = "|".join([URL, EMAIL, UUID, IPV6, PATH, DOTTED, TICKET, MENTION, WORD, OTHER])
# Most tokens, told by their ends without a try of each pattern: a word before nothing that goes on, and what can't begin another pattern. They cut as TOKEN does.
PLAIN = rf"[{_WORDY}]++(?![@:/~.\\%+-](?![{_SPACE}]))|[^{_WORDY}@:/~.\\%+-][^{_WORDY}@/~.\\%+-]*+"
INNER = "|".join([TICKET, WORD, OTHER])
_PLACEHOLDER = re.compile(f"(?:{'|'.join(KINDS)})_[0-9]+")


_INNER, _WORDS = re.compile(INNER), re.compile(WORD)
_URL, _EMAIL, _UUID, _DOTTED, _TICKET, _MENTION, _PATH = (re.compile(f"(?:{p})") for p in (URL, EMAIL, UUID, DOTTED, TICKET, MENTION, PATH))
_SETS = {name: frozenset(v.lower() for v in values) for name, values in (("ext", EXTENSIONS), ("stem", FILE_STEMS), ("not file", NOT_FILES), ("host", HOST_SUFFIXES), ("word", WORD_SUFFIXES), ("code", CODE_LABELS), ("not ticket", NOT_TICKETS), ("stop", TICKET_STOPS))}
_PAIRS = frozenset(PROSE_PAIRS) | {"/".join(reversed(p.split("/"))) for p in PROSE_PAIRS}


def _wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


def _extension(name: str) -> str:
    stem, dot, last = name.rpartition(".")
    return dot + last if stem and last.lower() in _SETS["ext"] else ""


def _host_or_file(name: str, after: str) -> tuple | None:
    labels = name.split(".")
    last, head = labels[-1], labels[:-1]
    low = last.lower()
    if len(labels) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in labels):
        return "HOST", ""
    if not (last.isascii() and last.isalpha()):
        return None
    if labels[0].lower() in _SETS["stem"]:
        return "PATH", ""
    if low in _SETS["ext"]:
        return None if name.lower() in _SETS["not file"] else ("PATH", "." + last)
    if after == "(" or re.search("[a-z][A-Z]", name):
        return None
    if low in _SETS["word"]:
        host = not any(x.lower() in _SETS["code"] for x in head)
    else:
        host = low in _SETS["host"] or (len(last) > 1 and name == name.lower() and any(re.search("[0-9-]", x) for x in head))
    return ("HOST", "") if host else None


def _is_path(text: str) -> bool:
    parts = [x for x in re.split(r"[/\\]", text) if x]
    if all(x.isdigit() for x in parts):
        return False
    return len(parts) != 2 or not (any(len(x) == 1 and not x.isupper() for x in parts) or "/".join(parts).lower() in _PAIRS)


def _is_key(prefix: str, before: str, after: str, vocabulary) -> bool:
    if prefix.lower() in _SETS["not ticket"] or (after[:1] and after[0].isalnum()):
        return False
    letters = prefix.isascii() and prefix.isalpha()
    if prefix == prefix.upper() or (letters and before == "[" and after[:1] == "]"):
        return True
    return letters and 2 <= len(prefix) <= 10 and prefix.lower() not in _SETS["stop"] and prefix.lower() not in vocabulary and before not in ("-", ".", "_") and not re.match(r"\.[0-9]", after)


def _is_ipv6(text: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(text)) and any(c.isdigit() for c in text)
    except ValueError:
        return False


def _is_hash(text: str) -> bool:
    return len(text) >= 32 or (any(c.isdigit() for c in text) and any(c.isalpha() for c in text))


def shape(token: str, before: str, after: str, vocabulary) -> tuple | None:
    """What a token is by its shape: (kind, start and end of what is replaced, extension kept, rank); ``before`` is the character there, ``after`` some that follow."""
    core = token.rstrip(_END)
    size, next_ = len(core), (token[len(core) :] + after)[:1]
    if _URL.fullmatch(token) and core:
        return "URL", 0, size, "", 0
    if _EMAIL.fullmatch(token):
        return "EMAIL", 0, size, "", 0
    if _UUID.fullmatch(token):
        return "ID", 0, len(token), "", 0
    if re.fullmatch("[0-9a-fA-F:.]*:[0-9a-fA-F:.]*", token):
        core = token if _is_ipv6(token) else core  # an address may end in a double colon
        next_ = (token[len(core) :] + after)[:1]
        alone = not (before and (_wordy(before) or before in ":.")) and not (next_ and (_wordy(next_) or next_ == ":"))
        return ("HOST", 0, len(core), "", 2) if alone and _is_ipv6(core) else None
    if token[0] == "@":
        name = token[1:].rstrip("./-")
        return ("PERSON", 1, 1 + len(name), "", 2) if name and not (before and (before in "_.@/" or (before.isascii() and before.isalnum()))) else None
    if "/" in token or "\\" in token:
        return ("PATH", 0, size, _extension(re.split(r"[/\\]", core)[-1]), 2) if _PATH.fullmatch(core) and _is_path(core) else None
    if "." in core:
        found = _host_or_file(core, next_)
        return (found[0], 0, size, found[1], 2) if found else None
    if _TICKET.fullmatch(token):
        prefix = token.rpartition("-")[0]
        head, cut_, tail = prefix.rpartition("_")
        if _is_key(prefix, before, after, vocabulary):
            return "TICKET", 0, len(token), "", 2
        return ("TICKET", len(head) + 1, len(token), "", 2) if cut_ and len(tail) >= 2 and _is_key(tail, "", after, vocabulary) else None
    if _PLACEHOLDER.fullmatch(token):
        return SAME, 0, len(token), "", 0
    for start in (0, 1):
        if (start == 0 or token[0] in "gG") and re.fullmatch("[0-9a-fA-F]{7,}", token[start:]) and _is_hash(token[start:]):
            return "ID", start, len(token), "", 0
    if re.fullmatch("[A-Za-z]{1,4}[0-9]{4,}", token) and token.rstrip("0123456789").lower() not in _SETS["not ticket"]:
        return "ID", 0, len(token), "", 2
    return None


class _Marks(dict):
    """By token, what is told of it alone, kept for the first MARKS of them: None of a plain one, else (hash of a name's beginning lower-cased, as spelled, shape).

    ``begun`` is the bitmap of beginnings, if names matter; the shape of a token of more than one word is IN_CONTEXT."""

    def __init__(self, vocabulary, ids: list[str] = (), begun: bytes | None = None):
        self.vocabulary, self.begun = frozenset(vocabulary), begun
        self.ids = re.compile("|".join(f"(?:{p})" for p in ids)) if ids else None
        self.pattern = re.compile("|".join([f"(?:{p})" for p in ids] + [PLAIN, TOKEN]))

    def __missing__(self, token: str) -> tuple | None:
        a = b = told = None
        if self.begun is not None:
            a, b = zlib.crc32(_low(token), _LOWS), zlib.crc32(token.encode() + b"\0", _TITLES)
            a, b = a if _set(self.begun, a) else None, b if _set(self.begun, b) else None
        if not (token.isalpha() and len(token) < 32) and any(map(str.isalnum, token)):
            if self.ids is not None and self.ids.fullmatch(token):
                told = ("ID", 0, len(token), "", 0)
            else:
                told = shape(token, "", "", self.vocabulary) if _WORDS.fullmatch(token) else IN_CONTEXT
        mark = None if a is None and b is None and told is None else (a, b, told)
        if len(self) < MARKS:
            self[token] = mark
        return mark


def tokens(text: str, known: _Marks) -> tuple[list[int], list[str], list[tuple | None], dict[int, tuple]]:
    """Starts, tokens and marks in order, and the shapes by number of token. Dotted names and paths that are neither are cut further, so that names in them are seen."""

    def marked(found):
        marks = [*map(known.__getitem__, found)]
        return [*accumulate(map(len, found), initial=0)], found, marks, {i: marks[i][2] for i in compress(range(len(found)), marks) if marks[i][2] is not None}

    def in_context(i):
        return shape(found[i], text[starts[i] - 1 : starts[i]] if starts[i] else "", text[starts[i + 1] : starts[i + 1] + 2], known.vocabulary)

    starts, found, marks, shapes = marked(known.pattern.findall(text))  # every character is in a token
    told = {starts[i]: in_context(i) for i, s in shapes.items() if s is IN_CONTEXT}
    if None in told.values():
        parts, last = [], 0
        for i in shapes:
            if told.get(starts[i], shapes[i]) is None:
                parts += found[last:i] + _INNER.findall(found[i])
                last = i + 1
        whole = {at: s for at, s in told.items() if s is not None}
        starts, found, marks, shapes = marked(parts + found[last:])
        told = {starts[i]: whole[starts[i]] if starts[i] in whole else in_context(i) for i, s in shapes.items() if s is IN_CONTEXT}
    shapes = {i: told[starts[i]] if s is IN_CONTEXT else s for i, s in shapes.items()}
    return starts, found, marks, {i: s for i, s in shapes.items() if s is not None}


def _normal(token: str) -> str:
    return token.lower() if token.isalnum() else re.sub(r"\s+", " ", token).replace("’", "'").lower()


def _low(token: str) -> bytes:
    return _normal(token).encode() + b"\0"


#: What precedes the tokens of names that count as spelled (``titled``), and of those that are lower-cased.
_EXACT, _LOWERED = b"1", b"0"
_TITLES, _LOWS = zlib.crc32(_EXACT), zlib.crc32(_LOWERED)


def _set(bitmap: bytes, crc: int) -> int:
    slot = crc % SLOTS
    return bitmap[slot >> 3] >> (slot & 7) & 1


#: What of a chunk's start belongs to the white space before it; how much text is taken at a time; chunks that a task remembers.
_LEAD, _AT_ONCE, CHUNKS = re.compile(rf"[^{_WORDY}@/~.\\%+-]*"), 1 << 20, 200_000
_AROUND = re.compile(rf"[^{_WORDY}@:/~.\\%+-]*\0(?:[^{_WORDY}@:/~.\\%+-]*\.?|:)")
LIVELY = object()  # a chunk that is cut into tokens wherever it is
_TITLED = frozenset(w.capitalize() for w in NAME_STOPS)


#: Kinds of characters, by which most chunks are told without being looked up; how many are told at a time.
_BLANK, _LETTER, _MARK, _DOT, _COLON, _ELSE = range(6)
_BLANKS, _TOLD_AT_ONCE = " \t\n\x0b\f\r", 1 << 17
#: A word's hash is the sum of its characters times powers of a factor, so sums along a text give those of all its words.
_FACTOR, _MIX = 0x9E3779B1, 0x85EBCA6B


@functools.cache
def _characters():
    """Kind and lower case by code point; what is beyond the first plane, or has no single lower case by itself, is _ELSE."""
    every = [chr(i) for i in range(1 << 16)]
    lows = [c.lower() if c != "Σ" else "" for c in every]
    kinds = {c: _BLANK for c in _BLANKS} | {".": _DOT, ":": _COLON} | dict.fromkeys("@/~\\%+-_", _ELSE)
    told = [kinds[c] if c in kinds else _LETTER if c.isalpha() and len(low) == 1 else _ELSE if c.isalnum() else _MARK for c, low in zip(every, lows)]
    return np.array([*told, _ELSE], np.uint8), np.array([*(ord(low) if len(low) == 1 else 0 for low in lows), 0], np.uint32)


@functools.lru_cache(4)
def _powers(base: int, n: int):
    out = np.full(n, base, np.uint32)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint32)


def _word_slot(word: str) -> int | None:
    """The slot of a lower-cased word, None if it is not of letters."""
    kinds = _characters()[0]
    if not word or len(word) >= 32 or any(kinds[min(ord(c), 1 << 16)] != _LETTER for c in word):
        return None
    return (sum(ord(c) * pow(_FACTOR, i, 1 << 32) for i, c in enumerate(word)) * _MIX) % (1 << 32) >> (33 - SLOTS.bit_length())


def _blanked(text: str) -> str:
    """The text with spaces for all white space of _SPACE."""
    for c in "\n\t\r\x0b\f":
        text = text.replace(c, " ")
    return text


def _exact(token: str) -> bytes:
    return token.encode() + b"\0"


class _Chunks:
    """What is told of a chunk (what is between white space) alone, once for each distinct one.

    ``told``: None of one that holds nothing; the names it holds (start and end in it, number of the entry, titled), if they are the same wherever it is;
    LIVELY of one that may hold a shape, or begin a name that goes on over white space. Only LIVELY ones are cut into tokens. Most chunks are a word with marks around
    it that begins no name; ``of_interest`` leaves them out by sums along the text.
    ``opens``: first characters of the names whose first token goes on over white space, as a chunk may only end in them; ``marks``: those of all names that are no letters or digits."""

    def __init__(self, known: _Marks, whole: bytes, opens: str, spaced: bytes, marks: str, words: bytes, titles: bytes, entry):
        self.known, self.whole, self.opens, self.spaced, self.entry = known, whole, opens, spaced, entry
        self.bits, self.words, self.titles = (np.frombuffer(x, np.uint8) for x in (known.begun, words, titles))
        self.told, self.around = {}, {}
        kinds, self.lows = _characters()
        self.kinds = kinds.copy()
        self.kinds[[min(ord(c), 1 << 16) for c in marks + opens + ("’" if "'" in marks + opens else "")]] = _ELSE
        self.latin = bytes(low if low < 256 else 0 for low in self.lows[:256].tolist()), self.kinds[:256].tobytes()

    def of_interest(self, text: str):
        """Starts and ends of the chunks of a text that ends in white space, without those that hold nothing by their characters and word."""
        try:
            codes = text.encode("latin-1")
            lows, kinds = (np.frombuffer(codes.translate(table), np.uint8) for table in self.latin)
        except UnicodeEncodeError:
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            lows, kinds = (table.take(codes, mode="clip") for table in (self.lows, self.kinds))
        codes = np.frombuffer(codes, lows.dtype)
        blanks = np.flatnonzero(kinds == _BLANK)
        cuts = np.unique(blanks[np.searchsorted(blanks, np.arange(_TOLD_AT_ONCE, len(codes), _TOLD_AT_ONCE))] + 1).tolist()
        found = [(a, *self._of_interest(codes[a:b], lows[a:b], kinds[a:b])) for a, b in zip([0, *cuts], [*cuts, len(codes)]) if a < b]
        return np.concatenate([a + starts for a, starts, _ in found]), np.concatenate([a + ends for a, _, ends in found])

    def _of_interest(self, codes, lows, kinds):
        ends = np.flatnonzero(kinds == _BLANK)
        starts = np.concatenate([[0], ends[:-1] + 1])
        letter, other = kinds == _LETTER, kinds == _ELSE
        stops = np.flatnonzero((kinds == _DOT) | (kinds == _COLON))
        other[stops] = (kinds[stops + 1] != _BLANK) | ((kinds[stops] == _COLON) & (kinds[stops - 1] != _LETTER))
        begins, closes = letter.copy(), letter.copy()
        begins[1:] &= ~letter[:-1]
        closes[:-1] &= ~letter[1:]
        words = np.cumsum(begins, dtype=np.int32)
        nth = np.where(starts > 0, words[starts - 1], 0)
        count = words[ends] - nth
        count[np.searchsorted(ends, np.flatnonzero(other))] = 2
        plain = np.flatnonzero(count == 1)
        a, b = np.flatnonzero(begins)[nth[plain]], np.flatnonzero(closes)[nth[plain]] + 1
        size = 1 << max(_TOLD_AT_ONCE.bit_length(), len(codes).bit_length())
        sums = np.zeros(len(codes) + 1, np.uint32)
        np.cumsum(lows * _powers(_FACTOR, size)[: len(codes)], dtype=np.uint32, out=sums[1:])
        slots = ((sums[b] - sums[a]) * _powers(pow(_FACTOR, -1, 1 << 32), size)[a] * np.uint32(_MIX)) >> np.uint32(33 - SLOTS.bit_length())
        bit = lambda bits, of: bits[of >> np.uint32(3)] >> (of & np.uint32(7)).astype(np.uint8) & 1 != 0
        told = bit(self.words, slots) | (b - a >= 32)
        upper = np.flatnonzero(codes[a] != lows[a])
        told[upper] |= bit(self.titles, slots[upper])
        keep = count > 1
        keep[plain] = told
        return starts[keep], ends[keep]

    def learn(self, chunks: set[str]) -> dict[str, list | object | None]:
        if len(self.told) > CHUNKS:
            self.told.clear()
        new = chunks.difference(self.told)
        self.told.update(dict.fromkeys(new))
        words = [c for c in new if c.isalpha() and len(c) < 32]
        of = words[:]
        for chunk in new.difference(of):
            word = chunk[:-1]
            if not word.isalpha():
                word = chunk.strip(",.;:!?()[]{}\"'*")
            if word.isalpha() and len(word) < 32 and self._quiet(chunk.replace(word, "\0", 1)):
                words.append(word)
                of.append(chunk)
            elif self._told(chunk):
                self.told[chunk] = LIVELY
        if words:
            slots = np.fromiter(map(zlib.crc32, ("\0\n".join(words) + "\0").lower().encode().split(b"\n"), repeat(_LOWS)), np.int64, len(words)) % SLOTS
            for i in np.flatnonzero(self.bits[slots >> 3] >> (slots & 7) & 1).tolist():
                self._hold(of[i], self._names(of[i], words[i], False))
            for i in compress(range(len(words)), map(_TITLED.__contains__, words)):
                self._hold(of[i], self._names(of[i], words[i], True))
        return self.told

    def _hold(self, chunk: str, names: list | object) -> None:
        if names:
            before = self.told[chunk] or []
            self.told[chunk] = LIVELY if LIVELY in (names, before) else before + names

    def _names(self, chunk: str, word: str, titled: bool) -> list | object:
        """The names that begin with the word of a chunk and end in it, or LIVELY."""
        form, crc = (_exact, _TITLES) if titled else (_low, _LOWS)
        at = chunk.index(word)
        found, end = [], at
        tail = chunk[at + len(word) :]
        pieces = [word, tail[:-1], "."] if tail[1:] and tail[-1] == "." else [word, "."] if tail == "." else [word]  # what else follows is of one token with the white space
        for n, piece in enumerate(pieces, 1):
            crc, end = zlib.crc32(form(piece), crc), end + len(piece)
            if not _set(self.known.begun, crc):
                return found
            if _set(self.whole, crc):
                found.append((at, end, self.entry(None, chunk[at:end], "", 1, _name(pieces[:n], titled)), titled))
        return LIVELY if _set(self.spaced, crc) else found

    def _quiet(self, around: str) -> bool:
        """Whether marks around a word (\\0) neither make another token of it nor matter by themselves."""
        quiet = self.around.get(around)
        if quiet is None:
            quiet = _AROUND.fullmatch(around) is not None and not self._told(around.partition("\0")[2], 0)
            if len(self.around) < MARKS:
                self.around[around] = quiet
        return quiet

    def _told(self, chunk: str, start: int | None = None) -> bool:
        """By a chunk's own tokens: marks at its ends go on over white space, so they count only at a text's ends (``_windows``) or if a name opens with them."""
        found = self.known.pattern.findall(chunk[_LEAD.match(chunk).end() if start is None else start :])
        if found and _LEAD.fullmatch(found[-1]):
            found.pop()
        if any(map(self.known.__getitem__, found)):
            return True
        at = len(chunk)
        while self.opens and at and _LEAD.fullmatch(chunk[at - 1]):
            at -= 1
        return any(c in self.opens for c in chunk[at : at + 1] + _normal(chunk[at:]))


def _name(pieces: list[str], titled: bool) -> str:
    """As in ``names_of``."""
    return "\0".join(["1", *pieces] if titled else ["0", *map(_normal, pieces)])


def _within(text: str, at: int) -> bool:
    """Whether a word in title case is within a sentence there."""
    back = text[max(0, at - 200) : at].rstrip(" \t")
    return bool(back) and back[-1] not in ".!?:;\n*->#([\"'"


def _windows(text: str, starts: list[int], at: list[int], known: _Marks, longest: int):
    """(first and last chunk; offset, first and last token that count, starts, tokens, marks, shapes) of the parts of a text around the chunks ``at``, with the tokens that follow as far as a name may go."""
    first, n = 0, len(starts) - 1
    while first < len(at):
        more = longest // 2 + 1
        while True:
            last = first
            while last + 1 < len(at) and at[last + 1] - at[last] <= more:
                last += 1
            low, end = max(0, starts[at[first]] - 1), starts[at[last] + 1] - 1
            stop = min(at[last] + 1 + more, n)
            got = tokens(text[low : starts[stop] - 1], known)
            upto = bisect_left(got[0], end - low, 0, len(got[1]))
            if stop == n or len(got[1]) - upto > longest:
                break
            more *= 2
        yield at[first], at[last], (low, int(low > 0), upto, *got)
        first = last + 1


class _Scanner:
    """Finds shapes, and the runs of tokens that may be names, in texts. ``entries``: what is found (kind, null of a name; core; extension; rank; name as in ``names_of``), each once, by number."""

    def __init__(self, begun: bytes, whole: bytes, opens: str, longest: int, spaced: bytes, marks: str, words: bytes, titles: bytes, vocabulary, ids):
        self.known, self.whole, self.longest, self.entries = _Marks(vocabulary, ids, begun), whole, longest, {}
        self.chunks = None if ids or " " in opens else _Chunks(self.known, whole, opens, spaced, marks, words, titles, self.entry)

    def entry(self, *what) -> int:
        return self.entries.setdefault(what, len(self.entries))

    def found(self, texts: list[str]):
        """(start, end, number of the entry) by start, for each text; all of it is cut into tokens where a token may hold any white space."""
        if self.chunks is None:
            for text in texts:
                got = tokens(text, self.known)
                yield sorted(self._spans(text, 0, 0, len(got[1]), *got))
            return
        every = "\n".join([*texts, ""]) or "\n"
        starts, ends = self.chunks.of_interest(every)
        chunks = [every[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        held = [*map(self.chunks.learn(set(chunks)).__getitem__, chunks)]
        starts, held = starts[np.fromiter((x is not None for x in held), bool, len(held))], [x for x in held if x is not None]
        firsts = [*accumulate(map((1).__add__, map(len, texts)), initial=0)]
        upto = np.searchsorted(starts, firsts).tolist()
        starts = starts.tolist()
        for text, first, a, b in zip(texts, firsts, upto, upto[1:]):
            yield self._of_chunks(text, [x - first for x in starts[a:b]], held[a:b])

    def _of_chunks(self, text: str, at: list[int], held: list) -> list[tuple[int, int, int]]:
        """What is found, of what is told of the chunks that start ``at``. Marks at the text's ends are tokens by themselves."""
        lively = [x for x, names in zip(at, held) if names is LIVELY]
        ends = [text[i] not in _BLANKS and _LEAD.match(text[i]).end() for i in (0, -1)] if text else []
        out, ranges = [], []
        if lively or any(ends):
            starts = [0, *accumulate(map((1).__add__, map(len, _blanked(text).split(" "))))]
            chosen = {bisect_left(starts, x) for x in lively} | ({0} if ends[0] else set()) | ({len(starts) - 2} if ends[1] else set())
            for first, last, window in _windows(text, starts, sorted(chosen), self.known, self.longest):
                ranges.append((starts[first], starts[last + 1]))
                out.extend(self._spans(text, *window))
        upto = iter([*ranges, (len(text) + 1, len(text) + 1)])
        first, last = next(upto)
        for x, names in zip(at, held):
            while x >= last:
                first, last = next(upto)
            if x < first:
                out.extend([(x + a, x + b, e) for a, b, e, titled in names if not titled or _within(text, x + a)])
        if ranges:
            out.sort()
        return out

    def _runs(self, found: list[str], i: int, crc: int, form):
        """Ends of the runs of tokens from i on that may be names."""
        last = min(len(found), i + self.longest)
        while True:
            i += 1
            if _set(self.whole, crc):
                yield i
            if i == last:
                return
            crc = zlib.crc32(form(found[i]), crc)
            if not _set(self.known.begun, crc):
                return

    def _spans(self, text: str, low: int, begin: int, upto: int, starts, found, marks, shapes):
        for i, (kind, a, b, ext, rank) in shapes.items():
            if begin <= i < upto:
                yield low + starts[i] + a, low + starts[i] + b, self.entry(kind, found[i][a:b], ext, rank, None)
        for i in compress(range(begin, upto), marks[begin:upto]):
            at = low + starts[i]
            for crc, form, titled in zip(marks[i][:2], (_low, _exact), (False, True)):
                if crc is not None and not (titled and not _within(text, at)):
                    for j in self._runs(found, i, crc, form):
                        core = "".join(found[i:j])
                        yield at, at + len(core), self.entry(None, core, "", 1, _name(found[i:j], titled))


def _slices(batch: pa.RecordBatch, *columns: str):
    """The columns as lists, of so many rows as hold _AT_ONCE characters of text."""
    ends, at = [0, *accumulate(pc.utf8_length(batch.column("text")).to_pylist())], 0
    while at < batch.num_rows:
        n = max(1, bisect_right(ends, ends[at] + _AT_ONCE) - 1 - at)
        yield [batch.column(c).slice(at, n).to_pylist() for c in columns]
        at += n


def _scan(batches, *how):
    """What a scanner finds in texts (k, doc_id, text), row by row."""
    scanner = _Scanner(*how)
    for batch in batches:
        for k, doc_id, text in _slices(batch, "k", "doc_id", "text"):
            found = [(*row, *span) for *row, spans in zip(k, doc_id, scanner.found(text)) for span in spans]
            entries = [*scanner.entries]
            yield pa.RecordBatch.from_pylist([dict(zip(("k", "doc_id", "start", "end", "kind", "core", "ext", "rank", "name"), (*row, *entries[e]))) for *row, e in found], _FOUND)


_FOUND = pa.schema([("k", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("core", pa.string()), ("ext", pa.string()), ("rank", pa.int32()), ("name", pa.string())])
_SCANNED = pa.schema([("p", pa.int32()), ("k", pa.binary()), ("doc_id", pa.int64()), ("spans", pa.binary()), ("e", pa.int32()), ("kind", pa.string()), ("core", pa.string()), ("ext", pa.string()), ("rank", pa.int32()), ("name", pa.string())])


def _filled(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """A batch with the given columns, nulls in the other ones."""
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _packed(batches, *how):
    """A row for each distinct text (k) of a part in which something is found: its ``spans`` as triples of 32 bits (start, end, number of the entry), by start. Then a row for each entry."""
    scanner, seen, part = _Scanner(*how), set(), None
    for batch in batches:
        for p, k, doc_id, text in _slices(batch, "p", "k", "doc_id", "text"):
            part = p[0] if part is None else part
            if {*p} != {part}:
                raise ValueError("a task holds one part")
            fresh = [i for i, x in enumerate(k) if not (x in seen or seen.add(x))]
            found = [(i, np.array(spans, np.int32).tobytes()) for i, spans in zip(fresh, scanner.found([text[i] for i in fresh])) if spans]
            if found:
                yield _filled(_SCANNED, len(found), p=[part] * len(found), k=[k[i] for i, _ in found], doc_id=[doc_id[i] for i, _ in found], spans=[s for _, s in found])
    entries = [*scanner.entries]
    for at in range(0, len(entries), 10_000):
        some = entries[at : at + 10_000]
        yield _filled(_SCANNED, len(some), p=[part] * len(some), e=range(at, at + len(some)), **dict(zip(("kind", "core", "ext", "rank", "name"), zip(*some))))


def name_key(text: Column) -> Column:
    return F.replace(F.lower(F.trim(F.regexp_replace(text, rf"[{_SPACE}]+", " "))), F.lit("’"), F.lit("'"))


def person_names(people: DataFrame, vocabulary: list[str] = VOCABULARY) -> DataFrame:
    """(name, kind, titled) of the people (name): the whole name and, of several words, each word and hyphenated part of three letters or more.

    Bots and names of the vocabulary are none; a part that is an ordinary word counts in title case only (``titled``)."""
    plain = people.select(F.trim("name").alias("name")).where((F.length("name") >= 2) & ~F.lower("name").rlike(r"^bot$|\[bot\]$|[-_]bot$")).distinct()
    whole = plain.where(~F.forall(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), lambda w: (w == "") | w.isin(vocabulary))).select("name", F.lit(False).alias("titled"))
    bare = F.regexp_replace("name", r"\([^)]*\)|\[[^\]]*\]|<[^>]*>", " ")
    words = F.filter(F.transform(F.split(bare, rf"[{_SPACE}._]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")
    parts = plain.select(words.alias("words")).where(F.size("words") > 1).select(F.explode(F.concat("words", F.flatten(F.transform("words", lambda w: F.split(w, "-"))))).alias("name"))
    parts = parts.where((F.length("name") >= 3) & F.col("name").rlike(r"^[\p{L}'’-]+$") & F.col("name").rlike(r"\p{L}") & ~F.lower("name").isin(vocabulary))
    stop = F.lower("name").isin(NAME_STOPS)
    parts = parts.select(F.when(stop, F.concat(F.upper(F.left("name", F.lit(1))), F.lower(F.substr("name", F.lit(2))))).otherwise(F.col("name")).alias("name"), stop.alias("titled"))
    return whole.union(parts).distinct().select("name", F.lit("PERSON").alias("kind"), "titled")


def _teaching(batches):
    """The texts that may teach a name: a quick look before the patterns."""
    for batch in batches:
        yield batch.filter(pc.match_substring_regex(batch.column("text"), "[@<]|[mM][eE][rR][gG][eE] "))


def learned(docs: DataFrame) -> DataFrame:
    """(name, kind) that texts teach: local parts of addresses, names before an address in trailers (``Reviewed-by: Jo Doe <jo@x.y>``), and branches of merge subjects."""
    docs, text = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_teaching, "text string"), F.col("text")
    every = lambda may, pattern: F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))
    near = F.filter(F.split(text, " "), lambda c: F.contains(c, F.lit("@")))  # an address is between spaces; a search from each character of a text takes long
    local = F.transform(F.flatten(F.transform(near, lambda c: F.regexp_extract_all(c, F.lit(f"({EMAIL})"), F.lit(1)))), lambda e: F.substring_index(e, "@", 1))
    local = F.when(F.contains(text, F.lit("@")), local).otherwise(F.array().cast("array<string>"))
    trailers = F.transform(every(F.contains(text, F.lit("<")) & F.contains(text, F.lit(":")), r"(?im)^[ \t>*-]{0,20}[a-z][a-z-]{0,40}(?:-by|-with|-to|author)[ \t]*:[ \t]*([^<\n,;]{1,200})<"), lambda n: F.trim(n))
    merged = text.rlike("[mM][eE][rR][gG][eE] ")
    branches = F.concat(every(merged, r"(?i)\bmerge (?:remote-tracking )?branch(?:es)? ['\"]([^'\"\n]{1,255})['\"]"), every(merged, rf"(?i)\bmerge pull request #[0-9]{{1,20}} from ([^{_SPACE}]{{1,255}})"))
    branches = F.filter(F.transform(branches, lambda b: F.rtrim(b, F.lit(_END))), lambda b: (b != "") & ~F.lower(F.regexp_replace(b, "^(?:origin|upstream)/", "")).isin(PUBLIC_BRANCHES))
    of = lambda kind, names: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))
    found = docs.where(F.contains(text, F.lit("@")) | (F.contains(text, F.lit("<")) & F.contains(text, F.lit(":"))) | merged).select(F.explode(F.concat(of("PERSON", local), of("PERSON", trailers), of("BRANCH", branches))).alias("f"))
    return found.select("f.name", "f.kind").where("name <> ''").distinct()


def names_of(docs: DataFrame, people: DataFrame | None = None, others: DataFrame | None = None, vocabulary: list[str] = VOCABULARY) -> DataFrame:
    """(name, pieces, kind, titled) of all names, ``name`` their tokens as runs of tokens are compared: ``people`` (name) and ``others`` (name, kind) as given, and what the texts teach. A term goes before a repository, branch, path and person of its spelling."""
    taught = stored(learned(docs))
    folk = taught.where("kind = 'PERSON'").select("name")
    folk = person_names(folk if people is None else folk.union(people.select("name")), vocabulary)
    rest = taught.where("kind <> 'PERSON'").select("name", "kind")
    rest = (rest if others is None else rest.union(others.select("name", "kind"))).where(F.length(F.trim("name")) >= 2).withColumn("titled", F.lit(False))
    rank = F.when(F.col("kind") == "TERM", 0).when(F.col("kind") == "REPO", 1).when(F.col("kind") == "BRANCH", 2).when(F.col("kind") == "PATH", 3).otherwise(4)
    spelled = F.when(F.col("titled"), F.trim("name")).otherwise(name_key(F.col("name")))
    best = rest.unionByName(folk).select(spelled.alias("spelled"), "kind", "titled", rank.alias("rank")).groupBy("spelled", "titled").agg(F.min_by("kind", "rank").alias("kind"))
    words = tuple(vocabulary)

    def cut_names(batches):
        known = _Marks(words)
        for batch in batches:
            found = [tokens(name, known)[1] for name in batch.column("spelled").to_pylist()]
            found = [p if titled else [_normal(t) for t in p] for p, titled in zip(found, batch.column("titled").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("spelled", "titled", "kind")] + [pa.array(found, pa.list_(pa.string()))], ["spelled", "titled", "kind", "pieces"])

    best = best.mapInArrow(cut_names, "spelled string, titled boolean, kind string, pieces array<string>")
    long = F.when(F.size("pieces") > NAME_TOKENS, F.raise_error(F.concat(F.lit("a name of too many tokens: "), "spelled"))).otherwise(F.size("pieces")).cast("int")
    pieces = F.when(long > 0, F.col("pieces"))
    return best.where(F.size("pieces") > 0).select(_joined(F.col("titled"), pieces).alias("name"), pieces.alias("pieces"), "kind", "titled")


def _joined(titled: Column, pieces: Column) -> Column:
    return F.concat_ws("\0", F.when(titled, "1").otherwise("0"), pieces)


def _bitmap(slots: DataFrame) -> bytes:
    """One bit a slot, SLOTS bits whatever the number of names."""
    slots = slots.where("slot is not null").select((F.col("slot") + 1).alias("slot"))
    parts = slots.groupBy(F.call_function("bitmap_bucket_number", F.col("slot")).alias("part")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("slot"))).alias("bits"))
    out = bytearray(SLOTS // 8)
    for row in parts.collect():
        out[(row.part - 1) * 4096 : row.part * 4096] = row.bits
    return bytes(out)


def _word_slots(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("titled"), pa.array([_word_slot(w.lower()) for w in batch.column("word").to_pylist()], pa.int64())], ["titled", "slot"])


def _bitmaps(names: DataFrame) -> tuple[bytes, bytes, str, int, bytes, str, bytes, bytes]:
    """Of the beginnings of names, token by token, and of whole names; a token's hash goes on from the one before, after a mark for titled ones. The first characters of names whose first token goes on over white space, and the most tokens of a name.

    Then of the beginnings that a token with white space follows; the first characters of names that are no letters or digits; and of first words, lower-cased, of names as they are and of titled ones."""
    mark, ends = F.when(F.col("titled"), _EXACT.decode()).otherwise(_LOWERED.decode()), F.sequence(F.lit(1), F.size("pieces"))
    upto = lambda n: F.concat(mark, F.array_join(F.slice("pieces", 1, n), "\0"), F.lit("\0"))
    first = F.col("pieces")[0]
    told = names.select(F.collect_set(F.when(first.rlike(r"(?U)\s"), F.left(first, F.lit(1)))), F.coalesce(F.max(F.size("pieces")), F.lit(0)), F.collect_set(F.when(first.rlike(r"^[^\p{L}\p{N}]"), F.left(first, F.lit(1))))).first()
    spaced = F.filter(ends, lambda n: F.coalesce(F.get("pieces", n).rlike(f"[{_SPACE}]"), F.lit(False)))
    begun, whole, spaced = (_bitmap(names.select(F.explode(keys).alias("key")).select(F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(SLOTS)).alias("slot"))) for keys in (F.transform(ends, upto), F.array(upto(F.size("pieces"))), F.transform(spaced, upto)))
    slots = names.select("titled", first.alias("word")).mapInArrow(_word_slots, "titled boolean, slot long")
    return begun, whole, "".join(" " if c.isspace() else c for c in told[0]), told[1], spaced, "".join(told[2]), _bitmap(slots.where("not titled")), _bitmap(slots.where("titled"))


class Pseudonymised(NamedTuple):
    """``texts``: doc_id, text; ``keys``: kind, stand_in, original, n_uses; ``replaced``: where the stand-ins of a text are, in order, and the spellings they took the place of."""

    texts: DataFrame
    keys: DataFrame
    replaced: DataFrame


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), text)))


class Found(NamedTuple):
    """What is replaced. ``uses`` (p, e, kind, key, core, ext, n_uses; doc_id, k and start of the first): each spelling (number e) in a part p of the texts, with the key under which a stand-in is given.
    ``spans`` (p, k, doc_id, spans): where, for each distinct (doc_id, text), as triples of start, end and e in code points. Texts are dealt by key into ``parts``."""

    uses: DataFrame
    spans: DataFrame
    parts: int


def _rows(docs: DataFrame, parts: int) -> DataFrame:
    """(p, k, doc_id, text); k is the key of a row's id and text, null of a null text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(F.when(text.isNotNull(), _row_key(doc_id, text)).alias("k"), doc_id.alias("doc_id"), text.alias("text"))
    return rows.select(F.pmod(F.xxhash64("k", "doc_id"), F.lit(parts)).cast("int").alias("p"), "*")


def _resolved(batches):
    """Of the spans of each text, by place, the first that doesn't overlap the one before; rows by part, its entries first, then its texts by id. After a part's texts, for each entry: the uses, and where the first is."""
    part, ranks, uses, seen = None, None, None, {}

    def counted():
        some = np.flatnonzero(uses).tolist()
        for at in range(0, len(some), 10_000):
            of = some[at : at + 10_000]
            doc_id, k, start = zip(*(seen[e] for e in of))
            yield _filled(_RESOLVED, len(of), p=[part] * len(of), e=of, n_uses=uses[of].tolist(), doc_id=doc_id, k=k, start=start)

    for batch in batches:
        parts = batch.column("p").to_numpy()
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            some = batch.slice(a, b - a)
            if parts[a] != part:
                if part is not None and len(uses):
                    yield from counted()
                part, ranks, uses, seen = int(parts[a]), np.zeros(0, np.int8), np.zeros(0, np.int64), {}
            entries = some.filter(pc.is_valid(some.column("e")))
            if entries.num_rows:
                e = entries.column("e").to_numpy()
                more = max(0, int(e.max()) + 1 - len(ranks))
                ranks, uses = np.pad(ranks, (0, more), constant_values=-1), np.pad(uses, (0, more))
                ranks[e] = entries.column("rank").to_numpy()
            texts = some.filter(pc.is_valid(some.column("spans")))
            if texts.num_rows and len(ranks):
                kept, sizes = _kept(texts.column("spans").to_pylist(), ranks)
                new, at = np.unique(kept[:, 2], return_index=True)
                unseen = [(e, i) for e, i in zip(new.tolist(), at.tolist()) if e not in seen]
                if unseen:
                    doc_id, k, of = texts.column("doc_id").to_pylist(), texts.column("k").to_pylist(), np.repeat(np.arange(len(sizes)), sizes)
                    seen.update((e, (doc_id[of[i]], k[of[i]], int(kept[i, 0]))) for e, i in unseen)
                uses += np.bincount(kept[:, 2], minlength=len(uses))
                ends = np.concatenate([[0], np.cumsum(sizes)]) * 12
                data, some = kept.tobytes(), [(i, x, y) for i, (x, y) in enumerate(zip(ends.tolist(), ends[1:].tolist())) if y > x]
                texts = texts.take(pa.array([i for i, _, _ in some], pa.int64()))
                yield _filled(_RESOLVED, len(some), p=texts.column("p"), k=texts.column("k"), doc_id=texts.column("doc_id"), spans=[data[x:y] for _, x, y in some])
    if part is not None and len(uses):
        yield from counted()


_RESOLVED = pa.schema([("p", pa.int32()), ("k", pa.binary()), ("doc_id", pa.int64()), ("spans", pa.binary()), ("e", pa.int32()), ("n_uses", pa.int64()), ("start", pa.int64())])


def _triples(spans: bytes):
    return np.frombuffer(spans, np.int32).reshape(-1, 3)


def _kept(spans: list[bytes], ranks) -> tuple[np.ndarray, np.ndarray]:
    """The triples that stay, and their number in each text. ``ranks``: by entry, negative of those that are no names; at one place the lowest goes first, then the longest."""
    every = _triples(b"".join(spans))
    of = np.repeat(np.arange(len(spans)), [len(s) // 12 for s in spans])
    real = ranks.take(np.minimum(every[:, 2], len(ranks) - 1)) >= 0  # entries after the last one that counts aren't there
    real &= every[:, 2] < len(ranks)
    every, of = every[real], of[real]
    clash = np.flatnonzero((of[1:] == of[:-1]) & (every[1:, 0] < every[:-1, 1]))
    if len(clash):
        keep = np.ones(len(of), bool)
        for t in np.unique(of[clash]).tolist():
            a, b = np.searchsorted(of, [t, t + 1]).tolist()
            reach = -1
            for start, rank, end, i in sorted((start, ranks[e], -end, i) for i, (start, end, e) in enumerate(every[a:b].tolist(), a)):
                keep[i] = start >= reach
                reach = -end if keep[i] else reach
        every, of = every[keep], of[keep]
    return every, np.bincount(of, minlength=len(spans))


def occurrences(docs: DataFrame, names: DataFrame, vocabulary: list[str] = VOCABULARY, ids: list[str] = ()) -> Found:
    """Texts are scanned part by part. What is found goes on as one row a text and one a spelling and part, however often it is there: only spellings meet the names."""
    how = _bitmaps(names)
    session = docs.sparkSession
    parts = 4 * max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))  # mostly computation, and texts differ in length
    scanned = _rows(docs, parts).where("k is not null").repartitionById(parts, F.col("p"))
    scanned = stored(scanned.mapInArrow(lambda batches: _packed(batches, *how, vocabulary, list(ids)), "p int, k binary, doc_id long, spans binary, e int, kind string, core string, ext string, rank int, name string"))
    entries = scanned.where("e is not null").select("p", "e", "kind", "core", "ext", "rank", "name")
    named = entries.where("kind is null").drop("kind").join(names.groupBy("name").agg(F.min("kind").alias("kind")), "name")
    every = ["p", "e", "kind", "core", "ext", "rank"]
    kind, core = F.col("kind"), F.col("core")
    key = F.when(kind.isin("URL", "PATH", "BRANCH", "ID", SAME), core).when(kind.isin("PERSON", "REPO", "TERM"), name_key(core)).otherwise(F.lower(core))
    entries = stored(entries.where("kind is not null").select(*every).union(named.select(*every)).withColumn("key", key))
    # of names at one place, lower-cased and titled, the first kind counts
    rank = (F.col("rank") * 20 + F.array_position(F.array(*map(F.lit, sorted([*KINDS, SAME]))), kind)).cast("byte")
    both = entries.select("p", "e", rank.alias("rank")).unionByName(scanned.where("spans is not null").select("p", "k", "doc_id", "spans"), allowMissingColumns=True)
    both = both.repartition("p").sortWithinPartitions("p", F.col("spans").isNotNull(), "doc_id", "k")
    resolved = stored(both.mapInArrow(_resolved, "p int, k binary, doc_id long, spans binary, e int, n_uses long, start long"))
    uses = stored(resolved.where("e is not null").drop("spans").join(entries.drop("rank"), ["p", "e"]))
    return Found(uses, resolved.where("e is null").select("p", "k", "doc_id", "spans"), parts)


def _rewritten(batches):
    """Texts with their parts ``r`` (start, end, new) replaced."""
    for batch in batches:
        changed = pc.is_valid(batch.column("r"))
        some, out = batch.filter(changed), []
        for text, parts in zip(some.column("text").to_pylist(), some.column("r").to_pylist()):
            ends = [0, *(p["end"] for p in parts)]
            out.append("".join(x for p, e in zip(parts, ends) for x in (text[e : p["start"]], p["new"])) + text[ends[-1] :])
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("doc_id"), pc.replace_with_mask(batch.column("text"), changed, pa.array(out, batch.column("text").type))], ["k", "doc_id", "text"])


def _replace(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(k, doc_id, text) with the parts (k, start, end, new) replaced; k is the key of a row's id and former text, null of a null text."""
    text = F.col("text").cast("string")
    by_text = parts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "end", "new"))).alias("r"))
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.when(text.isNotNull(), _row_key(F.col("doc_id").cast("long"), text)).alias("k")).join(by_text, "k", "left")
    return rows.select("k", "doc_id", "text", "r").mapInArrow(_rewritten, "k binary, doc_id long, text string")


def _found(docs: DataFrame, people: DataFrame | None, others: DataFrame | None, ids: list[str], vocabulary: list[str]) -> Found:
    return occurrences(docs, stored(names_of(docs, people, others, vocabulary)), vocabulary, ids)


def _keys(uses: DataFrame) -> DataFrame:
    """(kind, key, original, n_uses, stand_in) of what is replaced."""
    first = F.struct("doc_id", "k", "start")
    seen = uses.groupBy("kind", "key").agg(F.min(first).alias("_first"), F.min_by("core", first).alias("original"), F.sum("n_uses").alias("n_uses"))
    seen = seen.select("kind", "key", "original", "n_uses", "_first.*")
    return stored(numbered(seen, ["kind"], ["doc_id", "k", "start", "key"]).select("kind", "key", "original", "n_uses", F.when(F.col("kind") == SAME, F.col("key")).otherwise(F.concat_ws("_", "kind", F.col("n").cast("string"))).alias("stand_in")))


def _with_stand_ins(batches):
    """Texts with what is new in the place of their spans; rows by part: its entries (e, new), then by k the spans (no text) and texts."""
    part, new, held, spans = None, {}, None, b""
    for batch in batches:
        p, e, k, spans_, text = (batch.column(c).to_pylist() if c != "text" else batch.column(c) for c in ("p", "e", "k", "spans", "text"))
        has_new, rows, changed, out = batch.column("new"), [], [], []
        for i in range(batch.num_rows):
            if p[i] != part:
                part, new, held = p[i], {}, None
            if e[i] is not None:
                new[e[i]] = has_new[i].as_py()
            elif spans_[i] is not None:
                held, spans = k[i], spans_[i]
            else:
                rows.append(i)
                changed.append(k[i] is not None and k[i] == held)
                if changed[-1]:
                    old, at, bits = text[i].as_py(), 0, []
                    for start, end, e_ in _triples(spans).tolist():
                        if e_ in new:
                            bits += old[at:start], new[e_]
                            at = end
                    out.append("".join(bits) + old[at:])
        some = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([some.column("k"), some.column("doc_id"), pc.replace_with_mask(some.column("text"), pa.array(changed, pa.bool_()), pa.array(out, some.column("text").type))], ["k", "doc_id", "text"])


def _moved(batches):
    """Where stand-ins are in the new texts; rows by part, its entries (e, new, stand_in, core) first."""
    part, new = None, {}
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["p"] != part:
                part, new = row["p"], {}
            if row["e"] is not None:
                new[row["e"]] = row["new"], row["stand_in"], row["core"]
                continue
            by = 0
            for start, end, e in _triples(row["spans"]).tolist():
                if e in new:
                    text, stand_in, core = new[e]
                    out.append((row["k"], start + by, start + by + len(text), stand_in, core))
                    by += len(text) - (end - start)
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(column, of) for column, of in zip(zip(*out[at : at + 10_000]), (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["k", "start", "end", "stand_in", "original"])


def _shown(keys: DataFrame) -> DataFrame:
    return keys.where(F.col("kind") != SAME).drop("key")


def pseudonymise(docs: DataFrame, people: DataFrame | None = None, others: DataFrame | None = None, ids: list[str] = (), vocabulary: list[str] = VOCABULARY) -> Pseudonymised:
    """Texts with stand-ins, the key table, and the spellings replaced. ``people`` (name) and ``others`` (name, kind REPO, TERM, BRANCH or PATH) are names known beforehand; ``ids`` are patterns of record ids."""
    docs = docs.select("doc_id", "text")
    found = _found(docs, people, others, ids, vocabulary)
    keys = _keys(found.uses)
    news = stored(found.uses.join(keys.select("kind", "key", "stand_in"), ["kind", "key"]).where(F.col("kind") != SAME).select("p", "e", F.concat("stand_in", "ext").alias("new"), "stand_in", "core"))
    spans = found.spans.select("p", "k", "spans")
    rows = news.select("p", "e", "new").unionByName(spans, allowMissingColumns=True).unionByName(_rows(docs, found.parts), allowMissingColumns=True)
    rows = rows.repartitionById(found.parts, F.col("p")).sortWithinPartitions("p", F.col("e").isNull(), "k", F.col("spans").isNull())
    texts = rows.mapInArrow(_with_stand_ins, "k binary, doc_id long, text string")
    both = news.unionByName(spans, allowMissingColumns=True).repartition("p").sortWithinPartitions("p", F.col("e").isNull())
    replaced = both.mapInArrow(_moved, "k binary, start long, end long, stand_in string, original string")
    new_keys = texts.where("k is not null").select("k", _row_key(F.col("doc_id"), F.col("text")).alias("new_k")).distinct()
    replaced = replaced.join(new_keys, "k").select(F.col("new_k").alias("k"), "start", "end", "stand_in", "original").distinct()
    return Pseudonymised(texts.drop("k"), _shown(keys), replaced)


def restored(texts: DataFrame, replaced: DataFrame) -> DataFrame:
    """(doc_id, text) as it was, from pseudonymised texts and what was replaced in them."""
    return _replace(texts, replaced.select("k", "start", "end", F.col("original").alias("new"))).drop("k")


def pseudonymised_documents(spark, sf_dir):
    """Every document with its stand-ins: digest and length of the new text. Names are those that the documents teach."""
    texts = pseudonymise(model.table(spark, sf_dir, "documents")).texts
    return texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


def pseudonym_keys(spark, sf_dir):
    """The key table of the documents' stand-ins; no text is rewritten for it."""
    return _shown(_keys(_found(model.table(spark, sf_dir, "documents").select("doc_id", "text"), None, None, [], VOCABULARY).uses))
