"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. A block's features are its number of words and its link density (share of its words
inside links), both of the blocks before and after it too, whether it is a heading, and whether the innermost telling container around it is
one of articles (or outside of the page's articles) or one of page furniture. A decision tree (Gini, exact splits) is trained on the small table ``LABELLED``.

A tag is a < before the name of an element and attributes, whose quoted values may hold any character; any other < is text.
Scripts, styles, comments and other parts without prose are no blocks. Character references are decoded, white space in a block
becomes one space, kept blocks are joined by one space. Null or empty html gives an empty text, an empty table no rows. Repeated pages are extracted
each; extra columns are ignored. A tag, script or comment that never closes ends with the page; an svg or the like that never closes is ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"
# Names of elements and words of class names by their part in a page.
ELEMENTS = frozenset(
    """a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col colgroup
    data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html
    i iframe img input ins kbd label legend li link main map mark marquee math menu meta meter nav nobr noembed noframes noscript object ol optgroup option output p param
    picture pre progress q rp rt ruby s samp script search section select slot small source span strike strong style sub summary sup svg table tbody td template textarea
    tfoot th thead time title tr track tt u ul var video wbr xmp""".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Parts without prose; those of RAW hold no tags and run to the end of the page if they never close.
SKIPPED = frozenset("applet audio canvas datalist iframe math noembed noframes noscript object script select style svg template textarea title video xmp".split())
RAW = frozenset("script style textarea title xmp".split())
FURNITURE = frozenset("nav footer aside form menu dialog button search label fieldset".split())
ALONE = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: An opened element closes the one of its kind before it, up to the list or table around both.
SIBLINGS = {"li": "ul ol menu dir".split(), "dt": ["dl"], "dd": ["dl"], "tr": ["table"], "td": ["table", "tr"], "th": ["table", "tr"], "option": ["select"]}
_ASIDE = r"ads?|adsense|advert\w*|sponsor\w*|promo\w*|banner|comments?|commentlist|commentary|respond|reply|replies|disqus\w*|discuss\w*|related|recommend\w*|teaser|trending"
_NAMED = re.compile(
    rf"(?:{_ASIDE}|menus?|menubar|nav\w*|sidebar|footer|masthead|topbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|signin|share|sharing|social|breadcrumbs?|pagination|pager|widgets?|toolbar|search|searchbox|hidden|copyright|skip|paywall)"
)
_NAMED_ARTICLE = re.compile(_ASIDE)
_MAIN_NAMED = re.compile(r"(?:article|content|entry|post|story|main)(?:body|content|text)?")
#: Words that turn a class name into one about the page's state.
_STATE = frozenset("no has with without open opened closed enabled disabled hide show fixed toggle count".split())
_ATTRIBUTE = r"""[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>][^\s<>]*+))?+"""
_TAG = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9:_.-]*+)((?:\s++{_ATTRIBUTE}|\s*+/(?!>)|(?<=[\"']){_ATTRIBUTE})*+)\s*+(/?)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:[\s/\"'][^<>]*+)?)()(?:>|\Z)")
_VALUED = re.compile(rf"""(?:\s*+[^\s"'<>/=]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>][^\s<>]*+)|\s*+/)*+\s*+""")
_NAME = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)(?=[\s=]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


#: Labelled blocks. words, link density, the same of the block before and after, heading, in an article, in furniture; main text or not.
LABELLED = np.array([
    [45, 0.00, 30, 0.00, 60, 0.00, 0, 1, 0, 1], [12, 0.00, 0, 0.00, 40, 0.00, 1, 1, 0, 1], [3, 0.00, 20, 0.00, 50, 0.00, 0, 1, 0, 1], [1, 0.00, 8, 0.00, 2, 0.00, 0, 1, 0, 1],
    [80, 0.05, 10, 0.00, 70, 0.00, 0, 1, 0, 1], [6, 0.00, 9, 1.00, 35, 0.00, 1, 1, 0, 1], [25, 0.10, 40, 0.00, 4, 0.00, 0, 1, 0, 1], [4, 0.50, 60, 0.00, 55, 0.00, 0, 1, 0, 1],
    [2, 0.00, 0, 0.00, 0, 0.00, 0, 1, 0, 1], [9, 1.00, 50, 0.00, 45, 0.00, 0, 1, 0, 1], [5, 1.00, 5, 1.00, 6, 1.00, 0, 1, 0, 1], [3, 1.00, 4, 1.00, 2, 1.00, 0, 1, 0, 1],
    [60, 0.00, 55, 0.00, 40, 0.00, 0, 0, 0, 1], [35, 0.05, 8, 0.00, 50, 0.02, 0, 0, 0, 1], [22, 0.00, 45, 0.00, 30, 0.00, 0, 0, 0, 1], [7, 0.00, 3, 1.00, 48, 0.00, 1, 0, 0, 1],
    [14, 0.00, 38, 0.00, 42, 0.00, 0, 0, 0, 1], [18, 0.20, 60, 0.00, 25, 0.00, 0, 0, 0, 1], [28, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1], [90, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 1],
    [1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 1, 0], [2, 1.00, 0, 0.00, 1, 1.00, 0, 0, 1, 0], [12, 0.00, 1, 1.00, 9, 0.00, 0, 0, 1, 0], [40, 0.00, 3, 1.00, 12, 0.00, 0, 0, 1, 0],
    [9, 0.00, 60, 0.00, 0, 0.00, 0, 0, 1, 0], [25, 0.30, 50, 0.00, 0, 0.00, 0, 0, 1, 0], [70, 0.00, 40, 0.00, 30, 0.00, 0, 0, 1, 0], [5, 0.00, 2, 0.00, 3, 0.00, 1, 0, 1, 0],
    [15, 0.80, 10, 0.90, 12, 0.70, 0, 0, 0, 0], [3, 1.00, 2, 1.00, 4, 1.00, 0, 0, 0, 0], [2, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0], [6, 0.00, 3, 1.00, 2, 1.00, 0, 0, 0, 0],
    [4, 0.00, 5, 0.00, 2, 0.50, 0, 0, 0, 0], [8, 0.75, 60, 0.00, 6, 1.00, 0, 0, 0, 0], [5, 0.00, 4, 1.00, 6, 1.00, 1, 0, 0, 0], [30, 0.90, 20, 0.90, 25, 0.80, 0, 0, 0, 0],
    # In an article, before blocks of links: the last paragraph, text before references, a paragraph that is a third links.
    [40, 0.00, 55, 0.00, 3, 1.00, 0, 1, 0, 1], [20, 0.00, 60, 0.00, 5, 1.00, 0, 1, 0, 1], [58, 0.05, 30, 0.00, 12, 0.80, 0, 1, 0, 1], [8, 0.00, 30, 0.00, 4, 1.00, 0, 1, 0, 1],
    [30, 0.33, 40, 0.00, 2, 1.00, 0, 1, 0, 1], [35, 0.00, 40, 0.00, 25, 0.33, 0, 1, 0, 1], [10, 0.60, 9, 0.70, 11, 0.60, 0, 1, 0, 1], [3, 0.00, 45, 0.00, 8, 0.70, 1, 1, 0, 1],
    [16, 0.00, 4, 1.00, 5, 1.00, 0, 1, 0, 1], [1, 0.00, 6, 1.00, 3, 1.00, 0, 1, 0, 1], [6, 1.00, 7, 1.00, 50, 0.00, 0, 1, 0, 1], [2, 1.00, 3, 1.00, 35, 0.00, 0, 1, 0, 1],
    # In an article, short: titles after navigation, short lines between links.
    [1, 0.00, 3, 1.00, 40, 0.00, 1, 1, 0, 1], [2, 0.00, 2, 1.00, 3, 1.00, 0, 1, 0, 1], [6, 0.00, 3, 1.00, 2, 1.00, 0, 1, 0, 1], [4, 0.00, 5, 0.00, 2, 0.50, 0, 1, 0, 1],
    [5, 0.00, 4, 1.00, 6, 1.00, 1, 1, 0, 1], [2, 0.00, 4, 0.00, 12, 0.00, 0, 1, 0, 1], [1, 0.00, 1, 0.00, 1, 0.00, 0, 1, 0, 1], [3, 0.00, 0, 0.00, 4, 1.00, 1, 1, 0, 1],
    # In furniture, before long blocks: adverts, notices, comments of any length.
    [20, 0.00, 10, 0.00, 60, 0.00, 0, 0, 1, 0], [15, 0.00, 0, 0.00, 80, 0.00, 0, 0, 1, 0], [45, 0.00, 3, 0.00, 50, 0.00, 0, 0, 1, 0], [120, 0.00, 40, 0.00, 90, 0.00, 0, 0, 1, 0],
    [35, 0.05, 8, 0.00, 50, 0.02, 0, 0, 1, 0], [4, 0.00, 2, 0.00, 45, 0.00, 1, 0, 1, 0], [80, 0.00, 70, 0.00, 3, 1.00, 0, 0, 1, 0], [12, 0.50, 60, 0.00, 70, 0.00, 0, 0, 1, 0],
    [65, 0.00, 20, 0.00, 0, 0.00, 0, 0, 1, 0], [2, 0.00, 0, 0.00, 34, 0.00, 0, 0, 1, 0], [3, 1.00, 2, 1.00, 40, 0.00, 0, 0, 1, 0], [25, 0.00, 90, 0.00, 36, 0.00, 0, 0, 1, 0],
    # In neither: text before links, links before text.
    [45, 0.00, 50, 0.00, 3, 1.00, 0, 0, 0, 1], [24, 0.00, 40, 0.00, 4, 1.00, 0, 0, 0, 1], [4, 1.00, 3, 1.00, 50, 0.00, 0, 0, 0, 0], [2, 1.00, 2, 1.00, 38, 0.00, 0, 0, 0, 0],
    [12, 0.00, 30, 0.00, 3, 1.00, 0, 0, 0, 1], [9, 0.00, 22, 0.00, 14, 0.00, 0, 0, 0, 1], [11, 0.09, 13, 0.00, 2, 1.00, 0, 0, 0, 1], [10, 0.00, 0, 0.00, 12, 0.00, 0, 0, 0, 1],
    [5, 0.00, 0, 0.00, 44, 0.00, 1, 0, 0, 1], [3, 0.00, 50, 0.00, 46, 0.00, 1, 0, 0, 1], [4, 0.00, 25, 0.00, 3, 1.00, 0, 0, 0, 0], [3, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0],
    [1, 1.00, 0, 0.00, 45, 0.00, 0, 0, 0, 0], [1, 1.00, 12, 0.00, 60, 0.00, 0, 0, 0, 0], [5, 0.80, 45, 0.00, 50, 0.00, 0, 0, 0, 0], [7, 0.60, 0, 0.00, 30, 0.00, 0, 0, 0, 0],
    # In neither, short: titles, first and last lines beside long text; lines of any shortness among links.
    [1, 0.00, 0, 0.00, 2, 0.00, 1, 0, 0, 1], [2, 0.00, 1, 0.00, 40, 0.00, 0, 0, 0, 1], [2, 0.00, 40, 0.00, 0, 0.00, 0, 0, 0, 1], [3, 0.00, 60, 0.00, 4, 0.00, 0, 0, 0, 1],
    [5, 0.00, 30, 0.00, 45, 0.00, 0, 0, 0, 1], [4, 0.00, 35, 0.00, 2, 0.00, 0, 0, 0, 1], [2, 0.00, 28, 0.00, 33, 0.00, 1, 0, 0, 1], [6, 0.00, 2, 1.00, 50, 0.00, 1, 0, 0, 1],
    [9, 0.00, 4, 1.00, 3, 1.00, 0, 0, 0, 0], [8, 0.00, 5, 1.00, 2, 1.00, 0, 0, 0, 0], [12, 0.00, 3, 1.00, 4, 1.00, 0, 0, 0, 0], [6, 0.00, 2, 1.00, 0, 0.00, 0, 0, 0, 0],
    [10, 0.00, 6, 1.00, 0, 0.00, 0, 0, 0, 0], [2, 0.00, 3, 1.00, 2, 0.00, 0, 0, 0, 0], [14, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0], [7, 0.00, 2, 1.00, 4, 1.00, 0, 0, 0, 0],
    [40, 0.00, 3, 1.00, 2, 1.00, 0, 0, 0, 1], [25, 0.00, 4, 1.00, 45, 0.00, 0, 0, 0, 1], [30, 0.00, 2, 1.00, 10, 0.00, 0, 0, 0, 1], [60, 0.00, 5, 1.00, 4, 1.00, 0, 0, 0, 1],
    [20, 0.00, 6, 1.00, 20, 0.00, 0, 0, 0, 1], [50, 0.00, 2, 1.00, 12, 0.00, 0, 0, 0, 1], [1, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0], [2, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0],
    # In neither, on a page that has an article elsewhere: prose of any length.
    [60, 0.00, 55, 0.00, 40, 0.00, 0, -1, 0, 0], [35, 0.05, 8, 0.00, 50, 0.02, 0, -1, 0, 0], [12, 0.00, 0, 0.00, 48, 0.00, 0, -1, 0, 0], [4, 0.00, 3, 1.00, 48, 0.00, 1, -1, 0, 0],
    [20, 0.00, 60, 0.00, 0, 0.00, 0, -1, 0, 0], [150, 0.00, 40, 0.00, 3, 1.00, 0, -1, 0, 0], [1, 1.00, 2, 1.00, 30, 0.00, 0, -1, 0, 0], [9, 0.00, 70, 0.00, 12, 0.00, 0, -1, 0, 0],
])


def grow(rows: np.ndarray, depth: int = 9):
    """A tree as nested (feature, bound, below or equal, above) with shares of main text at its leaves."""
    share = rows[:, -1].mean()
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            low, high = rows[rows[:, f] <= bound, -1], rows[rows[:, f] > bound, -1]
            loss = len(low) * low.mean() * (1 - low.mean()) + len(high) * high.mean() * (1 - high.mean())
            if best is None or loss < best[0] - 1e-12:
                best = (loss, f, bound)
    if best is None:
        return share
    _, f, bound = best
    return f, bound, grow(rows[rows[:, f] <= bound], depth - 1), grow(rows[rows[:, f] > bound], depth - 1)


def judge(tree, features) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def _called(attributes: str) -> tuple[str, bool]:
    """The words of class, id and role, and whether the element is hidden."""
    names, hidden = [], False
    for kind, value in _NAME.findall(attributes):
        kind, value = kind.lower(), value.strip("\"'").lower()
        if kind in ("class", "id", "role"):
            names += value.split()
        else:
            hidden |= kind == "hidden" or (kind == "aria-hidden" and value == "true") or (kind == "style" and "display:none" in value.replace(" ", ""))
    return " ".join(names), hidden


def _part(name: str, attributes: str, main: int, furniture: int) -> tuple[int, int]:
    """Whether an element is in an article, and in furniture (2: only in a form), given where it stands."""
    called, hidden = _called(attributes) if attributes else ("", False)
    named = _NAMED_ARTICLE if name in ("article", "main") else _NAMED
    aside = likes = False
    if name not in ("html", "body"):
        for one in called.split():
            words = [w for w in re.split(r"[-_:]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one)) if w]
            if _STATE.isdisjoint(words):
                aside |= any(named.fullmatch(w) for w in words) or (not main and "header" in words and name not in ("article", "main"))
                likes |= bool(_MAIN_NAMED.fullmatch("".join(words))) or (len(words) > 1 and bool(_MAIN_NAMED.fullmatch(words[0])) and words[-1] in ("body", "content", "text", "inner", "wrapper"))
    if hidden or aside or (name in FURNITURE and name != "form") or (name == "header" and not main):
        return 0, 1
    if name == "form":
        return 0, furniture or 2
    if furniture != 1 and (name in ("article", "main") or likes):
        return 1, 0
    return main, furniture


def _next_tag(page: str, at: int):
    """The next tag, comment or declaration at or after a place; a < of any other shape is text."""
    while (at := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), at):
            return at, None
        m = _TAG.match(page, at)
        if m and m.group(2).lower() not in ELEMENTS and not _VALUED.fullmatch(m.group(3)):
            m = None
        if m is None:
            m = _LOOSE.match(page, at)
            m = m if m and m.group(2).lower() in ELEMENTS else None
        if m:
            return at, m
        at += 1
    return None


def blocks(page: str) -> list[tuple[str, int, float, int, int, int]]:
    """Text, words, link density, heading, in an article (-1: the page has one elsewhere), in furniture of each flat block that has text."""
    out: list[tuple[str, int, float, int, int, int]] = []
    stack: list[tuple[str, int, int]] = []  # element, in an article, in furniture
    places: dict[str, list[int]] = {}  # where the open elements of a name are in the stack
    endless: set[str] = set()  # names of skipped parts that no closing tag follows
    parts: list[str] = []
    linked, links, heading, at, n = 0, 0, 0, 0, len(page)

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            words = text.count(" ") + 1
            _, main, furniture = stack[-1] if stack else ("", 0, 0)
            out.append((text, words, min(1.0, linked / words), heading, main, int(furniture > 0)))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if links:
                linked += len(raw.split())

    def drop(k: int) -> None:
        for element in stack[k:]:
            places[element[0]].pop()
        del stack[k:]

    def leave(name: str, inside=()) -> None:
        """Closes the last open element of a name, unless one of ``inside`` was opened since."""
        last = lambda one: places[one][-1] if places.get(one) else -1
        k = last(name)
        if k >= 0 and all(last(one) <= k for one in inside):
            drop(k)

    while at < n:
        tag = _next_tag(page, at)
        add(page[at : tag[0] if tag else n])
        if tag is None:
            break
        at, m = tag
        if m is None:
            mark = "-->" if page.startswith("<!--", at) else ">"
            end = page.find(mark, at + 2)
            at = n if end < 0 else end + len(mark)
            continue
        at = m.end()
        closing, name, attributes, alone = m.group(1), m.group(2).lower(), m.group(3), m.group(4)
        if name in SKIPPED:
            if not closing and not alone:
                end = None if name in endless else re.compile(rf"</{name}\b[^<>]*>?", re.I).search(page, at)
                if end is None:
                    endless.add(name)
                at = end.end() if end else n if name in RAW else at
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in BLOCK_TAGS:
            close()
            heading = int(len(name) == 2 and name[0] == "h" and name[1] in "123456" and not closing)
            if name in ALONE:
                continue
            if closing:
                leave(name)
                continue
            if stack and stack[-1][0] == "p":
                drop(len(stack) - 1)
            if name in SIBLINGS:
                leave(name, SIBLINGS[name])
            if not alone:
                _, main, furniture = stack[-1] if stack else ("", 0, 0)
                places.setdefault(name, []).append(len(stack))
                stack.append((name, *_part(name, attributes, main, furniture)))
    close()
    if any(b[4] for b in out):
        out = [(*b[:4], b[4] if b[4] or b[5] else -1, b[5]) for b in out]
    return out


def extract(page: str | None, tree) -> tuple[str, int, int]:
    """Main text, number of blocks, number of blocks kept."""
    found = blocks(page or "")
    kept = []
    edge = ("", 0, 0.0)
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else edge, found[i + 1] if i + 1 < len(found) else edge
        if judge(tree, (b[1], b[2], before[1], before[2], after[1], after[2], b[3], b[4], b[5])) >= 0.5:
            kept.append(b[0])
    return " ".join(kept), len(found), len(kept)


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars, n_blocks, n_kept."""
    tree = grow(LABELLED)

    def run(batches):
        for batch in batches:
            rows = [extract(page, tree) for page in batch.column("html").to_pylist()]
            texts, all_blocks, kept = (list(x) for x in zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(all_blocks, pa.int64()), pa.array(kept, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, SCHEMA)
