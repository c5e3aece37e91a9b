"""Hand-made pages: articles that end in links, long furniture, odd markup, odd rows."""

import time

import numpy as np
import pytest

from tidemark.llm import html_text

SAYS = " ".join(f"word{i}" for i in range(40))
SHORT = "A last paragraph of the article that is rather short."
LINKS = "<a href='/a'>About us</a> <a href='/b'>Contact</a>"
PAGES = [
    (f"<nav>{LINKS}</nav><article><h1>Title</h1><p>{SAYS}</p><p>{SHORT}</p></article><footer>{LINKS}</footer>", f"Title {SAYS} {SHORT}"),
    (f"<article><p>{SAYS}</p><p>{SHORT}</p><p>See <a href='/r'>this here</a> for more words.</p><p>{SHORT}</p></article><nav>{LINKS}</nav>", f"{SAYS} {SHORT} See this here for more words. {SHORT}"),
    (f"<article><p>{SHORT}</p><p>{SAYS}</p><ul><li>Smith, J. <a href='/1'>Of many things</a> 1999</li><li>Lee, K. <a href='/2'>Of few things</a> 2001</li></ul></article>", f"{SHORT} {SAYS} Smith, J. Of many things 1999 Lee, K. Of few things 2001"),
    (f"<div class='advert'><p>Buy this thing now.</p></div><article><p>{SAYS}</p></article>", SAYS),
    (f"<div class='notice'><p>We have moved, see below.</p></div><article><p>{SAYS}</p><p>{SAYS}</p></article>", f"{SAYS} {SAYS}"),
    (f"<article><p>{SAYS}</p></article><div class='comments'><p>{SHORT}</p><p>{SAYS} {SAYS}</p><p>{SAYS}</p></div>", SAYS),
    # furniture before long blocks
    (f"<nav><a href=/>Home</a></nav><article><p>{SAYS}</p></article>", SAYS),
    (f"<div id=cookie-banner><p>We use cookies. {SAYS}</p><button>OK</button></div><article><p>{SAYS}</p></article>", SAYS),
    (f"<aside><p>{SHORT}</p><p>{SAYS} {SAYS}</p></aside><article><p>{SAYS}</p><aside>{SHORT}</aside><p>{SHORT}</p></article>", f"{SAYS} {SHORT}"),
    (f"<div class='site-header'><h1>The Daily Page</h1><p>{SHORT}</p></div><main><h1>Title</h1><p>{SAYS}</p></main>", f"Title {SAYS}"),
    (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{SAYS}</p><footer>Filed under: news</footer></article>", f"Title {SAYS}"),
    (f"<article class='post comments-open'><p>{SAYS}</p></article><article class='comment'><p>{SAYS} {SHORT}</p></article>", SAYS),
    (f"<article><p>{SAYS}</p><p class=ad>{SHORT}<p>{SHORT}</article><div style='display: none'>{SAYS}</div>", f"{SAYS} {SHORT}"),
    # pages without an article element
    (f"<body><div class=menu>{LINKS}</div><p>{SAYS}</p><p>{SHORT}</p><div>{LINKS}</div></body>", f"{SAYS} {SHORT}"),
    (f"<div id='main-content'><h2>Part</h2>{SAYS}<br>{SHORT}</div><div class='sidebar'>{SAYS}</div>", f"Part {SAYS} {SHORT}"),
    (f"<table><tr><td>{LINKS}</td><td><p>{SAYS}</p><p>{SHORT} {SAYS}</p></td></tr></table>", f"{SAYS} {SHORT} {SAYS}"),
    # forms
    (f"<article><p>{SAYS}</p><form><label>Name</label><input><textarea>{SAYS}</textarea><select><option>One</select></form><p>{SHORT}</p></article>", f"{SAYS} {SHORT}"),
    (f"<form id=page><article><p>{SAYS}</p></article><label>Search</label></form>", SAYS),
    # odd markup
    (f"<article><p title=\"a > b\">{SAYS}</p><a href='x>y'>{SHORT}</a></article>", f"{SAYS} {SHORT}"),
    ("<article><p>If x<y here and i<n;i++ or a < b, then 1<2 and <3 is a heart.</p></article>", "If x<y here and i<n;i++ or a < b, then 1<2 and <3 is a heart."),
    (f"<ARTICLE><P CLASS=x>{SAYS}</P><!-- <p>no</p> --><![CDATA[no]]><?php no ?></ARTICLE>", SAYS),
    (f"<article><p>{SAYS}</p><script>if (a<b) document.write('<p>no</p>')</script><style>p > a {{}}</style><noscript>no</noscript><svg><title>no</title></svg></article>", SAYS),
    (f"<article><p>{SAYS}</p><ul><li class=promo>no<li>One &lt;b&gt; &amp;amp; two&nbsp;three</ul><x-note kind='a'>{SHORT}</x-note></article>", f"{SAYS} One <b> &amp; two three {SHORT}"),
    (f"<article><p>{SAYS}<p>Second<br>line<pre>  a\n  b </pre>", f"{SAYS} Second line a b"),
    (f"<html><head><title>no</title><body><article>{SAYS}</article>", SAYS),
    (f"<article>{SAYS}<svg><path d='m0'/> {SHORT}", f"{SAYS} {SHORT}"),
    ("<p>unclosed <b", ""),
    ("<script>never closed " + SAYS, ""),
    (None, ""),
    (" \n", ""),
    ("<article>" + "<div>" * 3000 + "deep " + SAYS, "deep " + SAYS),
    ("<article>" + f"<p>{SAYS}</p>" * 4000 + "</article>", " ".join([SAYS] * 4000)),
]


@pytest.fixture(scope="module")
def tree():
    return html_text.grow(html_text.LABELLED)


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_hand_made_page(tree, k):
    page, want = PAGES[k]
    got = html_text.extract(page, tree)[0]
    assert got == want, (page or "")[:300]


def test_operator_equals_the_pages(spark, tree):
    rows = [(i, "u" if i % 2 else None, page, "e", 1) for i, (page, _) in enumerate(PAGES)] + [(1, "u", PAGES[1][0], None, 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.main_text(frame).collect()
    assert sorted(r.page_id for r in got) == sorted([*range(len(PAGES)), 1])
    for r in got:
        assert (r.text, r.n_chars) == (html_text.extract(PAGES[r.page_id][0], tree)[0], len(r.text))
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_tree_uses_flags_and_own_links(tree):
    def features(tree):
        return {tree[0]} | features(tree[2]) | features(tree[3]) if isinstance(tree, tuple) else set()

    assert {1, 7, 8} <= features(tree)


@pytest.mark.parametrize("page", ["<svg>" * 400_000, "<div></p>" * 300_000, "<li><ul>" + "<div>" * 150_000 + "<li>x</li>" * 150_000])
def test_megabytes_of_odd_tags_take_linear_time(page):
    start = time.process_time()
    html_text.blocks(page)
    assert time.process_time() - start < 20


def test_neighbours_decide_outside_of_articles():
    """Short lines beside long text stay, the same lines among links go; the tree splits on the blocks before and after."""
    tree = html_text.grow(html_text.LABELLED)
    used = lambda t: {t[0]} | used(t[2]) | used(t[3]) if isinstance(t, tuple) else set()
    assert used(tree) & {2, 3, 4, 5}
    blind = html_text.LABELLED.copy()
    blind[:, 2:6] = 0
    blind = html_text.grow(np.asarray(blind))
    page = f"<div class=wrap><h1>Title</h1><p>Short intro.</p><p>{SAYS}</p><p>The end.</p></div>"
    assert html_text.extract(page, tree)[0] == f"Title Short intro. {SAYS} The end." != html_text.extract(page, blind)[0]
    line = "Some nine words that stand among these links here."
    page = f"<div><div>{LINKS}</div><p>{line}</p><div>{LINKS}</div><p>{SAYS}</p><div>{LINKS}</div><p>Short intro.</p><div>{LINKS}</div></div>"
    assert html_text.extract(page, tree)[0] == SAYS
