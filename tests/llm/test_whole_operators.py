"""Cases in which an operator did less than its whole job."""

import random
import time

import pytest

from firnline.llm import html_extract, line_dedup

PROSE = "This is a long paragraph of prose, with commas, and enough characters to be taken as the text of an article, I think."


@pytest.mark.parametrize("name", ["content has-sidebar", "no-ads", "page-with-widget", "hasSidebar", "widget", "main-header"])
def test_a_named_wrapper_does_not_lose_the_article(name):
    html = f'<div class="menu"><a>aa</a></div><div class="{name}"><h1>T</h1><p>{PROSE}</p><p>short</p><div class="comments"><p>{PROSE}</p></div></div><div class="ad"><p>{PROSE[:60]}</p></div>'
    assert html_extract.main_text(html) == f"T {PROSE} short"


def test_named_passages_of_an_article_stay():
    html = f"<article><p>{PROSE}</p><section id='related-work'><h2>R</h2><p>{PROSE}</p></section><p class='notice'>Mind the gap.</p><div class='related'><p>{PROSE}</p></div><div class='social'><a>Share this with all</a></div></article>"
    assert html_extract.main_text(html) == f"{PROSE} R {PROSE} Mind the gap."


def test_short_parts_between_kept_ones_stay():
    html = f"<body><div><p>{PROSE}</p><p>{PROSE}</p></div><p>Short.</p><ul><li>one<li>two</ul>bare<ul><li><a>link</a></ul><table><tr><td>1</table><div><p>{PROSE}</p><p>{PROSE}</p></div><p>{PROSE}</p>"
    assert html_extract.main_text(html).split(PROSE)[2].strip() == "Short. one two bare 1"


@pytest.mark.parametrize(
    "html,text",
    [
        ("<p>x</p><![foo[y]]>", "x"), ("<![>", ""), ("<![ x", ""), ("<![CDATA[a]]><p>b", "b"), ("<!ELEMENT x>y", "y"), ("<!x", ""), ("<!-->a<p>b", "a b"), ("<!--->a", "a"), ("<!-- - --!>a", "a"),
        ("<p>a</p><!--x", "a"), ("<p>a</p><p class='", "a"), ("<p>a</p", "a"), ("<p>a<?php echo", "a"), ("<p>a<script>b", "a"), ("a &amp b &#", "a & b &#"), ("<", "<"), ("</", ""), ("</>", ""),
        (f"<form><div><p>{PROSE}</p><p>{PROSE}</p></div></form>", f"{PROSE} {PROSE}"), (f"<form role='form'><article><p>{PROSE}</p></article></form>", PROSE),
        (f"<div><p>{PROSE}</p><form><p>Write to us, with your name, and we will answer.</p><button>Send</button></form></div>", PROSE),
        (f'<div class="social-science article"><p>{PROSE}</p></div>', PROSE), (f'<body><div class="menu"><a>n</a></div><div class="sidebar-left main-content"><p>{PROSE}</p></div>', PROSE),
        (f"<article><p>Let <math><mi>x</mi></math> be, and press <button>OK</button> now. {PROSE}</p></article>", f"Let x be, and press OK now. {PROSE}"),
    ],
)
def test_awkward_markup(html, text):
    assert html_extract.main_text(html) == text


def test_any_markup_is_read():
    rng = random.Random(13)
    parts = ["<", ">", "</", "<!", "<![", "]]>", "<!--", "--", "-->", "<?", "?>", "&", "&#x", ";", "'", '"', "=", " ", "/", "\n", "\0", "p", "div", "a href", "article", "script", "b", "form", "table", "tr", "td", "li", "ul", "CDATA[", "DOCTYPE", "text, and more of it", "\u2028", "漢"]
    for _ in range(3000):
        html = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert isinstance(html_extract.main_text(html), str)
        html_extract.main_text(f"<article><p>{PROSE}</p>{html}")


@pytest.mark.parametrize("unit", ["<div>", "<div class='menu'>", "<b><hr>", "<p>", "<li><article>", "<a>", "<p><button><b>", "<div><p>x, y</p>", "<form>", "<!", "<a b='", "<table><td>"])
def test_time_grows_with_the_page(unit):
    """A hundred thousand tags that are left open take seconds, not hours."""
    start = time.process_time()
    html_extract.main_text(unit * (100_000 // max(1, unit.count("<"))) + PROSE)
    assert time.process_time() - start < 20


def test_short_lines_are_near_within_one_edit(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(9, 27))).replace(" ", "_") for _ in range(14)]
    lines = ["Read more about it", "Read more about it."]
    for _ in range(150):
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(x))
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "Y"])
        lines.append("".join(x))
    first = {x: lines.index(x) for x in lines}
    most = lambda x, y: 2 if min(len(x), len(y)) >= 24 else 1 if min(len(x), len(y)) >= 12 else 0
    near = {max(x, y, key=first.get) for x in first for y in first if x != y and line_dedup.edit_distance_within(x, y, most(x, y)) <= most(x, y)}
    assert "Read more about it." in near
    got = {r.doc_id: (r.n_exact, r.n_near) for r in line_dedup.line_report(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {i: (int(first[x] != i), int(first[x] == i and x in near)) for i, x in enumerate(lines)}


@pytest.mark.parametrize("tag", "fieldset aside dialog menu map object audio video canvas nav footer form".split())
def test_an_element_that_holds_the_whole_article_is_read(tag):
    """It is left out beside an article, and kept where its prose is the page's."""
    assert html_extract.main_text(f"<body><{tag}><p>{PROSE}</p><p>{PROSE}</p></{tag}></body>") == f"{PROSE} {PROSE}"
    assert html_extract.main_text(f"<body><div><p>{PROSE}</p><p>{PROSE}</p></div><{tag}><p>{PROSE}</p></{tag}></body>") == f"{PROSE} {PROSE}"
    assert html_extract.main_text(f"<body><article><p>{PROSE}</p></article><{tag}><p>{PROSE}</p><p>{PROSE}</p></{tag}></body>") == PROSE
