import html
import re
import time

import pytest

from leadlake.llm.html import extract, main_text, marked

PROSE = "This is a long paragraph of an article that has quite some words in it, and goes on for a while."


def page(inside, before="", after=""):
    return (
        '<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>'
        f"<nav><ul><li><a href=x>No menu</a></li></ul></nav>{before}{inside}{after}<footer>No footer &copy;</footer></body></html>"
    )


@pytest.mark.parametrize("noise", [
    "<header><h2>No</h2></header>", "<aside><p>No " + PROSE + "</p></aside>", '<div class="cookie-notice"><p>No ' + PROSE + "</p></div>",
    '<div class="ad">No</div>', "<form><label>No</label><input value=no><button>No</button></form>", "<!-- no -->",
    '<section id="comments"><article><p>No ' + PROSE * 3 + "</p></article></section>", '<div role="navigation">No</div>',
    "<noscript>No</noscript>", '<div style="display: none">No</div>', '<ul class="breadcrumb"><li>No</li></ul>',
])
def test_boilerplate_goes(noise):
    body = f"<article><h1>Title</h1><p>{PROSE}</p><p>Short.</p></article>"
    expected = f"Title\n\n{PROSE}\n\nShort."
    assert main_text(page(body, before=noise)) == expected
    assert main_text(page(body, after=noise)) == expected
    assert main_text(page(f"<article><h1>Title</h1><p>{PROSE}</p>{noise}<p>Short.</p></article>")) == expected


def test_blocks_space_and_references():
    text = page("<article><p>a &amp; b<br>c\n\t d &#233;<b>x</b>y<p>open <i>end</article>")
    assert main_text(text) == "a & b c d éxy\n\nopen end"


def test_page_without_article():
    items = "".join(f"<li><a href=/{i}>Go {i}</a></li>" for i in range(12))
    text = f"<html><body><ul>{items}</ul><div><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p></div><ul>{items}</ul></body></html>"
    assert main_text(text) == f"Title\n\n{PROSE}\n\n{PROSE}\n\nYes.\n\n{PROSE}"


def test_layout_names_do_not_hide_the_page():
    assert main_text(f'<body class="x"><div class="has-sidebar page"><p>{PROSE}</p></div></body>') == PROSE


@pytest.mark.parametrize("text", ["", "<", "<p", "plain words only", "<article>" * 50, "</p></article>", "<script>", "&", "<p>" * 2000 + "x"])
def test_broken_markup(text):
    assert isinstance(main_text(text), str)


def article_of(page):
    article = re.split(r"</article>|<footer>", page.split("<article>")[1])[0]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n\n".join(b for b in blocks if b)


def test_pages_of_the_table(spark, sf):
    rows = extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article_of(pages[r.page_id]) and r.n_chars == len(r.text)


def test_pages_without_their_article_tags(spark):
    """The ratios find the same text where no article element names it."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        expected = article_of(r.html).split("\n\n")
        found = main_text(re.sub(r"(</?)(?:article|main)\b", r"\1div", r.html)).split("\n\n")
        assert set(found) <= set(expected)
        assert sum(map(len, found)) >= 0.98 * sum(map(len, expected)), r.page_id


def test_unmarked_menus_go_by_their_ratio():
    """Menus and a footer in plain divisions, as no name tells."""
    links = "".join(f'<div><a href="/{i}">Go {i}</a></div>' for i in range(8))
    body = f"<div><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p><ul><li>one</li><li>two</li></ul><p>Short.</p></div>"
    page_ = f"<body><div>{links}</div>{body}<div>{links}</div></body>"
    assert main_text(page_) == "\n\n".join(["Title", PROSE, PROSE, "one", "two", "Short."])


def test_nested_and_sibling_regions():
    assert main_text(f"<main><h1>Title</h1><p>Lead</p><article><p>{PROSE}</p><p>{PROSE}</p></article></main>") == f"Title\n\nLead\n\n{PROSE}\n\n{PROSE}"
    two = page(f"<article><h1>T</h1><p>{PROSE * 5}</p></article><article><p>{PROSE}</p></article>")
    assert main_text(two) == f"T\n\n{PROSE * 5}\n\n{PROSE}"
    inside = page(f'<article><div class="entry-header"><h1>Title</h1></div><p class="notice-period">{PROSE}</p><p>{PROSE}</p></article>')
    assert main_text(inside) == f"Title\n\n{PROSE}\n\n{PROSE}"
    assert main_text(f"<body><form action=x><div><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></div><input></form></body>") == f"Title\n\n{PROSE}\n\n{PROSE}"
    assert main_text(page(f"<article><p>{PROSE}</p></article><form>Search the site <input><button>Go</button></form>")) == PROSE
    menu = "<ul>" + "<li><a href=x>Other page</a></li>" * 5 + "</ul>"
    assert main_text(page(f"<article><p>{PROSE}</p>{menu}<p>{PROSE}</p></article>")) == f"{PROSE}\n\n{PROSE}"


def test_names():
    assert all(map(marked, ("ad", "cookie-notice", "site-footer", "page_header", "comments", "post-comments", "nav-menu", "left-sidebar")))
    assert not any(map(marked, ("entry-header", "notice-period", "has-sidebar", "content", "article-footer", "radar", "search-results", "", "-")))


@pytest.mark.parametrize("made", [
    lambda n: "<i>" * n + "</b>" * n, lambda n: "<b><div>" + "<i>" * n + "</b>" * n, lambda n: "<article>" * n + "x", lambda n: "<div><p>" * n + "</i>" * n,
    lambda n: "".join(f"<article><p>{i} words</p></article>" for i in range(n)), lambda n: "<ul><li>" * n, lambda n: "<p>" * n + "</p>" * n,
])
def test_time_is_linear(made):
    def seconds(n):
        text, started = made(n), time.process_time()
        main_text(text)
        return time.process_time() - started

    assert seconds(40_000) < 0.5 + 9 * seconds(8_000)


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", page(f"<article><p>{PROSE}</p></article>")), (2, "u", None), (3, "u", "<p>" + "word " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = extract(pages).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == sorted([("1", 0), ("None", 0), ("2", len(PROSE)), ("2", 0), ("3", 499_999)])
    assert extract(pages.limit(0)).count() == 0
