import html as entities
import re

import pytest

from casegate.llm.html import extract, main_text
from casegate.llm.queries import op10_html
from tests.llm.helpers import SF

TEXT = "A long paragraph, with commas, about something that readers want, and then some more of it. " * 3
PLAIN = " ".join(TEXT.split())


def plain(page):
    """The test pages' main text: what stands in their article."""
    inner = re.search("<article>(.*?)(?:</article>|$)", page, re.S)
    if not inner:
        return ""
    text = re.sub("<[a-z/][^>]*(?:>|$)|<!--.*?-->|</?$", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner[1], flags=re.S)
    return " ".join(entities.unescape(text).split())


def test_query_matches_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op10_html(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id].html), r.page_id
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, ""), ("", ""), ("   \n", ""), ("<html><body></body></html>", ""), ("just text", "just text"),
        ("<p>one<p>two &amp; th<b>r</b>ee<br>four&nbsp;five", "one two & three four five"),
        (f"<body><div class=menu><a href=x>Home</a></div><div id=c><h1>T</h1><p>{TEXT}</p><p>Short.</p></div><div class='side-bar sidebar'>{TEXT}</div></body>", f"T {PLAIN} Short."),
        (f"<article><header><h1>T</h1></header><p>{TEXT}<section id=comments><p>{TEXT}</p></section></article><footer>{TEXT}</footer>", f"T {PLAIN}"),
        (f"<main><div><p>{TEXT}</p></div><div><p>x, y</p></div><form><p>{TEXT}</p></form></main><div class=cookie-notice><p>{TEXT}</p></div>", f"{PLAIN} x, y"),
        (f"<div><p>{TEXT}<script>if (a<b) '</p>'</script> end</div><ul><li><a href=/>{TEXT}</a></ul>", f"{PLAIN} end"),
        (f"<table><tr><td>a<td>{TEXT}<tr><td>b</table>", f"a {PLAIN} b"),
        ("<article><p>cut &am", "cut &am"), ("<article><p>cut <a href=\"x", "cut"), ("<article>1 < 2 and 3 > 2</artic", "1 < 2 and 3 > 2"),
        ("<article><p>a<!-- <p>no</p> -->b</p><p hidden>c</p></article>", "ab"),
        (f"<body class='has-sidebar comments-open'><div class='main-content'><p>{TEXT}</p></div></body>", PLAIN),
    ],
)
def test_pages(page, expected):
    assert main_text(page) == expected


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f"<div><p class=\"a\"\">{TEXT}</p><p class=b>end, of it</p></div>", f"{PLAIN} end, of it"),
        (f"<div><p title=Don't>{TEXT}</p><p class='b'>end, of it</p></div>", f"{PLAIN} end, of it"),
        (f"<div><p 'x>{TEXT}</p><p class=b>end, of it</p></div>", f"{PLAIN} end, of it"),
        (f"<div><p =\"x>{TEXT}</p><p lang=a\"b=\"c>end, of it</p></div>", f"{PLAIN} end, of it"),
        (f"<div><p title = 'a > \"b'id=c title=\"it's > x\"data-x=y/>{TEXT}</p><p lang=>end, of it</p></div>", f"{PLAIN} end, of it"),
    ],
)
def test_quotes_hold_values_alone(page, expected):
    assert main_text(page) == expected


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f"<html><head><title>T</title><meta charset=utf-8><body><div><p>{TEXT}</p></div></body></html>", PLAIN),
        (f"<head>\n<title>T</title>\n<!-- c -->\n<script src=x /><link href=y>\n<div><p>{TEXT}</p></div>", PLAIN),
        (f"<!doctype html><html><head><title>T</title>\n<h1>One</h1><p>{TEXT}", f"One {PLAIN}"),
        ("<head><title>T</title>one<b>two", "onetwo"), ("<head><head><title>T</title></head>one", "one"),
        (f"<head><style>p {{}}</style><svg><p>no</p></svg><main><p>{TEXT}</p></main>", PLAIN),
        ("<html><head><title>T</title></head><body>one</body></html>", "one"), ("<head> <title>T</title> </html>", ""),
    ],
)
def test_heads_without_an_end_tag(page, expected):
    assert main_text(page) == expected


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f"<body><article class='post comments-open'><h1>T</h1><p>{TEXT}</p></article></body>", f"T {PLAIN}"),
        (f"<body><div id=content class=with-ads><p>{TEXT}</p></div><div class=ads>{TEXT}</div></body>", PLAIN),
        (f"<body><form id=aspnetForm><input name=q><label>Find</label><div class=main-menu>Home</div><article><p>{TEXT}</p></article><select><option>a</select></form></body>", PLAIN),
        (f"<body><form><div id=wrap><h1>T</h1><p>{TEXT}</p></div><button>Go</button></form></body>", f"T {PLAIN}"),
        (f"<main><div class=main-menu>Home page About us</div><p>{TEXT}</p><div class=page-footer>Imprint</div><div class=content-sidebar>x</div></main>", PLAIN),
        (f"<body><div class=page-header>Site</div><div><p>{TEXT}</p></div></body>", PLAIN),
        (f"<main><div class=entry-header><h1>T</h1></div><p>{TEXT}</p></main>", f"T {PLAIN}"),
        (f"<article><p>{TEXT}<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> end</p></article>", f"{PLAIN} x=2 end"),
        (f"<body><script src=//cdn/>code()</script><div><p>{TEXT}</p></div><script src=/b/>more()</script></body>", PLAIN),
        (f"<body><div><p>{TEXT}</p></div><div class=comments-area><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div></body>", PLAIN),
        (f"<article><p>{TEXT}</p><article class=comment><p>{TEXT}</p></article></article>", PLAIN),
        (f"<body><div class='page-with-widgets sidebar-layout'><p>{TEXT}</p></div><div class=sidebar><p>x, y</p></div></body>", PLAIN),
    ],
)
def test_parts_are_told_from_states_and_wrappers(page, expected):
    assert main_text(page) == expected


def test_very_long_and_deep_pages():
    assert main_text("<div>" * 30_000 + "x" + "</div>" * 30_000) == "x"
    assert main_text("<p><b><i>" * 30_000 + "y") == "y"
    assert len(main_text("<article>" + "<p>word, word</p>" * 50_000 + "</article>")) == 50_000 * 11 - 1
    assert main_text("<" * 100_000).startswith("<")


def test_edge_rows(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, id string")
    got = extract(pages).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)], key=str)
    assert extract(pages.limit(0)).count() == 0
