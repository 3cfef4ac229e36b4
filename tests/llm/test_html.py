"""Main text of hand-made pages, and of the registered table by its own structure."""

from __future__ import annotations

import pytest

from quillon.llm import html

P1 = "The house was old and it stood on the hill that he had seen from the window of his room in the town for as long as he could remember it at all."
P2 = "She said that the river had been there before them and that it would be there with all of its boats when they were gone from the place."
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News &amp; more</a></li></ul></nav>'
FOOT = "<footer>&copy; 2020 the example of all that is in it and on it</footer>"


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>No text</title><style>p{{}}</style><script>var a='<p>x</p>';</script></head><body>{NAV}{body}{FOOT}</body></html>"


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<article><p>{P1}</p><p>{P2}</p></article>", [P1, P2]),
        (f"<article><h1>Short head</h1><p>{P1}</p><p>Yes.</p><p>{P2}</p></article>", ["Short head", P1, "Yes.", P2]),
        (f"<div><p>{P1}</p><p>Yes.</p><p>{P2}</p></div>", [P1, "Yes.", P2]),  # a short block between good ones
        (f"<article><p>{P1}</p><div class='ad'>{P2}</div></article>", [P1]),
        (f"<article><p>{P1}</p></article><section id='comments'><p>{P2}</p></section>", [P1]),
        (f"<aside>{P2}</aside><main><p>{P1}</p></main>", [P1]),
        (f"<div class='cookie-notice'>{P2}</div><article><p>{P1}</p></article>", [P1]),
        (f"<article><p>{P1}</p><form><label>Your name in the field</label><input></form></article>", [P1]),
        (f"<article><h1>Head</h1><div class='share widget'><p>{P1}</p><p>{P2}</p></div></article>", ["Head", P1, P2]),  # a name isn't all
        (f"<article><p>{P1}<p>{P2}</article>", [P1, P2]),  # unclosed paragraphs
        (f"<article><p>{P1[:40]}<b>{P1[40:]}</b></p></article>", [P1]),
        (f"<article><p>{P1}<br>{P2}</p></article>", [P1 + " " + P2]),
        (f"<article><p>\n {P1.replace(' ', chr(10) + ' ')} &nbsp;</p></article>", [P1]),
        (f"<article><p>{P1} &lt;b&gt; &amp;amp; &eacute;&#233;&#xe9;</p></article>", [P1 + " <b> &amp; ééé"]),
        (f"<article><p>{P1}</p><!-- <p>{P2}</p> --></article>", [P1]),
        (f"<article><p>{P1}</p><p style='display:none'>{P2}</p></article>", [P1]),
        (f"<article><p>{P1}</p><p><a href='x'>{P2}</a></p></article>", [P1]),
        (f"<article><p>{P1}</p><ul><li>{P2}</li><li>Also this</li></ul></article>", [P1, P2, "Also this"]),
        (f"<article><p title=\"a > b\">{P1}</p></article>", [P1]),
    ],
)
def test_pages(body, want):
    assert html.main_text(page(body)) == "\n".join(want)


@pytest.mark.parametrize("raw", [None, "", " ", "<", "<<<>>>", "</p></p>", "<p", "<!--", "<script>", "&#0;&#xffffffff;", "<a b='", "\x00", "<p>" * 3000, "</div>" * 3000])
def test_broken_pages_give_some_text(raw):
    assert isinstance(html.main_text(raw), str)


def test_no_elements_at_all():
    assert html.main_text(P1 + " " + P2) == P1 + " " + P2


DIVS = [  # pages without any element, class or role that tells side matter
    f"<div><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News &amp; more of it</a></li></ul></div><div><p>{P1} {P2}</p><p>Yes.</p><p>{P2} {P1}</p></div>",
    f"<div><p>{P1} {P2}</p><div>Buy now</div><p><a href='x'>{P1} {P2}</a></p><p>No.</p></div>",
    "<div><p>Kaufen Angebot Preis Rabatt Lieferung Versand Bestellung Kunde Konto Warenkorb Kasse Zahlung Rechnung Gutschein</p>"
    f"<p><a href='x'>{P1}</a></p><p>Preis</p></div><div><h2>Head</h2><p>{P1} {P2}</p></div>",
    f"<div><p><a href='x'>{P1}</a></p><p>{P1} {P2}</p><p><a href='y'>{P2}</a></p></div>",
]


def test_blocks_are_decided_by_their_text():
    assert html.main_text(DIVS[0]) == f"{P1} {P2}\nYes.\n{P2} {P1}"
    assert html.main_text(DIVS[1]) == f"{P1} {P2}"
    assert html.main_text(DIVS[3]) == f"{P1} {P2}"
    assert html.main_text(DIVS[2]) == f"Head\n{P1} {P2}"


@pytest.mark.parametrize("rule", [("STOP_WORDS", frozenset()), ("LINKS", 2.0), ("SHORT", 0), ("LONG", 10_000)])
def test_every_rule_decides(monkeypatch, rule):
    """Without stop words, the rule of links or those of length, results differ."""
    want = [html.main_text(x) for x in DIVS]
    monkeypatch.setattr(html, *rule)
    assert [html.main_text(x) for x in DIVS] != want


@pytest.mark.parametrize(
    "page", ["<div>" * 100_000 + P1, "<div>" * 50_000 + "</b>" * 50_000, "<div class='ad'>x" * 50_000, "<b>" * 50_000 + "<p>" * 50_000, "<p><b>" * 50_000 + "<h1>x" * 50_000,
             "<li>" * 100_000, "<i>x</b>" * 50_000, "<td><a>x" * 50_000]
)
def test_deep_and_broken_pages_take_linear_time(page):
    import time

    began = time.time()
    html.main_text(page)
    assert time.time() - began < 20


def test_long_pages_take_linear_time():
    import time

    body = f"<article>{f'<p>{P1}</p>' * 20_000}</article>"
    began = time.time()
    assert html.main_text(page(body)).count("\n") == 19_999
    assert time.time() - began < 30


def test_rows(spark):
    rows = [(1, "u", page(f"<article><p>{P1}</p></article>"), 5), (1, "u", page(f"<article><p>{P1}</p></article>"), 5), (None, None, None, 1), (3, "v", "", 1)]
    schema = "page_id long, url string, html string, text int"
    out = html.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.page_id or 0), r.url or "", r.text, r.n_chars) for r in out) == [(0, "", "", 0), (1, "u", P1, len(P1)), (1, "u", P1, len(P1)), (3, "v", "", 0)]
    assert html.extract_text(spark.createDataFrame([], schema)).collect() == []


def test_the_table_holds_articles_and_nothing_else(spark):
    """An independent reading of these pages: the paragraphs and headings inside <article>."""
    import html as h
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    good = total = 0
    for r in html.extract_text(pages).collect():
        m = re.search(r"<article>(.*?)</article>", raw[r.page_id] or "", re.S)
        if not m or re.search(r"<(?!/?(?:p|h1|b|br)\b)", m[1]):
            continue  # pages with more in them are for the tests above
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", m[1])]
        total += 1
        good += r.text == "\n".join(x for x in parts if x)
    assert total and good == total


@pytest.mark.parametrize(
    "between",
    [
        "<svg/>", "<svg class='i' />", '<svg viewBox="0 0 1 1" aria-label="a > b"/>', "<MATH />", "<svg/><svg><text>in a picture</text></svg>",
        "<svg-icon></svg-icon>", "<svg-icon name='x'/>", "<video-player src='a'></video-player>", "<template-x></template-x>", "<math-field></math-field>",
        "<svg width='1'><path d='M0 0'/><text>in a picture</text></svg>", "<script src='a'></script>",
    ],
)
def test_text_after_empty_and_custom_elements(between):
    assert html.main_text(page(f"<article><p>{P1}</p>{between}<p>{P2}</p></article>")).split("\n") == [P1, P2]


@pytest.mark.parametrize("unit", ["<p '>'a", "<p \">x", "<a b='c\">y", "<p ''>'z", "<svg '>'/>q", "<p '<p>'x'", "<b '\"'>", "</p '>'"])
def test_quotes_that_do_not_pair_take_linear_time(unit):
    import time

    began = time.perf_counter()
    html.main_text(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 20


def test_a_page_in_one_form_keeps_its_article():
    prose = "It was the second of the days that he had with them, and they were there for it as she was. " * 4
    page = f"<html><head><title>t</title></head><body><form action='x'><h1>Heading</h1><p>{prose}</p><select><option>one</option></select><p>{prose}</p></form></body></html>"
    assert html.main_text(page) == "\n".join(["Heading", prose.strip(), prose.strip()])
    small = f"<body><h1>Heading</h1><p>{prose}</p><form><p>{prose[:150]}</p><button>Send</button></form></body>"
    assert html.main_text(small) == "\n".join(["Heading", prose.strip()])
