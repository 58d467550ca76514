import random
from itertools import product

import pytest

from tallyhouse.llm.extraction import extract_text, main_text, minimum_cut
from tests.llm.cases import prose

P = prose(1, 30)
PAGES = {
    f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>"
    f"<!-- c --><div class='ad'>Buy {P}</div><article><h1>Head &amp; line</h1><p><b>{P}.<br><p>Short.</p></article>"
    f"<footer>&copy; {P}</footer></body></html>": f"Head & line {P}. Short.",
    f"<header><h1>Site</h1></header><div id='cookie-notice'>We use cookies {P}</div><main><article><h2>T</h2><p>{P}</p><ul><li>one</li><li>two</li></ul>"
    f"<div class=share-buttons>Share</div><form>Mail {P}<input></form></article><section class='comments'><p>{P}</p></section></main>"
    f"<aside class=sidebar><p>{P}</p></aside>": f"T {P} one two",
    f"<div id=page><div class='post-content'><p>{P}</p><p>x\n\t y&nbsp;z</p></div><div class=menu>{P}</div></div>": f"{P} x y z",
    "": "", "<script>if (a < b) c()": "", "<nav><a href=1>One</a></nav>": "",
    f"<article><p>a &lt; b {P} <!-- <p>no</p> --> c<i>d</i>": f"a < b {P} cd",
}


@pytest.mark.parametrize("html", PAGES, ids=range(len(PAGES)))
def test_main_text(html):
    assert main_text(html) == PAGES[html]


WRAPPERS = [
    "<body style='overflow:hidden'><article>{}</article>", "<body class=overflow-hidden><div class='overflow-hidden'><article>{}</article></div>",
    "<article style='overflow-x: hidden; display: block' data-hidden-by=x>{}</article>", "<body class='home has-sidebar menu-fixed'><article>{}</article>",
    "<html class=no-cookies><article class='post comments-open'>{}</article>", "<main class=tags-x><article class='post tags-x'>{}</article></main>",
    "<div class='with-sidebar'><article>{}</article></div>", "<div class=sticky-header><article>{}</article></div>",
    "<div class=sticky-header><article><h1>T</h1>{}</article><aside><article><p>a card</p></article></aside></div>",
    "<div id=header-fixed><main><p>{}</p></main></div>"]


@pytest.mark.parametrize("wrapper", WRAPPERS, ids=range(len(WRAPPERS)))
def test_names_and_styles_of_what_holds_the_article(wrapper):
    assert main_text(wrapper.format(f"<p>{P}</p>")).removeprefix("T ") == P


@pytest.mark.parametrize("rest", ["hidden", "hidden=''", "class=a hidden", "style='color:red; display : none'", "style=visibility:hidden",
                                  "aria-hidden=true", "class=comments", "class='related posts'"])
def test_what_is_hidden_or_named_otherwise_stays_out(rest):
    assert main_text(f"<article><p>{P}</p><div {rest}><article class=comment-body><p>no {P}</p></article></div></article>") == P
    cards = "<article><p>no {0}</p></article><article><p>no {0}</p></article>".format(P)
    assert main_text(f"<body class=has-sidebar><article><h1>T</h1><p>{P}</p></article><section {rest}>{cards}</section>") == "T " + P


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 7)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def price(kept):
            return sum(o for o, k in zip(odds, kept) if o > 0 and not k) - sum(o for o, k in zip(odds, kept) if o < 0 and k) + sum(
                w for a, b, w in edges if kept[a] != kept[b])

        assert price(minimum_cut(odds, edges)) == pytest.approx(min(price(k) for k in product([True, False], repeat=n)))


def test_tables(spark):
    rows = [(i, "u", h, "x") for i, h in enumerate(PAGES)] + [(99, None, None, None), (None, "u", "plain " + P, "x"), (0, "u", next(iter(PAGES)), "x")]
    out = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "text"]
    got = [(r["page_id"], r["text"]) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(i, main_text(h or "")) for i, _, h, _ in rows]))
    assert main_text("<article>" + f"<p>{P}</p>" * 3000 + "</article>").count(P) == 3000
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
