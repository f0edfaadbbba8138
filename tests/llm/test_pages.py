"""Main text of pages built from templates: precision and recall of words, and the cost of odd pages."""

from __future__ import annotations

import random
import resource
import time
from collections import Counter

import pytest

from tests.llm.conftest import prose
from wavecrate.llm import htmltext

WRAPPERS = (
    "<div class='content no-sidebar'>{}</div>",
    "<div class='wrap has-sidebar'>{}</div>",
    "<div class='page sticky-header'>{}</div>",
    "<div class='post social-history'>{}</div>",
    "<div class='layout-related'>{}</div>",
    "<div class='site-content ad-free'>{}</div>",
    "<form id='aspnetForm'><input type=hidden>{}</form>",
    "<div style='display: none'>{}</div>",
    "<div id='main'><div class='row'>{}</div></div>",
    "<table><tr><td>{}</td></tr></table>",
)
ARTICLES = (
    "<article><header class='post-header'><h1>{h}</h1></header>{body}</article>",
    "<main><h1>{h}</h1>{body}</main>",
    "<div class='entry'><div class='entry-header'><h1>{h}</h1></div><div class='intro'>{first}</div><div class='rest'>{rest}</div></div>",
)
FURNITURE = (
    "<nav><ul><li><a href=/>{a}</a><li><a href=/x>{b}</a></ul></nav>",
    "<header><p>{a}</p></header>",
    "<div class='cookie-notice'><p>{a} {b} {a}</p></div>",
    "<div class='sidebar'><p>{a}</p></div>",
    "<div class=ad>{a}</div>",
    "<div id=comments><article class=comment><p>{a} {b}</p></article><article class=comment><p>{b} {a}</p></article></div>",
    "<ul class='comment-list'><li>{a} {b}</li><li>{b} {a} {b}</li></ul>",
    "<form class=search><label>{a}</label><input><button>{b}</button></form>",
    "<div role=alert>{a}</div>",
    "<script>var x = '<p>{a}</p>';</script><style>p {{}}</style>",
    "<footer>{b}</footer>",
)


def pages(n: int) -> list[tuple[str, str, str]]:
    """(host, html, main text)"""
    r = random.Random(5)
    out = []
    for k in range(n):
        wrapper, article = WRAPPERS[k % len(WRAPPERS)], ARTICLES[k // len(WRAPPERS) % len(ARTICLES)]
        paragraphs = [prose(r, r.randint(20, 60)) for _ in range(r.randint(3, 6))]
        title = prose(r, 5)
        held = [f"<p>{p}</p>" for p in paragraphs]
        own = article.format(h=title, body="".join(held), first=held[0], rest="".join(held[1:]))
        around = [f.format(a="menu " + prose(r, 8), b="junk " + prose(r, 12)) for f in r.sample(FURNITURE, 5)]
        inside = wrapper.format(own if k % 2 else own + around.pop())
        out.append((f"h{k % (len(WRAPPERS) * len(ARTICLES))}.example", f"<html><head><title>{title}</title></head><body class='has-sidebar'>{around[0]}{around[1]}{inside}{''.join(around[2:])}</body></html>", " ".join([title, *paragraphs])))
    return out


def agreement(got: str, want: str) -> tuple[int, int, int]:
    a, b = Counter(got.split()), Counter(want.split())
    return sum((a & b).values()), sum(a.values()), sum(b.values())


def test_words_found_and_left_out(spark):
    made = pages(300)
    rows = [(i, f"https://{host}/{i}", page) for i, (host, page, _) in enumerate(made)]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    sums = [sum(x) for x in zip(*(agreement(got[i], want) for i, (_, _, want) in enumerate(made)))]
    precision, recall = sums[0] / sums[1], sums[0] / sums[2]
    print(f"precision {precision:.4f} recall {recall:.4f}")
    assert precision >= 0.98 and recall >= 0.98
    assert not [i for i, (_, _, want) in enumerate(made) if agreement(got[i], want)[0] < 0.9 * len(want.split())]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_lose_nothing(wrapper):
    body = "<article><p>" + "good words " * 30 + "</p></article>"
    assert htmltext.parse("<body>" + wrapper.format(body) + "<div class='comments'><p>" + "bad words " * 50 + "</p></div></body>").text(None) == ("good words " * 30).strip()


def test_siblings_stay_together():
    page = "<body><div class='content'><div class='a'><p>" + "one two " * 40 + "</p></div><div class='b'><p>" + "three four " * 15 + "</p></div></div><div class='x'><p>five</p></div></body>"
    assert len(htmltext.parse(page).text(None).split()) == 110


def test_odd_pages_cost_in_proportion():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    began = time.perf_counter()
    assert htmltext.parse("<div class='abcdefgh'>" * 100_000 + "x").text(None) == "x"
    assert len(htmltext.parse("".join(f"<div class='c{i}'><p>w</p>" for i in range(20_000))).text(None)) >= 1
    assert htmltext.parse("<div><b>" * 30_000 + "</i>" * 100_000 + "x").text(None) == "x"
    htmltext.parse("<dl>" * 30_000 + "<dt>x" * 30_000)
    assert time.perf_counter() - began < 30
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10
