from __future__ import annotations

import html as entities
import re

import numpy as np
import pytest

from civicflow.llm.html_extraction import extract, main_text, smooth
from tests.llm.conftest import SF


def by_hand(page: str) -> str:
    """The blocks of pages of the given shape, cut by patterns instead of a parser."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", article)
    plain = (entities.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")) for b in blocks)
    return "\n".join(t for t in (" ".join(b.split()) for b in plain) if t)


def test_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: (r.url, by_hand(r.html), len(by_hand(r.html))) for r in pages.collect()}
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in extract(pages).collect()} == want


LONG = "Enough words to make a paragraph that stands out from what is around it."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("only text", "only text"),
        ("<p>a<br>b&nbsp;&#99; &eacute;<p>d", "a b c é\nd"),
        ("<body><nav>menu</nav></body>", ""),
        (f"<header>Site</header><article><header><h1>T</h1></header><p>{LONG}</p><footer>by</footer></article>", f"T\n{LONG}"),
        (f"<div class='cookie-notice'>We use cookies {LONG}</div><main><p>{LONG}<p>Be.</main><aside>{LONG}</aside>", f"{LONG}\nBe."),
        (f"<article><p>{LONG}</p><form><label>Mail</label></form></article><div id='comments'><article>{LONG} no</article></div>", LONG),
        (f"<article><p>{LONG}</p><div class='comment'>{LONG}</div><p>End</p></article>", f"{LONG}\nEnd"),
        (f"<div class='ad'>Buy<article><p>{LONG}</p></article>", LONG),
        (f"<div><div class='menu'>a</div><div><p>{LONG}</p><p>x</p><p>{LONG}</p></div></div><div class='footer'>f</div>", f"{LONG}\nx\n{LONG}"),
        (f"<article><p>{LONG}<script>var a='<p>no</p>'</script><style>p{{}}</style><!-- no --></p></article>", LONG),
        (f"<article><ul><li>one<li>two</ul><table><tr><td>c<td>d</table>{LONG}</article>", f"one\ntwo\nc\nd\n{LONG}"),
        (f"<article><p>{LONG}", LONG),
        (f"<div class='layout with-sidebar'><p>{LONG}</p><p>{LONG}</p><div class='sidebar'>no</div></div>", f"{LONG}\n{LONG}"),
        (f"<main class='sidebar-left'><p>{LONG}</p></main><article class='related'>{LONG} {LONG}</article>", LONG),
        (f"<p>{LONG} <span class='ad'>buy</span> on</p><div role='navigation'>x</div>", f"{LONG} on"),
    ],
)
def test_shapes(page, text):
    assert main_text(page) == text


SECTIONS = "".join(f"<section><h2>Part {k}</h2><p>{LONG}</p><p>Short.</p></section>" for k in range(3))
ITEMS = "".join(f"<li>{k} {LONG}</li>" for k in range(4))
CELLS = "".join(f"<tr><td>{k}</td><td>{LONG}</td></tr>" for k in range(3))
IN_SECTIONS = "\n".join(f"Part {k}\n{LONG}\nShort." for k in range(3))
IN_ITEMS = "\n".join(f"{k} {LONG}" for k in range(4))
IN_CELLS = "\n".join(f"{k}\n{LONG}" for k in range(3))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><body><div>Site</div><div id=content>{SECTIONS}</div><div>end</div></body></html>", IN_SECTIONS),
        (f"<body><div>Site</div>{SECTIONS}<div>end</div></body>", IN_SECTIONS),
        (f"<body><ul>{ITEMS}<li>last</li></ul></body>", f"{IN_ITEMS}\nlast"),
        (f"<body><div>Site</div><div><table>{CELLS}</table></div></body>", IN_CELLS),
        (f"<body><h1>Title</h1><p>{LONG}</p><section><p>{LONG} {LONG}</p></section><p>The end.</p></body>", f"Title\n{LONG}\n{LONG} {LONG}\nThe end."),
        (f"<body><blockquote>{LONG * 9}</blockquote><blockquote>{LONG}</blockquote></body>", f"{LONG * 9}\n{LONG}"),
        (f"<body><section><p>{LONG * 9}</p></section><section><p>Two.</p></section></body>", f"{LONG * 9}\nTwo."),
        (f"<article><p>{LONG}</p></article><article><h2>Two</h2><p>{LONG} {LONG}</p></article>", f"{LONG}\nTwo\n{LONG} {LONG}"),
        (f"<body><div><p>{LONG * 5}</p><p>{LONG * 5}</p></div><article>Teaser</article></body>", f"{LONG * 5}\n{LONG * 5}\nTeaser"),
    ],
)
def test_text_across_boxes(page, text):
    assert main_text(page) == text


LINKS = "".join(f"<li><a href=/{k}>Another story {k}</a></li>" for k in range(6))
LINKED = "\n".join(f"Another story {k}" for k in range(6))
ROWS = "".join(f"<tr><td><a href=/{k}>Land {k}</a><td><a href=/t{k}>Town {k}</a><td>{k}</tr>" for k in range(3))
IN_ROWS = "\n".join(f"Land {k}\nTown {k}\n{k}" for k in range(3))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>{LONG * 3}</p><ul>{LINKS}</ul><p>{LONG * 3}</p><p>End.</p></article>", f"{LONG * 3}\n{LONG * 3}\nEnd."),
        (f"<main><div><a href=/>Home</a> | <a href=/a>About</a> | <a href=/b>Mail</a></div><h1>T</h1><p>{LONG * 3}</p></main>", f"T\n{LONG * 3}"),
        (f"<body><div><p>{LONG * 3}</p><div>{LINKS}</div><p>{LONG * 3}</p></div></body>", f"{LONG * 3}\n{LONG * 3}"),
        (f"<article><p>{LONG * 3} <a href=/>here</a></p><h2><a href=/x>Part</a></h2><p><a href=/y>All of a line</a></p></article>", f"{LONG * 3} here\nPart\nAll of a line"),
        (f"<article><p>{LONG}</p><table>{ROWS}</table></article>", f"{LONG}\n{IN_ROWS}"),
        (f"<main><h1>Links</h1><ul>{LINKS}</ul></main><div>{LONG}</div>", f"Links\n{LINKED}\n{LONG}"),
        (f"<article><p><a href=/>{LONG * 3}<p>{LONG * 3}<p>{LONG * 3}</article>", f"{LONG * 3}\n{LONG * 3}\n{LONG * 3}"),
    ],
)
def test_ratios_decide_on_lists_of_links(page, text):
    assert main_text(page) == text


def test_the_threshold_takes_part_within_an_article():
    page = f"<article><p>{LONG * 3}</p><ul>{LINKS}</ul><p>{LONG * 3}</p></article>"
    assert main_text(page, 1.0) == f"{LONG * 3}\n{LONG * 3}" != main_text(page, 40.0)


@pytest.mark.parametrize(
    "part",
    [
        "<section id=discussion><p>{}</p></section>",
        "<h2 id=related-work>{}</h2>",
        "<h2 class=notice>{}</h2>",
        "<p class=notice>{}</p>",
        "<div id=search-results-explained><p>{}</p></div>",
        "<h2 id=social-impact>{}</h2>",
        "<h2 id=copyright-law>{}</h2>",
        "<div class=subscription-economics>{}</div>",
        "<div class=widget><div class=notice>{}</div></div>",
        "<p>{} <math><mi>x</mi><annotation encoding=tex>no</annotation></math></p>",
        "<p><label>{}</label></p>",
        "<article id=comment-on-the-law><p>{}</p></article>",
    ],
)
def test_names_do_not_drop_content_of_an_article(part):
    within = LONG + (" x" if "math" in part else "")
    page = f"<article><p>{LONG}</p>{part.format(LONG)}<p>{LONG}</p></article>"
    assert main_text(page) == f"{LONG}\n{within}\n{LONG}"


@pytest.mark.parametrize(
    "part",
    [
        "<div class='related posts'><a href=/>{0}</a></div>",
        "<div class=share-buttons>Tell others</div>",
        "<div id=newsletter>Mail</div>",
        "<div class=widget><p>Tags</p><div class=social-links><a href=/>{0}</a></div></div>",
        "<div class=sponsored>{0}</div>",
        "<div class=comment-list>{0}</div>",
        "<section id=comments>{0}</section>",
        "<div role=navigation>{0}</div>",
        "<article id=comment-12>{0}</article>",
    ],
)
def test_names_with_a_low_ratio_or_links_drop(part):
    assert main_text(f"<main><p>{LONG * 3}</p>{part.format(LONG)}<p>{LONG * 3}</p></main>") == f"{LONG * 3}\n{LONG * 3}"


def test_slugs_of_pages_without_an_article():
    page = f"<body><div><section id=discussion><h2 id=related-work>{LONG}</h2><p>{LONG}</p></section></div></body>"
    assert main_text(page) == f"{LONG}\n{LONG}"
    assert main_text(f"<main><div class=notice>{LONG}</div></main>") == LONG


def test_deep_boxes():
    assert main_text("<div>" * 20000 + LONG + "<div>x" * 20000) == "\n".join([LONG] + ["x"] * 20000)


def test_odd_pages(spark):
    rows = [(1, None, None), (1, "u", "<p>a"), (None, "", ""), (3, "u", "<" * 3000), (4, "u", "<b>" * 20000 + "x")]
    rows += [(5, "u", "<article>" + f"<p>{LONG}" * 20000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'t' AS text", "1 AS n_chars")
    got = {(r.page_id, r.url): r.n_chars for r in extract(df).collect()}
    assert got[1, None] == 0 and got[1, "u"] == 1 and got[4, "u"] == 1 and got[5, "u"] == 20000 * (len(LONG) + 1) - 1
    assert extract(df.limit(0)).collect() == []


def test_smoothing_keeps_the_mean_of_a_flat_row():
    assert np.allclose(smooth(np.full(9, 3.0), 1.0), 3.0) and np.allclose(smooth(np.array([2.0]), 1.0), 2.0)
