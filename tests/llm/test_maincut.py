"""Main text: the cut against enumeration, the parser on broken markup, pages of several layouts."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tracewright.llm import dom, maincut

PARAS = [
    "The committee met on Tuesday to discuss the new bridge, which has been planned for several years and still has no budget.",
    "Engineers said that the old one would last another decade; others in the town were less sure about it.",
    "Short one.",
    "“We have waited long enough,” the mayor said & left the room without taking any further questions from the press.",
]
BODY = "".join(f"<p>{p.replace('&', '&amp;')}</p>" for p in PARAS)
WANT = "\n\n".join(PARAS)
MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a><li><a href='/c'>Sports</a></ul>"
COMMENT = "<p>I fully agree with the mayor here, this bridge has been an embarrassment for years and years.</p><p>Reply</p>"

LAYOUTS = {
    "semantic": f"<header><h1>Site name</h1>{MENU}</header><main><article>{BODY}</article></main><aside><h2>Most read</h2><p>Another story with a long teaser text, which goes on and on.</p></aside><footer>&copy; 2020 The Paper. All rights reserved.</footer>",
    "classes": f"<div id='top-nav'>{MENU}</div><div class='cookie-notice'><p>We use cookies to improve your experience. Read our policy to learn more about that.</p></div><div class='post-content'>{BODY}</div><div class='comments'>{COMMENT * 3}</div><div class=footer>Imprint</div>",
    "nested comments": f"<article>{BODY}<section id=comments><article><p>First! I have waited for this article for years, thank you so much for it.</p></article><article>{COMMENT}</article></section></article>",
    "one form": f"<form id=aspnetForm><div class=menu>{MENU}</div><article>{BODY}</article><form class=newsletter>Your mail <input name=mail><button>Subscribe</button></form></form>",
    "soup": f"<div>{MENU}</div><div><div>{BODY}</div></div><div><a href=x>About</a> <a href=y>Contact</a> <a href=z>Terms of use</a></div>",
    "capitals": f"<DIV ID=NAVIGATION>{MENU.upper()}</DIV><DIV CLASS='Article Body'>{BODY.replace('<p>', '<P>').replace('</p>', '')}</DIV><DIV CLASS=adBox>Buy now! You will not regret it, we promise.</DIV>",
    "hidden": f"<div hidden><p>You should not see this sentence, which is hidden.</p></div><article>{BODY}<div style='display: none'>Nor this one, of course.</div></article><noscript>Please enable JavaScript to see everything.</noscript>",
    "inside": f"<article><nav>{MENU}</nav>{BODY}<div class='share-buttons'><a>Tweet</a> <a>Mail</a></div><aside class=related><p>Related: a very long teaser of another story, with commas, and more.</p></aside></article>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page = f"<!DOCTYPE html><html><head><title>x</title><style>p {{}}</style></head><body class='has-sidebar'><script>var a = '<p>no</p>'</script>{LAYOUTS[name]}</body></html>"
    assert "\n\n".join(maincut.content(page, maincut.PRIOR)) == WANT


def texts(source):
    return [b.text for b in dom.parse(source).blocks]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", []),
        ("plain &lt;text&gt;\n  and&nbsp;more", ["plain <text> and more"]),
        ("<p>a<p>b</div></p>c", ["a", "b", "c"]),
        ("<p><b>a<br>b<p>c</b> d", ["a b", "c d"]),
        ("<a title='x > y' href=\"<p>\">l</a>ink", ["link"]),
        ("<script>if (a </p> b) {}</script>x<style>y", ["x"]),
        ("<!-- <p>no</p> --><p>yes<!-- -->!</p><!-- open", ["yes!"]),
        ("a < b <3 &amp &am &#65;&#x42;", ["a < b <3 & &am AB"]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<select><option>a</select><textarea><p>b</textarea>c<svg><text>d</text></svg>", ["c"]),
        ("<head><title>t</title><body>x", ["x"]),
        ("<head><meta charset=x><p>x", ["x"]),
        ("x<p", ["x"]),
        ("e<i>m</i>ph", ["emph"]),
    ],
)
def test_parser(source, want):
    assert texts(source) == want


def test_deep_and_long_pages():
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000
    assert maincut.content(f"<article>{deep}</article>", maincut.PRIOR) == ["x"]
    assert texts("<a " * 200_000) == [] and texts("<" * 200_000) == ["<" * 200_000]
    many = f"<div>{BODY * 5000}</div>"
    assert len(maincut.content(many, maincut.PRIOR)) == 5000 * len(PARAS)


def energy(x, gain, edges):
    return sum(abs(g) for v, g in zip(x, gain, strict=True) if v != (g >= 0)) + sum(w for a, b, w in edges if x[a] != x[b])


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_the_least(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 11)
    gain = [rng.randrange(-9, 10) for _ in range(n)]
    edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(9)) for _ in range(rng.randrange(3 * n))]
    got = maincut.min_cut(gain, edges)
    assert energy(got, gain, edges) == min(energy(x, gain, edges) for x in itertools.product([False, True], repeat=n))


def test_flow_on_a_large_grid():
    """Few nodes settle at once here, so that the flow has work; no single flip and no block of flips is better."""
    rng = random.Random(1)
    side = 40
    gain = [rng.randrange(-6, 7) for _ in range(side * side)]
    edges = [(v, v + 1, 3) for v in range(side * side) if (v + 1) % side] + [(v, v + side, 3) for v in range(side * (side - 1))]
    got = maincut.min_cut(gain, edges)
    least = energy(got, gain, edges)
    for _ in range(3000):
        x = got[:]
        r, c, h, w = rng.randrange(side), rng.randrange(side), rng.randrange(1, 6), rng.randrange(1, 6)
        for a in range(r, min(side, r + h)):
            for b in range(c, min(side, c + w)):
                x[a * side + b] = not x[a * side + b]
        assert energy(x, gain, edges) >= least


def test_smoothing_decides():
    """A short line between paragraphs stays; the same line among links goes."""
    page = f"<div><p>{PARAS[0]}</p><p>Ok</p><p>{PARAS[1]}</p></div><div><div><a>One</a></div><div>Ok</div><div><a>Two</a></div></div>"
    assert maincut.content(page, maincut.PRIOR) == [PARAS[0], "Ok", PARAS[1]]


def test_fit_follows_labels_and_falls_back():
    assert (maincut.fitted([]) == maincut.PRIOR).all()
    good, bad = (5, 0, 1, 0), (1, 4, 0, 3)
    w = maincut.fitted([(good, 900, 10), (bad, 5, 800)])
    assert w @ maincut.features(*good) > 1 and w @ maincut.features(*bad) < -3
    assert np.isfinite(w).all()


def test_odd_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "v", LAYOUTS["semantic"]), (2, "v", LAYOUTS["semantic"]), (3, None, "<p>"), (4, "w", " \n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "h", "n_chars", "a", "n")})
    got = sorted(str(tuple(r)) for r in maincut.extracted(pages).collect())
    assert got == sorted(map(str, [(1, "u", ""), (None, None, ""), (2, "v", WANT), (2, "v", WANT), (3, None, ""), (4, "w", "")]))
    assert maincut.extracted(pages.limit(0)).count() == 0


def test_sql(spark, agree):
    assert agree(maincut.op13_main_text(spark, str(TESTDATA / "sf0.001")), maincut.SQL, TESTDATA / "sf0.001") == 50
