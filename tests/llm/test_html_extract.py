"""Pages by hand, the given pages against their article element, and the cut against all labellings."""

import itertools
import random
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vulnsift.llm import html_extract as H
from vulnsift.llm.queries import QUERIES

P1 = "The first paragraph is long enough to be read as running text, with commas, and a full stop."
P2 = "Another paragraph follows it and also has quite a number of words in it, as articles have."

PAGES = {
    "plain article": (f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{P1}<p>Be.<p>{P2}</article>"
                      "<footer>&copy; us</footer>", f"Title\n{P1}\nBe.\n{P2}"),
    "divs only": (f"<div class=menu><a href=a>One</a> <a href=b>Two</a></div><div id=main><p>{P1}</p><p>Yes.</p><p>{P2}</p></div>"
                  "<div class='sidebar'><p>Read also this other text, which is long enough for a sentence.</p></div>"
                  "<div class=cookie-notice>We use cookies to give you the best service, as you may know.</div>",
                  f"{P1}\nYes.\n{P2}"),
    "comments": (f"<main><article><p>{P1}</p></article><section id='comments'><div class=comment><p>I liked this text "
                 "very much, thank you for writing it, dear author.</p></div></section></main>", P1),
    "inside the article": (f"<article><p>{P1}</p><aside>See more of these texts in our archive, they are good.</aside>"
                           f"<div class=ad>Buy this now, it is cheap and it is good, believe us.</div>"
                           f"<form><label>Mail</label><input><button>Go</button></form><p>{P2}</p></article>", f"{P1}\n{P2}"),
    "wrapper named after its sidebar": (f"<div class='with-sidebar'><article><p>{P1}</p></article><div class=sidebar>"
                                        "<p>Short text.</p></div></div>", P1),
    "page header": (f"<header><h1>Site name</h1></header><article><header><h1>Title</h1></header><p>{P1}</p></article>",
                    f"Title\n{P1}"),
    "references and white space": (f"<article><p>a&nbsp;&amp;&#233;&lt;b&gt;\n\t c<br>d &amp;amp; {P1}</p></article>",
                                   f"a &é<b> c d &amp; {P1}"),
    "markup": (f"<!-- <p>no</p> --><script>var t='</p>';if(a<b)x()</script><style>p{{}}</style><article><p title='a>b'>{P1}</p>"
               "<!-- open", P1),
    "lists": (f"<article><p>{P1}</p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", f"{P1}\none\ntwo\nx\ny"),
    "unclosed": (f"<article><p><b>{P1}<br><p>{P2}", f"{P1}\n{P2}"),
    "less-than in text": (f"<article><p>1 < 2 and {P1}</p></article>", f"1 < 2 and {P1}"),
    "nothing": ("", ""), "null": (None, ""), "menu only": ("<nav><a href=/>Home</a></nav>", ""),
    "hidden": (f"<article><p hidden>No.</p><p style='display: none'>No.</p><p>{P1}</p></article>", P1),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_by_hand(name):
    html, want = PAGES[name]
    assert H.extract(html) == want


def test_given_pages_equal_their_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = QUERIES["op3_html_extract"](spark, SF_SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = [" ".join(unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in want if x)
        assert r.n_chars == len(r.text)


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 8)
        scores = [rng.randint(-9, 9) for _ in range(n)]
        ties = [(a, b, rng.randint(1, 9)) for a, b in itertools.combinations(range(n), 2) if rng.random() < .4]

        def cost(keep):
            return sum(abs(s) for s, k in zip(scores, keep) if (s > 0) != k and s) + sum(w for a, b, w in ties if keep[a] != keep[b])

        got = H.min_cut(scores, ties)
        best = min(cost(k) for k in itertools.product([True, False], repeat=n))
        assert cost(got) == best
        assert sum(got) == max(sum(k) for k in itertools.product([True, False], repeat=n) if cost(k) == best)


def test_smoothing_decides_weak_blocks():
    bs = H.blocks(f"<div><p>{P1}</p><p>Be</p><p>{P2}</p></div><div><div><p>Be</p></div></div>")
    alone = [H.score(b) > 0 for b in bs]
    assert alone == [True, False, True, False]
    assert H.min_cut([H.score(b) for b in bs], H.edges(bs)) == [True, True, True, False]


def test_large_pages_and_table_cases(spark):
    page = "<article>" + f"<p>{P1}</p><p>x</p>" * 5000 + "</article>" + "<div class=ad>Buy</div>" * 5000
    assert len(H.extract(page).split("\n")) == 10000
    assert H.extract("<p>" * 20000) == "" and H.extract("<div>" * 3000 + P1) == P1 and H.extract("<" * 5000).startswith("<") in (True, False)
    rows = [(1, None, None, "t"), (1, "u", "<article><p>" + P1, "t"), (1, "u", "<article><p>" + P1, "t"), (None, "", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.n_chars, r.text) for r in H.extract_pages(df).collect())
    assert got == [(0, 0, ""), (1, 0, ""), (1, len(P1), P1), (1, len(P1), P1)]
    assert H.extract_pages(df.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("html,want", [
    (f"<body><form action=/ method=post><nav><a href=/>Home</a></nav><article><p>{P1}</p></article></form>", P1),
    (f"<div class='page has-comments'><article><p>{P1}</p></article></div>", P1),
    (f"<div class='no-comments'><main><p>{P1}</p></main></div>", P1),
    (f"<div class=comments><article><p>{P1}</p></article></div>", P1),
    (f"<article><p>{P1}</p></article><div class=comments><article><p>{P2}</p></article></div>", P1),
    (f"<article><p>{P1}</p></article><aside><article><p>{P2}</p></article></aside>", P1),
    (f"<article><p>{P1} <math><mi>a</mi><mo>+</mo><mi>b</mi></math> <noscript>is</noscript> <object>it</object></p>"
     f"<xmp>x = 1</xmp><svg><text>no</text></svg></article>", f"{P1} a+b is it\nx = 1"),
])
def test_articles_under_marked_wrappers_and_embedded_text(html, want):
    assert H.extract(html) == want


@pytest.mark.parametrize("html,want", [
    (f"<article><p>{P1}</p></article><script src=/a/>var x=1;</script><script/>alert(1)", P1),
    (f"<article><p>{P1}</p><iframe src=x /><svg/><p>{P2}</p></article>", f"{P1}\n{P2}"),
    (f"<article><p>{P1} <span class=ad>BUY NOW</span> {P2}</p></article>", f"{P1} {P2}"),
    (f"<article><p><span class='sponsored ad'>BUY <b>NOW</b></span> {P1}</p><p><i class=ad>Buy it all now.</i></p></article>", P1),
    (f"<article><p>{P1} <span hidden>no</span><span style='display:none'>no</span>{P2}</p></article>", f"{P1} {P2}"),
    (f"<article><p>{P1}</p><pre>x = 1 <span class=comment># one</span></pre></article>", f"{P1}\nx = 1 # one"),
    (f"<main><section class='related-work'><h2>Related work</h2><p>{P1}</p></section><p>{P2}</p></main>", f"Related work\n{P1}\n{P2}"),
    (f"<article><p>{P1}</p><div class='menu-recipes'><p>{P2}</p></div></article>", f"{P1}\n{P2}"),
    (f"<article><p>{P1}</p><div class='related-posts'><p>{P2}</p></div><div class=notice><p>{P2}</p></div></article>", P1),
])
def test_script_text_inline_adverts_and_subjects_named_like_parts(html, want):
    assert H.extract(html) == want


def test_the_cut_joins_a_short_block_of_a_subject_to_its_article():
    bs = H.blocks(f"<article><div class='menu-recipes'><p>{P1}</p><p>Pancakes</p><p>{P2}</p></div></article>")
    assert [H.score(b) > 0 for b in bs] == [True, False, True]
    assert H.min_cut([H.score(b) for b in bs], H.edges(bs)) == [True, True, True]


def test_nested_blocks_cost_memory_by_their_number():
    depth = 40_000
    bs = H.blocks("".join(f"<div>{i} " for i in range(depth)) + "</div>" * depth)
    assert len(bs) == depth and bs[-1].node.depth == depth
    assert H._near(bs[5].node, bs[5].node) == H.NEAR and H._near(bs[5].node, bs[8].node) == H.NEAR >> 2 and not H._near(bs[5].node, bs[50].node)
    assert len(H.edges(bs)) >= depth - 1
