import itertools
import random

import pytest

from promptloom.llm import html_extract

LONG = "A paragraph of the article, which has enough words in it to be told from the rest of the page, and a comma."


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain", ""), ("<p>", ""), ("<!-- <p>never closed", ""), ("<script>var x = '</p>'; if (a<b) {}", ""),
    (f"<article><h1>T&amp;T</h1><p>{LONG}<p>x&nbsp;&lt;  \n y &#233;&copy</article>", f"T&T\n{LONG}\nx < y é©"),
    (f"<nav><a href='a>b'>Menu</a></nav><article><p><b>{LONG}<br>more</article><footer>end</footer>", f"{LONG} more"),
    (f"<body class='has-sidebar'><div class=content><p>{LONG}</p><aside>{LONG}</aside><form>{LONG}</form><div id='comments'><p>{LONG}</p></div></div>", LONG),
    (f"<header><p>{LONG}</p></header><main><p>{LONG}</p><ul><li>one</li><li>two</li></ul></main>", f"{LONG}\none\ntwo"),
    (f"<div class='cookie-notice'>{LONG}</div><article><p>{LONG}</p><div class='ad'>{LONG}</div><p>Short.</p></article>", f"{LONG}\nShort."),
    (f"<article class='post meta'><p>{LONG}</p></article>", LONG),
    (f"<div class='main side-by-side'><p>{LONG}</p></div>", LONG),
    (f"<div class='content post-comments-open'><p>{LONG}</p></div><div class='post-comments'><p>{LONG}</p></div>", LONG),
    (f"<main class='site-main has-sidebar'><p>{LONG}</p></main><div class='sidebar'><p>{LONG}</p></div>", LONG),
    (f"<form id='f'><div class='nav'><a href=x>{LONG}</a></div><article><p>{LONG}</p><p>{LONG}</p></article></form>", f"{LONG}\n{LONG}"),
    (f"<article><h2><a href=x>A title of a few words, linked</a></h2><ul><li><a href=y>an item</a></li></ul><p>{LONG}</p></article>", f"A title of a few words, linked\nan item\n{LONG}"),
    (f"<article><p>{LONG}</p><datalist><option>one<option>two</datalist><p>{LONG}</p></article><select><option>x</option></select>", f"{LONG}\n{LONG}"),
    (f"<article><p>so <math><mi>x</mi></math> is {LONG}</p><svg><svg><text>no</text></svg><text>no</text></svg></article>", f"so x is {LONG}"),
    (f"<article><p>{LONG}</p><svg><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
])
def test_pages(page, want):
    assert html_extract.extract(page) == want


def test_minimum_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 8)
        source, sink = ([rng.randrange(6) for _ in range(n)] for _ in range(2))
        edges = [(a, b, rng.randrange(4)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(side):
            return sum(t if s else c for s, c, t in zip(side, source, sink)) + sum(c for a, b, c in edges if side[a] != side[b])

        assert cost(html_extract.minimum_cut(source, sink, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_long_page_and_table(spark):
    page = "<article>" + f"<p>{LONG}</p>" * 3000 + "</article>" + "<nav>" + "<a href=x>link</a> " * 3000 + "</nav>"
    df = spark.createDataFrame([(1, "u", page), (None, None, None), (1, "u", page)], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = html_extract.main_text(df).collect()
    assert sorted(len(r["text"].split("\n")) for r in got) == [1, 3000, 3000] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_stray_end_tags_take_linear_time():
    page = "<div>" * 20_000 + "</p>" * 20_000 + "</div>" * 20_000 + f"<article><p>{LONG}</p></article>"
    assert html_extract.extract(page) == LONG


def test_small_pages_have_the_cheapest_labelling():
    rng = random.Random(7)
    for _ in range(60):
        page = "".join(rng.choice(("<p>", "<div>", "</div>", "<article>", "</article>", "<div class=ad>", "<a>", "</a>", "<li>", "word " * rng.randrange(1, 30))) for _ in range(rng.randrange(2, 24)))
        tree, found = html_extract.blocks(page)
        if not 0 < len(found) <= 10:
            continue
        pairs = [(i - 1, i, html_extract.NEXT + html_extract.NEAR // (1 + tree.distance(found[i - 1][2], found[i][2]))) for i in range(1, len(found))]
        for i in range(len(found)):
            before = [j for j in range(i) if found[j][2] == found[i][2]]
            if before and before[-1] < i - 1:
                pairs.append((before[-1], i, html_extract.SAME))

        def cost(side):
            return sum(max(0, -s) if x else max(0, s) for x, (_, s, _) in zip(side, found)) + sum(c for a, b, c in pairs if side[a] != side[b])

        best = min(map(cost, itertools.product([False, True], repeat=len(found))))
        some = [side for side in itertools.product([False, True], repeat=len(found)) if cost(side) == best]
        assert html_extract.extract(page) in {"\n".join(t for (t, _, _), x in zip(found, side) if x) for side in some}
