"""Main text: names on the wrong elements, formulas, deep pages, clashing columns; and what the cut is for."""

import time

import pytest

from factorloom.llm import htmltext

SAID = "This is a long paragraph of running text, which says something about the matter. It has two sentences."
CASES = {
    "name on body": (f'<body class="has-sidebar"><article><h1>T</h1><p>{SAID}</p></article></body>', f"T\n{SAID}"),
    "listed name on body": (f'<body class="menu"><article><p>{SAID}</p></article></body>', SAID),
    "name above the content": (f'<div class="page with-header"><main><p>{SAID}</p></main></div>', SAID),
    "listed name above the content": (f'<div class="menu"><main><p>{SAID}</p></main></div>', SAID),
    "title in an entry header": (f'<article><div class="entry-header"><h1>The Title</h1></div><p>{SAID}</p></article>', f"The Title\n{SAID}"),
    "widget in an article": (f'<article><div class="widget"><p>{SAID}</p></div></article>', SAID),
    "paragraph with a name": (f'<article><p>{SAID}</p><p class="share">Watch out here.</p><p>{SAID}</p></article>', f"{SAID}\nWatch out here.\n{SAID}"),
    "formula": (f"<article><p>{SAID} <math><mi>x</mi><mo>+</mo><mn>1</mn></math></p></article>", f"{SAID} x+1"),
    "links in an article": (f'<article><p>{SAID}</p><p><a href="x">see also this page</a></p><p>{SAID}</p></article>', f"{SAID}\nsee also this page\n{SAID}"),
    "advert in an article": (f'<article><p>{SAID}</p><div class="ad">{SAID}</div><p>{SAID}</p></article>', f"{SAID}\n{SAID}"),
    "comments in an article": (f'<article><p>{SAID}</p><section id="comments"><div class="comment"><p>{SAID} {SAID}</p></div></section></article>', SAID),
    "notice and banner": (f'<div class="notice">{SAID}</div><main><p>{SAID}</p></main><div id="banner">{SAID}</div>', SAID),
    "no hints at all": (f'<div><a href="a">One</a> <a href="b">Two</a></div><div><p>{SAID}</p><p>{SAID}</p></div>', f"{SAID}\n{SAID}"),
    "menu without a name": (f'<ul><li><a href="a">One</a></li><li><a href="b">Two</a></li></ul><div><p>{SAID}</p></div>', SAID),
    "empty": ("", ""),
    "only a menu": ('<nav><a href="a">One</a></nav>', ""),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_cases(case):
    page, text = CASES[case]
    assert htmltext.extract(page) == text


def test_the_cut_decides():
    """Where the classifier alone is wrong, neighbours put it right: labels change, and towards the right text."""
    changed = wrong = 0
    for page, text in CASES.values():
        read = htmltext.Page(page)
        on = htmltext.label(read)
        changed += sum((b.odds > 0) != x for b, x in zip(read.blocks, on, strict=True))
        wrong += "\n".join(b.text for b in read.blocks if b.odds > 0) != text
    assert changed >= 2 and wrong >= 2


@pytest.mark.parametrize("page", ["<div>x" * 20_000, "<article>" + "<p>word word word." * 40_000, "<b>" * 50_000, "<p>" + "a " * 500_000])
def test_large_and_deep(page):
    began = time.time()
    htmltext.extract(page)
    assert time.time() - began < 20


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", f"<main><p>{SAID}</p></main>", "t", 5), (1, "u", f"<main><p>{SAID}</p></main>", "t", 5), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars long")
    assert [tuple(r) for r in htmltext.main_text(df).collect()] == [(1, "u", SAID, len(SAID))] * 2 + [(None, None, "", 0)]
