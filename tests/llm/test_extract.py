"""Main text of literal and supplied pages."""

import html
import os
import re
import time

import pytest

from weblode.llm.extract import extract_text, main_text

P1, P2 = "First paragraph, with a good deal of plain text in it. " * 4, "Second paragraph, which is as long as the first one was. " * 4
SF = "/root/testdata/sf0.001"


def clean(*parts):
    return "\n\n".join(" ".join(p.split()) for p in parts)


@pytest.mark.parametrize("page,want", [
    (f"<body><nav><a href=/>Home</a></nav><div class=wrap><div id=content><h1>Title</h1><p>{P1}</p><p>{P2}</p></div>"
     f"<div class=sidebar><p>{P1}</p></div></div><div class='cookie-notice'>We use cookies</div><footer>x</footer>", clean("Title", P1, P2)),
    (f"<article><header><h1>Title</h1></header><p>{P1}<p>{P2}<form>Mail <input></form><section class=comments><p>{P2}</p></section></article>", clean("Title", P1, P2)),
    (f"<article><p>a&amp;b &copy; &#8364;&#x41; &ltx\n\t {P1}<br>line<b>bold</b></p><ul><li>one<li>two</ul></article>", clean("a&b © €A <x " + P1 + " linebold", "one", "two")),
    (f"<header><p>{P1}</p></header><div><p>{P1}</p></div><div class='ad-slot'><p>{P2}</p></div><script>x='</p>'</script><style>p{{}}</style>", clean(P1)),
    (f"<article><p>{P1}<!-- <p>no</p> --></p><aside>{P2}</aside><button>Go</button></article><p hidden>{P2}</p>", clean(P1)),
    (f"<main><article><p>{P1}</p></article></main><article class=comment><p>{P1}</p><p>{P1}</p></article>", None),
    ("", ""), (None, ""), ("just text", "just text"), ("<p></p>", ""), ("<!-- ", ""), ("<script>var x", ""), ("<p>a<p class=\"x", "a"),
])
def test_pages(page, want):
    got = main_text(page)
    assert got == want if want is not None else P1.strip() in got


@pytest.mark.parametrize("part", ["<!--", "<a \"", "<div>", "<p x=\"", "<script>", "<b>", "</b>", "<table><tr>", "<p><i>", "&", "<", "<li><ul>", "<a title='"])
def test_time_follows_the_page(part):
    start = time.perf_counter()
    main_text(part * 60000)
    assert time.perf_counter() - start < 5


def test_rows(spark):
    page = f"<article><p>{P1}</p></article>"
    rows = [(1, "u", page, "x", 1), (1, "u", page, "x", 1), (None, None, None, None, None), (2, "v", "", "y", 2), (3, "w", "<p>é😀</p>", "z", 3)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, "u", P1.strip(), len(P1.strip()))] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", "é😀", 2)], key=str)
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")
def test_supplied_pages(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        assert "".join(main_text(r.html).split()) == "".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())


@pytest.mark.parametrize("page,want", [
    (f"<body><div class='{name}'><article><h1>T</h1><p>{P1}</p></article><div class=sidebar><p>{P2}</p></div></div>", clean("T", P1))
    for name in ("site has-sidebar", "no-sidebar", "content-sidebar-wrap", "header-fixed page", "sidebar", "with-header", "headerless", "menu-open")
] + [
    (f"<body><div class='{name}'><h1>T</h1><p>{P1}</p><p>{P2}</p></div><div class=widget><p>{P1}</p></div>", clean("T", P1, P2))
    for name in ("site has-sidebar", "content-sidebar-wrap", "page-header-sticky", "layout-sidebar", "sidebar")
] + [
    (f"<main><article class='{name}'><p>{P1}</p></article></main>", clean(P1))
    for name in ("post category-advice", "tag-adoption", "adventure", "comments-open", "post tag-promo", "category-ad", "advance", "replying")
] + [
    (f"<div id=content><article><p>{P1}</p></article></div><div class='{name}'><article class=teaser><p>{P2}</p><p>{P2}</p></article></div>", clean(P1))
    for name in ("related-posts", "sidebar", "site-footer", "widget")
] + [
    (f"<div class=widget><article><p>{P1}</p></article></div><div class=widget><article><p>{P2}</p></article></div>", clean(P1, P2)),
    (f"<article><p>{P1}</p></article><div id=comments><article class=comment-body><p>{P2}</p><p>{P2}</p><p>{P2}</p></article></div>", clean(P1)),
    (f"<main><article><p>{P1}</p></article><article class='post ad'><p>{P2}</p></article><article class=promo><p>{P2}</p></article></main>", clean(P1)),
    (f"<article><p>{P1}</p><div class=newsletterSignup><p>{P2}</p></div><div class='post-header'><p>{P2}</p></div></article>", clean(P1, P2)),
])
def test_names_drop_boilerplate_and_no_wrapper(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page,want", [
    (f'<article><p title="my class=ad here">{P1}</p><p data-x=\'id="sidebar"\'>{P2}</p></article>', clean(P1, P2)),
    (f'<article><p class="x" class="ad">{P1}</p><p CLASS=ad>{P2}</p></article>', clean(P1)),
] + [
    (f"<article><p>{P1}</p><section {name}><p>{P2}</p></section></article>", clean(P1, P2))
    for name in ("id=share-prices", "id=related-work", "id=form-and-function", "class=social-history", "class='search-results-2020'", "id=comment-on-method")
] + [
    (f"<article><p>{P1}</p><section {name}><p>{P2}</p></section></article>", clean(P1))
    for name in ("class=ad-slot", "id=related-posts", "class='share-buttons x'", "class=newsletterSignup", "id=ad-1", "class=comment-list", "class=sidebar")
] + [
    (f"<body>{P1}<div><p>{P2}</p><p>{P1}</p></div>", clean(P1, P2, P1)), (f"<body><div><p>{P2}</p><p>{P1}</p></div>{P1}<p>end", clean(P2, P1, P1, "end")),
    (f"<body><div><p>{P2}</p><p>{P1}</p></div><ul><li><a href=/a>one link</a><li><a href=/b>another</a></ul>", clean(P2, P1)),
    (f"<body><div class=menu>x</div><div><div><p>{P1}</p></div><div><p>{P2}</p><p>{P1}</p></div></div><div class=footer>{P1}</div>", clean(P1, P2, P1)),
])
def test_nothing_of_the_article_is_lost(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("head,one,two", [
    ("<body><b><div>", "<i>", "</b>"), ("<ul><li><table>" + "<div>" * 20000, "<li>", "</li>"), ("<p>", "<b>", "<p>"), ("", "<div>", "</div>"), ("", "<td>", "</tr>"),
    ("<p><button>", "<i>", "<p>"), ("<dl>", "<dt>x", "<dd>y"), ("", "<a class='ad slot'>", "</b>"), ("<i>", "<div>", "</i>"), ("", "<p title='", "'>"),
    ("<select>", "<option>", "<b>"), ("<table>", "<tr><td>", "<div></table>")])
def test_time_follows_pairs_of_markup(head, one, two):
    for part in (head + one * (150_000 // len(one)) + two * (150_000 // len(two)), head + (one + two) * (300_000 // len(one + two))):
        start = time.perf_counter()
        main_text(part)
        assert time.perf_counter() - start < 4


def test_densities_by_brute_force():
    """Every element's density from its subtree as listed, and the choice from all sums, on random trees without an article."""
    import math
    import random

    from weblode.llm.extract import Page

    rng = random.Random(8)

    def tree(depth):
        if not depth or rng.random() < 0.2:
            return rng.choice(["word " * rng.randint(0, 30), f"<a href=/x>{'link ' * rng.randint(1, 5)}</a>", "<br>", "<img src=x>"])
        name = rng.choice(["div", "section", "span", "b", "blockquote", "div"])
        return f"<{name}>" + "".join(tree(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{name}>"

    for _ in range(40):
        page = Page("<html><body>" + "".join(tree(4) for _ in range(4)) + "</body></html>")
        n = len(page.name)

        def above(i):
            out = [i]
            while out[-1]:
                out.append(page.parent[out[-1]])
            return out

        sub = [[j for j in range(n) if i in above(j)] for i in range(n)]
        in_link = [any(page.name[k] == "a" for k in above(j) if k) for j in range(n)]
        size = lambda i, only: sum(sum(map(len, t.split())) for node, _, t in page.texts if node in sub[i] and (in_link[node] or not only))
        share = size(0, True) / max(size(0, False), 1)
        want = []
        for i in range(n):
            c, lc = size(i, False), size(i, True)
            t, lt = max(len(sub[i]) - 1, 1), max(sum(page.name[j] == "a" for j in sub[i] if j != i), 1)
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e) if c else 0
            want.append(c / t * math.log(c * t / (max(lc, 1) * lt) + 1) / math.log(base + math.e - 1) if c else 0.0)
        density, sums, last = page.densities()
        assert density == pytest.approx(want)
        assert sums == pytest.approx([sum(want[j] for j in range(1, n) if page.parent[j] == i) for i in range(n)])
        assert last == [max(s) for s in sub]
        first, end = page.main()
        best = max(range(n), key=lambda i: (sums[i], -i))
        assert not sums[best] or first in above(best) and end == last[first]
