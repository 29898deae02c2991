import html
import math
import random
import re

import duckdb
import pytest

from factloom.llm.pages import APART, HOLDERS, Tree, extract, main_text

P1, P2 = "One long paragraph of the article that says a good deal about it. " * 3, "Another paragraph, with more to say about the same thing & others. " * 4


def e(t):
    return html.escape(t.strip())


ARTICLE = f"<h1>A title</h1><p>{e(P1)}</p><p>{e(P2)}</p>"
WANT = "\n\n".join(["A title", P1.strip(), P2.strip()])


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article>{ARTICLE}</article><footer>&copy; me</footer></body></html>",
        f"<body><header>Site name</header><div id=menu><a href=1>one</a><a href=2>two</a></div><div class='content'>{ARTICLE}</div><aside>About me and my life</aside></body>",
        f"<body><main><article>{ARTICLE}</article><section class='comments'><p>First comment that is rather long, as long as it gets.</p></section></main></body>",
        f"<body><div class=wrap><h1>A title</h1><div class=post><p>{e(P1)}</p><p>{e(P2)}</p></div></div><div class='sidebar widget'><ul><li><a href=1>one</a></ul></div>",
        f"<article><div class=\"cookie-notice\">We use cookies</div>{ARTICLE}<form><label>Mail</label><input></form><script>var x='</p>'</script></article",
        f"<BODY><ARTICLE>{ARTICLE.replace('<p>', '<P>').replace('</p>', '')}<div class=ad>Buy now</div></ARTICLE>",
    ],
)
def test_article_without_what_surrounds_it(page):
    assert main_text(page) == WANT


def test_white_space_references_and_broken_markup():
    assert main_text("<article><p>a\n  b&nbsp;c<br>d &lt;e&gt; &amp;amp; &#233;<!-- x --><p> <p>1 < 2 <b>bold<p>end") == "a b c d <e> &amp; é\n\n1 < 2 bold\n\nend"
    assert [main_text(p) for p in (None, "", "   ", "<p>", "<nav><a>x</a></nav>", "<", "<script>var a=1", "<!-- open")] == ["", "", "", "", "", "<", "", ""]
    assert main_text("plain text") == "plain text"
    deep = "<div>" * 20_000 + "deep text" + "</div>" * 20_000
    assert main_text(deep) == "deep text"
    assert main_text("<body class='has-sidebar ad'><p>kept</p></body>") == "kept"


def test_pages_of_the_table_and_edge_cases(spark):
    sf = "/root/testdata/sf0.01/pages.parquet"
    want = {}
    for i, page in duckdb.sql(f"select page_id, html from '{sf}'").fetchall():
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = [re.sub(r"<[^>]*(>|$)", "", x) for x in re.split(r"</?(?:p|h1)>", body)]
        want[i] = "\n\n".join(" ".join(html.unescape(x).split()) for x in parts if x.strip())
    out = extract(spark.read.parquet(sf)).collect()
    assert {r.page_id: r.text for r in out} == want and all(r.n_chars == len(r.text) for r in out)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x</p>", 2), (1, "u", "<p>x</p>", 2)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.text) for r in extract(odd).collect()) == [(0, ""), (1, "x"), (1, "x")]
    assert extract(odd.limit(0)).count() == 0


def paragraphs(n, k=0):
    return [f"{i}: {P1.strip()}" for i in range(k, k + n)]


def marked(texts):
    return "".join(f"<p>{e(t)}</p>" for t in texts)


AROUND = "<body><div id=top><a href=/>Home</a> <a href=/a>About us</a></div>{}<div class=foot><a href=/x>Terms</a> <a href=/y>Contact</a></div></body>"


@pytest.mark.parametrize(
    ("article", "want"),
    [
        (f"<div class=content><h1>T</h1><p>A short lead.</p><div class=text>{marked(paragraphs(10))}</div><p>A short end.</p></div>", ["T", "A short lead.", *paragraphs(10), "A short end."]),
        (f"<h1>T</h1><p>A short lead.</p><div class=text>{marked(paragraphs(10))}</div><p>A short end.</p>", ["T", "A short lead.", *paragraphs(10), "A short end."]),
        (f"<div class=content><h1>T</h1><p>Lead.</p><div class=wrap><div class=text>{marked(paragraphs(10))}</div></div><pre>x = 1</pre><h2>More</h2><p>End.</p></div>", ["T", "Lead.", *paragraphs(10), "x = 1", "More", "End."]),
        (
            f"<div class=content><h1>T</h1><p>Lead.</p><section><h2>One</h2>{marked(paragraphs(12))}</section><section><h2>Two</h2><p>Short.</p></section><section><h2>Three</h2>{marked(paragraphs(2, 20))}</section><p>End.</p></div>",
            ["T", "Lead.", "One", *paragraphs(12), "Two", "Short.", "Three", *paragraphs(2, 20), "End."],
        ),
        (f"<div class=content><div class=part>{marked(paragraphs(12))}</div><div class=part>{marked(paragraphs(1, 30))}</div><div class=last>{marked(paragraphs(2, 40))}</div></div>", [*paragraphs(12), *paragraphs(1, 30), *paragraphs(2, 40)]),
        (f"<div class=content>Bare <b>lead</b> text.<div class=text>{marked(paragraphs(10))}</div></div>", ["Bare lead text.", *paragraphs(10)]),
    ],
)
def test_whole_article_without_article_element(article, want):
    assert main_text(AROUND.format(article)) == "\n\n".join(want)


def slow_densities(tree):
    """Densities and their sums by going through the whole page for each node."""
    n = len(tree.tag)
    above = [[i] for i in range(n)]
    for i in range(1, n):
        above[i] += above[tree.parent[i]]
    shown = [i for i in range(n) if not tree.apart[i]]
    pieces = [(i, len(t.strip())) for i, t in filter(None, tree.pieces) if i in shown]
    in_link = lambda i: any(tree.tag[a] == "a" for a in above[i])
    counts = {}
    for i in range(n):
        own = [(j, k) for j, k in pieces if i in above[j]]
        below = [j for j in shown if j != i and i in above[j]]
        counts[i] = sum(k for _, k in own), len(below), sum(k for j, k in own if in_link(j)), sum(tree.tag[j] == "a" for j in below)
    body = tree.tag.index("body") if "body" in tree.tag else 0
    ratio = counts[body][2] / max(1, counts[body][0])
    density = []
    for i in range(n):
        c, t, lc, lt = counts[i]
        if not c or tree.apart[i]:
            density.append(0.0)
            continue
        x = c * max(1, t) / (max(1, lc) * max(1, lt))
        of = math.log(c * lc / max(1, c - lc) + ratio * c + math.e)
        density.append(c / max(1, t) * (math.log(max(1, x)) / math.log(of) if of > 1 + 1e-9 else math.log(max(1, x)) + 1))
    return density, [sum(density[j] for j in range(1, n) if tree.parent[j] == i) for i in range(n)], counts


def test_densities_sums_and_choice_against_slow_ones():
    rnd = random.Random(6)

    def some(depth):
        tag = rnd.choice("div div section p a span ul li nav b table td".split())
        inner = "".join(some(depth - 1) if depth and rnd.random() < 0.6 else "word " * rnd.randrange(12) for _ in range(rnd.randrange(4)))
        return f"<{tag} class='{rnd.choice(['x', 'ad', 'post'])}'>{inner}</{tag}>"

    pages = [f"<body>{''.join(some(4) for _ in range(5))}</body>" for _ in range(25)]
    pages += [p for (p,) in duckdb.sql("select html from '/root/testdata/sf0.001/pages.parquet' limit 10").fetchall()]
    for page in pages:
        tree = Tree(page)
        density, sums, counts = slow_densities(tree)
        got = tree.densities()
        assert got[0] == pytest.approx(density) and got[1] == pytest.approx(sums)
        assert got[2:] == ([counts[i][0] for i in range(len(density))], [counts[i][2] for i in range(len(density))])
        holders = [i for i in range(len(density)) if tree.tag[i] in HOLDERS and not tree.apart[i] and counts[i][0]]
        if holders:
            best = max(holders, key=lambda i: (round(sums[i], 9), round(density[i], 9), -i))
            assert any(a <= best < b for a, b in tree.selected())
        assert not any(tree.tag[i] in APART and not tree.apart[i] for i in range(len(density)))


def test_names_and_headers_of_the_article_stay():
    page = "<body><div class=post><header><h1>Title</h1><p class=lead>Lead of it all, a sentence.</p></header><p>Body text is here, and it is long enough to be an article.</p><p>More of the same text, as articles have.</p></div></body>"
    assert main_text(page).split("\n\n")[:2] == ["Title", "Lead of it all, a sentence."]
    # a header of the page stands above the article, not beside its paragraphs
    page = "<body><div id=page><header><h1>Site</h1></header><div><p>Body text is here, and it is long enough to be an article.</p><p>More of the same text.</p></div></div></body>"
    assert "Site" not in main_text(page)
    inside = '<section id="related-work"><p>Work that is related.</p></section><div class="social-science"><p>On science.</p></div><pre class="search-example">grep x</pre><h2 class="share-title">Shares</h2>'
    outside = '<div class="reader-opinions"><p>I liked it</p></div><div class="comments-area"><p>me too</p></div><div class="related-posts"><p>Other texts</p></div><div id="cookie-banner-2"><p>Cookies</p></div><ul class="share-buttons"><li>Share</li></ul>'
    text = main_text(f"<body><article><p>A first long paragraph of the article, with words.</p>{inside}{outside}</article></body>")
    assert text.split("\n\n") == ["A first long paragraph of the article, with words.", "Work that is related.", "On science.", "grep x", "Shares"]


def test_many_open_elements_and_end_tags_that_match_none():
    import time

    start = time.time()
    assert main_text("<div>" + "<span>" * 20_000 + "text" + "</b></i></p>" * 20_000 + "<div>x</div>" * 2000).startswith("text")
    assert time.time() - start < 10
