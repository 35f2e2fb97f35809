import random
import re

import pytest
from helpers import empty

from cadenza.llm import catalog, html_main

PAGES = "page_id long, url string, html string"
WEIGHTS = {}
MENU = '<nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav>'


def text(page, weights=WEIGHTS):
    return html_main.Page(page).text(weights)


def test_articles_of_sf_pages(spark, sf_dir):
    """Against a plain cut at the article's tags, and a plain decoding."""
    import html

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = catalog.QUERIES["op11_html_main"](spark, sf_dir).collect()
    assert len(out) == len(pages)
    for r in out:
        inner = re.search("<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        plain = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))).split())
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain, len(plain))


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        (f"<header><h1>Site</h1></header>{MENU}<article><h1>A  title</h1><p>First\n par&amp;a</p><p>Second</p></article><footer>end</footer>", "A title First par&a Second"),
        ("<article><p>before</p><aside><p>many words of no use at all, and more of them than the article has</p></aside><p>after</p></article>", "before after"),
        ('<article><p>text</p><div class="ad">buy</div><p>more</p><section id="reader-comments"><article><p>me too</p></article></section></article>', "text more"),
        ('<main><p>words</p><form><label>name</label><input name="x"></form><script>var t="</p>";</script><style>p{}</style></main>', "words"),
        ('<div class="cookie-notice">We use cookies</div><article>a<br>b <b>c</b>d<i>e</i></article><div id="sidebar">more</div>', "a b cde"),
        ("<article><p>x &lt; y &copy; &#233; &#x1F389; &am &amp</p>1 < 2<p>a>b</article>", "x < y © é 🎉 &am & 1 < 2 a>b"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one two a b"),
        ("<article>kept<!-- no --><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p> too</article>", "kept too"),
        ('<article><p title="a > b" data-x=\'>\'>quoted</p><p title="open>stray</p></article>', "quoted stray"),
        ("<article>one<p>two <!-- never closed <p>three", "one two"),
        ("<article>one<p>two <b title='x", "one two"),
        ("</div></article></p>" + MENU, ""),
        ("", ""),
        ("plain words only, without a tag, and some more of them", "plain words only, without a tag, and some more of them"),
        (f"<body>{MENU}<div><h1>The title</h1><p>Ten or more words stand in this paragraph, so that it counts.</p><p>Short.</p></div><div><a href=x>a link here</a></div></body>", "The title Ten or more words stand in this paragraph, so that it counts. Short."),
    ],
)
def test_main_text(body, expected):
    assert text(body) == expected


def test_best_region_equals_all_regions():
    rng = random.Random(5)
    for _ in range(300):
        scored, place = [], 0
        for _ in range(rng.randint(0, 12)):
            if rng.random() < 0.5:
                scored.append((rng.choice([-2, -1, 0, 1, 2, 3]), place))
                place += 1
            else:
                scored.append((-rng.choice([0, 1, 2]), -1))
        sums = [sum(s for s, _ in scored[i:j]) for i in range(len(scored)) for j in range(i + 1, len(scored) + 1)]
        first, last = html_main.best_region(scored)
        at = {p: i for i, (_, p) in enumerate(scored) if p >= 0}
        assert (sum(s for s, _ in scored[at[first] : at[last - 1] + 1]) if last else 0) == max([0, *sums])


def test_weights_are_learned(spark):
    """Elements get their weight from pages that mark their article; pages without marks are then read by it."""
    marked = [(i, "u", f"<body><box>{'some words here ' * 5}</box><article><par>{'long text of the article ' * 9}</par></article></body>") for i in range(60)]
    weights = html_main.fit(spark.createDataFrame(marked, PAGES))
    assert weights["tag par"] > -0.2 > -1 > weights["tag box"] and weights["word"] > 0 and weights["word in"] > 0 > weights["word out"]
    assert html_main.fit(empty(spark, PAGES)) == {}


def test_odd_pages(spark):
    long = "<article><p>" + "word " * 200_000 + "</p></article>"
    hard = ["<" * 50_000, "<a" * 50_000, '<a "' * 20_000, "<b>" * 50_000 + "</i>" * 50_000, "<!--" * 50_000, "<p>" * 50_000, "&" * 50_000]
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article>null id</article>"), (4, "u", long), (5, "u", "<article>twice</article>"), (5, "u", "<article>twice</article>"), *((6 + i, "u", h) for i, h in enumerate(hard))]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as text", "2 as n_chars", "'x' as kind")
    out = {(r.page_id, r.text) for r in html_main.extract(pages).collect()}
    assert {(1, ""), (2, ""), (None, "null id"), (4, ("word " * 200_000).strip()), (5, "twice"), (6, "<" * 50_000)} <= out
    assert html_main.extract(pages).count() == len(rows)
    assert html_main.extract(empty(spark, PAGES)).count() == 0
