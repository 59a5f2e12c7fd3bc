import html
import re
from collections import Counter

import pytest

from lodeglass.llm import html_region
from lodeglass.llm.queries import QUERIES


def article_text(page):
    """The blocks of the one article of a generated page, by its end tags."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = re.split(r"<[^>]+>", re.sub(r"</?b>", "", inner))
    return " ".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_query_gives_the_articles(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op1_html_region"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        want = article_text(pages[r["page_id"]]["html"])
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))


OTHER_MARKS = [("<div>", "</div>"), ("<main>", "</main>"), ('<div role="main">', "</div>"), ("<section>", "</section>"), ("", "")]


@pytest.mark.parametrize(("opened", "closed"), OTHER_MARKS)
def test_what_is_learnt_holds_without_the_mark(spark, sf, opened, closed):
    """Weights from pages with an article element, used on the same pages with another element or none."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = html_region.learn(spark, html_region.labelled_by_article(pages))
    words = found = more = 0
    for r in pages.collect():
        want = Counter(article_text(r["html"]).split())
        got = Counter(html_region.extract(r["html"].replace("<article>", opened).replace("</article>", closed), weights).split())
        words, found, more = words + want.total(), found + (want & got).total(), more + (got - want).total()
    assert found >= 0.95 * words and more <= 0.05 * words


def test_the_mark_is_taken_out():
    page, region = html_region.without_mark("<p>x</p><article class='a'>in<b>side</b></article>out", 8, 40)
    assert page == "<p>x</p>in<b>side</b>out" and page[region[0] : region[1]] == "in<b>side</b>"


def scored(page, weights):
    out = []
    for _, text, path, tag in html_region.segments(page):
        out.append(weights.tag(tag) if tag else weights.word(path) * len(text.split()))
    return out


@pytest.mark.parametrize("page", html_region.SEED_PAGES)
def test_scan_finds_the_greatest_sum(spark, page):
    weights = html_region.learn(spark)
    scores = scored(page, weights)
    best = max(sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1))
    parts = [t for _, t, _, tag in html_region.segments(page) if not tag]
    regions = [(m.start(), m.end()) for m in re.finditer(r"<!--main-->.*?<!--/main-->", page, re.S)]
    inside = [t for at, t, _, tag in html_region.segments(page) if not tag and regions[0][0] <= at < regions[0][1]]
    assert parts and best > 0
    assert html_region.extract(page, weights) == " ".join(" ".join(t.split()) for t in inside if t.strip())


LAYOUT = """<html><head><title>t</title><style>p{{}}</style></head><body class="site"><header><p>site name</p></header>{}
<footer><p>copyright words</p></footer></body></html>"""


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<article><h1>Ti<b>t</b>le</h1><p>a&nbsp;b &lt;c&gt;\n d<br>e</p></article>", "Title a b <c> d e"),
        ("<article><p>one two three</p><div class='ad'><p>buy now</p></div><p>four five</p></article>", "one two three four five"),
        ("<main><p>one two three</p><form><p>your mail</p></form><ul><li>x y<li>z</ul></main>", "one two three x y z"),
        ("<article><p>text words</p><section class=\"comments\"><p>I disagree</p></section></article>", "text words"),
        ("<article><p>text <a href='x>y'>linked</a> words<script>var a='</p>'</script></p></article>", "text linked words"),
        ("<article><p>unclosed text<p>more &amp;amp; text", "unclosed text more &amp; text"),
        ("<nav><ul><li><a>only</a></li></ul></nav>", ""),
        ("<article><p>foo<img src='x'>bar b<script>s()</script>az</p></article>", "foobar baz"),
        ("<article><p>A &<b>lt;</b> &#x<i>41;</i> &amp;lt;</p></article>", "A &lt; &#x41; &lt;"),
        ("<article><p>one<svg><path d='M0'/></svg>two<br/>three<hr>four</p></article>", "onetwo three four"),
    ],
)
def test_rules(spark, inner, want):
    assert html_region.extract(LAYOUT.format(inner), html_region.learn(spark)) == want


def test_null_empty_long_repeated_and_broken_pages(spark, make):
    long = LAYOUT.format("<article>" + "<p>word and word</p>" * 30_000 + "</article>")
    pages = [None, "", "plain words", "<", "<p", "<!--", "<script>x", "<" * 5000, "</p></p>", long, long]
    df = make([(i, "u", p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, feature string")
    weights = html_region.learn(spark, html_region.labelled_by_article(df))
    rows = {r["page_id"]: r for r in html_region.extract_pages(df, weights).collect()}
    assert rows[0]["text"] == rows[1]["text"] == rows[6]["text"] == ""
    assert rows[2]["text"] == "plain words"
    assert rows[9]["text"] == rows[10]["text"] == " ".join(["word and word"] * 30_000)
    assert rows[0]["feature"] == "x" and len(rows) == len(pages)
    assert html_region.extract_pages(make([], "page_id long, url string, html string"), weights).count() == 0
    assert html_region.labelled_by_article(make([], "page_id long, html string")).count() == 0
    with pytest.raises(ValueError, match="text"):
        html_region.extract_pages(make([], "html string, text string"), weights)


@pytest.mark.parametrize(
    "silent",
    [
        "<script>for(var i=0;i<n;i++){f(i);}</script>",
        "<SCRIPT type='x'>if (a<b) { s = \"it's\"; t = '<p>'; }</SCRIPT >",
        "<script>// don't\nif(a<b){c()}</script>",
        "<style>a::after{content:'<b'} /* isn't */</style>",
        "<script><!-- if (a<b) x('--') </script>",
        "<textarea>a<b and \"c</textarea>",
        "<svg><style>/* a<b's */</style><path d='M0'/></svg>",
        "<template><p>no</p><script>w('</template>'+a<b)</script></template>",
    ],
)
def test_content_of_silent_elements_is_not_markup(spark, silent):
    weights = html_region.learn(spark)
    for page in (f"{silent}<article><p>one two</p>{silent}<p>three four</p></article>", LAYOUT.format(f"<article><p>one two</p>{silent}<p>three four</p></article>")):
        assert html_region.extract(page, weights) == "one two three four"
    head = f"<html><head><title>t</title>{silent}</head><body><article><p>one two</p></article></body></html>"
    assert html_region.extract(head, weights) == "one two"
    assert html_region.extract(head.replace("</head>", "<script>w('</head>')</script>"), weights) == "one two"
