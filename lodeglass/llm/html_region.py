"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores the sum of the weights of the elements around it (names, and parts of
class, id and role), a tag scores below zero. One linear scan finds the contiguous region with the greatest sum; words
inside it whose own score is below zero (an advert or a form amid an article) are left out.

Weights are log-odds counted on labelled pages: pages whose content region is known. ``SEED_PAGES`` are hand-labelled
layouts; ``labelled_by_article`` takes pages of a table whose one article element marks the region, a bounded sample of them. The mark itself is
taken out before counting, and containers that hold menus as well as content (``CONTAINERS``) are judged by the hand-labelled layouts
alone, so that what is learnt holds for pages without that element too. Counting runs on Spark; the weights, those of the bounded
sample, travel with the tasks. Extraction is one narrow pass.

Text rules: character references are decoded in each piece of text between tags, white space inside a block becomes one blank, blocks are
trimmed and joined by one blank in page order. Images, scripts and other elements inside a line do not end it. Scripts, styles, templates,
heads and comments hold no words. Null or empty pages give an empty text, an empty table an empty result; a column of the
result's name in the input is an error. Rows are handled one by one, so repeated rows repeat their result; the greatest sum that
starts first wins a tie.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.llm.columns import require

#: Pages to learn from (met within a few percent: chosen by hash).
SAMPLE_PAGES = 500
_SEED_WEIGHT = 20  # a labelled layout counts as this many pages
#: Least and greatest log-odds of a feature: sections and class parts say much, plain elements little, so that a list
#: inside an article stays and a comment inside an article goes.
_SECTION_LIMITS = (-8.0, 3.0)
_PLAIN_LIMITS = (-1.5, 1.0)

#: Element names. Those without end tags, those whose content is no text, and those inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style template noscript iframe svg math object head title textarea select option button".split())
#: Silent elements whose content is characters up to their own end tag, whatever it looks like.
RAW = frozenset("script style noscript iframe title textarea".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
    "ol p pre section table ul".split()
)
#: Elements whose content goes on in the line around them, whether it is text or not.
IN_LINE = INLINE | SILENT - {"head", "title"} | frozenset("img picture source track audio video canvas embed input map area param".split())
CONTAINERS = frozenset("article div section main body html".split())
SECTIONS = frozenset("article aside footer form header main nav".split())
SELF_CLOSING = frozenset("li dt dd tr td th".split())  # a new one ends the one before it

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)",
    re.S,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Hand-labelled layouts; what stands between main marks is content.
SEED_PAGES = [
    """<html><body><header id="masthead" class="site-header"><a>Site</a> name here</header><nav class="menu"><ul><li><a>Home</a></li>
    <li><a>News</a></li></ul></nav><div class="breadcrumb"><a>Home</a> where you are</div><!--main--><main id="content"><article class="post entry">
    <h1>A long title of the story</h1><p>First words of a long paragraph of a story that goes on.</p><h2>Part</h2><p>More words of the story
    in full length.</p><blockquote><p>Quoted words of the story.</p></blockquote><ul><li>one point of the story</li><li>another point</li></ul>
    <pre>words of code here</pre><table><tr><td>cell words</td><td>other words</td></tr></table></article></main><!--/main--><aside class="sidebar widget">
    <h3>Related</h3><ul><li><a>other story</a></li></ul></aside><section class="comments" id="comments"><h3>Comments</h3><div class="comment reply">
    <p>I do not agree with the story at all.</p></div></section><footer class="site-footer"><p>Copyright of the site words</p></footer></body></html>""",
    """<body><div class="cookie notice banner consent"><p>We use cookies on this site to count you</p></div><div class="topbar header">
    <a>Login</a></div><div class="nav navigation menu"><a>one</a><a>two</a></div><div class="container"><!--main--><div class="content article body text">
    <h1>Title of the text</h1><div class="entry"><p>Words of the text that matter to a reader of it.</p><p>And more words of it here.</p></div></div>
    <!--/main--><div class="ad ads advert advertisement sponsor promo"><p>Buy this thing now and here</p></div><div class="sidebar related recommended
    trending popular"><p>Read this other thing too</p></div><form class="newsletter subscribe search signup"><label>Your mail</label><p>Sign up
    for our letter today</p></form><div class="share social tools"><a>Share</a></div><div class="discussion disqus feedback respond comment">
    <p>A reader writes what was thought of it</p></div></div><div id="footer" class="footer legal copyright"><p>All rights</p></div></body>""",
    """<body><div role="banner"><p>The name of the site</p></div><div role="navigation"><p>go here or there</p></div><!--main--><div role="main">
    <section><h2>Heading</h2><p>Body words in a plain section of a page.</p><p>Body words again, some more of them.</p><figure><figcaption>what is
    seen</figcaption></figure><dl><dt>term</dt><dd>meaning of it</dd></dl></section></div><!--/main--><div role="complementary"><p>aside words</p></div>
    <div role="contentinfo"><p>who made the site</p></div><div class="alert popup modal overlay warning message"><p>Please turn on your script</p></div>
    <div class="pagination pager"><a>next</a></div><div class="tags meta byline author"><a>tag</a></div></body>""",
]


def _features(name: str, attributes: str) -> tuple[str, ...]:
    found = [name]
    named = _NAMED.findall(attributes) if "=" in attributes and name not in ("html", "body") else ()
    for values in named:
        for part in _PART.findall(_CAMEL.sub(" ", "".join(values))):
            found.append("." + part.lower().removesuffix("s"))
    return tuple(dict.fromkeys(found))


def segments(page: str) -> Iterator[tuple[int, str, tuple, str]]:
    """The page in order: (position, text, surrounding features, "") for text and (position, "", (), name) for tags.

    End tags carry a slash before their name. Elements that are never closed end with their parent.
    """
    stack: list[tuple[str, tuple[str, ...]]] = []
    path: tuple[str, ...] = ()
    at, silent = 0, ""
    unclosed: set[str] = set()

    def raw_end(name: str, begin: int) -> int:
        """Where the end tag of a raw element ends; -1 where there is none."""
        found = None if name in unclosed else _RAW_END[name].search(page, begin)
        if not found:
            unclosed.add(name)
        return found.end() if found else -1

    def rebuilt() -> tuple[str, ...]:
        return tuple(dict.fromkeys(f for _, features in stack for f in features))

    after = 0
    while token := _TOKEN.search(page, after):
        after = token.end()
        if not silent and token.start() > at:
            yield at, page[at : token.start()], path, ""
        slash, name, attributes = token[1], (token[2] or "").lower(), token[3] or ""
        if silent and not (silent == "head" and name == "body" and not slash):
            if slash and name == silent:
                silent, at = "", after
            elif name in RAW and not slash and not attributes.endswith("/"):
                after = max(after, raw_end(name, after))
            continue
        silent, at = "", after
        if not name:
            continue
        if name in SILENT:
            if not slash and not attributes.endswith("/"):
                silent = name
                if name in ("head", "title", "button", "select", "option", "object", "noscript"):
                    end = re.compile(rf"</{name}\s*>|<body\b|<article\b|<main\b", re.I).search(page, at)
                    silent = name if end and end[0].startswith("</") else ""
                if silent in RAW:
                    end_at = raw_end(name, at)
                    silent, at = ("", end_at) if end_at >= 0 else (name, len(page))
                    after = at
            yield token.start(), "", (), name
            continue
        if slash:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    path = rebuilt()
                    break
        elif name not in VOID and not attributes.endswith("/"):
            if stack and ((stack[-1][0] == "p" and name in CLOSES_P) or (stack[-1][0] == name and name in SELF_CLOSING)):
                stack.pop()
            if name not in INLINE or name == "a":
                stack.append((name, _features(name, attributes)))
            path = rebuilt()
        yield token.start(), "", (), slash + name
    if not silent and at < len(page):
        yield at, page[at:], path, ""


def _is_container(feature: str) -> bool:
    return feature.lstrip("</") in CONTAINERS


def _log_odds(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    inside, outside = counts.get("", (0, 0))
    out = {}
    for feature, (a, b) in counts.items():
        if feature:
            odds = math.log((a + 1) / (inside + 2)) - math.log((b + 1) / (outside + 2))
            low, high = _SECTION_LIMITS if feature in SECTIONS or feature[0] == "." else _PLAIN_LIMITS
            out[feature] = max(low, min(high, odds))
    return out


class Weights:
    """Scores of words by their surroundings and of tags by their name."""

    def __init__(self, counts: dict[str, tuple[float, float]], containers: dict[str, tuple[float, float]] | None = None) -> None:
        """``counts`` inside and outside by feature, all words under ''; ``containers`` judges ``CONTAINERS`` instead, where given."""
        self._log_odds = _log_odds(counts)
        if containers is not None:
            own = _log_odds(containers)
            self._log_odds = {f: v for f, v in self._log_odds.items() if not _is_container(f)}
            self._log_odds |= {f: v for f, v in own.items() if _is_container(f)}
        self._words: dict[tuple, float] = {}

    def word(self, path: tuple[str, ...]) -> float:
        score = self._words.get(path)
        if score is None:
            if len(self._words) > 50_000:
                self._words.clear()
            score = self._words[path] = 0.25 + sum(self._log_odds.get(f, 0.0) for f in path)
        return score

    def tag(self, name: str) -> float:
        return min(-0.05, self._log_odds.get("<" + name, 0.0) / 4)


def extract(page: str | None, weights: Weights) -> str:
    """The main text of a page."""
    found: list[tuple[str, float, bool]] = []  # text, score, ends a line of text
    best, best_from, best_to = 0.0, 0, 0
    total, start = 0.0, 0
    for _, text, path, tag in segments(page or ""):
        if tag:
            score, breaks = weights.tag(tag), tag.lstrip("/") not in IN_LINE
            found.append(("", 0.0, breaks))
        else:
            each = weights.word(path)
            score = each * len(text.split())
            found.append((text, each, False))
        if total <= 0:
            total, start = 0.0, len(found) - 1
        total += score
        if total > best:
            best, best_from, best_to = total, start, len(found)
    blocks, line = [], []
    for text, each, breaks in [*found[best_from:best_to], ("", 0.0, True)]:
        if breaks:
            blocks.append(" ".join("".join(line).split()))
            line = []
        elif text and each > 0:
            line.append(entities.unescape(text))
    return " ".join(b for b in blocks if b)


# ---- learning ----


def count_features(page: str, regions: list[tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """Words inside and outside the content regions, by surrounding feature; tags likewise; all words under ''."""
    inside, outside = Counter(), Counter()
    for at, text, path, tag in segments(page):
        counter = inside if any(a <= at < b for a, b in regions) else outside
        n = 1 if tag else len(text.split())
        counter.update(dict.fromkeys(["<" + tag] if tag else ["", *path], n))
    return {f: (inside[f], outside[f]) for f in inside.keys() | outside.keys()}


def without_mark(page: str, start: int, end: int) -> tuple[str, tuple[int, int]]:
    """The page without the tags that mark its region from ``start`` to ``end``, and the region there."""
    opened = page.index(">", start) + 1
    closed = page.index(">", end) + 1
    return page[:start] + page[opened:end] + page[closed:], (start, start + end - opened)


def _seed_counts() -> Counter:
    sums: Counter = Counter()
    for page in SEED_PAGES:
        regions = [(m.start(), m.end()) for m in re.finditer(r"<!--main-->.*?<!--/main-->", page, re.S)]
        for f, (a, b) in count_features(page, regions).items():
            sums[f, 0] += a * _SEED_WEIGHT
            sums[f, 1] += b * _SEED_WEIGHT
    return sums


def _paired(sums: Counter) -> dict[str, tuple[float, float]]:
    return {f: (sums[f, 0], sums[f, 1]) for f in {k[0] for k in sums}}


def labelled_by_article(pages: DataFrame, html: str = "html", pages_to_learn: int = SAMPLE_PAGES) -> DataFrame:
    """``html``, ``start`` and ``end`` of pages with exactly one article element: about ``pages_to_learn``, by hash."""
    require(pages, html)
    text = F.col(html)
    marked = pages.select(text.alias("html")).where(
        (F.regexp_count(text, F.lit("<article[\\s>]")) == 1) & (F.regexp_count(text, F.lit("</article>")) == 1)
    )
    total = marked.count()
    limit = -(2.0**63) + 2.0**64 * pages_to_learn / max(total, 1)
    chosen = marked.where(F.xxhash64("html") < F.lit(limit)).distinct()
    return chosen.select(
        "html", (F.regexp_instr("html", F.lit("<article[\\s>]")) - 1).alias("start"), (F.instr("html", "</article>") - 1).alias("end")
    ).where(F.col("start") < F.col("end"))


def learn(spark: SparkSession, labelled: DataFrame | None = None) -> Weights:
    """Weights from the seed pages and from ``labelled`` (html, start, end)."""
    sums = _seed_counts()
    if labelled is not None:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for page, start, end in zip(*[batch.column(n).to_pylist() for n in range(3)], strict=True):
                    plain, region = without_mark(page, start, end)
                    counts = count_features(plain, [region])
                    rows += [(f, a, b) for f, (a, b) in counts.items() if not _is_container(f)]
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["feature", "inside", "outside"])

        counted = labelled.select("html", "start", "end").mapInArrow(count, "feature string, inside bigint, outside bigint")
        totals = counted.groupBy("feature").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b"))
        for r in totals.collect():  # of the sample alone
            sums[r["feature"], 0] += r["a"]
            sums[r["feature"], 1] += r["b"]
    return Weights(_paired(sums), _paired(_seed_counts()))


def extract_pages(pages: DataFrame, weights: Weights, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` without the html, with the main text under ``name``; other columns stay, names must not clash."""
    require(pages, html)
    kept = [c for c in pages.columns if c != html]
    if name in kept:
        raise ValueError(f"a column {name!r} is there already")
    rows = pages.select(*kept, html)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(v.as_py(), weights) for v in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*kept, name])

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept]
    return rows.mapInArrow(read, ", ".join([*kinds, f"`{name}` string"]))
