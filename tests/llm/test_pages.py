"""Main text of odd but common markup, and of whole sites against a plain extraction that shares no code."""

import html
import random
import re
from html.parser import HTMLParser

import pytest

from tidemark.llm import html_extract

LONG = "Long text of the page, sentence after sentence. " * 6


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p title=it's>Hello</p><p>World's end</p></article>", "Hello\nWorld's end"),
        ("<article><p title='a>b' data-x=\"c>d\">Kept</p></article>", "Kept"),
        ("<article><p title = 'a' =odd b=/x/ c>Kept</p></article>", "Kept"),
        ("<article><p title=\"never ends>One</p><p>Two</p></article>", "One\nTwo"),
        ("<form action=/x><input name=v><div><h1>Title</h1><p>Whole page in a form</p></div><select><option>x</select></form>", "Title\nWhole page in a form"),
        (f"<form><article>{LONG}</article></form>", LONG.strip()),
        (f"<div>{LONG}</div><form><p>Subscribe</p><input></form>", LONG.strip()),
        ("<article><header class=header><h1>Title</h1></header><p>Body</p><footer>By</footer></article>", "Title\nBody"),
        (f"<header>Site</header><div>{LONG}</div>", LONG.strip()),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding=t>x=1</annotation></math> be.</p><svg><title>icon</title></svg></article>", "Let x=1 be."),
        (f"<div id=content><p>{LONG}</p></div><article><a href=/x>Teaser card</a></article>", LONG.strip()),
        ("<main>m</main><article class=related>r</article>", "m"),
        ("<article><p>The post</p></article><article class='comment'>A reader says</article>", "The post"),
        ("<p>One</p><!--><p>Two</p><!---><p>Three</p><!-- gone --!><p>Four</p><!-- > still gone --><p>Five</p>", "One\nTwo\nThree\nFour\nFive"),
        ("<p>One</p><!-- never ends <p>Two</p>", "One"),
        (f"<p>{LONG}</p><div class=post-comments>c</div><div id=user-comments>c</div><ins class=adsbygoogle>a</ins><div class='popup-overlay'>p</div><p style='display: none'>h</p>", LONG.strip()),
        ("<article class='post right-sidebar'><div class='post-header'><h1>Head</h1></div><p>Text</p></article>", "Head\nText"),
        ("<main><article><p>In main</p></article></main>", "In main"),
        ("<!DOCTYPE html><title>t</title><p>Only", "Only"),
    ],
)
def test_odd_markup(page, text):
    assert html_extract.extract(page) == text


class Plain(HTMLParser):
    """Text of articles, by a parser of its own: what is inside of other parts goes, blocks end lines."""

    DROP = {"script", "style", "nav", "header", "footer", "aside", "form", "button", "noscript", "head"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.gone, self.lines, self.line = 0, 0, [], []
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        said = re.sub(r"\s+", " ", "".join(self.line)).strip()
        if said:
            self.lines.append(said)
        self.line = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        if tag in self.DROP:
            self.gone += 1
        if tag == "br":
            self.line.append(" ")
        if tag in ("p", "div", "h1", "h2", "h3", "ul", "ol", "li", "article", "section", "table", "tr", "td", "blockquote", "pre"):
            self.cut()

    def handle_endtag(self, tag):
        if tag in self.DROP:
            self.gone -= 1
        if tag in ("p", "div", "h1", "h2", "h3", "ul", "ol", "li", "article", "section", "table", "tr", "td", "blockquote", "pre"):
            self.cut()
        if tag == "article":
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and not self.gone:
            self.line.append(data)


def test_all_pages_agree_with_a_plain_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]] == "\n".join(Plain(r["html"]).lines), r["url"]


def test_generated_sites_without_article_tags(spark):
    """Menus, sidebars and notes in plain divs: what a page has to itself is its text."""
    rng = random.Random(9)
    words = [f"word{k}" for k in range(300)] + ["naïve", "5 &lt; 6", "Smith &amp; Sons"]
    rows, want = [], {}
    for site in range(3):
        menu = "".join(f"<li><a href=/{k}>{rng.choice(words)} {k}</a></li>" for k in range(6))
        side, note = (" ".join(rng.choices(words, k=12)) for _ in range(2))
        for page in range(40):
            own = [" ".join(rng.choices(words, k=rng.randrange(4, 25))) for _ in range(rng.randrange(2, 6))]
            body = "".join(f"<div><p>{p}</p></div>" for p in own[1:])
            key = 100 * site + page
            rows.append((key, f"https://s{site}.example/{page}", f"<html><body><ul>{menu}</ul><div><div>{side}</div></div><h1>{own[0]}</h1>{body}<div>{note}</div></body></html>"))
            want[key] = "\n".join(html.unescape(p) for p in own)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(6)
    assert {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()} == want
