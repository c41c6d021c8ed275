"""HTML extraction with site template removal.

Every element subtree of a page is hashed (tag and flattened text, bottom up), distinct pages are counted
per (host, hash) in Spark, and block subtrees that recur on many pages of their host are deleted before
anything else is read, inside and outside of an article alike:

- outside of an article, a block on half of the host's pages (at least ``PAGES``), or a menu (a container whose
  text is mostly links) on a tenth of them;
- inside of one, a container on half of the pages (a list only if it holds a link), and any block on nearly all
  of many pages (``MOST`` of at least ``MANY``).

What recurs on few pages recurs with copied articles, not with the site, so it stays; words inside a line
stay with their line. Copies that make up half of a host's pages cannot be told from its template. What a
page has to itself cannot recur, so marks in the page say the rest: elements that never hold an article
(``GONE``; a form only if the page does not stand in it, a header not inside of an article), classes, ids, roles and styles that
name or hide such parts (whole names only), and then the place to read: the ``article`` elements if they hold a third or more of the
text that would be read else, which is that of ``main`` or of what is left; smaller ones are cards and go.

The recurring hashes are broadcast if their measured number is within ``SMALL``; beyond it they join
back by page. All steps take time in proportion to the page: one tokenizer that never looks back, trees without
recursion, so depth has no limit. Defined cases: a null, empty or textless page gives an empty text; a null or
hostless url is a host of its own; unclosed and stray tags are repaired as browsers do in the common cases; a tag
that never ends is text; a page with an unpaired quote in a tag ends its tags at the next ``>`` from there on; pages
of one content on a host count once; repeated rows each give a row; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
GONE = frozenset("head script style noscript template iframe svg annotation nav header footer aside form button select textarea dialog menu object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the key closes an open element of the values.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = ("ul", "ol", "dl", "table", "select")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of class and id that mark what is not the article, and words that may stand beside them in a hyphenated name.
ROLES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer header menu modal nav navbar "
    "navigation newsletter notice pagination popup promo related share sharing sidebar social sponsored subscribe toolbar widget".split()
)
BESIDE = frozenset("area bar block bottom box container global left list main overlay page right section site slot top wrapper".split())
#: Beside these, in a name that says comments.
TALK, SPEAKERS = frozenset("comment comments".split()), frozenset("article entry post reader thread user".split())
#: Names of an ``article`` that is not the page's own.
OTHERS = frozenset("ad advert comment promo related reply sponsored teaser widget".split())
MARK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
#: Never taken for a marked part, whatever their class.
PLACES = frozenset("html body main".split())
#: ``article`` elements are the place to read if they hold so much of the text that would be read else.
OWN = 1 / 3
#: A subtree recurs if it is on this many distinct pages of a host, and on a share of them: SITE, or SHARE for menus.
PAGES, SHARE, SITE = 3, 0.1, 0.5
#: On this share of at least so many pages of a host, any block is the site's.
MOST, MANY = 0.9, 20
#: A menu has this many links, and this share of its characters in them.
LINKS, LINKED = 3, 0.8
BOXES, LISTS = frozenset("div section table figure".split()), frozenset("ul ol dl".split())
SMALL = 200_000

#: The rest of a tag as browsers read it: a quote opens a value only right after ``=``.
_REST = re.compile(r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>))|(?!\s*+=)))*+>""")
_COMMENT = re.compile(r"--!?>")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
_ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I | re.A) for tag in RAW}
_BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "role", "items", "hash", "links", "linked", "size")

    def __init__(self, tag: str, role: bool = False):
        self.tag, self.role, self.items = tag, role, []
        self.hash = self.links = self.linked = self.size = 0


def _named(value: str) -> bool:
    """One of the names is a role, or is put together from roles and words beside them."""
    for name in value.split():
        words = set(re.split(r"[-_]+", name))
        if words & ROLES and words <= ROLES | BESIDE or words & TALK and words <= TALK | SPEAKERS | BESIDE:
            return True
    return False


def _is_role(tag: str, attrs: str) -> bool:
    if tag in PLACES:
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "style" and _UNSEEN.search(value):
            return True
        if name in ("class", "id") and (not OTHERS.isdisjoint(value.split()) if tag == "article" else _named(value)):
            return True
        if name == "role" and value in MARK_ROLES or name == "aria-hidden" and value == "true":
            return True
    return False


def parse(page: str) -> list[Node]:
    """All nodes in page order, the root first; a node comes before what it holds. Text items are still escaped."""
    root = Node("#root")
    nodes, stack = [root], [root]
    open_at: dict[str, list[int]] = {}
    blocks, walls = [0], [0]
    at, n, paired = 0, len(page), True

    def drop(to: int) -> None:
        while len(stack) > to:
            k = len(stack) - 1
            open_at[stack.pop().tag].pop()
            for marks in (blocks, walls):
                if marks[-1] == k:
                    marks.pop()

    def last(*tags: str) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            stack[-1].items.append(page[at:])
            break
        if start > at:
            stack[-1].items.append(page[at:start])
        nxt = page[start + 1 : start + 2]
        if nxt in ("!", "?"):
            if page.startswith(("<!-->", "<!--->"), start):
                at = page.find(">", start) + 1
            elif page.startswith("<!--", start):
                end = _COMMENT.search(page, start + 4)
                at = end.end() if end else n
            else:
                at = page.find(">", start + 2) + 1 or n
            continue
        closing = nxt == "/"
        name = _NAME.match(page, start + 1 + closing)
        if name is None:
            stack[-1].items.append("<")
            at = start + 1
            continue
        whole = _REST.match(page, name.end()) if paired else None
        if whole is None:
            paired = False
            end = page.find(">", name.end()) + 1
            if not end:
                stack[-1].items.append(page[start:])
                break
        else:
            end = whole.end()
        tag, attrs, at = name[0].lower(), page[name.end() : end - 1], end
        if closing:
            depth = last(tag)
            if depth and (tag in BLOCK or depth > blocks[-1]):
                drop(depth)
            continue
        if tag in BLOCK:
            if last("p") > walls[-1]:
                drop(last("p"))
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                drop(len(stack) - 1)
        if tag in CLOSES and last(*CLOSES[tag]) > last(*FENCES):
            drop(last(*CLOSES[tag]))
        node = Node(tag, bool(attrs) and _is_role(tag, attrs))
        stack[-1].items.append(node)
        nodes.append(node)
        if tag in RAW:
            m = _ENDS[tag].search(page, at)
            if tag not in GONE:
                node.items.append(page[at : m.start() if m else n])
            close = page.find(">", m.end()) if m else -1
            at = n if close < 0 else close + 1
        elif tag not in VOID and not attrs.endswith("/"):
            k = len(stack)
            open_at.setdefault(tag, []).append(k)
            if tag in BLOCK:
                blocks.append(k)
                if tag != "p" and tag not in HEADINGS:
                    walls.append(k)
            stack.append(node)
    return nodes


def _flat(text: str) -> str:
    return _BLANK.sub(" ", html.unescape(text)).strip()


def measure(nodes: list[Node]) -> None:
    """Sets each node's hash (of tag, text and child hashes; 0 without text), its links and its characters, bottom up."""
    for node in reversed(nodes):
        parts, told = [node.tag], False
        for x in node.items:
            if isinstance(x, Node):
                told = told or x.hash != 0
                parts.append(f"\x01{x.hash}")
                node.links += x.links + (x.tag == "a")
                node.linked += x.linked
                node.size += x.size
            elif t := _flat(x):
                told = True
                parts.append("\x02" + t)
                node.size += len(t)
        if node.tag == "a":
            node.linked = node.size
        if told:
            node.hash = int.from_bytes(hashlib.blake2b("".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def subtrees(nodes: list[Node]) -> set[int]:
    """Hashes of the block subtrees below the body: all that can be deleted."""
    return {x.hash for x in nodes if x.hash and x.tag in BLOCK and x.tag not in ("html", "body")}


def is_template(x: Node, level: int, inside: bool) -> bool:
    """``level``: 1 if the subtree is on some of its host's pages, 2 on half of them, 3 on nearly all of many."""
    if x.tag not in BLOCK:
        return False
    if inside:
        return level == 3 or level == 2 and (x.tag in BOXES or x.tag in LISTS and x.links > 0)
    menu = (x.tag in BOXES or x.tag in LISTS) and x.links >= LINKS and x.linked >= LINKED * x.size
    return level >= 2 or level == 1 and menu


def _page_forms(nodes: list[Node]) -> set[int]:
    """Forms that the page stands in: they hold a place to read, or over half of the text that is not of a marked part."""
    if not any(x.tag == "form" for x in nodes):
        return set()
    size: dict[int, int] = {}
    places: set[int] = set()
    for node in reversed(nodes):
        total = 0
        for x in node.items:
            if not isinstance(x, Node):
                total += len(x.strip())
            elif not (x.role or x.tag in GONE and x.tag not in ("form", "header")):
                total += size[id(x)]
                if x.tag in ("article", "main") or id(x) in places:
                    places.add(id(node))
        size[id(node)] = total
    return {id(x) for x in nodes if x.tag == "form" and (id(x) in places or 2 * size[id(x)] > size[id(nodes[0])])}


def _kept(nodes: list[Node], levels: dict[int, int]) -> list[tuple[Node, bool]]:
    """Nodes in page order that neither recurrence nor marks delete, with whether they are in an article; what a deleted one holds goes too.

    A form stays if it holds a place to read or most of the page, an article's own header always.
    """
    out, todo = [], [(nodes[0], False)]
    forms = _page_forms(nodes)
    while todo:
        node, inside = todo.pop()
        out.append((node, inside))
        inside = inside or node.tag in ("article", "main")
        stays = []
        for x in node.items:
            if isinstance(x, Node):
                spared = id(x) in forms or x.tag == "header" and inside
                if not spared and (x.tag in GONE or x.role) or is_template(x, levels.get(x.hash, 0), inside):
                    x.items = []
                    x.tag = "#block" if x.tag in BLOCK else "#gone"
                else:
                    stays.append((x, inside))
        todo += reversed(stays)
    return out


def lines(top: Node) -> list[str]:
    """Flattened blocks of a node in page order."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = _flat("".join(line))
        if text:
            out.append(text)
        line.clear()

    todo: list[Node | str | None] = [None, *reversed(top.items)]
    while todo:
        x = todo.pop()
        if x is None or isinstance(x, Node) and x.tag == "#block":
            close()
        elif not isinstance(x, Node):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in BLOCK:
            close()
            todo += [None, *reversed(x.items)]
        elif x.tag not in VOID and x.tag != "title":
            todo += reversed(x.items)
    return out


def extract(page: str | None, levels: dict[int, int] | None = None) -> str:
    """The main text. ``levels``: how far each recurring hash of the page's host recurs (see ``is_template``)."""
    if not page:
        return ""
    nodes = parse(page)
    if levels:
        measure(nodes)
    kept = _kept(nodes, levels or {})
    articles = [x for x, inside in kept if x.tag == "article" and not inside]
    wide = [x for x, inside in kept if x.tag == "main" and not inside] or [nodes[0]]
    if articles:
        held = [lines(x) for x in articles]
        count = lambda parts: sum(len(line) for part in parts for line in part)
        if count(held) >= OWN * count(map(lines, wide)):
            return "\n".join(line for part in held for line in part)
        for x in articles:  # cards beside the text
            x.items, x.tag = [], "#block"
    return "\n".join(line for top in wide for line in lines(top))


def host(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns before the last one, a page, with each hash on it."""
    for batch in batches:
        found, size = [], []
        for page in batch.column(batch.num_columns - 1):
            own = []
            if page.is_valid and page.as_py():
                nodes = parse(page.as_py())
                measure(nodes)
                own = sorted(subtrees(nodes))
            found += own
            size.append(len(own))
        where = pa.array([k for k, s in enumerate(size) for _ in range(s)], pa.int64())
        kept = [c.take(where) for c in batch.columns[:-1]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.int64())], names=[*batch.schema.names[:-1], "hash"])


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, hash, level): subtrees that recur, by their share of the host's distinct pages that are not blank."""
    keyed = pages.where(F.trim(html_col) != "").select(host(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("page"), F.col(html_col).alias("html"))
    met = keyed.mapInArrow(_hashes, "host string, page bigint, hash bigint").distinct()
    seen = met.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    sizes = keyed.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("all"))
    share = F.col("n") / F.col("all")
    level = F.when((share >= MOST) & (F.col("all") >= MANY), 3).when(share >= SITE, 2).otherwise(1)
    return seen.join(sizes, "host").where(share >= SHARE).select("host", "hash", level.alias("level"))


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", small: int = SMALL
) -> DataFrame:
    """(page_id, url, text) of every page."""
    from pyspark.sql import types as T

    from tidemark.llm.common import discard, materialize

    spark = pages.sparkSession
    known = materialize(templates(pages, url_col, html_col))
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host")
    )
    kinds = rows.schema
    schema = T.StructType([kinds["page_id"], kinds["url"], T.StructField("text", T.StringType())])

    def emit(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(out.field(0).type), batch.column(1).cast(out.field(1).type), pa.array(texts, pa.string())], schema=out)

    if known.limit(small + 1).count() <= small:
        by_host: dict[str, dict[int, int]] = {}
        for r in known.collect():
            by_host.setdefault(r["host"], {})[r["hash"]] = r["level"]
        discard(known)
        shared = spark.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield emit(batch, [extract(p.as_py(), shared.value.get(h.as_py())) for p, h in zip(batch.column(2), batch.column(3))])

        return rows.mapInArrow(run, schema)

    keyed = rows.withColumn("key", F.xxhash64("url", "html"))
    pairs = keyed.select("key", "host", "html").mapInArrow(_hashes, "key bigint, host string, hash bigint")
    own = pairs.distinct().join(known, ["host", "hash"]).groupBy("key").agg(F.collect_set(F.struct("hash", "level")).alias("levels"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), {x["hash"]: x["level"] for x in found.as_py() or ()}) for p, found in zip(batch.column(2), batch.column(3))]
            yield emit(batch, texts)

    return keyed.join(own, "key", "left").select("page_id", "url", "html", "levels").mapInArrow(run_joined, schema)
