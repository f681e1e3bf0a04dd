"""Main text of pages: site template removal.

A page is parsed once, tolerantly, into blocks of text and the containers around
them; each container's subtree has a hash, and Spark counts on how many pages of its host each
hash comes. Subtrees that recur across many pages of a host are its template, and
go. What is no article by its name, role or class (menus, site headers, footers, sidebars,
notices, adverts, forms, reader comments, scripts, styles) goes on pages of any host,
also where a host has too few pages to tell. Elements that call themselves article or main
say where to look: where a page has any, the outermost of them are its text, and a headline
before them if they have none; where it has none, all that is left is.

A page counts once for a hash, and pages whose articles are equal count once
together, so an article that was copied to many addresses is no template. Running text
(a paragraph, heading, list item, cell or quotation by itself) is no template either: what recurs of
it is a passage that articles share. Nor is what holds most of an article.

Defined results. A null html is an empty page: empty text, n_chars 0. Unclosed and
stray tags are read as browsers do, about; a quote that is never closed ends with its tag; a
cut-off page is read as far as it goes. Time is in proportion to a page's length.
The host of a null or odd url is empty, and such pages share it. Rows that repeat
are extracted each; a null page_id is kept. An empty table gives no rows. Columns
other than page_id, url and html are not read.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: A subtree is template if it recurs across so many different articles of a host: this many at least, and the fourth
#: root of the host's articles, so that the bar hardly rises with a host's size.
TEMPLATE_PAGES, TEMPLATE_ROOT = 5, 0.25
NOISE_TAGS = frozenset("script style noscript template nav footer aside menu dialog button select textarea input iframe object embed svg canvas head title link meta base video audio".split())
RAW_TAGS = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option br".split())
#: Elements of running text, or within a line: no template by themselves.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre caption figcaption summary option br hr article main body html a b i u s em strong span small sub sup code kbd samp var q cite abbr time mark label font img picture ins del big tt strike bdi bdo data dfn ruby rt rp wbr".split())
#: An element that opens closes these first, if they are open in the same container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
CONTAINERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
CLOSES_P = BLOCK_TAGS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option"}
HOLDS_P = {"button", "table", "object", "div", "article", "section", "li", "blockquote", "td", "th"}
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog".split())
#: Parts of a class or id. A name is no article if all its parts are known and one says so: strong ones beside parts of any
#: kind, weak ones (an article has a header too) beside parts that say nothing.
STRONG = frozenset("ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies consent gdpr footer masthead menu menus nav navbar navigation newsletter pager pagination popup modal promo promoted related recommended replies respond share sharing sidebar sponsor sponsored subscribe subscription toolbar widget widgets paywall overlay".split())
WEAK = frozenset("header head foot legal copyright disclaimer notice notices notification alert social side login signup reply".split())
PLAIN = frozenset("site page top bottom left right main global primary secondary wrapper wrap container inner outer box block area section bar list item items row col column content body button buttons link links panel form title text module unit slot zone group nav js is has the of my app web mobile desktop sticky fixed small large full first last new".split())
OF_ARTICLES = frozenset("article articles post posts entry story stories blog news".split())

TAG = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<decl>[!?][^>]*(?:>|\Z))|/(?P<end>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|(?P<start>[A-Za-z][^\s/>]*)(?:(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|(?P<broken>[^>]*)(?:>|\Z)))",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")
SPACE = re.compile(r"\s+")
SAYS = re.compile(r"class|id\s*=|role|hidden|style", re.IGNORECASE)


class Element:
    __slots__ = ("tag", "attrs", "children", "digest", "size", "hint")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.digest, self.size, self.hint = b"", 0, False

    def attributes(self) -> dict[str, str]:
        """By name, in lower case; the first of a name counts."""
        out: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(self.attrs):
            out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        return out


class Stack:
    """Open elements, and where those of each tag are, so that closing one does not search all."""

    def __init__(self, root: Element):
        self.open, self.places = [root], {}

    def push(self, node: Element) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def cut(self, place: int) -> None:
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()

    def end(self, tag: str) -> None:
        """Closes the innermost open element of a tag, and all within it."""
        if self.places.get(tag):
            self.cut(self.places[tag][-1])

    def close(self, tags: set[str], within: set[str]) -> None:
        """Closes the outermost of the open elements that are one of tags, up to the innermost of within."""
        wall = max((self.places[t][-1] for t in within if self.places.get(t)), default=0)
        found = [own[k] for t in tags if (own := self.places.get(t)) and (k := bisect_right(own, wall)) < len(own)]
        if found:
            self.cut(min(found))


def parse(page: str) -> Element:
    """A page's tree. Children are elements and decoded strings; comments and declarations are dropped."""
    root = Element("", "")
    stack, at = Stack(root), 0

    def text(raw: str) -> None:
        if raw:
            stack.open[-1].children.append(entities.unescape(raw))

    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m["comment"] is not None or m["decl"] is not None:
            continue
        if m["end"]:
            stack.end(m["end"].lower())
            continue
        tag = m["start"].lower()
        if tag in CLOSES_P:
            stack.close({"p"}, HOLDS_P)
        if tag in CLOSES:
            stack.close(CLOSES[tag], CONTAINERS[tag])
        node = Element(tag, m["attrs"] if m["attrs"] is not None else m["broken"].replace('"', " ").replace("'", " "))
        stack.open[-1].children.append(node)
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            raw = page[at : end.start() if end else len(page)]
            node.children.append(entities.unescape(raw) if tag in ("title", "textarea") else raw)
            at = end.end() if end else len(page)
        elif tag not in VOID_TAGS and (not node.attrs.endswith("/") or tag in BLOCK_TAGS):
            stack.push(node)
    text(page[at:])
    return root


def walk(root: Element) -> list[Element]:
    """Elements, each before its children, without recursion: pages may be nested deeply."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Element)]
    return out


def hash_tree(root: Element) -> list[Element]:
    """Sets each element's digest, the length of its text and whether it holds an article; returns them, each before its children."""
    nodes = walk(root)
    for node in reversed(nodes):
        h = hashlib.blake2b(f"{node.tag} {SPACE.sub(' ', node.attrs).strip()}".encode("utf-8", "surrogatepass"), digest_size=8)
        node.size, node.hint = 0, node.tag in ("article", "main")
        for c in node.children:
            if isinstance(c, Element):
                h.update(b"\0" + c.digest)
                node.size += c.size if c.tag not in NOISE_TAGS else 0
                node.hint |= c.hint
            else:
                words = SPACE.sub(" ", c).strip()
                h.update(b"\1" + words.encode("utf-8", "surrogatepass"))
                node.size += len(words)
        node.digest = h.digest()
    return nodes


@functools.lru_cache(4096)
def noise_name(name: str) -> bool:
    """Whether a class or id says that it is no article."""
    parts = {p.lower() for p in PARTS.findall(name)}
    if parts & STRONG:
        return parts <= STRONG | WEAK | PLAIN | OF_ARTICLES
    return bool(parts & WEAK) and parts <= WEAK | PLAIN


def noise(node: Element, inside: bool, page: int) -> bool:
    """Whether an element is no article by its name, role, class or id. inside: of an article; page: length of the page's text."""
    if node.tag in NOISE_TAGS:
        return True
    if node.tag == "header":
        return not inside and not node.hint
    if node.tag == "form":  # some sites hold all of a page in a form
        return not node.hint and 2 * node.size <= page
    if node.tag in ("html", "body", "main", "") or not node.attrs or not SAYS.search(node.attrs) or node.hint and not (node.tag == "article" and inside):
        return False
    a = node.attributes()
    if "hidden" in a or a.get("role", "").lower() in NOISE_ROLES or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    return any(noise_name(x) for x in a.get("class", "").split()) or noise_name(a.get("id", ""))


def is_hint(node: Element) -> bool:
    return node.tag in ("article", "main") or "main" in node.attrs and node.attributes().get("role", "").lower() == "main"


class Page:
    """Blocks of text in page order, and the containers around them that may be template: digest, first block, end."""

    def __init__(self, html: str | None):
        root = parse(html or "")
        nodes = hash_tree(root)
        self.blocks: list[str] = []
        self.containers: list[tuple[bytes, int, int]] = []
        self.line: list[str] = []
        hinted = root.hint or any("main" in n.attrs and is_hint(n) for n in nodes)
        self.read(root, root.size, hinted)
        if hinted and not self.blocks:  # what calls itself article is empty, or noise
            self.containers.clear()
            self.read(root, root.size, False)
        self.article = hashlib.blake2b("\n".join(self.blocks).encode("utf-8", "surrogatepass"), digest_size=8).digest()

    def end(self) -> None:
        if words := SPACE.sub(" ", "".join(self.line)).strip():
            self.blocks.append(words)
        self.line.clear()

    def read(self, root: Element, page: int, hinted: bool) -> None:
        """hinted: only what is in article or main elements, and a headline before them, is read."""
        headline = None  # block place of a headline outside
        headed = False
        # Of each open element: the element, whether it is being left, the article it is in, and the first block.
        todo: list = [(root, False, None, 0)]
        while todo:
            node, leaving, top, first = todo.pop()
            if isinstance(node, str):
                if top is not None or not hinted:
                    self.line.append(node)
                continue
            block = node.tag in BLOCK_TAGS and node.tag != "br" or node.tag not in TEXT_TAGS
            if leaving:
                if block:
                    self.end()
                if len(self.blocks) > first and node.tag not in TEXT_TAGS and node.tag and (top is None or top is not node and 2 * node.size <= top.size):
                    self.containers.append((node.digest, first, len(self.blocks)))
                continue
            if node is not root and noise(node, top is not None, page):
                if block:
                    self.end()
                continue
            if block:
                self.end()
            if node.tag == "br":
                self.line.append(" ")
                continue
            if hinted and top is None and is_hint(node):
                top = node
            headed |= top is not None and node.tag == "h1"
            if hinted and top is None and node.tag == "h1" and headline is None and not headed:
                # Its own digest makes it template if it is the site's name.
                headline = len(self.blocks)
                before, self.blocks = self.blocks, []
                inner = Page.__new__(Page)
                inner.blocks, inner.containers, inner.line = [], [], []
                inner.read(node, page, False)
                self.blocks = before + inner.blocks
                if inner.blocks:
                    self.containers.append((node.digest, headline, len(self.blocks)))
                continue
            todo.append((node, True, top, len(self.blocks)))
            todo += [(c, False, top, 0) for c in reversed(node.children)]
        self.end()
        if headline is not None and headed:  # the article has a headline of its own
            gone = next((e - s for d, s, e in self.containers if s == headline), 0)
            del self.blocks[headline : headline + gone]
            shift = lambda x: x - gone if x > headline else x
            self.containers = [(d, shift(s), shift(e)) for d, s, e in self.containers if shift(e) > shift(s)]

    def text(self, template: set[bytes] | frozenset[bytes] = frozenset()) -> str:
        """Blocks that no template container holds, joined."""
        if not template:
            return "\n".join(self.blocks)
        return kept(self.blocks, [(s, e) for d, s, e in self.containers if d in template])


def kept(blocks: list[str], gone: list[tuple[int, int]]) -> str:
    """Blocks outside of the stretches gone, joined; one sweep."""
    out, at = [], 0
    for s, e in sorted(gone):
        if s > at:
            out += blocks[at:s]
        at = max(at, e)
    return "\n".join(out + blocks[at:])


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def main_text(page: str | None, template: frozenset[bytes] = frozenset()) -> str:
    return Page(page).text(template)


def read_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """A row for each page: its id and url, row, host, article (a digest), blocks, and containers (digest, first block, end)."""
    keys = f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` string, row long"
    stretch = pa.list_(pa.struct([("digest", pa.int64()), ("first", pa.int32()), ("end", pa.int32())]))
    number = lambda d: int.from_bytes(d, "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                seen = [Page(x.as_py()) for x in part.column(3)]
                cols = [
                    pa.array([host_of(u.as_py()) for u in part.column(1)], pa.string()), pa.array([number(p.article) for p in seen], pa.int64()), pa.array([p.blocks for p in seen], pa.list_(pa.string())),
                    pa.array([[{"digest": number(d), "first": s, "end": e} for d, s, e in p.containers] for p in seen], stretch),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *cols], names=[id_col, url_col, "row", "host", "article", "blocks", "containers"])

    return small_batches(pages).select(id_col, url_col, F.monotonically_increasing_id().alias("row"), html_col).mapInArrow(
        run, f"{keys}, host string, article long, blocks array<string>, containers array<struct<digest: long, first: int, end: int>>"
    )


def templates(read: DataFrame) -> DataFrame:
    """host, digest of the subtrees that recur on a host.

    Rows are (host, digest, article) once each, then counted: both groupings are by a digest, and tasks send partial
    counts, so no host is gathered in one task.
    """
    rows = read.select("host", "article", F.explode(F.array_distinct(F.transform("containers", lambda c: c["digest"]))).alias("digest")).distinct()
    counts = rows.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {TEMPLATE_PAGES}")
    hosts = read.select("host", "article").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("articles"))
    return counts.join(hosts, "host").where(F.col("n") >= F.pow("articles", F.lit(TEMPLATE_ROOT))).select("host", "digest")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page.

    Pages are parsed once, and what was read of them is written. What of a page is template comes from a join of narrow rows
    (row, host, digest); only pages that have any are joined with it.
    """
    read = materialize(read_pages(pages, id_col, url_col, html_col), "pages")
    known = materialize(templates(read), "templates")
    each = read.select("row", "host", F.explode(F.array_distinct(F.transform("containers", lambda c: c["digest"]))).alias("digest"))
    gone = materialize(each.join(known, ["host", "digest"], "left_semi").groupBy("row").agg(F.collect_list("digest").alias("template")), "recurring")
    schema = f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = []
                for blocks, containers, template in zip(part.column(2), part.column(3), part.column(4)):
                    marks = set(template.as_py() or ())
                    stretches = [(c["first"], c["end"]) for c in containers.as_py() if c["digest"] in marks] if marks else []
                    texts.append(kept(blocks.as_py(), stretches))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return read.join(gone, "row", "left").select(id_col, url_col, "blocks", "containers", "template").mapInArrow(run, schema)


def op3_html(spark, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
