"""Main text of web pages: site template removal by subtree hashes, then the blocks of the article.

A page is parsed into elements, and the subtrees of its blocks are hashed. Spark counts for each host on how many pages
a subtree recurs. Recurring alone doesn't make a template: near copies of one article share their paragraphs, too. So a
page has a say only if at least half of its text is its own, and a subtree that enough such pages share is deleted from
every page of the host. What is left is the text of the article elements, or else of the main one, or else of the page,
without what tags, roles and plain class names mark as something else.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterfold.llm.common import dim_join, materialised, ship
from meterfold.llm.ragged import tidy

#: Fixed values of HTML: elements without content, with raw text, and those that break text into blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
CELL = frozenset(["td", "th", "br"])
#: Elements that a new one of the listed kinds closes, unless one of the stops lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("table ul ol dl div section article main body html select menu".split())
CELL_STOPS = frozenset(["td", "th"])
ENDS_P = BLOCK - {"html", "body", "head", "caption", "tbody", "tfoot", "thead", "tr", "legend", "figcaption", "summary"}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt tr figcaption".split())
#: Elements and roles that don't belong to the article.
DROPPED = frozenset("nav footer aside form script style noscript template head title iframe svg canvas button select textarea input object embed dialog menu search audio video annotation annotation-xml xmp noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Class names and ids that say so as they stand; beside other words than PLACES and PARTS they are a hint only.
DROPPED_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr newsletter subscribe subscription social share sharing comment comments disqus related recommended recommendations popup modal pagination pager skip notice notification reply replies respond teaser teasers copyright colophon".split())
DROPPED_NAMES = frozenset("header site-header page-header masthead topbar logo branding user-notes reader-notes user-comments".split())
#: Names that say so of the outermost blocks of a page only, where these hold no heading.
EDGES = frozenset("top bottom head foot".split())
#: Names that a paragraph of an article may have and still be one.
LOOSE = frozenset("share sharing social banner menu pager skip respond".split())
#: Names by which an article is none of the page's own: a reader's comment, or a hint at another page.
NO_ARTICLE = frozenset("comment comments reply replies teaser teasers related recommended recommendations promo promotion sponsored sponsor ad ads advert advertisement".split())
#: What stands before or behind such a word in the name of a part of a page, and leaves it what it is.
PLACES = frozenset("site page post article entry main top bottom left right global primary secondary user reader content".split())
PARTS = frozenset("area bar block body box card entry button buttons container content form group inner item items line link links list message messages outer overlay panel posts section slot text thread title unit widget widgets wrap wrapper".split())
KEPT = frozenset(["html", "body", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: The rest of a tag. A quote opens a value behind an equals sign only; nothing is tried twice, so bad markup costs no more.
REST = re.compile(r"""(?>[^>="']++|=\s*+(?:"[^"]*"|'[^']*')|[="'])*+>""")
ATTRIBUTE = re.compile(r"""([^\s/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]++)))?""")
TELLING = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
SEAMS = re.compile(r"[-_:]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass(frozen=True)
class Params:
    """A subtree is part of the template if so many pages of its host share it that differ in half of their text or more."""

    least: int = 5


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    dropped: bool = False
    hinted: bool = False  # its names hint that it isn't part of the article
    inside: bool = False  # in an article or main element
    edge: bool = False  # its tag or names say so if it is at the edge of the page
    main: str = ""
    parts: list = field(default_factory=list)  # texts and numbers of child elements, in order


def _all_known(pieces: list[str], said: frozenset[str]) -> bool:
    """Whether one of a name's pieces says so, and the others are places or kinds of part."""
    return not said.isdisjoint(pieces) and all(x in said or x in PLACES or x in PARTS for x in pieces)


def _named(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool, str]:
    """Whether an element of this tag and these attributes goes, whether its names hint so or say so of the page's edge, and if it says that it is the main one."""
    if tag in DROPPED:
        return True, False, False, ""
    edge = tag == "header" and not inside
    if not TELLING.search(attributes):
        return False, False, edge, ""
    main, hinted = "", False
    loose = LOOSE if inside and tag in PROSE else frozenset()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            if value == "main":
                main = "main"
            elif value in DROPPED_ROLES and tag not in KEPT and tag != "article":
                return True, False, False, ""
        elif name in ("class", "id") and tag not in KEPT:
            for word in value.split():
                pieces = [x for x in SEAMS.split(word) if x and not x.isdigit()]
                if tag == "article":
                    if _all_known(pieces, NO_ARTICLE):
                        return True, False, False, ""
                elif word in loose:
                    continue
                elif word in DROPPED_NAMES or word in DROPPED_WORDS or _all_known(pieces, DROPPED_WORDS):
                    return True, False, False, ""
                else:
                    edge = edge or word in EDGES and not inside
                    hinted = hinted or tag not in PROSE and not DROPPED_WORDS.isdisjoint(pieces)
        elif name == "hidden" or name == "style" and UNSEEN.search(value):
            return True, False, False, ""
    return False, hinted, edge, main


@lru_cache(maxsize=32)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}", re.IGNORECASE)


class _Open:
    """The open elements, and where those of each tag stand among them, so that none is searched for."""

    def __init__(self):
        self.path, self.tags, self.of, self.stops, self.cells = [0], [""], defaultdict(list), [0], []

    def push(self, element: int, tag: str) -> None:
        at = len(self.path)
        self.path.append(element)
        self.tags.append(tag)
        self.of[tag].append(at)
        if tag in STOPS:
            self.stops.append(at)
        elif tag in CELL_STOPS:
            self.cells.append(at)

    def close(self, upto: int) -> None:
        while len(self.path) > upto:
            self.path.pop()
            tag = self.tags.pop()
            self.of[tag].pop()
            if tag in STOPS:
                self.stops.pop()
            elif tag in CELL_STOPS:
                self.cells.pop()

    def close_last(self, tags: tuple[str, ...], after: int) -> None:
        """Close the innermost open element of these tags that stands after another."""
        last = max((self.of[t][-1] for t in tags if self.of[t]), default=0)
        if last > after:
            self.close(last)

    def close_implied(self, tag: str) -> None:
        """Close what a new element of this tag ends."""
        stop, cell = self.stops[-1], self.cells[-1] if self.cells else 0
        if tag in ENDS_P:
            self.close_last(("p",), max(stop, cell))
        if tag == "tr":
            firsts = [own[k] for own in (self.of["tr"], self.of["td"], self.of["th"]) if (k := bisect_right(own, stop)) < len(own)]
            if firsts:
                self.close(min(firsts))
        elif tag in CLOSES:
            self.close_last(CLOSES[tag], stop if tag in CELL_STOPS else max(stop, cell))


def parse(page: str) -> list[Element]:
    """Elements of a page in the order in which they open; the first is the document. Bad markup never fails.

    One scan forward: a tag ends at the first > outside of quoted values, or at the first one if no other is found.
    """
    elements = [Element("#document", -1)]
    opened = _Open()
    at, end, last, loose = 0, len(page), page.rfind(">"), False

    def text(raw: str) -> None:
        elements[opened.path[-1]].parts.append(entities.unescape(raw) if "&" in raw else raw)

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        if page.startswith("<!--", lt):
            close_at = page.find("-->", lt + 2)
            at = end if close_at < 0 else close_at + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            close_at = page.find(">", lt)
            at = end if close_at < 0 else close_at + 1
            continue
        name = NAME.match(page, lt) if lt < last else None
        if not name:
            text("<")
            at = lt + 1
            continue
        rest = None if loose else REST.match(page, name.end())
        if rest:
            at = rest.end()
        else:
            loose, at = True, page.find(">", name.end()) + 1
        tag, attributes = name[1].lower(), page[name.end() : at - 1]
        if page[lt + 1] == "/":
            if opened.of[tag]:
                opened.close(opened.of[tag][-1])
            continue
        opened.close_implied(tag)
        number = opened.path[-1]
        parent = elements[number]
        inside = parent.inside or parent.main != ""
        dropped, hinted, edge, main = _named(tag, attributes, inside)
        own = Element(tag, number, dropped or parent.dropped, hinted, inside, edge, tag if tag in ("article", "main") else main)
        number = len(elements)
        parent.parts.append(number)
        elements.append(own)
        if tag in RAW:
            stop = _end_of(tag).search(page, at)
            to = stop.start() if stop else end
            if tag in ("textarea", "title"):
                own.parts.append(entities.unescape(page[at:to]))
            gt = page.find(">", to)
            at = end if not stop or gt < 0 else gt + 1
        elif tag not in VOID:
            opened.push(number, tag)
    _follow_hints(elements)
    return elements


def _follow_hints(elements: list[Element]) -> None:
    """Drop what hints and edges decide by structure; what lies in a dropped element is dropped.

    A hinted element outside of articles goes if half of it or more is links. One at the edge goes if it has no heading, or is a child of the body and something else on the page has one.
    """
    if not any(e.hinted or e.edge for e in elements):
        return
    n = len(elements)
    size, links, headings, articles = [0] * n, [0] * n, [0] * n, [0] * n
    for k in range(n - 1, 0, -1):
        own = elements[k]
        size[k] += sum(len(x) for x in own.parts if isinstance(x, str))
        if own.tag == "a":
            links[k] = size[k]
        if not own.dropped:
            headings[k] += own.tag in HEADINGS
            articles[k] += own.main != ""
            for count in (size, links, headings, articles):
                count[own.parent] += count[k]
    for k, own in enumerate(elements):
        if own.hinted and not own.inside and 2 * links[k] >= size[k]:
            own.dropped = True
        if own.edge and not articles[k]:
            outermost = k > 0 and elements[own.parent].tag in ("html", "body")
            own.dropped = own.dropped or not headings[k] or own.tag == "header" and outermost and headings[0] > headings[k]
        own.dropped = own.dropped or k > 0 and elements[own.parent].dropped


def subtrees(elements: list[Element]) -> list[tuple[int, int, int, bool]]:
    """Number, hash, characters of its own and whether it may be a template, of each block that isn't dropped.

    Characters of inline elements count to the block around them. Prose inside an article never is a template, so that
    a passage which several articles quote stays in them.
    """
    hashes, sizes = [b""] * len(elements), [0] * len(elements)
    out = []
    for k in range(len(elements) - 1, 0, -1):  # children come after their parents
        own = elements[k]
        if own.dropped:
            continue
        h = xxhash.xxh64(own.tag)
        for part in own.parts:
            if isinstance(part, int):
                h.update(hashes[part])
            elif words := " ".join(part.split()):
                h.update(words.encode("utf-8", "replace") + b"\0")
                sizes[k] += len(words)
        hashes[k] = h.digest()
        if own.tag in BLOCK and own.tag not in ("html", "body", "head", "hr"):
            out.append((k, h.intdigest() - (1 << 63), sizes[k], not (own.inside and own.tag in PROSE)))
        else:
            sizes[own.parent] += sizes[k]
    return out


def main_text(elements: list[Element], deleted: frozenset[int] = frozenset()) -> str:
    """Blocks of the articles, or else of the main elements, or else of the page, without what was deleted."""

    def blocks(root: int) -> list[str]:
        out, run = [], []

        def flush() -> None:
            if words := " ".join("".join(run).split()):
                out.append(words)
            run.clear()

        stack = [(root, 0)]
        while stack:
            k, at = stack.pop()
            own = elements[k]
            if not at and own.tag in BLOCK:
                flush()
            elif not at and own.tag in CELL:
                run.append(" ")
            for i in range(at, len(own.parts)):
                part = own.parts[i]
                if isinstance(part, str):
                    run.append(part)
                elif not elements[part].dropped and part not in deleted:
                    stack += [(k, i + 1), (part, 0)]
                    break
                elif elements[part].tag in BLOCK:
                    flush()
                elif elements[part].tag in CELL:
                    run.append(" ")
            else:
                if own.tag in BLOCK:
                    flush()
                elif own.tag in CELL:
                    run.append(" ")
        flush()
        return out

    roots = {"article": [], "main": []}
    gone, within = bytearray(len(elements)), {kind: bytearray(len(elements)) for kind in roots}
    for k, own in enumerate(elements):
        gone[k] = own.dropped or k in deleted or k > 0 and gone[own.parent]
        for kind, inner in within.items():
            inner[k] = k > 0 and (inner[own.parent] or elements[own.parent].main == kind)
            if own.main == kind and not gone[k] and not inner[k]:
                roots[kind].append(k)
    return "\n\n".join(b for k in roots["article"] or roots["main"] or [0] for b in blocks(k))


def templates(found: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(host, hash) of the subtrees that are templates, and the rows of found that recur at all.

    found: page, host, element, hash, size, able; pages of equal html on a host are one page.
    """
    pages = found.groupBy("host", "hash", "page").agg(F.count("*").alias("n")).groupBy("host", "hash").agg(F.count("*").alias("n_pages"))
    recurring = materialised(pages.where(F.col("n_pages") >= p.least).select("host", "hash"), "recurring")
    again = materialised(dim_join(found, recurring, ["host", "hash"], "inner"), "again")
    shared = again.groupBy("page").agg(F.sum("size").alias("shared"))
    own = found.groupBy("page").agg(F.sum("size").alias("size"))
    voters = shared.join(own, "page").where(2 * F.col("shared") <= F.col("size")).select("page")
    votes = again.where("able").groupBy("host", "hash", "page").agg(F.count("*").alias("n")).join(voters, "page", "left_semi")
    return votes.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= p.least).select("host", "hash"), again


def extract(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages; other columns aren't carried.

    A null or empty html gives an empty text. A page without a host in its url belongs to the host ''. Rows of equal
    html on a host count as one page and give equal results.
    """
    ship(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    keyed = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), host.alias("host"))
    keyed = keyed.withColumn("page", F.xxhash64("host", "html"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page": pa.int64(), "host": pa.string(), "element": pa.int32(), "hash": pa.int64(), "size": pa.int64(), "able": pa.bool_()}
        for batch in batches:
            out = [(page, host, *row) for page, host, html in zip(*(batch.column(k).to_pylist() for k in ("page", "host", "html")), strict=True) for row in subtrees(parse(html))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    found = keyed.select("page", "host", "html").mapInArrow(tidy(rows), "page long, host string, element int, hash long, size long, able boolean")
    found = materialised(found, "subtrees")
    hashes, again = templates(found, p)
    hashes = materialised(hashes, "templates")
    marks = dim_join(again.where("able"), hashes, ["host", "hash"], "inner").groupBy("page").agg(F.collect_set("element").alias("deleted"))
    marks = materialised(marks, "marks")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(parse(html), frozenset(deleted or ())) for html, deleted in zip(batch.column("html").to_pylist(), batch.column("deleted").to_pylist(), strict=True)]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    joined = dim_join(keyed, marks, ["page"], weight=F.size("deleted"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "deleted").mapInArrow(tidy(texts), f"page_id {kind}, url string, text string, n_chars long")
