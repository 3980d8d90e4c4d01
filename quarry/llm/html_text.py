"""Main text of web pages, with the templates of sites removed.

Each element's subtree is hashed and the hashes are counted per host in Spark.
A subtree that recurs on most pages of a host is template.  So is a *slot*, the
path of names and classes that leads to an element, whose subtrees recur on
their hosts often enough: menus and adverts are filled anew from page to page,
and what is seen once is deleted with what is seen often.  Recurrence counts
only where the elements around differ, so that copies of a page make no
template of its paragraphs.  An element with an article in it is never
template, nor is a slot that mostly holds most of its page's text.  Markup that names furniture (menus, headers,
footers, side bars, notices, adverts, forms, scripts, reader comments) is a
second means.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import Rows
from quarry.llm.scratch import discard, materialise
from quarry.llm.url_filter import host_of

#: A subtree is template if it is on so many pages of its host at least, and on this share of them.
LEAST_PAGES, SHARE = 10, 0.5
#: A slot is template if so many of its elements, and this share of them, recur: have a subtree that is on ``RECURS`` pages of the host.
LEAST_ELEMENTS, SLOT_SHARE, RECURS = 30, 0.15, 3
MOST_BROADCAST = 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("aside audio button canvas datalist dialog footer form head header iframe input menu nav noscript object script select style svg template textarea title video".split())
NAMES = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo recommended related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: What they hold is no text of the page.
SILENT = frozenset("head script style template noscript svg iframe object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that begins closes an open one of these kinds, up to the nearest of the others.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ol ul menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
_PARTS = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(HTMLParser):
    """A forgiving tree: end tags that match nothing are dropped, missing ones are supplied."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]

    def _close(self, kinds: frozenset[str], until: frozenset[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in kinds:
                del self.open[k:]
                return
            if tag in until:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in BLOCKS:
            self._close(frozenset(["p"]), frozenset("article aside body button caption div footer header main nav section table td th".split()))
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path"):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            # An inline end tag does not close the block around it, nor a paragraph's end the article.
            if self.open[k].tag in BLOCKS and tag not in BLOCKS or self.open[k].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def slot_of(above: str, node: Node) -> str:
    """The path to the node, of names and classes."""
    return f"{above}/{node.tag}.{'.'.join(sorted(node.attrs.get('class', '').lower().split()))}"


class Subtree:
    """Hash of a block element with text (names, classes and text), and of the element around it; its slot, the size of its text, whether an article is in it."""

    __slots__ = ("around", "article", "hash", "size", "slot")


def subtrees(root: Node) -> dict[int, Subtree]:
    """The subtrees of a page by the id of their node."""
    found: dict[int, Subtree] = {}
    stack: list[tuple[Node, str, bool]] = [(root, "", False)]
    done: dict[int, tuple[bytes, int, bool]] = {}
    while stack:
        node, slot, ready = stack.pop()
        if not ready:
            stack.append((node, slot, True))
            stack.extend((c, slot_of(slot, c), False) for c in node.children if isinstance(c, Node) and c.tag not in SILENT)
            continue
        parts, size, article = [node.tag, node.attrs.get("class", ""), node.attrs.get("id", "")], 0, node.tag in ("article", "main")
        for c in node.children:
            if isinstance(c, Node):
                if id(c) in done:
                    digest, inner, holds = done.pop(id(c))
                    size, article = size + inner, article or holds
                    parts.append(digest.hex())
            elif words := c.split():
                parts.append(" ".join(words))
                size += len(parts[-1])
        digest = xxhash.xxh64_digest("\x00".join(parts), 3)
        done[id(node)] = digest, size, article
        own = int.from_bytes(digest, "big", signed=True)
        if size and node.tag in BLOCKS and node.tag not in ("html", "body"):
            t = found[id(node)] = Subtree()
            t.hash, t.around, t.slot, t.size, t.article = own, 0, slot, size, article
        for c in node.children:
            if id(c) in found:
                found[id(c)].around = own
    return found


def _named(node: Node) -> bool:
    """Is the element furniture by its class, id or role?"""
    if node.attrs.get("role", "").lower() in ROLES or "hidden" in node.attrs:
        return True
    names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()
    return len(names) > 1 and not NAMES.isdisjoint(_PARTS.split(names))


def _holds_article(node: Node) -> bool:
    stack = [node]
    while stack:
        n = stack.pop()
        if n.tag in ("article", "main", "body", "html"):
            return True
        stack.extend(c for c in n.children if isinstance(c, Node))
    return False


@dataclass(frozen=True)
class Template:
    """Hashes of subtrees (of one host) and of slots that are template."""

    hashes: frozenset[int] = frozenset()
    slots: frozenset[int] = frozenset()


def slot_hash(slot: str) -> int:
    return xxhash.xxh64_intdigest(slot, 3) - (1 << 63)


def marked(root: Node, template: Template) -> set[int]:
    """ids of the elements that the template deletes."""
    if not template.hashes and not template.slots:
        return set()
    return {k for k, t in subtrees(root).items() if not t.article and (t.hash in template.hashes or slot_hash(t.slot) in template.slots)}


def _walk(node: Node, gone: set[int], inside: bool) -> list[str]:
    """Text of the node with a block break (``\\x00``) around block elements; furniture and what is ``gone`` left out."""
    out: list[str] = []
    stack: list = [(node, inside, False)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        n, within, headings = item
        if n is not node:
            if id(n) in gone:
                continue
            if n.tag in FURNITURE:
                if not (n.tag == "header" and within):
                    continue
                headings = True
            elif n.tag not in ("article", "main", "body", "html") and _named(n) and not _holds_article(n):
                continue
            elif n.tag == "article" and within and _named(n):
                continue
        within = within or n.tag in ("article", "main")
        told = not headings or n.tag in HEADINGS
        inner: list = []
        for c in n.children:
            if isinstance(c, str):
                if told:
                    inner.append(c.replace("\x00", " "))
            else:
                inner.append((c, within, headings and c.tag not in HEADINGS and n.tag not in HEADINGS))
        if n.tag in BLOCKS:
            inner = ["\x00", *inner, "\x00"]
        elif n.tag in ("br", "wbr", "img"):
            inner = [" "] if n.tag == "br" else []
        stack.extend(reversed(inner))
    return out


def _blocks(parts: list[str]) -> str:
    blocks = (" ".join(b.split()) for b in "".join(parts).split("\x00"))
    return "\n".join(b for b in blocks if b)


def main_text(html: str, template: Template = Template()) -> str:
    """The articles of a page: every outermost ``article`` or ``main`` that is no furniture, in page order; without any, the body."""
    root = parse(html)
    gone = marked(root, template)
    texts, stack, found = [], [root], False
    while stack:
        n = stack.pop()
        if id(n) in gone:
            continue
        if n.tag in ("article", "main"):
            if not _named(n):
                texts.append(_blocks(_walk(n, gone, True)))
                found = True
        # A main may hold several articles and their comments: it is taken whole.
        elif n.tag not in FURNITURE and (n.tag in ("html", "body") or not _named(n) or _holds_article(n)):
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return "\n".join(t for t in texts if t) if found else _blocks(_walk(root, gone, False))


_SUBTREES = pa.schema([("host", pa.string()), ("slot", pa.int64()), ("h", pa.int64()), ("around", pa.int64()), ("large", pa.bool_())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different subtree of a page once."""
    out = Rows(_SUBTREES)
    for batch in batches:
        hosts = batch.column("host").to_pylist()
        for host, html in zip(hosts, batch.column("html"), strict=True):
            found = subtrees(parse(html.as_py() or "")).values()
            whole = max((t.size for t in found), default=0)
            rows = {t.hash: (slot_hash(t.slot), t.hash, t.around, 2 * t.size > whole) for t in found if not t.article}
            slots, hashes, around, large = zip(*rows.values(), strict=True) if rows else ((), (), (), ())
            yield from out.add([host] * len(rows), list(slots), list(hashes), list(around), list(large))
    yield from out.rest()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, hashes, slots in zip(batch.column("html"), batch.column("hashes"), batch.column("slots"), strict=True):
            texts.append(main_text(html.as_py() or "", Template(frozenset(hashes.as_py() or ()), frozenset(slots.as_py() or ()))))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])


def counted(pages: DataFrame) -> DataFrame:
    """(host, slot, h, n, large, recurs): the pages of each subtree, those whose text is mostly in it, and those that count as a recurrence of its slot."""
    seen = pages.select("host", "html").mapInArrow(_hashed, "host string, slot long, h long, around long, large boolean")
    seen = seen.groupBy("host", "slot", "h").agg(F.count("*").alias("n"), F.count_if("large").alias("large"), F.min("around").alias("a"), F.max("around").alias("b"))
    return seen.select("host", "slot", "h", "n", "large", F.when((F.col("n") >= RECURS) & (F.col("a") != F.col("b")), F.col("n")).otherwise(0).alias("recurs"))


def template_slots(counts: DataFrame, share: float = SLOT_SHARE) -> DataFrame:
    """(slot): those whose subtrees recur on their hosts often enough, and seldom hold most of a page's text."""
    slots = counts.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("recurs").alias("k"), F.sum("large").alias("large"))
    return slots.where((F.col("k") >= LEAST_ELEMENTS) & (F.col("k") >= share * F.col("n")) & (2 * F.col("large") < F.col("n"))).select("slot")


def templates(counts: DataFrame, pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE, slot_share: float = SLOT_SHARE) -> DataFrame:
    """(host, hashes, slots): the subtrees on most of a host's pages, ``1 / share`` times as many as a page has elements at most, and the template slots that the host has."""
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    common = counts.groupBy("host", "h").agg(F.sum("n").alias("n"), F.sum("recurs").alias("k")).where((F.col("n") >= least) & (F.col("k") > 0)).join(totals, "host")
    hashes = common.where(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share))).select("host", F.col("h"), F.lit(None).cast("long").alias("slot"))
    slots = counts.select("host", "slot").distinct().join(template_slots(counts, slot_share), "slot").select("host", F.lit(None).cast("long").alias("h"), "slot")
    return hashes.unionByName(slots).groupBy("host").agg(F.collect_list("h").alias("hashes"), F.collect_list("slot").alias("slots"))


def _with_templates(rows: DataFrame, least: int, share: float, slot_share: float) -> DataFrame:
    """``rows`` with their host's template; pages of a hot host stay spread over the tasks.

    The table of templates is counted first.  Up to ``MOST_BROADCAST`` hashes
    (8 bytes each): broadcast.  Beyond: a shuffle join under a key that Spark
    deals out anew on both sides, so that AQE may split a hot host's partition.
    """
    counts = materialise(counted(rows), "subtrees")
    found = materialise(templates(counts, rows, least, share, slot_share), "templates")
    discard(counts)
    size = found.agg(F.coalesce(F.sum(F.size("hashes") + F.size("slots")), F.lit(0))).first()[0]
    if size <= MOST_BROADCAST:
        return rows.join(F.broadcast(found), "host", "left")
    return rows.join(found.withColumn("host", F.substring("host", 1, 1 << 20)), "host", "left")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_PAGES, share: float = SHARE, slot_share: float = SLOT_SHARE) -> DataFrame:
    """(id, url, text, n_chars) for every row of ``pages``.

    Null and empty html give an empty text.  Pages without a host (null url, or
    one without ``://``) share the empty host.  Rows that share an id are pages
    of their own.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    with_template = _with_templates(rows, least, share, slot_share).select("id", "url", "html", "hashes", "slots")
    kinds = dict(rows.dtypes)
    out = with_template.mapInArrow(_extract, f"id {kinds['id']}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
