"""Operator 7, HTML extraction: site style trees.

The DOMs of a host's pages merge into one style tree.  A node is a path of tags (with class
and id), and has two kinds of entropy over the pages that hold it:

* content: a text that n of the node's m pages share leaves 1 - ln n / ln m of it, near 0
  for menus and notices that repeat and 1 for a text of one page;
* presentation: the entropy of the length classes (powers of two words) of its blocks and of
  its child styles. Links, adverts and footers look alike on every page whatever they say;
  paragraphs don't.

A text's importance is its content importance times its node's presentation (not below
`floor`); an element's is that of all texts below it, weighed by their words, from the
leaves up.  A branch goes as a whole if its importance is below `importance` times that of
the best branch beside it; headings are as important as what follows them, and an article or
main element, where there is one, is never judged.  A repeated text goes alone if what is
below its element is important.

A host's counts are blended with those of all hosts, which weigh as much as `prior` pages:
a small host borrows and a large one speaks for itself, without a switch in between.

Counts are made in two steps: each task counts what it reads, and one row for each
distinct (host, node, feature) and task goes on, so a hot host is summed before any
shuffle.  What comes back is one short list a host, as long as its template and not its
number of pages.

No site tree can tell a page's own advert or a comment of a reader from its article, so with
`named` branches whose element says what it is (nav, aside, footer, form, `class="ad"` ...)
go as well; scripts, styles and hidden elements always do. An element that says so but holds
an article, or a form or header that holds most of a page's words, only wraps it and stays.

Defined results: null html and pages without text give '' and 0; an unparsable or null
url is a host of its own (''); repeated pages count each; void and unclosed elements are
closed as browsers do for paragraphs, list items and cells; very deep pages are cut at no
depth; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.shared import columns, kept, small
from pathloom.llm.url_filter import host_of

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start a new block of text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements and names that say that they are not the main text.
NOISE = frozenset("script style noscript template head title nav aside footer header form button select textarea iframe svg canvas menu dialog object math audio video".split())
NAMES = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer header menu modal nav navbar navigation newsletter notice notices popup promo promoted related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
RAW = frozenset(("script", "style"))
#: Elements whose content is never shown as text.
UNSEEN = frozenset("script style noscript template head title select textarea iframe svg canvas object math audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What a start tag closes, if open and not beyond the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
PARAGRAPH = (frozenset(("p",)), BLOCK - {"p"} | {"button"})
MAIN = frozenset(("article", "main"))
#: Tags as nearly all pages write them: no attributes, or quoted ones without references.
PLAIN_START = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z-]*="[^"&]*")*)>')
PLAIN_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
PLAIN_ATTRIBUTE = re.compile(r' ([a-zA-Z-]+)="([^"]*)"')
#: Elements whose content some HTMLParser reads in a way of its own.
OWN_CONTENT = UNSEEN | frozenset("xmp noembed noframes plaintext".split())


class Node:
    __slots__ = ("tag", "name", "noise", "unseen", "children", "parent", "main", "words", "holds", "key", "text", "own", "mark")

    def __init__(self, tag: str, name: str, noise: bool, unseen: bool, parent: Node | None):
        self.tag, self.name, self.noise, self.unseen, self.parent = tag, name, noise, unseen, parent
        self.main = tag in MAIN or (parent is not None and parent.main)
        self.children: list[Node | str] = []
        self.words, self.holds, self.key, self.text, self.own, self.mark = 0, tag in MAIN, 0, "", 0, 0


def is_unseen(tag: str, attrs: dict[str, str | None]) -> bool:
    return tag in UNSEEN or "hidden" in attrs or (attrs.get("aria-hidden") or "") == "true"


def says_noise(tag: str, attrs: dict[str, str | None], parent: Node | None) -> bool:
    if tag in NOISE and not (tag == "header" and parent is not None and parent.main):
        return True
    if (attrs.get("role") or "").lower() in ROLES:
        return True
    if tag in MAIN or tag in ("html", "body"):
        return False
    words = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().replace("_", "-").replace("-", " ").split()
    if parent is not None and parent.main:  # an article's own header is part of it
        words = [x for x in words if x != "header"]
    return not NAMES.isdisjoint(words)


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", "", False, False, None)
        self.feed(html)
        self.close()
        self.seen = list(seen(self.root))
        for node in reversed(self.seen):  # children before parents
            node.words += node.own
            if node.parent is not None:
                node.parent.words += node.words
                node.parent.holds |= node.holds
        for node in self.seen:
            if node.noise and (node.holds or node.tag in ("form", "header") and 2 * node.words > self.root.words):
                node.noise = False

    def updatepos(self, i, j):
        return j  # lines aren't counted

    def parse_starttag(self, i):
        if (m := PLAIN_START.match(self.rawdata, i)) and (tag := m[1].lower()) not in OWN_CONTENT:
            self.handle_starttag(tag, [(k.lower(), v) for k, v in PLAIN_ATTRIBUTE.findall(m[2])] if m[2] else None)
            return m.end()
        return super().parse_starttag(i)

    def parse_endtag(self, i):
        if self.cdata_elem is None and (m := PLAIN_END.match(self.rawdata, i)):
            self.handle_endtag(m[1].lower())
            return m.end()
        return super().parse_endtag(i)

    def _close(self, tags: set[str], stop: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        elif tag in BLOCK:
            self._close(*PARAGRAPH)
        if not attrs:  # most elements
            node = Node(tag, tag, tag in NOISE and not (tag == "header" and self.at.main), tag in UNSEEN, self.at)
            self.at.children.append(node)
            if tag not in VOID:
                self.at = node
            return
        given = dict(attrs)
        name = tag + "".join(f".{x}" for k in ("id", "class") for x in (given.get(k) or "").split() if not any(ch.isdigit() for ch in x))
        node = Node(tag, name, says_noise(tag, given, self.at), is_unseen(tag, given), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            if tag not in BLOCK and node.tag in BLOCK:  # an inline end tag doesn't close a block
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if self.at.tag not in RAW:
            self.at.children.append(data)


@lru_cache(1 << 16)
def path_key(path: str) -> int:
    return digest(path)


@lru_cache(1 << 16)
def form_key(words: int, style: str) -> int:
    """A block's length class (a power of two) and child styles."""
    return digest(str(words.bit_length()), style)


def digest(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)


def seen(root: Node) -> Iterator[Node]:
    """Elements that are shown, parents first, without recursion; sets their key and text."""
    stack = [(root, "")]
    while stack:
        node, path = stack.pop()
        node.key = path_key(path)
        words = " ".join([x for x in node.children if x.__class__ is str]).split()
        if words:
            node.own, node.text = len(words), " ".join(words)
            node.mark = digest(node.text)
        yield node
        stack += [(x, f"{path}/{x.name}") for x in reversed(node.children) if x.__class__ is Node and not x.unseen]


#: Kinds of features.
CONTENT, FORM, PAGES = 0, 1, 2


def features(tree: Tree) -> Counter:
    """(node, kind, feature) of a page: texts once a page, forms once a block, and the node itself."""
    out: Counter = Counter()
    for node in tree.seen:
        out[node.key, PAGES, 0] = 1
        if node.text:
            out[node.key, CONTENT, node.mark] = 1
            style = "|".join(k for k, _ in groupby(x.name for x in node.children if isinstance(x, Node)))
            out[node.key, FORM, form_key(node.own, style)] += 1
    return out


@dataclass
class Site:
    """What a host's style tree says: presentation of nodes, and what is left of the content
    importance of texts that several pages share."""

    form: dict[int, float]
    shared: dict[tuple[int, int], float]
    floor: float

    def importance(self, node: Node) -> float:
        left = self.shared.get((node.key, node.mark), 1.0) if self.shared else 1.0
        return left * max(self.floor, self.form.get(node.key, 1.0))


def low_branches(tree: Tree, site: Site, importance: float, named: bool) -> set[int]:
    """Ids of the page's elements whose branch goes, and of those whose own text goes."""
    mass: dict[int, float] = {}
    out: set[int] = set()
    words: dict[int, int] = {}
    for node in reversed(tree.seen):
        own = node.own
        gone = named and node.noise
        words[id(node)] = words.get(id(node), 0) + own
        mass[id(node)] = mass.get(id(node), 0.0) + own * site.importance(node) if own else mass.get(id(node), 0.0)
        branches = [x for x in node.children if isinstance(x, Node) and not x.unseen and words.get(id(x)) and not (named and x.noise)]
        if len(branches) > 1 and not node.main:
            score, after = {}, None
            for x in reversed(branches):
                score[id(x)] = mass[id(x)] / words[id(x)]
                if x.tag in HEADINGS and after is not None:
                    score[id(x)] = max(score[id(x)], score[id(after)])
                after = x
            best = max(score.values())
            out |= {id(x) for x in branches if score[id(x)] < importance * best and not x.holds}
        if not gone and node.parent is not None:
            mass[id(node.parent)] = mass.get(id(node.parent), 0.0) + mass[id(node)]
            words[id(node.parent)] = words.get(id(node.parent), 0) + words[id(node)]
    return out


def extract(tree: Tree, site: Site, importance: float, repeat: float = 0.25, named: bool = True) -> str:
    """Blocks of text in page order, without noise, low branches and low texts."""
    low = low_branches(tree, site, importance, named)
    blocks: list[str] = []
    current: list[str] = []

    def end() -> None:
        if text := " ".join("".join(current).split()):
            blocks.append(text)
        current.clear()

    stack: list[Node | str | None] = [tree.root]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            current.append(item)
        elif not item.unseen and not (named and item.noise) and id(item) not in low:
            if item.tag == "br":
                current.append(" ")
                continue
            if item.tag in BLOCK:
                end()
                stack.append(None)
            # A shared text goes alone: what is below its element has texts of its own.
            shared = site.shared and not item.main and site.shared.get((item.key, item.mark), 1.0) < repeat
            stack += [" " if shared and isinstance(x, str) else x for x in reversed(item.children)]
    end()
    return " ".join(blocks)


_COUNTS = pa.schema([("host", pa.string()), ("node", pa.int64()), ("kind", pa.int8()), ("feature", pa.int64()), ("n", pa.int64())])
#: A task's counts are handed on once they have so many entries.
_HELD = 200_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(held)
        b = pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], _COUNTS.field(i).type) for i in range(4)] + [pa.array([held[k] for k in keys], pa.int64())], schema=_COUNTS)
        held.clear()
        return b

    for b in batches:
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            for key, n in features(Tree(html or "")).items():
                held[(host, *key)] += n
            if len(held) > _HELD:
                yield out()
    if held:
        yield out()


def style_tree(pages: DataFrame, prior: float) -> DataFrame:
    """(host, nodes, forms, text_nodes, texts, lefts): for each host the presentation of the
    nodes that several of its pages hold, in [0, 1], and what is left of the content
    importance of texts that several pages share. `pages` has host and html."""
    counts = pages.select("host", "html").mapInArrow(_count, "host string, node long, kind byte, feature long, n long").groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"))
    counts = kept(counts.where(f"n > 1 or kind <> {CONTENT}"))
    holds = counts.where(f"kind = {PAGES}").groupBy("host", "node").agg(F.sum("n").alias("pages"))
    forms = counts.where(f"kind = {FORM}")

    def entropy(*keys: str) -> DataFrame:
        """In units of the entropy of eight equally common forms, at most 1."""
        rows = forms.groupBy(*keys, "feature").agg(F.sum("n").alias("n"))
        sums = rows.groupBy(*keys).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("nlog"))
        return sums.select(*keys, F.least(F.lit(1.0), (F.log2("m") - F.col("nlog") / F.col("m")) / 3).alias("h"))

    everywhere = entropy("node").withColumnRenamed("h", "all")
    form = entropy("host", "node").join(everywhere, "node").join(holds, ["host", "node"]).where("pages > 1")
    form = form.withColumn("form", (F.col("pages") * F.col("h") + prior * F.col("all")) / (F.col("pages") + prior))
    texts = counts.where(f"kind = {CONTENT} and n > 1").join(holds, ["host", "node"])
    # Of m pages, as if `prior` / 10 more had texts of their own: two equal texts of two pages are no proof.
    texts = texts.withColumn("left", 1 - F.ln("n") / F.ln(F.col("pages") + prior / 10))
    rows = form.select("host", F.struct("node", "form").alias("f"), F.lit(None).cast("struct<node:long,feature:long,left:double>").alias("t"))
    rows = rows.unionByName(texts.select("host", F.lit(None).cast("struct<node:long,form:double>").alias("f"), F.struct("node", "feature", "left").alias("t")))
    lists = rows.groupBy("host").agg(F.collect_list("f").alias("f"), F.collect_list("t").alias("t"))
    return kept(lists.select("host", F.col("f.node").alias("nodes"), F.col("f.form").alias("forms"), F.col("t.node").alias("text_nodes"), F.col("t.feature").alias("texts"), F.col("t.left").alias("lefts")))


def html_extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", importance: float = 0.4, repeat: float = 0.25, prior: float = 20.0, floor: float = 0.05, named: bool = True) -> DataFrame:
    """Returns page_id, url, text, n_chars (code points), host."""
    pages = columns(pages, page_id=id_col, url=url_col, html=html_col)
    pages = pages.withColumn("host", host_of(F.col("url")))
    kind = pages.schema["page_id"].dataType.simpleString()
    said = ["nodes", "forms", "text_nodes", "texts", "lefts"]
    tree = small(style_tree(pages, prior).withColumnRenamed("host", "_host"), 64, *said)

    def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Site] = {}
        for b in batches:
            hosts = b.column("host").to_pylist()
            text = []
            for i, html in enumerate(b.column("html").to_pylist()):
                if hosts[i] not in held:
                    lists = [b.column(name)[i].as_py() or [] for name in said]
                    held = held if len(held) < 100 else {}
                    held[hosts[i]] = Site(dict(zip(lists[0], lists[1], strict=True)), dict(zip(zip(lists[2], lists[3], strict=True), lists[4], strict=True)), floor)
                text.append(extract(Tree(html or ""), held[hosts[i]], importance, repeat, named))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), b.column("host")], ["page_id", "url", "text", "n_chars", "host"])

    return pages.join(tree, F.col("host") == F.col("_host"), "left").drop("_host").mapInArrow(main_text, f"page_id {kind}, url string, text string, n_chars long, host string")
