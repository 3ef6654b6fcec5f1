"""Main text of pages by wrapper induction.

Pages become trees of their block elements.  The pages of a host are brought together,
put in the order of a hash of their content and each is aligned with the one before it by
simple tree matching: from the roots down, siblings of equal label are paired in order so
that the pairs weigh most (identical subtrees weigh twice their nodes, subtrees of one
shape their nodes, others of one label one and the child labels they share).  Spark sums
over all pairs of a host how often an element's text stayed the same.  A text that stays
the same on most pages at one path of labels is template, wherever it stands among its
siblings; texts that vary are content slots.  The wrapper of a host is the set of its
template texts, by path.

Elements that HTML marks as something else than the article (navigation, footers, forms,
scripts, asides), or that bear a name such as "sidebar" or "comment-list", never count,
whether they vary or not, and where a page has an `article` or `main`, content is looked
for there.

A host with very many pages is dealt at random to runs of about RUN pages, which are
aligned each by itself, so which pages meet depends on the pages alone, neither on their
order nor on the partitions.  Wrappers are broadcast while their measured number allows,
and joined by host beyond that.
"""

from __future__ import annotations

import html as entities
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from repolytics.llm.common import checkpointed, sized_partitions, worker_object

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_IN_TAG = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Element kinds of HTML, and names by which pages mark what is no article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style iframe textarea title xmp noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mspace mstyle mpadded mphantom menclose semantics annotation".split()
)
_CLOSES_P = frozenset("address article aside blockquote dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = ("article", "main", "body", "table")
_OTHER = frozenset("head nav footer aside form button menu dialog svg object select noscript template".split())
_OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus discussion footer "
    "header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related replies reply respond search share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget widgets contentinfo complementary".split()
)
_STATES = frozenset("free open closed off has no without enabled disabled less".split())
_STORY = frozenset("article story entry post".split())
_NEVER_OTHER = frozenset("html body main article".split())
_CONTENT = frozenset(("article", "main"))

RUN = 64
MOST_LARGE_HOSTS = 100_000
LEAST_PAIRS = 3
TEMPLATE_SHARE = 0.4
TEMPLATE_SHARE_IN_ARTICLE = 0.9
LEAST_PAIRS_IN_ARTICLE = 20


def host_column() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


@lru_cache(maxsize=10_000)
def marks(token: str) -> bool:
    """Whether a class, id or role says that an element is no part of the article.

    The last part of a name decides (site-footer, top-banner), or the first where the last
    one names no story (comment-list); a header or footer of an entry belongs to it, and
    names of states (has-sidebar, comments-open, ad-free) say nothing.
    """
    parts = [p.lower() for p in _PARTS.findall(token)]
    if not parts or not _STATES.isdisjoint(parts):
        return False
    if parts[-1] in _OTHER_NAMES:
        return parts[-1] not in ("header", "footer") or _STORY.isdisjoint(parts)
    return parts[0] in _OTHER_NAMES and parts[-1] not in _STORY


@lru_cache(maxsize=10_000)
def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """(tag and names of an element, whether its names mark it as no article)."""
    names, other = set(), False
    if "=" in attributes:
        for _, *values in _ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "")
            names.update(re.findall(r"[a-z]+", value.lower()))
            other = other or any(marks(t) for t in value.split() if len(t) <= 100)
    return ".".join([tag, *sorted(names)]), other


class Node:
    """A block element: label (tag and names), path (hash of the labels down to it), own text and children in page order."""

    __slots__ = ("children", "full", "inside", "label", "other", "parts", "path", "shape", "size", "tag")

    def __init__(self, tag: str, label: str, path: int, other: bool, inside: bool):
        self.tag, self.label, self.path, self.other, self.inside = tag, label, path, other, inside
        self.parts: list = []  # strings and child nodes, in page order
        self.children: list[Node] = []

    def text(self) -> str:
        return " ".join("".join(p if isinstance(p, str) else " " for p in self.parts).split())


def _tag_end(raw: str, at: int, quoted: bool) -> int:
    """Where the tag whose name ends at `at` closes: the first > outside quoted values; -1 where none does."""
    while quoted:
        found = _IN_TAG.search(raw, at)
        if not found:
            return -1
        if found[0] == ">":
            return found.start()
        closing = raw.find(found[0][-1], found.end())
        if closing < 0:
            return -1
        at = closing + 1
    return raw.find(">", at)


@lru_cache(maxsize=32)
def _closer(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


def parse(html: str | None) -> list[Node]:
    """The block elements of a page in page order, the root first; inline markup joins the text around it.

    One pass, linear in the page: an element closes what it cannot stand in, an end tag
    closes up to its element.  Once a tag's quotes do not close, quotes no longer hide a >
    in the rest of the page.  A tag cut off by the page's end is dropped.
    """
    raw = html or ""
    root = Node("#", "#", 0, False, False)
    nodes, stack, places = [root], [root], {}
    at = text_from = 0
    last, quoted = raw.rfind(">"), True

    def say(end: int) -> None:
        if end > text_from:
            text = raw[text_from:end]
            stack[-1].parts.append(entities.unescape(text) if "&" in text else text)

    def pop() -> None:
        places[stack.pop().tag].pop()

    while True:
        start = raw.find("<", at)
        if start < 0:
            say(len(raw))
            return nodes
        if raw.startswith("<!--", start):
            say(start)
            end = raw.find("-->", start + 2)
            at = text_from = end + 3 if end >= 0 else len(raw)
            continue
        closing = raw.startswith("/", start + 1)
        name = _NAME.match(raw, start + 1 + closing)
        if not name and raw[start + 1 : start + 2] not in ("!", "?", "/"):
            at = start + 1  # a mere sign
            continue
        if start > last:
            say(start)
            return nodes
        say(start)
        if not name:
            at = text_from = raw.find(">", start) + 1
            continue
        tag = name[0].lower()
        end = _tag_end(raw, name.end(), quoted)
        if end < 0:
            quoted, end = False, raw.find(">", name.end())
        attributes = raw[name.end() : end]
        at = text_from = end + 1
        if closing:
            if tag == "p" or tag not in _INLINE:
                own = places.get(tag)
                scope = max((places[s][-1] for s in _SCOPES if places.get(s)), default=0) if tag in ("p", "li") else 0
                if own and own[-1] > scope:
                    for _ in range(len(stack) - own[-1]):
                        pop()
                stack[-1].parts.append(" ")
            continue
        if tag in _RAW:
            found = _closer(tag).search(raw, at)
            at = raw.find(">", found.end()) + 1 if found else 0
            at = text_from = at or len(raw)
            stack[-1].parts.append(" ")
            continue
        if tag in _VOID or tag == "svg" and attributes.endswith("/"):
            stack[-1].parts.append(" ")
            continue
        if tag in _INLINE:
            continue
        while stack[-1].tag == "p" and tag in _CLOSES_P or stack[-1].tag in _CLOSES.get(tag, ()):
            pop()
        up = stack[-1]
        label, named = (_label if len(attributes) <= 300 else _label.__wrapped__)(tag, attributes)
        other = up.other or tag in _OTHER or tag == "header" and not up.inside or named and tag not in _NEVER_OTHER
        node = Node(tag, label, xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), up.path), other, up.inside or tag in _CONTENT)
        up.parts.append(node)
        up.children.append(node)
        nodes.append(node)
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)


def measured(nodes: list[Node]) -> list[Node]:
    """The nodes with size, shape (labels below) and full (labels and texts below)."""
    for node in reversed(nodes):  # children come after their parents
        node.size = 1 + sum(c.size for c in node.children)
        node.shape = hash((node.label, *(c.shape for c in node.children)))
        node.full = hash((node.shape, node.text(), *(c.full for c in node.children)))
    return nodes


def _weights(u: Node, vs: list[Node], labels: np.ndarray, shapes: np.ndarray, fulls: np.ndarray) -> np.ndarray:
    """What pairing u with each of vs weighs; 0 where labels differ."""
    alike = labels == hash(u.label)
    out = np.where(alike, 1 + (shapes == u.shape) * (u.size - 1), 0)
    out += np.where(alike & (fulls == u.full), u.size, 0)
    if u.children:
        own: dict[str, int] = {}
        for c in u.children:
            own[c.label] = own.get(c.label, 0) + 1
        known: dict[int, int] = {}
        for j in np.flatnonzero(alike & (shapes != u.shape)):
            if vs[j].shape not in known:
                left, common = dict(own), 0
                for c in vs[j].children:
                    if left.get(c.label):
                        left[c.label] -= 1
                        common += 1
                known[vs[j].shape] = common
            out[j] += known[vs[j].shape]
    return out


def _rows(us: list[Node], vs: list[Node]) -> np.ndarray:
    """The last row of the table of best weights of us against every beginning of vs."""
    labels, shapes, fulls = (np.array([f(v) for v in vs], np.int64) for f in (lambda v: hash(v.label), lambda v: v.shape, lambda v: v.full))
    row = np.zeros(len(vs) + 1, np.int64)
    for u in us:
        row[1:] = np.maximum(row[1:], row[:-1] + _weights(u, vs, labels, shapes, fulls))
        np.maximum.accumulate(row, out=row)
    return row


def matched(us: list[Node], vs: list[Node], cells: int = 4_000_000) -> list[tuple[Node, Node]]:
    """Siblings paired in order so that the pairs weigh most, in linear memory (halves of long lists are matched apart)."""
    head = tail = 0
    while head < min(len(us), len(vs)) and us[head].full == vs[head].full:
        head += 1
    while tail < min(len(us), len(vs)) - head and us[-1 - tail].full == vs[-1 - tail].full:
        tail += 1
    first, last = list(zip(us[:head], vs[:head])), list(zip(us[len(us) - tail :], vs[len(vs) - tail :]))
    us, vs = us[head : len(us) - tail], vs[head : len(vs) - tail]
    if not us or not vs:
        return first + last
    if len(us) > 1 and len(us) * len(vs) > cells:
        half = len(us) // 2
        front, back = _rows(us[:half], vs), _rows(us[half:][::-1], vs[::-1])
        cut = int(np.argmax(front + back[::-1]))
        return first + matched(us[:half], vs[:cut], cells) + matched(us[half:], vs[cut:], cells) + last
    labels, shapes, fulls = (np.array([f(v) for v in vs], np.int64) for f in (lambda v: hash(v.label), lambda v: v.shape, lambda v: v.full))
    grid = np.zeros((len(us) + 1, len(vs) + 1), np.int64)
    for i, u in enumerate(us):
        grid[i + 1, 1:] = np.maximum(grid[i, 1:], grid[i, :-1] + _weights(u, vs, labels, shapes, fulls))
        np.maximum.accumulate(grid[i + 1], out=grid[i + 1])
    i, j, chosen = len(us), len(vs), []
    while i and j:
        if grid[i, j] == grid[i - 1, j]:
            i -= 1
        elif grid[i, j] == grid[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            chosen.append((us[i], vs[j]))
    return first + chosen[::-1] + last


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of elements that the matching aligns, from the roots down."""
    pairs, left = [], [(a, b)]
    while left:
        x, y = left.pop()
        pairs.append((x, y))
        left += reversed(matched(x.children, y.children))
    return pairs


def text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 1) - (1 << 63)


def _pairs(batches):
    """Of each pair of neighbours of a run: the pair itself (path 0), and every aligned text that stayed the same."""
    before: tuple | None = None
    sums: dict[tuple, int] = {}

    def flush():
        if sums:
            columns = list(zip(*sums))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(list(sums.values()), pa.int64())], ["host", "path", "text", "inside", "n"])
        sums.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for host, run, html in zip(*(part.column(i).to_pylist() for i in range(3))):
                last = before if before and before[:2] == (host, run) else None
                if last and last[2] == html:
                    continue  # a copy of the page before says nothing about the template
                tree = measured(parse(html))
                if last:
                    sums[host, 0, 0, False] = sums.get((host, 0, 0, False), 0) + 1
                    for x, y in align(last[3][0], tree[0]):
                        if not x.other and not y.other and (one := x.text()) and one == y.text():
                            key = (host, x.path - (1 << 63), text_key(one), x.inside)
                            sums[key] = sums.get(key, 0) + 1
                before = (host, run, html, tree)
            if len(sums) > 100_000:
                yield from flush()
    yield from flush()


def runs(pages: DataFrame, run: int = RUN, most_large: int = MOST_LARGE_HOSTS) -> DataFrame:
    """host, run, html of all pages, the pages of a run in one task and in the order of a hash.

    Only hosts of more than `run` pages (and, in a very large table, more than the
    most_large-th part of it) are split; there are at most most_large of them, so that list is broadcast.
    """
    own = pages.select(host_column().alias("host"), F.xxhash64("page_id", "url", "html").alias("place"), "page_id", "url", "html")
    sizes = own.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    least = max(run, own.count() // most_large)
    large = F.broadcast(sizes.filter(F.col("host_pages") > least).select(F.col("host").alias("large_host"), F.ceil(F.col("host_pages") / run).alias("n_runs")))
    dealt = own.join(large, F.col("host") == F.col("large_host"), "left")
    dealt = dealt.select("host", F.when(F.col("n_runs").isNull(), 0).otherwise(F.pmod(F.xxhash64("place"), F.col("n_runs"))).cast("long").alias("run"), "html", "place", "page_id", "url")
    parts = sized_partitions(pages, 16 << 20)
    return dealt.repartition(parts, "host", "run").sortWithinPartitions("host", "run", "place", "page_id", "url", "html").select("host", "run", "html")


def induce(pages: DataFrame, run: int = RUN) -> DataFrame:
    """host, path, text, inside (an article), n: over all pairs of pages; path 0 counts the pairs."""
    found = runs(pages, run).mapInArrow(_pairs, "host string, path long, text long, inside boolean, n long")
    return found.groupBy("host", "path", "text").agg(F.bool_or("inside").alias("inside"), F.sum("n").alias("n"))


def templates(wrapper: DataFrame) -> DataFrame:
    """host, path, text of the template elements of a wrapper."""
    pairs = wrapper.filter("path = 0 and text = 0").select(F.col("host").alias("of_host"), F.col("n").alias("pairs"))
    named = wrapper.filter((F.col("path") != 0) & (F.col("n") >= LEAST_PAIRS)).join(pairs, F.col("host") == F.col("of_host"))
    outer = ~F.col("inside") & (F.col("n") >= TEMPLATE_SHARE * F.col("pairs"))
    inner = F.col("inside") & (F.col("n") >= LEAST_PAIRS_IN_ARTICLE) & (F.col("n") >= TEMPLATE_SHARE_IN_ARTICLE * F.col("pairs"))
    return named.filter(outer | inner).select("host", "path", "text")


def content(html: str | None, constant: dict[int, set[int]] | None = None) -> str:
    """The text of a page's content slots: of its articles where it has any, else of all.

    constant: the template texts of the host, by path.
    """
    nodes = parse(html)
    top = [n for n in nodes if n.tag in _CONTENT and not n.other]
    out: list[str] = []
    done: set[int] = set()
    for root in top or nodes[:1]:
        if id(root) in done:
            continue
        left: list = [root]
        while left:
            part = left.pop()
            if isinstance(part, str):
                out.append(part)
                continue
            if part.other:
                continue
            done.add(id(part))
            own = constant.get(part.path - (1 << 63)) if constant else None
            template = own and text_key(part.text()) in own
            left.append(" ")
            left += [p for p in reversed(part.parts) if not (template and isinstance(p, str))]
            out.append(" ")
    return " ".join("".join(out).split())


def _extracted(part, constant_of):
    texts = [content(h, constant_of(i)) for i, h in enumerate(part.column(2).to_pylist())]
    return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _by_path(rows) -> dict[int, set[int]]:
    found: dict[int, set[int]] = {}
    for r in rows:
        found.setdefault(r["path"], set()).add(r["text"])
    return found


_RESULT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, most_broadcast: int = 200_000, run: int = RUN) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty pages give an empty text; a null or odd url is a host of its own kind
    (''); repeated rows give repeated rows, and of neighbours with one html only the first
    is aligned; rows without a page_id are pages like any other; hosts with too few pages
    have no template and rely on the markup alone; pages are parsed in one linear pass
    whatever they hold; an empty table gives an empty result; further columns of pages are
    not looked at.
    """
    constant = checkpointed(templates(checkpointed(induce(pages.select("page_id", "url", "html"), run))))
    own = pages.select("page_id", "url", "html", host_column().alias("host"))
    if constant.count() <= most_broadcast:
        found: dict[str, list] = {}
        for row in constant.toLocalIterator():
            found.setdefault(row["host"], []).append(row)
        shared, key = own.sparkSession.sparkContext.broadcast({h: _by_path(rows) for h, rows in found.items()}), uuid.uuid4().hex

        def told(batches):
            known = worker_object(key, lambda: shared.value)
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    hosts = part.column(3).to_pylist()
                    yield _extracted(part, lambda i: known.get(hosts[i]))

        return own.mapInArrow(told, _RESULT)

    def joined(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = part.column(3).to_pylist()
                yield _extracted(part, lambda i: _by_path(lists[i] or ()))

    lists = constant.groupBy("host").agg(F.collect_set(F.struct("path", "text")).alias("constant"))
    return own.join(lists, "host", "left").select("page_id", "url", "html", "constant").mapInArrow(joined, _RESULT)
