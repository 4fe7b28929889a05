"""Main text of pages by wrapper induction.

Pages of one host share a template. Every page's DOM tree is aligned with one reference page
of its host by simple tree matching (the largest common top-down tree that keeps the order of
children). Over all pages of the host, each reference node is counted: how often it was
matched, how often with the same text, and how much text it held, in links and in all. Nodes
matched often and nearly always with the same text are template; the others are slots. A slot's
mass is its text over all pages, none where half of it is links. From the body down, the slot
with most of its level's mass is followed while it is a container without headings beside
it; where that ends is the content of the host. Neither names nor roles of elements play a
part in this. Hosts without enough pages take the layout (path of labels) that won on most
pages of other hosts and that their page has exactly once at each level.

Mark-up follows as a check: parts of the content that it names as no content (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) are left out; an
article marked inside or around the content sets its limits; a content that mark-up rejects,
or that lies apart from the marked article, gives way to the article. Without both, the text
is the page less its template. Nothing in a marked article counts as template: two pages of a
host may well quote the same paragraph. ``decided_by`` tells: ``induced``, ``adjusted`` (limits
by a marked article), ``marked`` or ``page``.

The reference is one page for each host; votes are summed per task before they are shuffled, so
a host that holds a third of all pages adds a row for each node and task. Pages equal to the
reference say nothing about what varies and do not vote.

Defined results: NULL and empty pages have no text; a page without a host (NULL or odd url)
belongs to one host of its own; hosts with fewer than ``MIN_VOTES`` voting pages have no
template; repeated rows are reported for every row; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_keeping, maybe_broadcast, text_of, written

#: Voting pages from which a host has a template, and the share of equal texts that makes a
#: matched node part of it.
MIN_VOTES = 3
CONSTANT_SHARE = 0.8
#: Share of its level's mass from which a slot is followed, and of links from which it has none.
MAIN_SHARE = 0.5
LINK_SHARE = 0.5
#: Layouts of other hosts that a page without a wrapper tries, and the levels one may have.
LAYOUTS = 20
LAYOUT_LEVELS = 64

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: An opening tag closes these open ones, up to the tags behind the bar.
_CLOSES_P = BLOCKS - frozenset("body html legend optgroup option summary tbody td tfoot th thead tr".split())
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Elements and roles that hold no article text.
NO_CONTENT = frozenset(
    "script style noscript template head title nav footer aside form button input select textarea iframe object embed svg "
    "canvas audio video menu dialog noframes noembed search map math xmp plaintext".split()
)
NO_CONTENT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
#: Words in a class or id that name no content.
NO_CONTENT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar aside rail footer cookie cookies consent gdpr notice notices popup modal newsletter "
    "subscribe subscription signup login comments comment respond disqus replies related recommended share sharing "
    "social widget toolbar pagination pager skip masthead".split()
)
#: The ones of them that hold even for an element marked as an article.
NO_ARTICLE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo comment comments respond replies related recommended".split()
)
#: A name with one of these speaks of another element ("has-sidebar").
_MODIFIERS = frozenset(("has", "with", "no", "without"))

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BLANK = re.compile(r"\s+")
_NAME_PARTS = re.compile(r"[^a-z]+")


class Node:
    """An element; children are elements and pieces of text."""

    __slots__ = ("tag", "names", "role", "children", "parent", "said", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children, self.said = tag, parent, [], 0
        self.chars = self.linked = 0
        self.names: frozenset[str] = frozenset()
        self.role = ""


def parse(page: str) -> Node:
    """A tolerant DOM tree: optional end tags, stray end tags, open ends, any depth."""
    root = here = Node("", None)
    at, n = 0, len(page)
    while at < n:
        found = _TAG.search(page, at)
        if found is None:
            here.children.append(page[at:])
            break
        if found.start() > at:
            here.children.append(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            here = _close(here, tag)
            continue
        here = _implied(here, tag)
        node = Node(tag, here)
        if found[3]:
            _attributes(node, found[3])
        here.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            stop = end.start() if end else n
            node.children.append(page[at:stop])
            at = end.end() if end else n
        elif tag not in VOID:
            here = node
    return root


def _attributes(node: Node, raw: str) -> None:
    for name, *values in _ATTRIBUTE.findall(raw):
        name = name.lower()
        if name in ("class", "id"):
            for token in html.unescape("".join(values)).lower().split():
                words = _NAME_PARTS.split(token)
                if not _MODIFIERS.intersection(words):
                    node.names |= frozenset(words) - {""}
        elif name == "role":
            node.role = "".join(values).strip().lower()


def _close(here: Node, tag: str) -> Node:
    """Where an end tag leads: out of the nearest open element of that name, if there is one."""
    node = here
    while node.parent is not None:
        if node.tag == tag:
            return node.parent
        if node.tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
            break  # an inner end tag does not close the article around it
        node = node.parent
    return here


def _implied(here: Node, tag: str) -> Node:
    """Where a new element goes, after the end tags that it implies."""
    closes, until = ({"p"}, {"td", "th", "caption", "button", "object"} | BLOCKS - {"p"}) if tag in _CLOSES_P else _SIBLINGS.get(tag, ((), ()))
    node = here
    while closes and node.parent is not None and node.tag not in until:
        if node.tag in closes:
            return _implied(node.parent, tag)
        node = node.parent
    return here


def is_content(node: Node, inside: bool) -> bool:
    """Whether mark-up lets a node hold article text; ``inside`` an article a header may."""
    if node.tag in NO_CONTENT or node.role in NO_CONTENT_ROLES:
        return False
    if node.tag in ("html", "body"):
        return True
    if node.tag in ("article", "main"):
        return not node.names & NO_ARTICLE_WORDS
    if node.tag == "header" and not inside:
        return False
    return not node.names & NO_CONTENT_WORDS


def article_of(root: Node) -> list[Node]:
    """The outermost marked articles, or else the main element; in page order."""
    for wanted in (lambda x: x.tag == "article", lambda x: x.tag == "main" or x.role == "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.tag != "" and not is_content(node, False):
                continue
            if wanted(node):
                found.append(node)
            else:
                stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return found
    return []


def blocks_of(node: Node, template: set[int]) -> list[str]:
    """Text blocks below a node: references decoded, white space collapsed, no empty ones."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _BLANK.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    inside = node.tag != ""
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            run.append(html.unescape(x))
        elif x is None:
            flush()
        elif x.tag == "br":
            run.append(" ")
        elif (x is node or is_content(x, inside)) and id(x) not in template:
            if x.tag in BLOCKS:
                flush()
                stack.append(None)
            stack += reversed(x.children)
        elif x.tag in BLOCKS:
            flush()
    flush()
    return out


# ------------------------------------------------------------------------------ alignment


def _label(node: Node) -> tuple[str, tuple[str, ...]]:
    return node.tag, tuple(sorted(node.names))


class Region:
    """A node as the alignment sees it: its tag and names, its regions, its text's digest. A
    run of like leaves is one region, so a long article is as quick to align as a short one."""

    __slots__ = ("label", "below", "size", "nodes", "shape")

    def __init__(self, node: Node):
        self.label = _label(node)
        self.nodes = [node]
        self.below: list[Region] = []
        self.size = 1
        self.shape = 0

    def held(self) -> tuple[int, int]:
        """Characters of the region's texts, in all and in links."""
        return sum(n.chars for n in self.nodes), sum(n.linked for n in self.nodes)

    def said(self) -> tuple[int, ...]:
        """Digests of the region's texts, in which a page can differ from the reference."""
        return tuple(n.said for n in self.nodes)

    def walk(self) -> Iterator[Region]:
        stack = [self]
        while stack:
            r = stack.pop()
            yield r
            stack += reversed(r.below)


def _region(top: Node) -> Region:
    """The regions below a node, without recursion: pages may be nested to any depth."""
    _digest(top)
    root = Region(top)
    order, stack = [], [root]
    while stack:
        r = stack.pop()
        order.append(r)
        for child in r.nodes[0].children:
            if isinstance(child, Node) and child.tag not in VOID and child.tag in BLOCKS:
                r.below.append(Region(child))
        stack += r.below
    for r in reversed(order):  # children before parents
        merged: list[Region] = []
        for c in r.below:
            if merged and not c.below and not merged[-1].below and merged[-1].label == c.label:
                merged[-1].nodes += c.nodes
            else:
                merged.append(c)
        r.below = merged
        r.size = 1 + sum(c.size for c in merged)
        r.shape = hash((r.label, tuple(c.shape for c in merged)))
    return root


def _digest(top: Node) -> None:
    """Set ``said`` of every node: a digest of its own text and of its children's, without
    those that mark-up names as no content; and the characters it holds, in all and in links,
    whatever mark-up says."""
    order, stack = [], [top]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        parts = []
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.linked += c.linked
                if c.said and is_content(c, True):
                    parts.append(c.said)
            elif piece := _BLANK.sub(" ", html.unescape(c)).strip():
                parts.append(piece)
                node.chars += len(piece) * (node.tag not in RAW)
        if node.tag == "a":
            node.linked = node.chars
        node.said = hash(tuple(parts)) if parts else 0


def body_of(root: Node) -> Node:
    """The page's body, or all of it where no body is marked."""
    tops = [c for c in root.children if isinstance(c, Node)]
    inner = [c for h in tops if h.tag == "html" for c in h.children if isinstance(c, Node)]
    return next((c for c in tops + inner if c.tag == "body"), root)


def regions_of(root: Node) -> Region:
    return _region(body_of(root))


def _ends(a: Region, b: Region) -> tuple[int, int, int]:
    """How many first and last regions have the same shape, and so match best one to one; and
    the size of what they match."""
    x, y = a.below, b.below
    most, size, head, tail = min(len(x), len(y)), 0, 0, 0
    while head < most and x[head].shape == y[head].shape:
        size += x[head].size
        head += 1
    while tail < most - head and x[-1 - tail].shape == y[-1 - tail].shape:
        size += x[-1 - tail].size
        tail += 1
    return head, tail, size


#: Cells of a table that a walk back through it keeps at once.
TABLE_CELLS = 1 << 20


class _Table:
    """The table of simple tree matching over two runs of regions, a row at a time: only the
    last row and the rows of a short stretch are ever held, whatever the lengths. Regions whose
    label the other run lacks match nothing and have no row or column."""

    def __init__(self, x: list[Region], y: list[Region], sizes: dict):
        common = {r.label for r in x} & {s.label for s in y}
        self.x, self.y, self.sizes = [r for r in x if r.label in common], [s for s in y if s.label in common], sizes
        self.by_label: dict = defaultdict(dict)
        codes: dict[int, int] = {}
        for s in self.y:
            self.by_label[s.label][s.shape] = codes.setdefault(s.shape, len(codes))
        self.codes, self.width = np.array([codes[s.shape] for s in self.y], np.int64), len(codes)
        self.kept: dict[int, np.ndarray] = {}

    def _matches(self, r: Region) -> np.ndarray:
        """Size of what ``r`` matches of every shape of the other run."""
        found = self.kept.get(r.shape)
        if found is None:
            found = np.zeros(self.width, np.int64)
            for shape, code in self.by_label[r.label].items():
                found[code] = r.size if r.shape == shape else self.sizes[r.shape, shape]
            if len(self.kept) * self.width < TABLE_CELLS:
                self.kept[r.shape] = found
        return found

    def _next(self, row: np.ndarray, i: int) -> np.ndarray:
        out = row.copy()
        np.maximum(row[1:], row[:-1] + self._matches(self.x[i])[self.codes[: len(row) - 1]], out=out[1:])
        return np.maximum.accumulate(out)

    def _first(self) -> np.ndarray:
        return np.zeros(len(self.y) + 1, np.int64)

    def best(self) -> int:
        row = self._first()
        for i in range(len(self.x)):
            row = self._next(row, i)
        return int(row[-1])

    def pairs(self) -> list[tuple[Region, Region]]:
        """The matched regions, last first; of equal choices the earlier region's is taken."""
        out: list[tuple[Region, Region]] = []

        def back(low: int, high: int, row: np.ndarray, j: int) -> int:
            """Walk from row ``high`` to ``low``, whose first cells are ``row``; the column reached."""
            if not j or low == high:
                return j
            row = row[: j + 1]
            if high - low == 1 or (high - low) * len(row) <= TABLE_CELLS:
                rows = [row]
                for i in range(low, high):
                    rows.append(self._next(rows[-1], i))
                i = high
                while i > low and j:
                    if rows[i - low][j] == rows[i - low - 1][j]:
                        i -= 1
                    elif rows[i - low][j] == rows[i - low][j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        out.append((self.x[i], self.y[j]))
                return j
            middle, half = (low + high) // 2, row
            for i in range(low, middle):
                half = self._next(half, i)
            return back(low, middle, row, back(middle, high, half, j))

        back(0, len(self.x), self._first(), len(self.y))
        return out


def _unlike(x: list[Region], y: list[Region]) -> Iterator[tuple[Region, Region]]:
    """Pairs of equal label and different shape, each pair of shapes once."""
    shapes: dict = defaultdict(dict)
    for s in y:
        shapes[s.label][s.shape] = s
    for r in {r.shape: r for r in x if r.label in shapes}.values():
        for shape, s in shapes[r.label].items():
            if shape != r.shape:
                yield r, s


def _between(r: Region, s: Region) -> tuple[list[Region], list[Region], int, int, int]:
    """The regions of both between their like ends, and those ends as ``_ends`` gives them."""
    head, tail, size = _ends(r, s)
    return r.below[head : len(r.below) - tail], s.below[head : len(s.below) - tail], head, tail, size


def align(a: Region, b: Region) -> tuple[int, list[tuple[Region, Region]]]:
    """Simple tree matching: size of the largest common tree, and its pairs. First and last
    regions of equal shape are matched before the table, whose entries are kept by shape. Runs
    of any length take the table; its time is the product of their lengths, its memory a row."""
    sizes: dict[tuple[int, int], int] = {}
    stack = [(a, b, None)]
    while stack:
        r, s, inner = stack.pop()
        if inner is None:
            if (r.shape, s.shape) in sizes:
                continue
            if r.label != s.label or r.shape == s.shape:
                sizes[r.shape, s.shape] = r.size if r.label == s.label else 0
                continue
            inner = _unlike(*_between(r, s)[:2])
        needed = next(((p, q) for p, q in inner if (p.shape, q.shape) not in sizes), None)
        if needed is not None:
            stack += [(r, s, inner), (*needed, None)]
            continue
        x, y, _, _, size = _between(r, s)
        sizes[r.shape, s.shape] = 1 + size + (_Table(x, y, sizes).best() if x and y else 0)
    if a.label != b.label:
        return 0, []
    pairs, stack = [], [(a, b)]
    while stack:
        r, s = stack.pop()
        pairs.append((r, s))
        x, y, head, tail, _ = _between(r, s)
        m, n = len(r.below), len(s.below)
        stack += [(r.below[i], s.below[i]) for i in range(head)]
        stack += [(r.below[m - 1 - i], s.below[n - 1 - i]) for i in range(tail)]
        if x and y:
            stack += _Table(x, y, sizes).pairs()
    return sizes[a.shape, b.shape] if a.shape != b.shape else a.size, pairs


def votes(reference: Region, page: Region) -> list[tuple[int, int, int, int]]:
    """Of every matched region its place in the reference, 1 where the text is the same, and
    the characters that the page holds there, in all and in links."""
    place = {id(r): k for k, r in enumerate(reference.walk())}
    return [(place[id(a)], int(a.said() == b.said()), *b.held()) for a, b in align(reference, page)[1]]


#: Elements that may be followed on the way to the content, and headings, which belong to it.
_CONTAINERS = frozenset("article center div main section table tbody td tr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


def content_place(reference: Region, counts: dict[int, tuple[int, int, int, int]]) -> tuple[int, list]:
    """Place of the reference's content by the counts (matched, same, characters, in links)
    of its regions, and the labels that lead there from the body; 0 where the body is it."""
    place = {id(r): k for k, r in enumerate(reference.walk())}

    def mass(r: Region) -> int:
        matched, same, chars, linked = counts.get(place[id(r)], (0, 0, 0, 0))
        varies = matched >= MIN_VOTES and same < CONSTANT_SHARE * matched
        return chars if varies and linked < LINK_SHARE * chars else 0

    here, path = reference, []
    while True:
        kids = [(mass(r), r) for r in here.below]
        total = sum(m for m, _ in kids)
        best, slot = max(kids, key=lambda k: k[0], default=(0, None))
        titled = any(m and r.label[0] in _HEADINGS for m, r in kids)
        if not total or titled or best <= MAIN_SHARE * total or slot.label[0] not in _CONTAINERS or len(slot.nodes) > 1:
            return place[id(here)], path
        here = slot
        path.append(slot.label)


def at_path(body: Node, path: list) -> Node | None:
    """The element that the labels lead to, where each names exactly one."""
    here = body
    for label in path:
        fits = [c for c in here.children if isinstance(c, Node) and c.tag == label[0] and _label(c) == label]
        if len(fits) != 1:
            return None
        here = fits[0]
    return here


class Wrapper:
    """What was induced for a host; parts that a page may not need are made when asked for."""

    def __init__(self, page: str | None, constant: set[int], content: int, path: list):
        self.page, self.constant, self.content, self.path = page, constant, content, path
        self._region: Region | None = None

    @property
    def reference(self) -> Region:
        if self._region is None:
            self._region = regions_of(parse(self.page))
        return self._region

    def content_in(self, root: Node) -> Node | None:
        """The page's content: by labels where they are unique, else by tree matching."""
        if not self.content:
            return None
        found = at_path(body_of(root), self.path)
        if found is not None:
            return found
        place = {id(r): k for k, r in enumerate(self.reference.walk())}
        pairs = align(self.reference, regions_of(root))[1]
        return next((b.nodes[0] for a, b in pairs if place[id(a)] == self.content), None)


def template_nodes(reference: Region, constant: set[int], page: Region) -> set[int]:
    """Nodes of the page that match constant regions of the reference with the same text."""
    place = {id(r): k for k, r in enumerate(reference.walk())}
    return {
        id(n) for a, b in align(reference, page)[1] if place[id(a)] in constant and a.said() == b.said() for n in b.nodes
    }


def _above(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def extract(page: str, wrapper: Wrapper | None = None, layouts: list = ()) -> tuple[str, str]:
    """Main text of a page and what decided it, given its host's wrapper and other layouts."""
    root = parse(page)
    found = None
    if wrapper is not None and wrapper.content:
        found = wrapper.content_in(root)
    else:
        body = body_of(root)
        found = next((n for n in (at_path(body, path) for path in layouts) if n is not None), None)
    if found is not None and not all(x.tag in ("", "header") or is_content(x, True) for x in _above(found)):
        found = None  # mark-up names it, or what it lies in, as no content
    articles, by = article_of(root), "induced"
    tops = [found]
    if articles and articles != [found]:
        near = found is not None and any(found in _above(a) or a in _above(found) for a in articles)
        tops, by = articles, "adjusted" if near else "marked"
    elif found is None:
        tops, by = [root], "page"
    template: set[int] = set()
    if not articles and wrapper is not None and wrapper.constant:
        template = template_nodes(wrapper.reference, wrapper.constant, regions_of(root))
    return "\n".join(b for t in tops for b in blocks_of(t, template)), by


# ------------------------------------------------------------------------------- operator


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))


def induce(pages: DataFrame, url: str, body: str) -> DataFrame:
    """``host``, ``reference`` (a page), ``constant`` (places of its template regions),
    ``content`` (place of its content, 0 if none), ``path`` (labels that lead to it) and
    ``voters`` (pages that voted)."""
    rows = pages.select(host_of(url).alias("host"), text_of(body).alias("page")).where(F.length("page") > 0)
    # The page whose digest is smallest: any choice will do, this one is the same at every run.
    reference = written(rows.groupBy("host").agg(F.min_by("page", F.sha1("page")).alias("reference")), "reference-pages")
    n = reference.count()
    side = maybe_broadcast(reference, n, 64 << 10)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[str, Region]] = {}
        counts: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for batch in batches:
            for host, page, reference in zip(batch["host"], batch["page"], batch["reference"]):
                if page == reference:
                    continue
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = reference, regions_of(parse(reference))
                for place, *seen in votes(known[host][1], regions_of(parse(page))):
                    count = counts[host, place]
                    for i, value in enumerate((1, *seen)):
                        count[i] += value
            if len(counts) > 100_000:
                yield _rows(counts)
                counts.clear()
        yield _rows(counts)

    names = ("matched", "same", "chars", "linked")
    voted = rows.join(side, "host").mapInPandas(run, "host string, place int, " + ", ".join(f"{n} long" for n in names))
    sums = voted.groupBy("host", "place").agg(*[F.sum(n).alias(n) for n in names])
    # As long as one page has regions.
    counted = sums.groupBy("host").agg(F.collect_list(F.struct("place", *names)).alias("counts"))

    def choose(batch: pd.DataFrame) -> dict[str, list]:
        made: dict[str, list] = {"constant": [], "content": [], "path": [], "voters": []}
        for page, found in zip(batch["reference"], batch["counts"]):
            counts = {c["place"]: tuple(c[n] for n in names) for c in found} if found is not None else {}
            content, path = content_place(regions_of(parse(page)), counts) if counts else (0, [])
            fixed = (p for p, (m, same, *_) in counts.items() if p and m >= MIN_VOTES and same >= CONSTANT_SHARE * m)
            made["constant"].append(sorted(fixed))
            made["content"].append(content)
            made["path"].append(json.dumps(path))
            made["voters"].append(counts.get(0, (0,))[0])
        return made

    both = reference.join(counted, "host", "left").withColumn("page", F.col("reference"))
    kinds = "constant array<int>, content int, path string, voters long"
    chosen = map_keeping(both.select("host", "page", "reference", "counts"), ["host", "page"], choose, kinds)
    return written(chosen.withColumnRenamed("page", "reference"), "wrappers")


def _rows(counts: dict[tuple[str, int], list[int]]) -> pd.DataFrame:
    return pd.DataFrame([(h, p, *c) for (h, p), c in counts.items()], columns=["host", "place", "matched", "same", "chars", "linked"])


def _path(text: str) -> list:
    return [(tag, tuple(names)) for tag, names in json.loads(text)]


def common_layouts(wrappers: DataFrame) -> list:
    """Paths to the content that won on most pages, at most ``LAYOUTS``."""
    found = wrappers.where(F.col("content") > 0).groupBy("path").agg(F.sum("voters").alias("n"))
    short = found.where(F.length("path") <= 4096).orderBy(F.desc("n"), "path").limit(LAYOUTS).collect()
    return [p for p in (_path(r["path"]) for r in short) if len(p) <= LAYOUT_LEVELS]


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """One row for each row of ``pages``: ``key``, ``url``, ``text``, ``n_chars`` and
    ``decided_by``."""
    wrappers = induce(pages, url, body)
    layouts = common_layouts(wrappers)
    side = maybe_broadcast(wrappers.drop("voters"), wrappers.count(), 64 << 10)

    def work(batch: pd.DataFrame) -> dict[str, list]:
        known: dict[str, Wrapper | None] = {}
        made: dict[str, list] = {"text": [], "n_chars": [], "decided_by": []}
        for host, page, *wrapper in zip(*(batch[c] for c in ("_host", "_page", "reference", "constant", "content", "path"))):
            if host not in known:
                reference, constant, content, path = wrapper
                known[host] = Wrapper(reference, set(constant), int(content), _path(path)) if reference is not None else None
            text, by = extract(page, known[host], layouts)
            made["text"].append(text)
            made["n_chars"].append(len(text))
            made["decided_by"].append(by)
        return made

    rows = pages.select(F.col(key), F.col(url), host_of(url).alias("_host"), text_of(body).alias("_page"))
    joined = rows.join(side, rows["_host"] == side["host"], "left").drop("host")
    return map_keeping(joined, [key, url], work, "text string, n_chars long, decided_by string")
