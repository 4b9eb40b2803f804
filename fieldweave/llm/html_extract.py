"""Main text of web pages by wrappers inferred for each host.

A page's tags form a token stream that is read as a tree of containers with text slots.  Wrappers are union-free regular
expressions over such streams: adjacent siblings of one label become a repeated group, the child sequences of two trees are
aligned by their longest common subsequence, what only one of them has becomes optional, and text slots keep whether their
text varies and in how many pages they have one.  Pages are reduced to their trees, one for each distinct text of a host; every task
folds its own trees into one wrapper for each host, and wrappers of a host are folded level by level, those of ``FAN`` tasks at a time.

A page is matched against its host's wrapper, which says which groups hold the article, by the text that varies from page to page: the ``article``
elements if they have half of it, with those that have a quarter of the fullest one's; else a ``main`` element that has half of it; else the
innermost container that has most of it, without its first and last children as far as these say one text on all pages.  So text that is the template's doesn't
count, however much of it there is.  All that is outside these groups goes.  Inside, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments go where an element's tag or role says so, or the whole of a class (``class="comments"``, ``class="comment-list"``, not
``class="comments-on-the-law"``).  Where a word may as well name a part of an article (``legal``, ``search``), or an id or a part of a longer class says it, the
wrapper decides: such a group goes if it says one text on all pages.  Everything else stays, whether or not other pages say it too.
White space inside a block becomes one space; blocks are joined in page order by one newline.

A label is a container's tag, role and classes, and not its id; classes with three digits in a row, or digits in two places, count as one, so
generated names don't make new groups.  A wrapper keeps at most ``MOST_CHILDREN`` children of a group, those of the most pages; the text of others is judged without it.
Attributes are read as HTML does where quotes are missing or too many, in time linear in the page.

Defined results: a null or empty page has an empty text; a page without a host, the only text of its host, or one that doesn't match its
wrapper is judged by its own tree, whose texts all count, and a group of a doubtful name goes there; null or repeated ids are rows like others; elements may nest to any depth; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as html_module
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

BROADCAST_BYTES = 32 << 20
#: Wrappers of a host that meet in one group, at each level.
FAN = 64
SALTS = 16

#: HTML elements by how they are read.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED = frozenset("script style noscript template textarea title iframe noembed noframes svg object select button canvas audio video head".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes".split())
DROPPED = frozenset("nav aside footer form menu dialog fieldset search".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Words of a class or id that mark what is not main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets related recommended recommendations share sharing social comment comments commentlist "
    "respond disqus reply replies footer masthead topbar toolbar pager pagination login search searchform form copyright legal skip hidden".split()
)
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar".split())

#: Words that say no more than that a class is a part of a page, and words of ``MARKS`` that may as well name a part of an article.
PARTS = frozenset("list body section area box block container content wrap wrapper inner outer item items slot unit link links button buttons bar title header footer meta author text thread form row col top bottom left right main page site the".split())
DOUBTFUL = frozenset("legal search notice notices copyright alert hidden skip form notification banner aside widget widgets login promotion".split())
MOST_CHILDREN = 1000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_READ = frozenset(("class", "id", "role", "hidden", "aria-hidden", "itemprop"))
_REST = re.compile(r"[\s/]*>?")
_MADE = re.compile(r"\d{3}|\d.*[a-zA-Z_-].*\d")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}


class Node:
    """A container of a page or of a wrapper: label, what was seen of it, and its children in order."""

    __slots__ = ("label", "pages", "repeated", "text", "held", "varies", "chars", "drop", "children")

    def __init__(self, label: str, pages: int = 1, drop: int = 0):
        self.label, self.pages, self.repeated = label, pages, False
        self.text: int | None = None  # of the text slot: the checksum of what one page says there
        self.held = 0  # pages whose slot has text
        self.varies, self.chars = False, 0
        self.drop = drop  # the least of its containers'
        self.children: list[Node] = []

    def dump(self) -> str:
        """Nodes in document order, each with its depth."""
        rows, work = [], [(0, self)]
        while work:
            depth, n = work.pop()
            rows.append([depth, n.label, n.pages, int(n.repeated), n.text, int(n.varies), n.chars, n.held, n.drop])
            work += [(depth + 1, c) for c in reversed(n.children)]
        return json.dumps(rows, separators=(",", ":"))

    @classmethod
    def load(cls, dump: str) -> Node:
        path: list[Node] = []
        for depth, label, pages, repeated, text, varies, chars, held, drop in json.loads(dump):
            node = cls(label, pages, drop)
            node.repeated, node.text, node.varies, node.chars, node.held = bool(repeated), text, bool(varies), chars, held
            del path[depth:]
            if path:
                path[-1].children.append(node)
            path.append(node)
        return path[0]

    def weight(self, root: Node) -> int:
        """Characters of the slot that speak for an article: all of a single page's, and of a wrapper's what isn't the same on several pages."""
        return self.chars if root.pages < 2 or self.varies or self.held < 2 else 0


class Page:
    """Containers of one page (parent, label, name, tag by meaning, whether it is dropped) and its text blocks (container, text)."""

    def __init__(self, html: str):
        self.parent, self.label, self.name, self.tag, self.drop = [-1], ["html"], ["html"], ["html"], [0]
        self.blocks: list[tuple[int, str]] = []
        self._read(html)

    def _open(self, parent: int, tag: str, attributes: list[tuple[str, str]]) -> int:
        words, classes, role, hidden = [], [], "", False
        for name, value in attributes:
            if name in ("class", "id"):
                words += value.split()
                classes += value.split() if name == "class" else []
            elif name == "role":
                role = value.lower()
            elif name == "itemprop":
                words += ["articleBody"] * (value == "articleBody")
                classes += ["articleBody"] * (value == "articleBody")
            elif name == "hidden" or value == "true":
                hidden = True
        self.parent.append(parent)
        self.name.append(tag)
        self.label.append(" ".join([tag, *dict.fromkeys("#" if _MADE.search(w) else w for w in classes), *([role] if role else [])]))
        self.tag.append("main" if role == "main" and tag not in ("article", "body") else "article" if "articleBody" in words else tag)
        # 3: what isn't main text; 2: named as such by a doubtful word or an id, 1: hinted at, both of which the wrapper has to agree to inside the article
        named = max((_named(w) for w in classes), default=0) or 2 * any(_named(w) for w in words)
        if tag in DROPPED or tag in SKIPPED or role in ROLES or hidden:
            drop = 3
        elif tag in ("html", "body", "article", "main"):
            drop = named if tag == "article" else 0
        else:
            drop = named or int(tag == "header" or bool((MARKS | {"header"}) & _words(words)))
        self.drop.append(drop)
        return len(self.parent) - 1

    def _read(self, html: str) -> None:
        stack, pieces, at, end = [0], [], 0, len(html)
        is_open: Counter[str] = Counter()  # elements on the stack by name

        def close(k: int) -> None:
            is_open.subtract(self.name[i] for i in stack[k:])
            del stack[k:]

        def flush() -> None:
            if pieces:
                text = " ".join(html_module.unescape("".join(pieces)).split())
                if text:
                    self.blocks.append((stack[-1], text))
                pieces.clear()

        while at < end:
            m = _TOKEN.search(html, at)
            if not m:
                pieces.append(html[at:])
                break
            if m.start() > at:
                pieces.append(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag, attributes, closed = m[2].lower(), [], False
            while (a := _ATTRIBUTE.match(html, at)) is not None:
                at = a.end()
                if a[1].lower() in _READ:
                    attributes.append((a[1].lower(), a[2] or a[3] or a[4] or ""))
            ends = _REST.match(html, at)
            closed, at = "/" in ends[0], ends.end()
            if not ends[0].endswith(">"):
                break  # the page ends inside a tag
            if tag == "br":
                pieces.append(" ")
                continue
            block = tag in BLOCK or tag in SKIPPED
            if not block:
                continue
            if m[1]:
                flush()
                for k in range(len(stack) - 1, 0, -1) if is_open[tag] > 0 else ():
                    if self.name[stack[k]] == tag:
                        close(k)
                        break
                continue
            flush()
            if tag == "body" or tag == "html":
                names = [self.tag[i] for i in stack]
                if tag == "html" or "body" in names:
                    continue
                if "head" in names:
                    close(names.index("head"))
            if tag in VOID:
                continue
            if self.tag[stack[-1]] == "p":
                close(len(stack) - 1)
            elif self.tag[stack[-1]] in HEADINGS and re.fullmatch(r"h\d|p|div|article|section", tag):
                close(len(stack) - 1)
            if tag in CLOSES and any(is_open[n] > 0 for n in CLOSES[tag][0].split()):
                names, fences = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    name = self.tag[stack[k]]
                    if name in fences:
                        break
                    if name in names.split():
                        close(k)
                        break
            if tag in RAW:
                raw = _RAW_END[tag].search(html, at)
                at = raw.end() if raw else end
            elif not closed or tag not in SKIPPED:
                stack.append(self._open(stack[-1], tag, attributes))
                is_open[tag] += 1
        flush()

    def tree(self) -> tuple[Node, list[Node]]:
        """The page as a wrapper of its own, and the node of each container; adjacent siblings of one label are one repeated node."""
        n = len(self.parent)
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            children[self.parent[i]].append(i)
        own: list[list[str]] = [[] for _ in range(n)]
        for i, text in self.blocks:
            own[i].append(text)
        nodes: list[Node | None] = [None] * n
        root = Node(self.label[0])
        work = [(root, [0])]
        while work:
            node, members = work.pop()
            merged: list[tuple[Node, list[int]]] = []
            for k, i in enumerate(members):
                nodes[i] = node
                text = "\n".join(own[i])
                if text:
                    node.text, node.held = zlib.crc32(text.encode("utf-8", "surrogatepass") + b"\n", node.text or 0), 1
                    node.chars += len(text)
                runs: list[tuple[str, list[int]]] = []
                for c in children[i]:
                    if runs and runs[-1][0] == self.label[c]:
                        runs[-1][1].append(c)
                    else:
                        runs.append((self.label[c], [c]))
                found = []
                for label, run in runs:
                    child = Node(label, drop=min(self.drop[c] for c in run))
                    child.repeated = len(run) > 1
                    found.append((child, run))
                merged = found if not k else _join(merged, found)
            node.children = [c for c, _ in merged]
            work += merged
        return root, nodes  # type: ignore[return-value]


def _named(name: str) -> int:
    """Whether the whole of a class or id is made of ``MARKS`` and ``PARTS``: 3, or 2 if only doubtful ones are among them; else 0."""
    words = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", name)}
    marks = words & MARKS
    return 0 if not marks or words - MARKS - PARTS else 3 if marks - DOUBTFUL else 2


def _words(names: list[str]) -> set[str]:
    return {w.lower() for name in names for w in _WORD.findall(name)}


def _aligned(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Positions of two label sequences in one order, by their longest common subsequence.

    A row of the table of lengths is one whole number, whose clear bits are where the length grows by one.  Every root-th row is kept and
    those between are made anew on the way back, so memory grows with len(a) * sqrt(len(b)) bits.
    """
    if a == b:
        return [(k, k) for k in range(len(a))]
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    x, y = a[head:], b[head:]
    full, at = (1 << len(x)) - 1, {}
    for i, label in enumerate(x):
        at[label] = at.get(label, 0) | 1 << i

    def rows(first: int, last: int, row: int) -> list[int]:
        out = []
        for label in y[first:last]:
            hit = row & at.get(label, 0)
            row = ((row + hit) | (row - hit)) & full
            out.append(row)
        return out

    step = max(1, math.isqrt(len(y)))
    marks = [full]
    for first in range(0, len(y), step):
        marks.append(rows(first, min(first + step, len(y)), marks[-1])[-1])
    out: list[tuple[int | None, int | None]] = []
    i, j, made, base = len(x), len(y), [], -1

    def row_of(j: int) -> int:
        """The row after ``j`` labels of ``b``."""
        nonlocal made, base
        if j % step == 0:
            return marks[j // step]
        if base != j // step:
            base = j // step
            made = rows(base * step, min((base + 1) * step, len(y)), marks[base])
        return made[j % step - 1]

    while i and j:
        if row_of(j) >> (i - 1) & 1:
            i -= 1
            out.append((head + i, None))
        else:
            j -= 1
            if row_of(j) >> (i - 1) & 1:
                i -= 1
                out.append((head + i, head + j))
            else:
                out.append((None, head + j))
    out += [(head + k, None) for k in range(i - 1, -1, -1)] + [(None, head + k) for k in range(j - 1, -1, -1)]
    return [(k, k) for k in range(head)] + out[::-1]


def _join(a: list[tuple[Node, list[int]]], b: list[tuple[Node, list[int]]]) -> list[tuple[Node, list[int]]]:
    out = []
    for i, j in _aligned([n.label for n, _ in a], [n.label for n, _ in b]):
        if j is None:
            out.append(a[i])
        elif i is None:
            out.append(b[j])
        else:
            node, members = a[i]
            node.repeated |= b[j][0].repeated
            node.drop = min(node.drop, b[j][0].drop)
            out.append((node, members + b[j][1]))
    return out


def fold(a: Node, b: Node) -> Node:
    """The wrapper that takes what either takes."""
    work = [(a, b)]
    while work:
        x, y = work.pop()
        x.pages += y.pages
        x.repeated |= y.repeated
        x.varies |= y.varies or (x.text is not None and y.text is not None and x.text != y.text)
        x.text = y.text if x.text is None else x.text
        x.chars += y.chars
        x.held += y.held
        x.drop = min(x.drop, y.drop)
        children = []
        for i, j in _aligned([c.label for c in x.children], [c.label for c in y.children]):
            if i is not None and j is not None:
                work.append((x.children[i], y.children[j]))
            children.append(y.children[j] if i is None else x.children[i])
        if len(children) > MOST_CHILDREN:
            least = sorted((c.pages for c in children), reverse=True)[MOST_CHILDREN - 1]
            spare = MOST_CHILDREN - sum(c.pages > least for c in children)
            kept = []
            for c in children:
                spare -= c.pages == least
                if c.pages > least or (c.pages == least and spare >= 0):
                    kept.append(c)
            children = kept
        x.children = children
    return a


def _tag(label: str) -> str:
    words = label.split(" ")
    return "article" if "articleBody" in words else "main" if words[-1] == "main" and words[0] not in ("article", "body") else words[0]


def _weights(root: Node, least: int) -> dict[int, int]:
    """What of each group's slots, with all below it, speaks for an article; groups of ``drop`` at least ``least`` count for nothing."""
    order, work = [], [root]
    while work:
        node = work.pop()
        order.append(node)
        work += node.children
    total: dict[int, int] = {}
    for node in reversed(order):
        total[id(node)] = 0 if node.drop >= least and node is not root else node.weight(root) + sum(total[id(c)] for c in node.children)
    return total


def articles_of(root: Node) -> list[Node]:
    """The groups that hold the article, by the text that counts: ``article`` elements, else ``main``, else the innermost container with most of it."""
    total = _weights(root, 1)
    if not total[id(root)]:
        return [_fullest(root)]
    arts: list[Node] = []
    mains: list[Node] = []
    work = [root]
    while work:
        node = work.pop()
        if node.drop >= 2 and node is not root:
            continue
        tag = _tag(node.label)
        if tag == "article" and total[id(node)]:
            arts.append(node)
        elif tag == "main":
            mains.append(node)
        if tag != "article" or not total[id(node)]:
            work += reversed(node.children)
    of = max((total[id(n)] for n in mains), default=0)
    whole = of if of * 2 >= total[id(root)] else total[id(root)]
    if arts and (sum(total[id(n)] for n in arts) * 2 >= whole or not mains and max(total[id(n)] for n in arts) * 4 >= whole):
        most = max(total[id(n)] for n in arts)
        return [n for n in arts if total[id(n)] * 4 >= most]
    if of * 2 >= total[id(root)]:
        return [next(n for n in mains if total[id(n)] == of)]
    node = root
    while True:
        inner = max((c for c in node.children if _tag(c.label) in BLOCK and _tag(c.label) not in HEADINGS | {"p", "ul", "ol", "table", "dl"} and not c.repeated), key=lambda c: total[id(c)], default=None)
        if inner is None or total[id(inner)] * 10 < total[id(node)] * 7 or not total[id(inner)]:
            return [node]
        node = inner


def _fullest(root: Node) -> Node:
    """Where no text counts, as all pages say the same: the ``article``, else the ``main`` with most text, else all."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    work = [root]
    while work:
        node = work.pop()
        if node.drop < 2 or node is root:
            found.get(_tag(node.label), []).append(node)
            work += reversed(node.children)
    nodes = found["article"] or found["main"]
    return max(nodes, key=_all_chars) if nodes else root


def _all_chars(node: Node) -> int:
    n, work = 0, [node]
    while work:
        x = work.pop()
        n += x.chars
        work += x.children
    return n


def is_semantic(node: Node) -> bool:
    return _tag(node.label) in ("article", "main")


def chrome_of(root: Node, article: Node) -> set[int]:
    """Children of an article's group without a tag of its own that come before or after all that varies, and say one text on all pages."""
    if root.pages < 2 or is_semantic(article):
        return set()
    total = _weights(root, 2)
    counts = [k for k, c in enumerate(article.children) if total[id(c)]]
    return {id(c) for k, c in enumerate(article.children) if counts and not counts[0] <= k <= counts[-1] and c.pages > 1}


def constant_of(root: Node) -> set[int]:
    """Groups of several pages in which, with all below them, no text varies."""
    total = _weights(root, 9)
    out, work = set(), [root]
    while work:
        node = work.pop()
        if node.pages > 1 and not total[id(node)]:
            out.add(id(node))
        work += node.children
    return out


class Wrapper:
    """A host's wrapper with what it says of its groups."""

    def __init__(self, root: Node):
        self.root, self.articles, self.constant = root, articles_of(root), constant_of(root)
        self.held = {id(n) for n in self.articles}
        self.semantic = all(is_semantic(n) for n in self.articles)
        self.chrome = chrome_of(root, self.articles[0]) if len(self.articles) == 1 else set()


def _kept(page: Page, groups: list[Node | None], holders: set[int], chrome: set[int], strict: bool, constant: set[int] | None) -> list[str]:
    """Blocks of the holders and of all below them that isn't dropped; ``groups``: the wrapper's for each container; ``constant``: those of one text, null without a wrapper.

    ``strict``: hints count too, outside of semantic elements.
    """
    n = len(groups)
    inside, semantic = [False] * n, [False] * n
    for i in range(n):
        up = page.parent[i]
        semantic[i] = page.tag[i] in ("article", "main") or (up >= 0 and semantic[up])
        within = up >= 0 and semantic[up]
        known = constant is not None and groups[i] is not None
        agreed = known and id(groups[i]) in constant
        dropped = page.drop[i] == 3 or i in chrome or page.drop[i] == 2 and (agreed or not known or not groups[i].pages > 1) or page.drop[i] == 1 and (agreed and page.tag[i] != "header" if within else strict)
        inside[i] = i in holders or (up >= 0 and inside[up] and not dropped)
    return [text for i, text in page.blocks if inside[i]]


def matched(root: Node, wrapper: Node) -> dict[int, Node]:
    """The wrapper's group for each node of a page's tree that it takes."""
    match: dict[int, Node] = {}
    work = [(root, wrapper)]
    while work:
        own, other = work.pop()
        match[id(own)] = other
        work += [(own.children[i], other.children[j]) for i, j in _aligned([c.label for c in own.children], [c.label for c in other.children]) if i is not None and j is not None]
    return match


def extract(html: str | None, root: Node | None, wrapper: Wrapper | None = None) -> str:
    """Main text of a page by its host's wrapper, or by itself; ``wrapper``: what is known of it already."""
    wrapper = wrapper or (Wrapper(root) if root is not None else None)
    page = Page(html or "")
    if not page.blocks:
        return ""
    own_root, nodes = page.tree()
    match = matched(own_root, wrapper.root) if wrapper is not None else {}
    groups = [match.get(id(node)) for node in nodes]
    holders = {i for i, g in enumerate(groups) if wrapper is not None and g is not None and id(g) in wrapper.held}
    local = articles_of(own_root)
    if holders and (wrapper.semantic or not all(is_semantic(n) for n in local)):
        chrome = {i for i, g in enumerate(groups) if g is not None and id(g) in wrapper.chrome}
        strict = wrapper.root.pages < 2 or any(_tag(n.label) in ("html", "body") for n in wrapper.articles)
    else:
        own = {id(n) for n in local}
        holders, chrome, strict = {i for i, node in enumerate(nodes) if id(node) in own}, set(), True
    return "\n".join(_kept(page, groups, holders, chrome, strict, wrapper.constant if wrapper is not None and wrapper.root.pages > 1 else None))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def infer_wrappers(pages: DataFrame, scratch: Scratch, url_col: str = "url", html_col: str = "html", fan: int = FAN) -> DataFrame:
    """(host, wrapper): folded over all distinct texts of each host, first in each task, then by host, ``fan`` tasks at a time."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dumps = [], []
            for html in batch.column(1).to_pylist():
                page = Page(html or "")
                text = "\n".join(x for _, x in page.blocks)
                keys.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                dumps.append(page.tree()[0].dump())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(dumps, pa.string())], ["host", "text", "wrapper"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Node] = {}
        task = TaskContext.get().partitionId()
        for batch in batches:
            for host, dump in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _fold_into(found, host, dump)
            if len(found) > 5000:
                yield _wrapper_batch(found, task)
                found = {}
        yield _wrapper_batch(found, task)

    def meet(table: pa.Table) -> pa.Table:
        found: dict[str, Node] = {}
        for host, dump in sorted(zip(table.column("host").to_pylist(), table.column("wrapper").to_pylist())):
            _fold_into(found, host, dump)
        return pa.Table.from_batches([_wrapper_batch(found, table.column("next")[0].as_py())])

    schema = "host string, task int, wrapper string"
    own_trees = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col)).mapInArrow(trees, "host string, text binary, wrapper string")
    distinct = own_trees.groupBy("host", "text").agg(F.min("wrapper").alias("wrapper"))
    folded, level = scratch.write(distinct.select("host", "wrapper").mapInArrow(own, schema), "wrappers0"), 0
    while not folded.groupBy("host").count().filter("count > 1").isEmpty():
        level += 1
        met = folded.withColumn("next", F.floor(F.col("task") / fan).cast("int")).groupBy("host", "next").applyInArrow(meet, schema)
        folded = scratch.write(met, f"wrappers{level}")
    return folded.select("host", "wrapper")


def _fold_into(found: dict[str, Node], host: str, dump: str) -> None:
    node = Node.load(dump)
    found[host] = fold(found[host], node) if host in found else node


def _wrapper_batch(found: dict[str, Node], task: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([task] * len(found), pa.int32()), pa.array([n.dump() for n in found.values()], pa.string())], ["host", "task", "wrapper"])


class _Wrappers:
    """Wrappers of hosts as read from their JSON, kept for the batches of a task."""

    def __init__(self):
        self.known: dict[str, Wrapper | None] = {}

    def of(self, host: str, dump: str | None) -> Wrapper | None:
        if host not in self.known:
            if len(self.known) > 5000:
                self.known.clear()
            self.known[host] = Wrapper(Node.load(dump)) if dump else None
        return self.known[host]


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: id, url, ``host`` and ``text``.

    Wrappers are sent to all tasks if their measured size is at most ``broadcast_bytes``; beyond, they are joined by host and salt.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    wrappers = infer_wrappers(pages, scratch, url_col, html_col)
    n_bytes = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("_host"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, host string, text string"
    known = None
    if n_bytes <= broadcast_bytes:
        known = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.toLocalIterator()})
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_html"), F.lit(SALTS)))
        spread = wrappers.select(F.col("host").alias("_host"), "wrapper", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("_salt"))
        rows = salted.join(spread, ["_host", "_salt"], "left").select(id_col, url_col, "_html", "_host", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers_of = _Wrappers()
        for batch in batches:
            hosts, htmls = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            dumps = [known.value.get(h) for h in hosts] if known is not None else batch.column(4).to_pylist()
            texts = [extract(x, None, wrappers_of.of(h, d)) for x, h, d in zip(htmls, hosts, dumps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(texts, pa.string())], [id_col, url_col, "host", "text"])

    return rows.mapInArrow(run, schema)
