"""Main text of web pages by wrapper induction.

Of each host a few distinct pages are references (the least by hash). The block elements of
every page of the host are aligned with those of each reference by simple tree matching, and
how often a text stands in an aligned place is summed over all distinct pages: a text on at
least half of them, and on four, is template; what else stands there is a varying slot. The
deepest region that holds most of the varying text outside links and asides is the host's content.
A page is read by the wrapper of its host: what is in the region, not template and not in an aside within it (comments,
adverts, related pages and forms vary too). Hosts of fewer than four distinct pages, and pages without the region,
are read by tags and names instead: article or main elements, or the region with most text, without menus, headers,
footers, sidebars, notices, adverts, forms and comments.

Pages are parsed once, in one forward pass whatever their markup; what is kept of them is an outline of block
elements and texts.

Rows and edge cases: null and empty html give an empty text; broken markup is read as it
comes (unclosed elements end with their parent, a quote that is never closed is none, a tag that is open at the end of the page
is dropped, as browsers do); a null or hostless url is read without a
wrapper; equal pages of a host count once; an empty table gives an empty result; other
columns are ignored. The whole page is read.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import materialize, small

#: A tag as most are written; no attempt looks beyond the next < or >.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:\s++[^\s=<>"'/]++(?:=(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'=<>`]++))?+)*+)\s*+(/?)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:=("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TAG_NAME, BETWEEN, ATTRIBUTE_NAME, EQUALS, UNQUOTED = (re.compile(x) for x in (r"[a-zA-Z][^\s/>]*+", r"[\s/]*+", r"=?[^\s/>=]*+", r"\s*+=\s*+", r"[^\s>]*+"))
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed"}
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
FOREIGN = {"svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "center", "address"}
#: Elements that are never main text.
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "input", "dialog", "menu", "canvas", "audio", "video", "map", "head", "fieldset", "object"} | FOREIGN | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
#: Of these, such as are also put around whole pages: with most of a page's text they are no asides.
FRAMES = {"form", "fieldset"}
#: Elements without running text, whatever the wrapper says.
NEVER = {"head", "button", "select", "option", "input", "canvas", "audio", "video", "map", "object"} | FOREIGN | RAW
#: Classes and ids that mark such elements, by themselves or before a word for a box.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs"
    " sidebar side aside widget header masthead topbar footer bottom copyright cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe"
    " subscription signup login share sharing social related recommended comment comments commentlist disqus reply replies respond feedback form search pagination pager toolbar legal disclaimer".split()
)
_MARKED = re.compile(rf"(?:{'|'.join(sorted(MARKS))})(?:[-_]?(?:area|bar|block|box|container|links|list|section|wrap|wrapper))?")
#: A start of one of these ends an open one of the named ones.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_CLOSE_P = {"p", "div", "article", "section", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "nav", "footer", "header", "aside", "main", "form", "figure", "hr", "address", "fieldset"}


class Node:
    """An element with children (elements and strings); its label is the tag with class and id."""

    __slots__ = ("tag", "label", "kids", "aside", "never")

    def __init__(self, tag: str, attributes: dict[str, str]):
        name = re.sub(r"[\d/]+", "", f"{attributes.get('class', '')} {attributes.get('id', '')}").lower()
        self.tag, self.kids, self.label = tag, [], f"{tag}.{'.'.join(sorted(name.split()))}" if name.strip() else tag
        self.never = tag in NEVER or "hidden" in attributes
        named = attributes.get("role", "").lower() in ROLES or (tag not in ("html", "body", "article", "main") and any(_MARKED.fullmatch(x) for x in name.split()))
        self.aside = 1 if self.never or named or (tag in ASIDE and tag not in FRAMES) else 2 if tag in FRAMES else 0



_NO_ATTRIBUTES: dict[str, str] = {}


def attributes_at(page: str, at: int, unclosed: set[str]) -> tuple[dict[str, str], bool, int]:
    """(attributes, is it closed by a slash, end) of the tag whose name ends at a place; the end is -1 if the page ends before it.

    unclosed: quotes that don't come again in this page.
    """
    found: dict[str, str] = {}
    while True:
        at = BETWEEN.match(page, at).end()
        if at >= len(page):
            return found, False, -1
        if page[at] == ">":
            return found, page[at - 1] == "/", at + 1
        name = ATTRIBUTE_NAME.match(page, at)
        value, at = "", name.end()
        if equals := EQUALS.match(page, at):
            at = equals.end()
            quote = page[at : at + 1]
            end = page.find(quote, at + 1) if quote in ("'", '"') and quote not in unclosed else -1
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                if quote in ("'", '"'):
                    unclosed.add(quote)
                bare = UNQUOTED.match(page, at)
                value, at = bare[0].strip("\"'"), bare.end()
        found.setdefault(name[0].lower(), value)


class _Builder:
    """A tree that grows by tags and texts in page order."""

    def __init__(self):
        self.root = Node("html", _NO_ATTRIBUTES)
        self.stack, self.open = [self.root], {}

    def cut(self, i: int) -> None:
        """Ends the open elements from the i-th on."""
        for node in self.stack[i:]:
            self.open[node.tag] -= 1
        del self.stack[i:]

    def end(self, tag: str) -> None:
        if self.open.get(tag):
            self.cut(next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == tag))

    def start(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        stack = self.stack
        if tag in ("html", "body") and len(stack) == 1:
            return
        if tag in BLOCKS_CLOSE_P:
            for foreign in FOREIGN:  # a block within a drawing ends it
                if self.open.get(foreign):
                    self.cut(next(i for i in range(1, len(stack)) if stack[i].tag == foreign))
        ends = CLOSES.get(tag, ())
        for i in range(len(stack) - 1, max(len(stack) - 4, 0), -1):
            if stack[i].tag in ends:
                self.cut(i)
                break
            if stack[i].tag in ("ul", "ol", "table", "dl"):
                break
        if tag in BLOCKS_CLOSE_P and self.open.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    self.cut(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        node = Node(tag, attributes)
        stack[-1].kids.append(node)
        if tag not in VOID and tag not in RAW and not closed:
            stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1


def parse(page: str) -> Node:
    """The tree of a page, in one forward pass."""
    tree, text_from, look, unclosed = _Builder(), 0, 0, set()
    while (at := page.find("<", look)) >= 0:
        tag, kind = None, page[at + 1 : at + 2]
        if m := TAG.match(page, at):
            ends, tag, end, closed = bool(m[1]), m[2].lower(), m.end(), bool(m[4])
            attributes = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m[3])} if m[3] else _NO_ATTRIBUTES
        elif name := TAG_NAME.match(page, at + 2 if kind == "/" else at + 1):
            ends, tag = kind == "/", name[0].lower()
            attributes, closed, end = attributes_at(page, name.end(), unclosed)
            if end < 0:
                tag, end = None, len(page)
        elif kind in ("!", "?", "/"):
            opening, closing = next(((o, c) for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(o, at)), ("<!", ">"))
            found = page.find(closing, at + len(opening))
            end = found + len(closing) if found >= 0 else len(page)
        else:
            look = at + 1
            continue
        if at > text_from:
            tree.stack[-1].kids.append(page[text_from:at])
        text_from = look = end
        if tag is None:
            continue
        if ends:
            tree.end(tag)
            continue
        tree.start(tag, attributes, closed)
        if tag in RAW:
            m = _RAW_END[tag].search(page, end)
            close = page.find(">", m.end()) if m else -1
            text_from = look = close + 1 if close >= 0 else len(page)
    if text_from < len(page):
        tree.stack[-1].kids.append(page[text_from:])
    return tree.root


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


class Outline:
    """The block elements of a tree in page order: labels, parents, and which are marked as aside by tag or name; runs:
    (element, text, characters outside links) of each run of text and inline elements. Inline asides, and elements without running text, are left out."""

    def __init__(self, labels: list[str], parents: list[int], asides: list[int], runs: list):
        self.labels, self.parents, self.asides, self.runs = labels, parents, asides, runs

    def path(self, at: int) -> str:
        parts = []
        while at >= 0:
            parts.append(self.labels[at])
            at = self.parents[at]
        return "/" + "/".join(reversed(parts))

    def kids(self) -> list[list[int]]:
        below: list[list[int]] = [[] for _ in self.labels]
        for i, p in enumerate(self.parents):
            if p >= 0:
                below[p].append(i)
        return below

    def inherited(self, of, start) -> list:
        """For each element of(what its parent has, its number), the root's parent having start."""
        out: list = []
        for i, p in enumerate(self.parents):
            out.append(of(out[p] if p >= 0 else start, i))
        return out

    def path_keys(self) -> list[int]:
        """A hash of the path of each element."""
        from xxhash import xxh3_64_intdigest

        return self.inherited(lambda above, i: xxh3_64_intdigest(self.labels[i].encode("utf-8", "surrogatepass"), above), 0)

    def aside(self) -> list[bool]:
        """Is an element in an aside?"""
        return self.inherited(lambda above, i: above or bool(self.asides[i]), False)

    def text(self) -> str:
        return json.dumps([self.labels, self.parents, self.asides, self.runs], ensure_ascii=False)

    @classmethod
    def read(cls, text: str) -> Outline:
        return cls(*json.loads(text))


def outline(root: Node) -> Outline:
    out = Outline([], [], [], [])
    run: list[str] = []
    of, own = -1, 0

    def flush() -> None:
        nonlocal own
        if text := clean("".join(run)):
            out.runs.append((of, text, min(own, len(text))))
        run.clear()
        own = 0

    todo: list = [("in", root, -1, False)]
    while todo:
        kind, one, at, link = todo.pop()
        if kind == "text":
            if not run:
                of = at
            run.append(one)
            own += 0 if link else len(one)
            continue
        if kind == "flush":
            flush()
            continue
        if one.never or (one.aside and one.tag in INLINE):
            continue
        if one.tag == "br":
            if not run:
                of = at
            run.append(" ")
            continue
        if one.tag not in INLINE:
            flush()
            todo.append(("flush", None, at, link))
            out.labels.append(one.label)
            out.parents.append(at)
            out.asides.append(one.aside)
            at = len(out.labels) - 1
        link = link or one.tag == "a"
        todo.extend(("text" if isinstance(kid, str) else "in", kid, at, link) for kid in reversed(one.kids))
    flush()
    if 2 in out.asides:
        held = [0] * len(out.labels)
        for at, text, _ in out.runs:
            held[at] += len(text)
        for i in range(len(held) - 1, 0, -1):
            held[out.parents[i]] += held[i]
        out.asides = [int(mark == 1 or (mark == 2 and 2 * h < held[0])) for mark, h in zip(out.asides, held, strict=True)]
    return out


#: Rows of siblings whose table has more cells are halved first, so that no table has; the sum is the same.
TABLE = 4_000_000


class Shapes:
    """Numbered shapes of subtrees, how many elements two of them have in common, and how the elements below align, kept over pages."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.rows: list[tuple] = []  # label, shapes below, height, elements
        self.sizes: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def of(self, tree: Outline) -> tuple[list[int], list[list[int]]]:
        """(shape, elements below) of each element."""
        kids, own = tree.kids(), [0] * len(tree.labels)
        for i in range(len(own) - 1, -1, -1):
            inner = tuple([own[k] for k in kids[i]])
            key = (tree.labels[i], inner)
            if key not in self.known:
                self.known[key] = len(self.rows)
                self.rows.append((*key, 1 + max((self.rows[s][2] for s in inner), default=0), 1 + sum(self.rows[s][3] for s in inner)))
            own[i] = self.known[key]
        return own, kids


def aligned_rows(xs: tuple, ys: tuple, size) -> list[tuple[int, int]]:
    """Places of two rows of siblings that are aligned in order for the greatest sum of size(x, y).

    Equal subtrees at either end belong together in some best alignment; only what is between needs a table.
    """
    low, most = 0, min(len(xs), len(ys))
    while low < most and xs[low] == ys[low]:
        low += 1
    high = 0
    while high < most - low and xs[-1 - high] == ys[-1 - high]:
        high += 1
    a, b = xs[low : len(xs) - high], ys[low : len(ys) - high]
    out = [(i, i) for i in range(low)]
    if a and b:
        out += [(i + low, j + low) for i, j in _best_pairs(a, b, size)]
    return out + [(len(xs) - k, len(ys) - k) for k in range(high, 0, -1)]


def _last_row(xs: tuple, ys: tuple, size) -> np.ndarray:
    """The greatest sums of all xs with the first 0, 1, 2... ys."""
    uy, iy = np.unique(ys, return_inverse=True)
    row, known = np.zeros(len(ys) + 1, dtype=np.int64), {}
    for x in xs:
        if x not in known:
            if len(known) * len(ys) > TABLE:
                known.clear()
            known[x] = np.array([size(x, y) for y in uy.tolist()], dtype=np.int64)[iy]
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + known[x]))
    return row


def _best_pairs(xs: tuple, ys: tuple, size, table: int | None = None) -> list[tuple[int, int]]:
    if len(xs) * len(ys) > (table or TABLE) and len(xs) > 1:
        half = len(xs) // 2
        ahead, behind = _last_row(xs[:half], ys, size), _last_row(xs[half:][::-1], ys[::-1], size)
        cut = int((ahead + behind[::-1]).argmax())
        return _best_pairs(xs[:half], ys[:cut], size, table) + [(i + half, j + cut) for i, j in _best_pairs(xs[half:], ys[cut:], size, table)]
    if len(xs) * len(ys) <= 400:
        m = [[0] * (len(ys) + 1)]
        for x in xs:
            before, row = m[-1], [0]
            for j, y in enumerate(ys):
                row.append(max(before[j + 1], row[j], before[j] + size(x, y)))
            m.append(row)
    else:
        (ux, ix), (uy, iy) = np.unique(xs, return_inverse=True), np.unique(ys, return_inverse=True)
        w = np.array([[size(x, y) for y in uy.tolist()] for x in ux.tolist()], dtype=np.int32)[:, iy]
        m = np.zeros((len(xs) + 1, len(ys) + 1), dtype=np.int32)
        for i, k in enumerate(ix):
            np.maximum.accumulate(np.maximum(m[i, 1:], m[i, :-1] + w[k]), out=m[i + 1, 1:])
    found, i, j = [], len(xs), len(ys)
    while i and j:
        if m[i][j] == m[i - 1][j]:
            i -= 1
        elif m[i][j] == m[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found[::-1]


def align(a: tuple, b: tuple, known: Shapes) -> list[tuple[int, int]]:
    """Simple tree matching of two trees by their shapes: the most elements that can be aligned in order, level by level."""
    of, below = (a[0], b[0]), (a[1], b[1])
    shapes, sizes = known.rows, known.sizes
    if not of[0] or not of[1] or shapes[of[0][0]][0] != shapes[of[1][0]][0]:
        return []

    def size(x: int, y: int) -> int:
        if x == y:
            return shapes[x][3]
        if shapes[x][0] != shapes[y][0]:
            return 0
        return sizes.get((x, y), 1)

    def rows(x: int, y: int) -> list[tuple[int, int]]:
        found = known.pairs.get((x, y))
        if found is None:
            found = aligned_rows(shapes[x][1], shapes[y][1], size)
            if len(found) <= 200:
                known.pairs[x, y] = found
        return found

    # pairs of shapes that the roots need, the lowest first
    needed, todo = set(), [(of[0][0], of[1][0])]
    while todo:
        x, y = todo.pop()
        if x == y or (x, y) in sizes or (x, y) in needed or shapes[x][0] != shapes[y][0] or not shapes[x][1] or not shapes[y][1]:
            continue
        needed.add((x, y))
        todo.extend((p, q) for p in set(shapes[x][1]) for q in set(shapes[y][1]))
    for x, y in sorted(needed, key=lambda pair: shapes[pair[0]][2]):
        xs, ys = shapes[x][1], shapes[y][1]
        sizes[x, y] = 1 + sum(size(xs[i], ys[j]) for i, j in rows(x, y))

    pairs, todo = [], [(0, 0)]
    while todo:
        p, q = todo.pop()
        pairs.append((p, q))
        x, y, ps, qs = of[0][p], of[1][q], below[0][p], below[1][q]
        if x == y:
            todo.extend(zip(ps, qs, strict=True))
        elif ps and qs:
            todo.extend((ps[i], qs[j]) for i, j in rows(x, y))
    return pairs


def tree_match(a: Node, b: Node, pairs: list[tuple[int, int]] | None = None) -> int:
    """How many block elements can be aligned; pairs gets their numbers in page order."""
    known = Shapes()
    found = align(known.of(outline(a)), known.of(outline(b)), known)
    if pairs is not None:
        pairs.extend(sorted(found))
    return len(found)


def slot_key(path_key: int, text: str) -> int:
    """A signed 64-bit hash of a text and the path of its block."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), path_key)).view(np.int64))


class References:
    """The reference trees of a host."""

    def __init__(self, trees: list[Outline]):
        self.trees, self.known = trees, None

    def slots(self, page: Outline) -> list[tuple[int, int, int, int, int]]:
        """(reference, its element, number of the run in it, key, characters outside links: below 0 in an aside) of each aligned run of a page."""
        if self.known is None or len(self.known.rows) + len(self.known.sizes) + len(self.known.pairs) > 20_000:
            self.known = Shapes()
            self.shapes = [self.known.of(t) for t in self.trees]
        keys, aside, runs, found = page.path_keys(), page.aside(), {}, []
        for at, text, own in page.runs:
            runs.setdefault(at, []).append((slot_key(keys[at], text), -own if aside[at] else own))
        own = self.known.of(page)
        for r, shape in enumerate(self.shapes):
            for p, q in align(shape, own, self.known):
                if q in runs:
                    found.extend((r, p, k, *one) for k, one in enumerate(runs[q]))
        return found


#: A text in an aligned place is template on so many distinct pages, and so large a share of the host's.
DISTINCT, SHARE = 4, 0.5


def induce(pages: list[str], references: int = 4) -> dict:
    """The wrapper of a host whose pages are at hand, with the template's texts as `constant`."""
    trees = [outline(parse(p)) for p in sorted(set(pages))]
    counts: dict[tuple, int] = {}
    known = References(trees[:references])
    for tree in trees:
        for slot in known.slots(tree):
            counts[slot] = counts.get(slot, 0) + 1
    template = {s[3] for s, n in counts.items() if n >= max(DISTINCT, SHARE * len(trees))}
    places = [(r, p, n * own) for (r, p, _, key, own), n in counts.items() if key not in template]
    texts = {text for tree in trees for keys in (tree.path_keys(),) for at, text, _ in tree.runs if slot_key(keys[at], text) in template}
    return {"constant": sorted(texts), "template": sorted(template), "region": content_region(trees, places), "pages": len(trees)}


def region(trees: list[Outline], masses: list[tuple[int, int, int]], share: float = 0.75) -> str:
    """The deepest path that holds at least this share of all the text of (tree, element, size) in containers; a paragraph or a list is no container."""
    total: dict[int, int] = {}
    where: dict[int, tuple[int, int, int]] = {}
    for t, tree in enumerate(trees):
        below = [0] * len(tree.labels)
        for _, at, size in (m for m in masses if m[0] == t):
            while tree.parents[at] >= 0 and tree.labels[at].split(".")[0] in TEXTUAL:
                at = tree.parents[at]
            below[at] += size
        for i in range(len(below) - 1, 0, -1):
            below[tree.parents[i]] += below[i]
        depths = tree.inherited(lambda above, i: above + 1, 0)
        for i, key in enumerate(tree.path_keys()):
            if below[i]:
                total[key] = total.get(key, 0) + below[i]
                where.setdefault(key, (depths[i], t, i))
    most = max(total.values(), default=0)
    best = max((where[key] for key, size in total.items() if size >= share * most), default=None)
    return trees[best[1]].path(best[2]) if best else ""


def content_region(trees: list[Outline], places: list[tuple[int, int, int]]) -> str:
    """The region of varying texts (reference, element, size, below 0 in an aside); asides count only where nothing else varies."""
    return region(trees, [x for x in places if x[2] > 0] or [(r, p, -size) for r, p, size in places])


def read_page(tree: Outline, wrapper: dict | None) -> str:
    """The main text of a page."""
    template, where = (set(wrapper["template"]), wrapper["region"]) if wrapper else (set(), "")
    labels, runs, aside = tree.labels, tree.runs, tree.aside()

    def within(path: str) -> list[int]:
        """For each element how far it is below the path's last one, -1 outside."""
        steps = path.split("/")[1:]
        depths = tree.inherited(lambda above, i: above + 1, 0)
        # so many steps of the path lead here, -1 where the way has left it
        led = tree.inherited(lambda above, i: above if above == len(steps) or above < 0 else above + 1 if labels[i] == steps[above] else -1, 0)
        return [d - len(steps) if n == len(steps) else -1 for d, n in zip(depths, led, strict=True)]

    chosen: list = []
    # a region that is all of the page tells nothing
    if where.count("/") > 1 and wrapper["pages"] >= DISTINCT:
        below = within(where)
        # the region's own way may lead through asides, what is below may not
        marked = tree.inherited(lambda above, i: above or (below[i] > 0 and bool(tree.asides[i])), False)
        chosen = [x for x in runs if below[x[0]] >= 0 and not marked[x[0]]]
    if not chosen:
        for kind in ("article", "main"):
            tops = tree.inherited(lambda above, i, kind=kind: above or (labels[i].split(".")[0] == kind and not aside[i]), False)
            if any(tops):
                chosen = [x for x in runs if tops[x[0]] and not aside[x[0]]]
                break
    if not chosen:
        every = [x for x in runs if not aside[x[0]]] or runs
        below = within(where) if where else []
        chosen = [x for x in every if below and below[x[0]] >= 0]
        if not chosen:
            below = within(region([tree], [(0, at, len(text)) for at, text, _ in every]))
            chosen = [x for x in every if below[x[0]] >= 0]
    if template:
        keys = tree.path_keys()
        chosen = [x for x in chosen if slot_key(keys[x[0]], x[1]) not in template]
    return " ".join(x[1] for x in chosen)


def main_text(page: str, wrapper: dict | None) -> str:
    return read_page(outline(parse(page)), wrapper)


def outlines(pages: DataFrame) -> DataFrame:
    """page_id, url, host, rank (a hash of the page) and the page's outline for every row of pages (page_id, url, host, html)."""

    def draw(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            drawn = [None if page is None else outline(parse(page)).text() for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(drawn, pa.string())], names=["page_id", "url", "host", "rank", "tree"])

    rows = pages.select("page_id", "url", "host", F.xxhash64("html", F.lit(5)).alias("rank"), "html")
    return rows.mapInArrow(draw, f"page_id {dict(pages.dtypes)['page_id']}, url string, host string, rank long, tree string")


def wrappers(pages: DataFrame, references: int = 4) -> DataFrame:
    """(host, wrapper as JSON) from all outlines of pages (host, rank, tree) of each host with two distinct pages."""
    known = pages.filter("host <> '' and tree is not null").select("host", "rank", "tree")
    ranks = materialize(known.select("host", "rank").distinct(), "ranks")
    hosts = ranks.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter("pages > 1")
    least = ranks
    for by in (["host", F.pmod("rank", F.lit(16))], ["host"]):
        least = least.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("rank"))).filter(F.col("k") <= references).drop("k")
    picks = materialize(least.join(hosts.select("host"), "host", "left_semi"), "picks")
    picked = known.join(F.broadcast(picks) if small(picks, text="host") else picks, ["host", "rank"]).groupBy("host", "rank").agg(F.min("tree").alias("tree"))
    drawn = picked.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "tree"))).alias("trees"))
    drawn = materialize(drawn.select("host", F.concat(F.lit("["), F.array_join("trees.tree", ","), F.lit("]")).alias("trees")), "references")
    met = known.join(F.broadcast(drawn) if small(drawn, text="trees") else drawn, "host")

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parsed: dict[str, References] = {}
        for batch in batches:
            found, ends = [], [0]
            for page, trees in zip(batch.column("tree").to_pylist(), batch.column("trees").to_pylist(), strict=True):
                if trees not in parsed:
                    if len(parsed) > 100:
                        parsed.clear()
                    parsed[trees] = References([Outline(*t) for t in json.loads(trees)])
                found.extend(parsed[trees].slots(Outline.read(page)))
                ends.append(len(found))
            ref, at, run, key, own = np.array(found, dtype=np.int64).reshape(-1, 5).T
            columns = ((ref << 56) | (at << 28) | run, key.copy(), own.astype(np.int32))
            flat = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["place", "key", "own"])
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("rank"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["host", "rank", "slots"])

    placed = met.select("host", "rank", "tree", "trees").mapInArrow(place, "host string, rank long, slots array<struct<place: long, key: long, own: int>>")
    # equal pages count once
    placed = placed.groupBy("host", "rank").agg(F.first("slots").alias("slots")).select("host", F.explode("slots").alias("s")).select("host", "s.*")
    counts = placed.groupBy("host", "place", "key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
    # a place is a reference, its element and the number of the run in it
    counts = counts.select("host", F.shiftright("place", 56).alias("ref"), F.shiftright("place", 28).bitwiseAND(F.lit((1 << 28) - 1)).alias("at"), "key", "n", "own")
    counts = counts.join(F.broadcast(hosts) if small(hosts, text="host") else hosts, "host")
    often = (F.col("n") >= DISTINCT) & (F.col("n") >= SHARE * F.col("pages"))
    mass = lambda sign: F.sum(F.when(often | (sign * F.col("own") < 0), 0).otherwise(F.col("n") * F.col("own")))
    places = counts.groupBy("host", "ref", "at").agg(F.collect_set(F.when(often, F.col("key"))).alias("template"), mass(1).alias("mass"), mass(-1).alias("in_asides"), F.max("pages").alias("pages"))
    learned = places.groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("template"))).alias("template"), F.collect_list(F.struct("ref", "at", "mass", "in_asides")).alias("places"), F.max("pages").alias("pages"))

    def finish(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = []
            for trees, template, places, pages in zip(*(batch.column(c).to_pylist() for c in ("trees", "template", "places", "pages")), strict=True):
                masses = [(one["ref"], one["at"], one[c]) for one in places for c in ("mass", "in_asides") if one[c]]
                where = content_region([Outline(*t) for t in json.loads(trees)], masses)
                texts.append(json.dumps({"template": sorted(template), "region": where, "pages": pages}))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(texts, pa.string())], names=["host", "wrapper"])

    return learned.join(drawn, "host").select("host", "trees", "template", "places", "pages").mapInArrow(finish, "host string, wrapper string")


def extract_text(pages: DataFrame, references: int = 4) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    ship(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    drawn = materialize(outlines(pages.select("page_id", "url", host.alias("host"), "html")), "outlines")
    known = materialize(wrappers(drawn, references), "wrappers")
    if small(known, text="wrapper"):
        known = F.broadcast(known)
    met = drawn.join(known, "host", "left").select("page_id", "url", "tree", "wrapper")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parsed: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column("tree").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if wrapper is not None and wrapper not in parsed:
                    if len(parsed) > 10_000:
                        parsed.clear()
                    parsed[wrapper] = json.loads(wrapper)
                texts.append("" if page is None else read_page(Outline.read(page), parsed.get(wrapper)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return met.mapInArrow(read, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
