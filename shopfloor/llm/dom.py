"""A small DOM for page extraction: tolerant parsing, simple tree matching, and text blocks."""

from __future__ import annotations

import hashlib
import re
from html import unescape

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSED_BY_BLOCK = frozenset(["p"])
#: An opening tag of the left side closes an open element of the right side, up to the nearest list or table.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table menu select".split())
DEEPEST = 200


class Node:
    __slots__ = ("tag", "names", "children")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names, self.children = tag, names, []

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.names}" if self.names else self.tag


TAG = re.compile(
    r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|$)|<[a-zA-Z][^>]*$""", re.S
)
NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())


class _Builder:
    def __init__(self):
        self.root = Node("#root")
        self.open = [self.root]

    def start(self, tag: str, attributes: str) -> None:
        stack = self.open
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSED_BY_BLOCK:
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SCOPES:
                    break
                if stack[i].tag in SIBLINGS[tag]:
                    del stack[i:]
        names = " ".join(x for found in NAMES.findall(attributes) for x in found if x).lower() if "=" in attributes else ""
        node = Node(tag, names)
        stack[-1].children.append(node)
        if tag not in VOID and len(stack) < DEEPEST:
            stack.append(node)

    def end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if tag not in BLOCK and self.open[i].tag in BLOCK:
                return  # an inline end tag closes nothing outside its block

    def text(self, data: str) -> None:
        self.open[-1].children.append(unescape(data) if "&" in data else data)


def parse(html: str) -> Node:
    """Tolerant of broken markup; character references are decoded, comments and declarations dropped."""
    builder, at = _Builder(), 0
    while True:
        found = TAG.search(html, at)
        if found is None:
            break
        if found.start() > at:
            builder.text(html[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            builder.end(tag)
            continue
        builder.start(tag, found[3] or found[6] or "")
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(html, at)
            builder.text(html[at : close.start() if close else len(html)])
            builder.end(tag)
            at = close.end() if close else len(html)
    if at < len(html):
        builder.text(html[at:])
    return builder.root


def skeleton(node: Node) -> list:
    """[label, digest, children] without text nodes. The digest covers the text and the structure below; it is empty without text."""
    parts, kids = [], []
    for child in node.children:
        if isinstance(child, str):
            text = " ".join(child.split())
            if text:
                parts.append(text)
        else:
            kids.append(skeleton(child))
            if kids[-1][1]:
                parts.append(f"{kids[-1][0]}\0{kids[-1][1]}")
    return [node.label, hashlib.blake2b("\0".join(parts).encode(), digest_size=8).hexdigest() if parts else "", kids]


class Matching:
    """Simple tree matching of two skeletons: the greatest number of pairs that keep labels, parents and order."""

    def __init__(self):
        self.shapes: dict[int, tuple[int, int]] = {}
        self.found: dict[tuple[int, int], int] = {}

    def shape(self, node: list) -> tuple[int, int]:
        """Hash of the labels and structure of a whole subtree, and its size."""
        out = self.shapes.get(id(node))
        if out is None:
            below = [self.shape(x) for x in node[2]]
            out = self.shapes[id(node)] = hash((node[0], *below)), 1 + sum(n for _, n in below)
        return out

    def pairs(self, a: list, b: list) -> int:
        """Pairs of two subtrees with their roots paired; 0 if the labels differ."""
        if a[0] != b[0]:
            return 0
        if not a[2] or not b[2]:
            return 1
        if self.shape(a) == self.shape(b):
            return self.shape(a)[1]
        key = id(a), id(b)
        if key not in self.found:
            self.found[key] = 1 + sum(self.pairs(a[2][i], b[2][j]) for i, j in self.align(a[2], b[2]))
        return self.found[key]

    def align(self, xs: list[list], ys: list[list]) -> list[tuple[int, int]]:
        """Children matched in order with the most pairs below them. Ends of equal structure are taken first, which loses no pair."""
        low, least = 0, min(len(xs), len(ys))
        while low < least and xs[low][0] == ys[low][0] and self.shape(xs[low]) == self.shape(ys[low]):
            low += 1
        end = 0
        while end < least - low and xs[-1 - end][0] == ys[-1 - end][0] and self.shape(xs[-1 - end]) == self.shape(ys[-1 - end]):
            end += 1
        out = [(i, i) for i in range(low)]
        mx, my = xs[low : len(xs) - end], ys[low : len(ys) - end]
        if len(mx) == len(my) == 1:
            if mx[0][0] == my[0][0]:
                out.append((low, low))
        elif mx and my:
            best = [[0] * (len(my) + 1) for _ in range(len(mx) + 1)]
            for i in range(len(mx) - 1, -1, -1):
                row, below, x = best[i], best[i + 1], mx[i]
                for j in range(len(my) - 1, -1, -1):
                    top = below[j] if below[j] >= row[j + 1] else row[j + 1]
                    if x[0] == my[j][0]:
                        top = max(top, below[j + 1] + self.pairs(x, my[j]))
                    row[j] = top
            i = j = 0
            while i < len(mx) and j < len(my):
                if best[i][j] == best[i + 1][j]:
                    i += 1
                elif best[i][j] == best[i][j + 1]:
                    j += 1
                else:
                    out.append((low + i, low + j))
                    i, j = i + 1, j + 1
        return out + [(len(xs) - k, len(ys) - k) for k in range(end, 0, -1)]

    def matched(self, a: list, b: list) -> list[tuple[tuple[int, ...], list, list, list[tuple[int, int]]]]:
        """(path of child numbers in a, node of a, node of b, pairs of their children) of all matched nodes under two roots of one label."""
        out, stack = [], [((), a, b)]
        while stack:
            path, x, y = stack.pop()
            kids = self.align(x[2], y[2]) if x[2] and y[2] else []
            out.append((path, x, y, kids))
            stack.extend((path + (i,), x[2][i], y[2][j]) for i, j in kids)
        return out


def matched(a: list, b: list) -> list[tuple[tuple[int, ...], list, list, list[tuple[int, int]]]]:
    return Matching().matched(a, b)


def merge(a: list, b: list) -> list:
    """A skeleton with the nodes of two under roots of one label: matched ones once, the others in between."""
    matching = Matching()

    def join(x: list, y: list) -> list:
        kids, i, j = [], 0, 0
        for p, q in matching.align(x[2], y[2]):
            kids += [*x[2][i:p], *y[2][j:q], join(x[2][p], y[2][q])]
            i, j = p + 1, q + 1
        return [x[0], "", [*kids, *x[2][i:], *y[2][j:]]]

    return join(a, b)
