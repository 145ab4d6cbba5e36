"""Main text of HTML pages by wrapper induction.

Pages of one host share templates. The distinct pages with text fall into layouts (their containers around the
article); pages of every layout are merged into the host's reference, one reference for each 16 layouts. Every
distinct page's DOM is aligned with the reference by simple tree matching, and each task counts for every reference
node which texts its pages hold there. Copies of a page count once, however many there are. Nodes whose most
frequent text is that of nearly all pages are
template; the other slots vary and are content. A page then loses what aligns with template nodes and what
HTML itself names as furniture (menus, footers, adverts, forms, comments, ...), and the text blocks of its
article are joined. Votes are summed in the tasks first, so a hot host costs what its pages cost.

Cases: a null or empty html gives an empty text; a null url or one without a host has no template; broken
markup is closed where HTML would close it; a form, a nav or another such element that the only article is in hides nothing; equal pages are extracted one by one, and vote once; nesting beyond 200 levels
is flattened, without loss of text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shopfloor.llm.dom import BLOCK, Node, matched, merge, parse, skeleton
from shopfloor.llm.store import keep, table

#: Elements and names that mark what is not the article.
FURNITURE_TAGS = frozenset("aside button canvas dialog footer form head header iframe input menu nav noscript object script search select style svg template textarea title".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies "
    "consent dialog disqus footer header menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
CONTENT_NAMES = frozenset("article content entry main post story".split())
#: Words that add only place or shape to a furniture word: "post-share-buttons" names furniture as a whole, "post-share-story" does not.
PLAIN_NAMES = frozenset(
    "area article bar block bottom box btn button buttons card center column container desktop entry fixed floating form global icon icons inline inner item "
    "large left link links list main medium mobile module outer page panel post primary right row secondary section site slot small sticky top unit wrap wrapper".split()
)
#: Furniture words that leave no doubt, however much text is below.
SURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer menu modal nav navbar navigation "
    "newsletter pagination popup replies respond sidebar signup sponsor sponsored subscribe toolbar".split()
)
NEVER_NAMED = frozenset("article body html main".split())
#: Furniture elements that frameworks or an end tag left out put around the article.
WRAPPER_TAGS = frozenset("aside dialog footer form header menu nav search".split())
#: A form with this share of the text is around it, and not a part of it.
FORM_SHARE = 0.8
NAME = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Wrapper:
    """Distinct pages that must match a node, and the share of them with the same text, for it to be template; more inside articles."""

    pages: int = 4
    share: float = 0.8
    article_pages: int = 8
    article_share: float = 0.95


HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]+)"


#: Layouts of a host that share a reference, and pages of each layout in it.
LAYOUTS, SAMPLES = 16, 2
CONTAINERS = frozenset("#root html body div section header footer nav aside form".split())
DIGITS = re.compile(r"\d+")


def layout(node: list, depth: int = 6) -> str:
    """Block elements around the article, to a depth; runs of equal paragraphs, lists and tables count once, numbers in names not at all."""
    label = DIGITS.sub("", node[0])
    if not depth or label.split(".")[0] not in CONTAINERS:
        return label
    kids: list[str] = []
    for kid in node[2]:
        tag = kid[0].split(".")[0]
        if tag in BLOCK:
            below = layout(kid, depth - 1)
            if tag in CONTAINERS or not kids or kids[-1] != below:
                kids.append(below)
    return f"{label}({','.join(kids)})"


def layout_digest(tree: list) -> str:
    return hashlib.blake2b(layout(tree).encode(), digest_size=8).hexdigest()


def tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, layout, digest (of the text of the page), tree (as JSON): pages with text, equal ones of a task once."""
    seen: set[tuple] = set()
    for batch in batches:
        rows = []
        for name, html in zip(*(batch.column(c).to_pylist() for c in ("host", "html"))):
            tree = skeleton(parse(html or ""))
            key = (name, layout_digest(tree), tree[1])
            if tree[1] and key not in seen:
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(key)
                rows.append((*key, json.dumps(tree, separators=(",", ":"))))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["host", "layout", "digest", "tree"])


def layout_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        layouts = [layout_digest(skeleton(parse(x or ""))) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), pa.array(layouts, pa.string())], ["host", "key", "layout"])


def reference_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [json.dumps(reduce(merge, map(json.loads, x)), separators=(",", ":")) for x in batch.column("trees").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("part"), pa.array(trees, pa.string())], ["host", "part", "reference"])


def vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, part, node (path in the reference), digest, pages that hold this text there; summed over the task's rows."""
    known: dict[tuple, list] = {}
    votes: Counter = Counter()
    for batch in batches:
        for name, part, reference, tree in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "reference", "tree"))):
            at = (name, part)
            if at not in known:
                known = {at: json.loads(reference)} if len(known) > 500 else known | {at: json.loads(reference)}
            for path, _, b, _ in matched(known[at], json.loads(tree)):
                if path and b[1]:
                    votes[name, part, ".".join(map(str, path)), b[1]] += 1
            if len(votes) > 200_000:
                yield vote_batch(votes)
                votes.clear()
    yield vote_batch(votes)


def vote_batch(votes: Counter) -> pa.RecordBatch:
    columns = [[k[i] for k in votes] for i in range(4)] + [list(votes.values())]
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], ["host", "part", "node", "digest", "n"])


def words_of(names: str) -> list[str]:
    return NAME.findall(names)


def named_furniture(node: Node) -> bool:
    """One furniture word in a class, id or role is enough: right around an article, too wide inside it."""
    return bool(node.names) and node.tag not in NEVER_NAMED and not FURNITURE_NAMES.isdisjoint(words_of(node.names))


def whole_names(node: Node) -> list[str]:
    """Classes, ids and roles that name furniture as a whole: furniture words, and words that say only where or in what shape."""
    if not node.names or node.tag in NEVER_NAMED or FURNITURE_NAMES.isdisjoint(words_of(node.names)):
        return []
    return [x for x in node.names.split() if (w := set(words_of(x))) & FURNITURE_NAMES and w <= FURNITURE_NAMES | PLAIN_NAMES]


def furniture(node: Node, holders: set[int]) -> bool:
    """By tag or by a name; neither counts for elements that hold the article (`holders`)."""
    return id(node) not in holders and (node.tag in FURNITURE_TAGS or named_furniture(node))


#: What holds the text, best first.
HOLDS_TEXT = (
    lambda n: n.tag == "article",
    lambda n: n.tag == "main" or "main" in n.names.split(),
    lambda n: n.tag in ("div", "section", "td") and not CONTENT_NAMES.isdisjoint(words_of(n.names)),
)


def article_holders(root: Node) -> set[int]:
    """Furniture elements (by identity) with an article, main or content element inside. Those that a furniture tag or a whole class
    or id marks (comments, related, a form or a nav around the page, ...) count only if what they hold is longer than any such element beside them."""
    order: list[Node] = []
    parent: list[int] = []
    outer: list[int] = []  # place of the nearest element around it that is sure to be furniture, -1 if none
    loose: list[bool] = []
    sure: list[bool] = []
    text: list[int] = []  # text below that no sure furniture inside surrounds
    stack: list = [(root, -1, -1)]
    while stack:
        node, above, around = stack.pop()
        place = len(order)
        order.append(node)
        parent.append(above)
        outer.append(around)
        sure.append(node.tag in WRAPPER_TAGS or (named_furniture(node) and not FURNITURE_NAMES.isdisjoint(node.names.split())))
        loose.append(node is not root and named_furniture(node))
        text.append(sum(len(c.strip()) for c in node.children if isinstance(c, str)))
        around = place if sure[place] else around
        stack.extend((c, place, around) for c in reversed(node.children) if isinstance(c, Node) and (c.tag not in FURNITURE_TAGS or c.tag in WRAPPER_TAGS))
    holds = [any(fits(node) for fits in HOLDS_TEXT) for node in order]
    if not any(holds):
        return set()
    for i in range(len(order) - 1, 0, -1):
        if not sure[i]:
            text[parent[i]] += text[i]
    inside = [-1] * len(order)  # longest text holder below
    beside: dict[int, int] = {}  # longest one by the sure furniture nearest around it
    for i in range(len(order) - 1, 0, -1):
        if holds[i]:
            beside[outer[i]] = max(beside.get(outer[i], -1), text[i])
            inside[parent[i]] = max(inside[parent[i]], text[i])
        inside[parent[i]] = max(inside[parent[i]], inside[i])
    out, free = set(), {-1: beside.get(-1, -1)}
    for i, node in enumerate(order):
        if sure[i]:
            rival = free[outer[i]]
            free[i] = max(rival, beside.get(i, -1))
            if inside[i] > rival:
                out.add(id(node))
        elif loose[i] and inside[i] >= 0:
            out.add(id(node))
    return out


def text_size(root: Node, skip: Callable[[Node], bool]) -> int:
    """Characters of text below outside links, and outside elements to skip."""
    size, stack = 0, [root]
    while stack:
        for child in stack.pop().children:
            if isinstance(child, str):
                size += len(child.strip())
            elif child.tag != "a" and not skip(child):
                stack.append(child)
    return size


#: A main element with so many times the text of its articles is the text, and they are teasers.
TEASERS = 3


def article_roots(root: Node, holders: set[int]) -> list[Node]:
    """The outermost articles, unless the main element has far more text than they have; else the main element, else elements named as content, else the page."""
    def outermost(fits) -> list[Node]:
        out, stack = [], [root]
        while stack:
            node = stack.pop()
            if node is not root and furniture(node, holders):
                continue
            if fits(node):
                out.append(node)
            else:
                stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
        return out

    size = lambda nodes: sum(text_size(x, lambda c: furniture(c, holders)) for x in nodes)
    articles, mains = outermost(HOLDS_TEXT[0]), outermost(HOLDS_TEXT[1])
    if articles and not (mains and size(mains) > TEASERS * size(articles)):
        return articles
    return mains or outermost(HOLDS_TEXT[2]) or [root]


def blocks(root: Node, template: set[int], holders: set[int]) -> list[str]:
    """Text blocks in page order without furniture and template nodes (by identity). Inside an article only a whole name marks
    furniture, and none that the words for adverts, comments and the like don't confirm if most of the text is in it."""
    out: list[str] = []
    line: list[str] = []
    strict = any(fits(root) for fits in HOLDS_TEXT)
    whole: list[int] = []

    def share(node: Node) -> float:
        skip = lambda c: c.tag in FURNITURE_TAGS and c.tag != "form"
        if not whole:
            whole.append(text_size(root, skip))
        return text_size(node, skip) / whole[0] if whole[0] else 0.0

    def left_out(node: Node) -> bool:
        if id(node) in holders:
            return False
        if node.tag in FURNITURE_TAGS:
            return node.tag != "form" or share(node) < FORM_SHARE
        names = whole_names(node)
        if any(not SURE_NAMES.isdisjoint(words_of(x)) for x in names):
            return True
        if strict:
            return bool(names) and share(node) <= 0.5
        return bool(names) or (named_furniture(node) and share(node) <= 0.5)

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif x is root or not (id(x) in template or left_out(x)):
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
        elif x.tag in BLOCK:
            flush()
    flush()
    return out


def template_nodes(root: Node, tree: list, reference: list, rules: dict[str, tuple[str, bool]]) -> set[int]:
    """Nodes of the page that align with template nodes of the reference and hold their text."""
    constant = {tuple(map(int, path.split("."))): rule for path, rule in rules.items()}
    out = set()
    stack = {(): root}
    for path, _, b, pairs in matched(reference, tree):
        node = stack[path]
        kids = [c for c in node.children if isinstance(c, Node)]
        for i, j in pairs:
            stack[path + (i,)] = kids[j]
        digest, anywhere = constant.get(path, ("", False))
        if digest and digest == b[1] and (anywhere or not in_article(path, reference)):
            out.add(id(node))
    return out


def in_article(path: tuple[int, ...], reference: list) -> bool:
    for i in path:
        if reference[0].split(".")[0] in ("article", "main"):
            return True
        reference = reference[2][i]
    return reference[0].split(".")[0] in ("article", "main")


def extract(html: str, reference: list | None = None, rules: dict[str, tuple[str, bool]] | None = None) -> str:
    """`rules`: paths of template nodes in the reference -> digest of their text, and whether they hold inside articles too."""
    root = parse(html)
    template = template_nodes(root, skeleton(root), reference, rules) if reference and rules else set()
    holders = article_holders(root)
    return "\n".join(b for part in article_roots(root, holders) for b in blocks(part, template, holders))


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, tuple] = {}
    for batch in batches:
        texts = []
        for name, part, reference, template, html in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "reference", "template", "html"))):
            at = (name, part)
            if reference is not None and at not in known:
                known = ({} if len(known) > 500 else known) | {at: (json.loads(reference), {t["node"]: (t["digest"], t["anywhere"]) for t in template or []})}
            texts.append(extract(html or "", *known[at]) if reference is not None else extract(html or ""))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def wrappers(named: DataFrame, rule: Wrapper = Wrapper()) -> tuple[DataFrame, DataFrame]:
    """host, part, reference (tree as JSON), template: array of (node, digest, anywhere). And host, key, part of the pages whose part is not 0."""
    trees = named.select("host", "html").mapInArrow(tree_rows, "host string, layout string, digest string, tree string")
    # copies of a page say nothing about its template: each counts once
    trees = keep(trees.groupBy("host", "layout", "digest").agg(F.min("tree").alias("tree")), "trees")
    layouts = trees.select("host", "layout").distinct()
    parts = layouts.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / LAYOUTS).alias("parts"))
    layouts = keep(layouts.join(parts, "host").withColumn("part", F.expr("pmod(xxhash64(layout), parts)")), "layouts")
    sample = F.pmod(F.xxhash64("digest"), F.lit(SAMPLES))
    first = trees.groupBy("host", "layout", sample.alias("sample")).agg(F.min("digest").alias("digest")).select("host", "layout", "digest")
    some = trees.join(first, ["host", "layout", "digest"], "left_semi").join(layouts, ["host", "layout"])
    merged = some.groupBy("host", "part").agg(F.sort_array(F.collect_list("tree")).alias("trees"))
    references = keep(merged.mapInArrow(reference_rows, "host string, part long, reference string"), "references")
    votes = trees.join(layouts, ["host", "layout"]).select("host", "part", "tree").join(references, ["host", "part"]).mapInArrow(vote_rows, "host string, part long, node string, digest string, n long")
    texts = votes.groupBy("host", "part", "node", "digest").agg(F.sum("n").alias("n"))
    total = texts.groupBy("host", "part", "node").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "digest")).alias("top"))
    same = F.col("top.n")
    fixed = total.filter((F.col("pages") >= rule.pages) & (same >= rule.share * F.col("pages")))
    anywhere = (F.col("pages") >= rule.article_pages) & (same >= rule.article_share * F.col("pages"))
    template = fixed.groupBy("host", "part").agg(F.collect_list(F.struct("node", F.col("top.digest").alias("digest"), anywhere.alias("anywhere"))).alias("template"))
    wide = layouts.filter("parts > 1")
    placed = named.join(wide.select("host").distinct(), "host", "left_semi").select("host", "key", "html").mapInArrow(layout_rows, "host string, key long, layout string")
    placed = placed.distinct().join(wide.filter("part > 0"), ["host", "layout"]).select("host", "key", "part")
    return keep(references.join(template, ["host", "part"], "left"), "wrappers"), keep(placed, "placed")


def extract_pages(pages: DataFrame, rule: Wrapper = Wrapper()) -> DataFrame:
    """page_id, url, text, n_chars"""
    name = F.lower(F.regexp_extract("url", HOST, 1))
    pages = pages.select("page_id", "url", "html", F.when(name != "", name).alias("host"), F.xxhash64("html").alias("key"))
    known, placed = wrappers(pages.filter("host is not null"), rule)
    placed = placed.groupBy("host", "key").agg(F.min("part").alias("part"))  # texts of equal key have one part
    parted = pages.join(placed, ["host", "key"], "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    return parted.join(known, ["host", "part"], "left").mapInArrow(text_rows, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
