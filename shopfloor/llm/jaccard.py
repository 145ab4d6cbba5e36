"""N-gram Jaccard join with count vectors in an R-tree.

A text's set are its distinct shingles of n words; length and percent are parameters, 4 and 85 in the query and in what follows. Every shingle is hashed to one of K segments and to one of
`GROUPS` groups. Sets of sizes a <= b that link differ in at most d = 15/185 (a + b) shingles, so of any
d + 1 segments at least one holds the same shingles in both. K follows from the size on a ladder, and each
text is filed under the first d + 1 non-empty segments: two texts that link always share one address,
the leaf of the tree in which that segment's point lies. Group counts over the whole vector alone cannot
serve as the tree's upper levels: at 0.85 the boxes of random counts overlap, and every pair of equal size
would be visited (figures in the README).

Within a leaf an R-tree over the group counts of its members finds the pairs that may link: nodes bound the
overlap by the sum of coordinate minima of their boxes, entries by their own counts; bitmaps of the sets then
bound it by the bits that only one side has. What survives is verified on the whole sets. A leaf of many texts
is cut into blocks by size, whose pairs are searched in tasks of their own where sizes and boxes allow a link.

No group of similar texts is expanded into its pairs: where a search finds more than twice as many pairs as it
has members, it first returns two or fewer for each member, and the leaf is searched once more when these are verified,
for pairs between what is not yet connected. No pair that could connect something is lost.

Sets are not written: a pair's sets are made from the texts anew, and one that many others meet travels once for
`STAR` of them. An address that is frequent within one piece of texts is dealt out by piece, so no task holds all
the texts of a frequent one.

Cases: null and empty texts have no shingles and link with nothing; 1 to 3 words are one shingle; equal
sets are one node; rows that share doc_id are one document; a row without doc_id gets no component and
links nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from shopfloor.llm.components import components
from shopfloor.llm.store import keep, keep_counted, meeting, table
from shopfloor.llm.text import U, Words, gram_starts, grams, lists, mix, pieces, signed, split_words

SHINGLE = 4
PERCENT = 85
GROUPS = 128
NODE = 64
#: Sets that meet one copy of the set they share, and occurrences within one piece of texts that make an address a frequent one.
STAR, FREQUENT = 256, 64
#: Rows of a block of a leaf, and tasks in which the boxes of a leaf's blocks meet.
BLOCK, SALTS = 2048, 16


def linked(common, a, b, percent: int = PERCENT):
    return percent * (a + b - common) <= 100 * common


def most_different(total, percent: int = PERCENT):
    """Greatest symmetric difference of two linked sets of `total` shingles together."""
    return (100 - percent) * total // (100 + percent)


def shingle_sets(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ordered by text and hash, and their texts."""
    at, text = gram_starts(w.first, n)
    hashes = mix(grams(w.hash, n)[at]) if len(at) else np.zeros(0, np.uint64)
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = [grams(w.hash[w.first[i] : w.first[i + 1]], int(counts[i]))[0] for i in short]
        hashes = np.concatenate([hashes, mix(np.array(whole, np.uint64) + counts[short].astype(np.uint64))])
        text = np.concatenate([text, short])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]


def _segments(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Number of segments for the level of a set: a power of two, at least 1.15 times what is needed."""
    need = wanted(sizes, percent) * 1.15
    return (1 << np.ceil(np.log2(np.maximum(need, 1))).astype(np.int64)).astype(np.int64)


def wanted(sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Addresses of a set: one more than its greatest difference from a linked set that is no smaller."""
    return most_different(sizes + sizes * 100 // percent, percent) + 1


def addresses(hashes: np.ndarray, text: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(address, text) rows. A set also files at the level of the smallest set it can link with, if that differs."""
    out = []
    own, low = _segments(sizes, percent), _segments(-(-sizes * percent // 100), percent)
    for level, active in ((own, sizes > 0), (low, (sizes > 0) & (low != own))):
        use = active[text]
        h, t = hashes[use], text[use]
        k = level[t].astype(np.uint64)
        segment = (mix(h ^ U(0xA5A5A5A5)) & (k - U(1))).astype(np.int64)
        order = np.lexsort((segment, t))
        h, t, segment, k = h[order], t[order], segment[order], k[order]
        first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (segment[1:] != segment[:-1])])) if len(t) else np.zeros(0, np.int64)
        if not len(first):
            continue
        point = np.add.reduceat(mix(h), first)
        address = mix(point ^ mix(segment[first].astype(np.uint64) * U(0x9E3779B97F4A7C15) + k[first]))
        owner = t[first]
        place = np.arange(len(owner)) - np.repeat(np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), np.diff(np.append(np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), len(owner))))
        filled = np.bincount(owner, minlength=len(sizes))
        chosen = place < wanted(sizes, percent)[owner]
        out.append((address[chosen], owner[chosen]))
        # fewer non-empty segments than wanted: two such sets may agree in empty segments only, so they share one more address
        poor = np.flatnonzero(active & (filled < wanted(sizes, percent)))
        out.append((mix(level[poor].astype(np.uint64) ^ U(0x5EED)), poor))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    address, owner = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(owner, kind="stable")
    return address[order], owner[order]


def group_counts(hashes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    group = (hashes >> U(40)).astype(np.int64) % GROUPS
    return np.bincount(text * GROUPS + group, minlength=texts * GROUPS).reshape(texts, GROUPS)


def text_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a piece of texts, their sorted shingle hashes, the text of each, number of each text's hashes)"""
    for batch in batches:
        for row, end, data, offsets in pieces(batch.column("text")):
            hashes, text = shingle_sets(split_words(data, offsets, lower=True), shingle)
            yield batch.slice(row, end - row), hashes, text, np.bincount(text, minlength=end - row)


def sketch_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for rows, hashes, text, sizes in text_sets(batches, shingle):
        sums = [np.zeros(rows.num_rows, np.uint64) for _ in range(2)]
        if len(hashes):
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            for s, value in zip(sums, (hashes, mix(hashes ^ U(0x1234567)))):
                s[text[first]] = np.add.reduceat(value, first)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes), *(pa.array(signed(s)) for s in sums)], ["doc_id", "n_shingles", "sum_a", "sum_b"])


def leaf_rows(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """leaf, salt, node: where each text is filed. An address that is frequent in a piece gets the piece's salt, and one of its texts stands for the piece at salt 0."""
    for rows, hashes, text, sizes in text_sets(batches, shingle):
        address, owner = addresses(hashes, text, sizes, percent)
        if not len(address):
            continue
        node = rows.column("doc_id").to_numpy()[owner]
        _, first, which, count = np.unique(address, return_index=True, return_inverse=True, return_counts=True)
        salt = np.where((count > FREQUENT)[which], int(node[0]) * 2 + 1, 0)
        stands = first[count > FREQUENT]
        columns = (np.append(signed(address), signed(address[stands])), np.append(salt, np.zeros(len(stands), np.int64)), np.append(node, node[stands]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["leaf", "salt", "node"])


def point_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """node, n, counts (group counts), marks"""
    for rows, hashes, text, sizes in text_sets(batches, shingle):
        counts, ends = group_counts(hashes, text, rows.num_rows), np.cumsum(sizes)
        bits = [marks(hashes[b - n : b]).tobytes() for b, n in zip(ends, sizes)]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes), lists(counts.ravel(), np.full(len(sizes), GROUPS), pa.int32()), pa.array(bits, pa.binary())], ["node", "n", "counts", "marks"])


def marks(items: np.ndarray) -> np.ndarray:
    """Bitmap of a set, of the power of two of bits above four for each item."""
    bits = np.zeros(1 << max(6, int(4 * len(items)).bit_length()), bool)
    bits[(items >> U(8)).astype(np.int64) & (len(bits) - 1)] = True
    return np.packbits(bits)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The marks that a bitmap of so many bytes has: those of a longer one, laid over each other."""
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def may_link(one: tuple[np.ndarray, list[np.ndarray]], two: tuple[np.ndarray, list[np.ndarray]], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets a[i] of one side (numbers of items, marks) and b[i] of the other may link: every mark that one alone has is an item that it alone has."""
    (n, marks_a), (m, marks_b) = one, two
    good = np.zeros(len(a), bool)
    size = np.minimum(np.array([len(x) for x in marks_a], np.int64)[a], np.array([len(x) for x in marks_b], np.int64)[b])
    for width in np.unique(size).tolist():
        at = np.flatnonzero(size == width)
        (of_a, i), (of_b, j) = np.unique(a[at], return_inverse=True), np.unique(b[at], return_inverse=True)
        bits = [np.stack([folded(x[k], width) for k in of]).view(np.uint64) for x, of in ((marks_a, of_a), (marks_b, of_b))]
        step = max(1, (1 << 22) // width)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            x, y, p, q = bits[0][i[k : k + step]], bits[1][j[k : k + step]], n[a[part]], m[b[part]]
            alone = [np.bitwise_count(v & ~w).sum(axis=1, dtype=np.int64) for v, w in ((x, y), (y, x))]
            good[part] = linked(np.maximum(np.minimum(p - alone[0], q - alone[1]), 0), p, q, percent)
    return good


def do_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return linked(int((b[at] == a).sum()), len(a), len(b), percent)


def travel_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """a, chunk, role (0: the set of a, 1: that of a b), node, items (the sorted hashes) for everywhere that a text's set has to go."""
    for rows, hashes, text, sizes in text_sets(batches, shingle):
        bounds, out = np.append(0, np.cumsum(sizes)), ([], [], [], [], [])
        for i, (node, goes, chunks) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "goes", "chunks")))):
            items = hashes[bounds[i] : bounds[i + 1]].tobytes()
            for row in [(g["a"], g["chunk"], 1, node, items) for g in goes or ()] + [(node, k, 0, node, items) for k in range(chunks or 0)]:
                for column, value in zip(out, row):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["a", "chunk", "role", "node", "items"])


def star_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b): pairs whose sets link, from rows sorted by a, chunk and role."""
    at, ones = None, []
    for batch in batches:
        out, items = ([], []), batch.column("items")
        for i, (a, chunk, role, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "role", "node")))):
            if (a, chunk) != at:
                at, ones = (a, chunk), []
            this = np.frombuffer(items[i].as_buffer(), np.uint64)
            if role == 0:
                ones.append(this.copy())
            elif any(do_link(one, this, percent) for one in ones):
                out[0].append(a)
                out[1].append(node)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])


def verify(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links among pairs (a, b). The sets of the b travel to those of the a."""
    pairs = keep(pairs.select("a", "b").distinct(), "pairs")
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("chunks"))
    goes = pairs.join(chunks, "a").groupBy(F.col("b").alias("doc_id")).agg(F.collect_list(F.struct("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))).alias("goes"))
    travel, (n, entries) = keep_counted(goes.join(chunks.withColumnRenamed("a", "doc_id"), "doc_id", "full"), "travel", F.sum(F.size(F.coalesce("goes", F.array()))))
    rows = meeting(docs, travel, "doc_id", 2 * n + 2 * (entries or 0))
    sent = rows.mapInArrow(lambda it: travel_rows(it, shingle), "a long, chunk long, role int, node long, items binary")
    dealt = sent.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")
    return keep(dealt.mapInArrow(lambda it: star_rows(it, percent), "a long, b long"), "links")


def boxes(counts: np.ndarray, sizes: np.ndarray) -> tuple[list[slice], np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of an R-tree packed in the order of the rows: their rows, greatest counts, least and greatest sizes."""
    rows = [slice(i, i + NODE) for i in range(0, len(sizes), NODE)]
    return rows, np.stack([counts[x].max(axis=0) for x in rows]), np.array([sizes[x].min() for x in rows]), np.array([sizes[x].max() for x in rows])


def tree_pairs(one: tuple, two: tuple | None = None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Join of two R-trees (counts, sizes, part), or of one with itself: pairs of different parts whose bound allows a link."""
    counts, sizes, part = one
    other_counts, other_sizes, other_part = two or one
    nodes, top, low, high = boxes(counts, sizes)
    others, other_top, other_low, other_high = boxes(other_counts, other_sizes) if two else (nodes, top, low, high)
    out = []
    for i, x in enumerate(nodes):
        first = 0 if two else i
        overlap = np.minimum(top[i], other_top[first:]).sum(axis=1)
        open_ = linked(overlap, low[i], other_low[first:], percent) & (100 * high[i] >= percent * other_low[first:]) & (100 * other_high[first:] >= percent * low[i])
        for j in first + np.flatnonzero(open_):
            y = others[j]
            common = np.minimum(counts[x][:, None, :], other_counts[y][None, :, :]).sum(axis=2)
            fine = linked(common, sizes[x][:, None], other_sizes[y][None, :], percent) & (part[x][:, None] != other_part[y][None, :])
            if not two and i == j:
                fine &= np.triu(np.ones(fine.shape, bool), 1)
            a, b = np.nonzero(fine)
            out.append((a + x.start, b + y.start))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def rtree_pairs(counts: np.ndarray, sizes: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Self-join of an R-tree packed by size and counts."""
    order = np.lexsort((*counts.T[::-1], sizes))
    a, b = tree_pairs((counts[order], sizes[order], part[order]))
    return order[a], order[b]


#: Columns of a block: members of one leaf in order of size and counts, with the box around them.
BLOCK_SCHEMA = "leaf long, block string, low long, high long, top array<int>, nodes array<long>, parts array<long>, sizes array<long>, marks array<binary>, counts array<int>"


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most BLOCK rows of each leaf of a partition sorted by leaf, size and counts."""
    task = uuid.uuid4().hex
    number = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        leaf, node, part, n = (batch.column(c).to_numpy() for c in ("leaf", "node", "component", "n"))
        counts = np.array(batch.column("counts").flatten(), np.int32).reshape(len(leaf), GROUPS)
        bounds = np.append(np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])), len(leaf))
        cuts = [(i, min(i + BLOCK, end)) for first, end in zip(bounds[:-1], bounds[1:]) for i in range(first, end, BLOCK)]
        lengths = np.array([b - a for a, b in cuts])
        first = np.array([a for a, _ in cuts])
        top = np.stack([counts[a:b].max(axis=0) for a, b in cuts])
        yield pa.RecordBatch.from_arrays(
            [pa.array(leaf[first]), pa.array([f"{task}-{number + i}" for i in range(len(cuts))]), pa.array(np.minimum.reduceat(n, first)), pa.array(np.maximum.reduceat(n, first)),
             lists(top.ravel(), np.full(len(cuts), GROUPS), pa.int32()), *(lists(x, lengths, pa.int64()) for x in (node, part, n)),
             pa.ListArray.from_arrays(pa.array(np.append(first, len(leaf)), pa.int32()), batch.column("marks")), lists(counts.ravel(), lengths * GROUPS, pa.int32())],
            ["leaf", "block", "low", "high", "top", "nodes", "parts", "sizes", "marks", "counts"],
        )
        number += len(cuts)


#: node, (counts, sizes, part) and marks of the members of one side of a search.
Side = tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def few(a: np.ndarray, b: np.ndarray, two: bool) -> np.ndarray:
    """Places of a few of the pairs: within a group at most two for each node, with its neighbours of the smallest and greatest hash,
    so that the searches of a group agree on them; between two blocks one for each node of the first."""
    ends, others = (a, b) if two else (np.concatenate([a, b]), np.concatenate([b, a]))
    order = np.lexsort((mix(others.view(np.uint64)), ends))
    new = np.append(True, ends[order[1:]] != ends[order[:-1]])
    last = order[np.append(new[1:], True)]
    return last if two else np.unique(np.concatenate([order[new], last]) % len(a))


def likely_pairs(leaf: int, one: Side, two: Side | None, percent: int, whole: bool) -> pa.RecordBatch:
    """leaf, a, b, more: the pairs that the trees let through and whose marks may link; if not `whole`, few of many, and `more`."""
    (node, tree, marks_), (other, other_tree, other_marks) = one, two or one
    a, b = tree_pairs(tree, other_tree if two else None, percent)
    good = may_link((tree[1], marks_), (other_tree[1], other_marks), a, b, percent)
    a, b = node[a[good]], other[b[good]]
    more = not whole and len(a) > (len(node) if two else 2 * len(node))
    if more:
        some = few(a, b, two is not None)
        a, b = a[some], b[some]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), leaf)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), more))], ["leaf", "a", "b", "more"])


def bitmaps(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8) for x in column]


def search_rows(batches: Iterator[pa.RecordBatch], two: bool, percent: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Likely pairs of each block with itself or of each pair of blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            sides: list[Side] = []
            for x in ("_a", "_b") if two else ("",):
                node, part, n, counts = (np.array(batch.column(f"{c}{x}")[i].values) for c in ("nodes", "parts", "sizes", "counts"))
                sides.append((node, (counts.reshape(len(node), GROUPS), n, part), bitmaps(batch.column(f"marks{x}")[i].values)))
            yield likely_pairs(batch.column("leaf")[i].as_py(), sides[0], sides[1] if two else None, percent, whole)


def leaf_pairs(batches: Iterator[pa.RecordBatch], percent: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Likely pairs of each leaf of a partition sorted by leaf."""
    rest: pa.Table | None = None

    def search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        leaf, node, part, n = (rows.column(c).to_numpy() for c in ("leaf", "node", "component", "n"))
        counts = rows.column("counts").combine_chunks().flatten().to_numpy().reshape(len(leaf), GROUPS)
        bits = bitmaps(rows.column("marks"))
        bounds = np.append(np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])), len(leaf))
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            found = likely_pairs(int(leaf[x]), (node[x:y], (counts[x:y], n[x:y], part[x:y]), bits[x:y]), None, percent, whole)
            if found.num_rows:
                yield found

    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]) if rest is not None else now
        leaf = now.column("leaf").to_numpy()
        last = int(np.searchsorted(leaf, leaf[-1]))  # the last leaf may go on in the next batch
        if last:
            yield from search(now.slice(0, last))
        rest = now.slice(last)
    if rest is not None:
        yield from search(rest)


FOUND = "leaf long, a long, b long, more boolean"


def searched(split: DataFrame, points: DataFrame, percent: int = PERCENT, whole: bool = True) -> DataFrame:
    """leaf, a, b, more: pairs of leaf, node, component that the trees of the leaves and the marks of points (node, n, counts, marks) let
    through. A leaf of at most BLOCK rows is searched as a whole; a larger one is cut into blocks, and pairs of blocks whose boxes
    allow a link are searched one by one."""
    sized = split.join(split.groupBy("leaf").agg(F.count(F.lit(1)).alias("members")), "leaf")
    small = sized.filter(F.col("members") <= BLOCK).drop("members").join(points, "node")
    out = small.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(lambda it: leaf_pairs(it, percent, whole), FOUND)
    rows, (n,) = keep_counted(sized.filter(F.col("members") > BLOCK).drop("members").join(points, "node"), "wide-leaves")
    if not n:
        return out
    dealt = rows.repartitionByRange("leaf", "n", "counts", "node").sortWithinPartitions("leaf", "n", "counts", "node")
    blocks = keep(dealt.mapInArrow(block_rows, BLOCK_SCHEMA), "blocks")
    alone = blocks.mapInArrow(lambda it: search_rows(it, False, percent, whole), FOUND)
    box = keep(blocks.select("leaf", "block", "low", "high", "top"), "boxes")
    side = lambda x, df: df.select("leaf", *(F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "leaf"))
    # the boxes of a large leaf meet in several tasks too, and only where their sizes are within one band of each other
    salt = F.pmod(F.xxhash64("block_a"), F.lit(SALTS))
    band = lambda x: F.floor(F.log(F.col(x)) / np.log(100 / percent)).cast("long")
    ones = side("a", box).withColumns({"salt": salt, "band": F.explode(F.sequence(band("low_a"), band("high_a")))})
    others = side("b", box).withColumn("band", F.explode(F.sequence(band("low_b") - 1, band("high_b") + 1)))
    meet = ones.join(others.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["leaf", "salt", "band"])
    overlap = F.aggregate(F.zip_with("top_a", "top_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda total, x: total + x)
    near = (100 * F.col("high_a") >= percent * F.col("low_b")) & (100 * F.col("high_b") >= percent * F.col("low_a"))
    pairs = meet.filter((F.col("block_a") < F.col("block_b")) & near).filter(linked(overlap, F.col("low_a"), F.col("low_b"), percent)).select("leaf", "block_a", "block_b").distinct()
    members = blocks.select("block", "nodes", "parts", "sizes", "marks", "counts")
    side = lambda x: members.select(*(F.col(c).alias(f"{c}_{x}") for c in members.columns))
    both = pairs.join(side("a"), "block_a").join(side("b"), "block_b").repartition(F.col("block_a"), F.col("block_b"))
    return out.unionByName(alone).unionByName(both.mapInArrow(lambda it: search_rows(it, True, percent, whole), FOUND))


def with_component(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: only the links between the components found so far are joined anew."""
    ends = links
    for x in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")), x, "left").withColumn(x, F.coalesce(f"of_{x}", x)).select("a", "b")
    more = components(ends.distinct())
    moved = labels.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return keep(moved.unionByName(more), "labels")


def shared_leaves(docs: DataFrame, copies: DataFrame, n_copies: int, shingle: int, percent: int) -> DataFrame:
    """leaf, node of the addresses that more than one text is filed under; of leaves with the same members one is enough."""
    singles = meeting(docs, copies, "doc_id", n_copies, "left_anti")
    filed = singles.mapInArrow(lambda it: leaf_rows(it, shingle, percent), "leaf long, salt long, node long")
    # a salt other than 0 holds the texts of one piece, salt 0 one of each piece
    leaf = W.partitionBy("leaf", "salt")
    shared = filed.withColumns({"low": F.min("node").over(leaf), "high": F.max("node").over(leaf)}).filter("salt <> 0 or low < high")
    members = keep(shared.select("leaf", "node").distinct(), "members")
    same = members.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in range(2)))
    return keep(members.join(same.filter("n > 1").groupBy("n", "h0", "h1").agg(F.min("leaf").alias("leaf")).select("leaf"), "leaf"), "leaves")


def joined(docs: DataFrame, sketches: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """node, component of all representatives of equal sets that the join connects with a smaller one."""
    sized = sketches.filter("n_shingles > 0 and doc_id is not null")
    classes = sized.groupBy("n_shingles", "sum_a", "sum_b").agg(F.min("doc_id").alias("node"))
    copies, (n_copies,) = keep_counted(sized.join(classes, ["n_shingles", "sum_a", "sum_b"]).filter("doc_id <> node").select("doc_id").distinct(), "equal-sets")
    docs = docs.filter("doc_id is not null")
    leaves = shared_leaves(docs, copies, n_copies, shingle, percent)
    nodes, (n,) = keep_counted(leaves.select(F.col("node").alias("doc_id")).distinct(), "members")
    points = keep(meeting(docs, nodes, "doc_id", n).mapInArrow(lambda it: point_rows(it, shingle), "node long, n long, counts array<int>, marks binary").filter("n > 0"), "points")
    found = keep(searched(leaves.withColumn("component", F.col("node")), points, percent, whole=False), "found")
    labels = components(verify(docs, found, shingle, percent))
    again, (n,) = keep_counted(with_component(leaves.join(found.filter("more").select("leaf").distinct(), "leaf", "left_semi"), labels), "searched-again")
    if not n:
        return labels
    parted = again.groupBy("leaf").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("leaf")
    rest = searched(again.join(parted, "leaf", "left_semi"), points, percent)
    return extended(labels, verify(docs, rest, shingle, percent))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every document. Texts link at `percent` of their distinct shingles of `shingle` words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = keep(docs.mapInArrow(lambda it: sketch_rows(it, shingle), "doc_id long, n_shingles long, sum_a long, sum_b long"), "sketches")
    classes = sketches.filter("n_shingles > 0").groupBy("n_shingles", "sum_a", "sum_b").agg(F.min("doc_id").alias("node"))
    labels = joined(docs, sketches, shingle, percent)
    named = classes.join(labels, "node", "left").select("n_shingles", "sum_a", "sum_b", F.coalesce("component", "node").alias("component_id"))
    rows = sketches.join(named, ["n_shingles", "sum_a", "sum_b"], "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group: that with the smallest doc_id. Rows that share a doc_id count as one
    document; rows without doc_id stay."""
    named = keep(jaccard_components(docs, shingle, percent), "components")
    rest = keep(named.filter("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    twice = keep(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    kept = docs.join(rest, "doc_id", "left_anti").select(*docs.columns)
    single = kept.join(twice, "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(kept.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), SHINGLE, PERCENT)


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n p ON o.a = p.doc_id JOIN n q ON o.b = q.doc_id WHERE 100 * c >= 85 * (p.n + q.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a
), c AS (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, t.doc_id) AS component_id
FROM documents t LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
