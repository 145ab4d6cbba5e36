"""Periodic runs of words by maximal pairs in an LCP-interval tree.

A run of a text is a stretch of words with smallest period q that repeats it at least `turns` times, has at
least `least` words, and can't be extended keeping q. Its first words and the same words q later are a
maximal pair: equal for length - q words, with different words to the left and to the right. So no run has
to be grown: maximal pairs at a distance of at most half of what they share (for three turns) are exactly
the runs, and a pair at a multiple of the smallest period has the same bounds as the pair at that period.

Each task lays the words of many texts behind one another, a mark of its own after each, and sorts their
suffixes by prefixes of 1, 2, 4, ... words. The LCP-interval tree is walked bottom-up; a node holds its
places in order, each with the class of the word on its left. When two children meet, the shorter list asks
the longer one. Places of one node that lie within the allowed distance are inside one run, so all but the
first have one left class: for each place only the leftmost on its left and the nearest on its right can
have another class and form a pair, two binary searches however many places the node holds. Texts in which
no sequence of the least shared length occurs twice have no such pair and get no tree.

Cases: null and empty texts have no words and no run; rows are judged by their text alone, so ids may be null
or repeat; the whole text is one unit of work, memory follows the longest one; an empty table gives an
empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shopfloor.llm.store import table
from shopfloor.llm.text import U, Words, gram_starts, grams, mix, pieces, split_words

LEAST, TURNS = 24, 3
#: Depth of a leaf of the tree: more than any interval has.
LEAF = 1 << 62


def suffix_ranks(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes, and for 1, 2, 4, ... words a rank that two suffixes share when those words are equal.
    Only suffixes that are not yet told apart are sorted again."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.ones(n, bool)
    new[1:] = ids[order[1:]] != ids[order[:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, width = [rank], 1
    while True:
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_):
            return order, levels
        at = order[open_]
        after = at + width
        key = rank[at].astype(np.int64) * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.argsort(key, kind="stable")
        key, order[open_] = key[again], at[again]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[open_] = fresh
        rank = rank.copy()
        rank[order[open_]] = open_[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        levels.append(rank)
        width *= 2


def shared_words(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Number of equal words from places a and b on."""
    n, a, b = len(levels[0]), a.copy(), b.copy()
    total = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        step = (inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])).astype(np.int64) << k
        total += step
        a += step
        b += step
    return total


def _met(one: list[int], two: list[int], depth: int, left: list[int], turns: int, found: list[tuple[int, int, int]]) -> list[int]:
    """Joins the places of two children of a node of `depth` shared words; adds (start, period, depth) of their maximal pairs."""
    big, small = (one, two) if len(one) >= len(two) else (two, one)
    reach = depth // (turns - 1)
    for p in small:
        i = bisect_left(big, p - reach)
        if i < len(big) and big[i] < p and left[big[i]] != left[p]:
            found.append((big[i], p - big[i], depth))
        i = bisect_right(big, p)
        if i < len(big) and big[i] - p <= reach and left[big[i]] != left[p]:
            found.append((p, big[i] - p, depth))
    if len(small) * 16 < len(big):
        for p in small:
            if p > big[-1]:
                big.append(p)
            else:
                insort(big, p)
        return big
    return sorted(big + small)


def maximal_pairs(order: list[int], shared: list[int], left: list[int], least: int, turns: int) -> list[tuple[int, int, int]]:
    """(start, period, depth) of the maximal pairs within reach; shared[i]: words that suffix i of the order has in common with the one before."""
    found: list[tuple[int, int, int]] = []
    stack: list[list] = []  # nodes from the root down: depth, places in order
    for place, depth in zip([*order, -1], [*shared, 0]):
        while stack and stack[-1][0] > depth:
            child = stack.pop()
            if stack and stack[-1][0] >= depth:
                stack[-1][1] = _met(stack[-1][1], child[1], stack[-1][0], left, turns, found)
            elif depth >= least:
                stack.append([depth, child[1]])
        stack.append([LEAF, [place]])
    return found


def least_shared(least: int, turns: int) -> int:
    """Words that the two ends of a run have in common at least."""
    return max(1, -(-least * (turns - 1) // turns))


def runs_of(w: Words, least: int = LEAST, turns: int = TURNS) -> dict[int, list[tuple[int, int, int]]]:
    """text -> (start, length, period) by start, then period, for the texts that have runs."""
    m = least_shared(least, turns)
    at, text = gram_starts(w.first, m)
    if not len(at):
        return {}
    salt = mix(np.arange(len(w.first), dtype=np.uint64) + U(1))
    keys = grams(w.hash, m)[at] + salt[text]
    again = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[again[1:]] == keys[again[:-1]])
    texts = np.unique(text[again[same]])
    if not len(texts):
        return {}
    lengths = np.diff(w.first)[texts]
    base = np.cumsum(lengths + 1) - (lengths + 1)
    total = int((lengths + 1).sum())
    place = np.repeat(base, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    source = np.repeat(w.first[texts], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kinds, named = np.unique(w.hash[source] + np.repeat(salt[texts], lengths), return_inverse=True)
    ids = np.empty(total, np.int64)
    ids[place] = named
    ids[base + lengths] = len(kinds) + np.arange(len(texts))  # the mark after each text
    order, levels = suffix_ranks(ids)
    k = min(len(levels) - 1, m.bit_length() - 1)
    near = np.flatnonzero(levels[k][order[1:]] == levels[k][order[:-1]]) + 1
    shared = np.zeros(total, np.int64)
    shared[near] = shared_words(order[near - 1], order[near], levels)
    shared[shared < m] = 0
    used = np.flatnonzero((shared > 0) | np.append(shared[1:] > 0, False))
    left = np.append(-1, ids[:-1])
    best: dict[tuple[int, int], int] = {}
    for start, period, depth in maximal_pairs(order[used].tolist(), shared[used].tolist(), left.tolist(), m, turns):
        if depth + period >= least:
            bounds = (start, depth + period)
            best[bounds] = min(period, best.get(bounds, period))
    out: dict[int, list[tuple[int, int, int]]] = {}
    for (start, length), period in best.items():
        i = int(np.searchsorted(base, start, "right")) - 1
        out.setdefault(int(texts[i]), []).append((start - int(base[i]), length, period))
    for found in out.values():
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def _joined(w: Words, kept: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space. The first word of a text is always kept."""
    data = data.copy()
    lead = np.ones(len(w.start), bool)
    lead[w.first[:-1][np.diff(w.first) > 0]] = False
    data[w.start[lead] - 1] = 0x20
    marks = np.zeros(len(data) + 1, np.int8)
    np.add.at(marks, (w.start - lead)[kept], 1)
    np.add.at(marks, w.end[kept], -1)
    inside = np.cumsum(marks[:-1]) > 0
    ends = np.append(0, np.cumsum(inside))[offsets]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[inside])])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def run_rows(batches: Iterator[pa.RecordBatch], least: int, turns: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in pieces(batch.column("text")):
            w = split_words(data, offsets)
            runs = runs_of(w, least, turns)
            kept = np.ones(len(w.start), bool)
            for text, found in runs.items():
                for start, length, period in found:
                    kept[w.first[text] + start + period : w.first[text] + start + length] = False
            rows = [[dict(zip(("start", "length", "period"), r)) for r in runs.get(i, ())] for i in range(end - row)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, end - row), pa.array(np.diff(w.first)), pa.array(rows, pa.list_(RUN)), _joined(w, kept, data, offsets).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, least: int = LEAST, turns: int = TURNS) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period in words), collapsed (the words, without what any run
    repeats after its first period, joined by one space) for every row."""
    if turns < 2:
        raise ValueError("a run has two turns at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: run_rows(it, least, turns), "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period, compared exactly; of equal ones the first."""
    none = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(1).cast("long").alias("period"))
    best = F.aggregate(runs, none, lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    return F.when(F.size(runs) > 0, best)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document of ten (by the checksum of its id) repeats a stretch of its words to its end."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    base = docs.select("doc_id", "text", h.alias("_h"), F.floor(h / 10).alias("_g")).withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    n = F.size("_w").cast("long")
    a = F.col("_g") % n
    sized = base.withColumns({"_a": F.when(n > 0, a).cast("int"), "_p": F.when(n > 0, 1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("int")})
    head = F.slice("_w", F.lit(1), F.col("_a"))
    turn = F.slice("_w", F.col("_a") + 1, F.col("_p"))
    rest = F.size("_w") - F.col("_a")
    tail = F.slice(F.flatten(F.array_repeat(turn, F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    return sized.select("doc_id", F.when(F.col("_a").isNotNull(), F.concat_ws(" ", F.concat(head, tail))).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")), LEAST, TURNS).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
