"""Suffix-array dedup of byte strings that occur more than once anywhere in the corpus.

A byte is removed if a string of 400 bytes that covers it also starts at another place. Such strings share
the anchor they own, so the corpus is cut into passages dealt by anchor, each holding the window starts
that own it. A task takes passages of many anchors into one text and builds its suffix array in two
stages: the suffixes smaller than their successors are sorted directly, the others are induced by a scan
over the buckets of first bytes. Neighbours with a common prefix of 400 bytes or more are repeats. An
anchor with more than CHUNK occurrences is dealt to several tasks; each then also reports one start of
each of its distinct windows, and a grouping of their digests finds the repeats between tasks.

Texts that are equal as a whole are met first: if they have 400 bytes, all are removed, and one of them
stands for all towards other texts.

Cases: null and empty texts have no bytes; texts under 400 bytes are never removed; rows are judged by
their text, so ids may be null or repeat; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shopfloor.llm.passages import anchors, chunk_of, merged
from shopfloor.llm.store import keep, table
from shopfloor.llm.text import U, buffers, lists, pieces, signed, slices

WINDOW, GRAM = 400, 32
#: Occurrences of one anchor that one task sorts; more are dealt to several, and what those leave open is matched by digests of windows.
CHUNK = 512
#: Bytes of passages that are sorted together.
SORTED = 1 << 19


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether suffix i is smaller than suffix i + 1: decided at the next byte that differs; the end counts as smallest."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)[:n]
    decides = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    after = np.append(text[1:], 0)
    return np.where(decides == n - 1, False, text[decides] < after[decides])


def two_stage(data: bytes, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes (and those between them and the next directly sorted one) in the order of their first `depth` bytes."""
    text = np.frombuffer(data, np.uint8)
    n = len(text)
    small = smaller_than_next(text)
    # an induced suffix needs its successor: extend each wanted run up to the next directly sorted suffix
    place = np.arange(n)
    next_small = np.minimum.accumulate(np.where(small, place, n)[::-1])[::-1]
    need = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(wanted)
    np.add.at(need, at, 1)
    np.add.at(need, np.minimum(next_small[at], n - 1) + 1, -1)
    need = np.cumsum(need)[:n] > 0
    direct = np.flatnonzero(need & small)
    heads = [data[i : i + depth] for i in direct.tolist()]
    direct = direct[np.array(sorted(range(len(heads)), key=heads.__getitem__), np.int64)]
    del heads
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced = need & ~small
    waiting: dict[int, list[np.ndarray]] = {int(text[-1]): [np.array([n - 1])]} if n and need[-1] else {}
    out = []
    chars = np.flatnonzero(np.bincount(text[need], minlength=256)) if n else []
    for c in chars:
        parts = waiting.pop(int(c), [])
        run = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        bucket = [run]
        while len(run):
            run = run[run > 0] - 1
            run = run[induced[run] & (text[run] == c)]
            bucket.append(run)
        bucket.append(direct[bounds[c] : bounds[c + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[induced[before] & (text[before] > c)]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts) if len(before) else ():
            waiting.setdefault(int(text[part[0]]), []).append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated_starts(data: bytes, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(wanted starts whose first `depth` bytes occur at another wanted start, one start of each distinct string)."""
    order = two_stage(data, wanted, depth)
    order = order[wanted[order]]
    same = np.fromiter((a == b for a, b in pairwise(data[i : i + depth] for i in order.tolist())), bool)
    before, after = np.append(False, same)[: len(order)], np.append(same, False)[: len(order)]
    return order[before | after], order[~before]


def head_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in pieces(batch.column("text")):
            text, key, low, high = anchors(data.astype(np.uint64) + U(1), offsets, n, GRAM)
            counts = np.bincount(text, minlength=end - row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_key").slice(row, end - row), lists(signed(key), counts, pa.int64()), lists(low, counts, pa.int32()), lists(high, counts, pa.int32())],
                ["text_key", "keys", "low", "high"],
            )


def cut_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        for digest, text, spots in zip(*(batch.column(c).to_pylist() for c in ("text_key", "text", "spots"))):
            data = text.encode()
            kinds = {"key": pa.int64(), "chunk": pa.int64(), "chunks": pa.int64(), "low": pa.int32()}
            rows = [pa.array([s[k] for s in spots], kind) for k, kind in kinds.items()]
            passages = pa.array([data[s["low"] : s["high"] + n] for s in spots], pa.binary())
            yield pa.RecordBatch.from_arrays([*rows, pa.array([digest] * len(spots), pa.binary()), passages], [*kinds, "text_key", "passage"])


def sorted_batch(rows: pa.RecordBatch, n: int) -> pa.RecordBatch:
    """text_key, low, high (starts of repeated windows), window (digest of a window that other tasks must see)."""
    passages, bounds = buffers(rows.column("passage"))
    data = passages[bounds[0] : bounds[-1]].tobytes()
    base, ends = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
    # starts of whole windows within a passage
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, base, 1)
    np.add.at(edge, np.maximum(ends - n + 1, base), -1)
    again, distinct = repeated_starts(data, np.cumsum(edge)[:-1] > 0, n)
    low, chunks = rows.column("low").to_numpy().astype(np.int64), rows.column("chunks").to_numpy()

    def owners(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.searchsorted(base, places, "right") - 1
        return owner, places + low[owner] - base[owner]

    again = np.sort(again)
    owner, start = owners(again)
    first = np.flatnonzero(np.append(True, (np.diff(again) != 1) | (np.diff(owner) != 0))[: len(again)])
    last = np.append(first[1:], len(again)).astype(np.int64)[: len(first)] - 1
    hot = distinct[chunks[owners(distinct)[0]] > 1]
    hot_owner, hot_start = owners(hot)
    windows = [None] * len(first) + [hashlib.md5(data[i : i + n]).digest() for i in hot.tolist()]
    keys = rows.column("text_key").take(pa.array(np.concatenate([owner[first], hot_owner])))
    return pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([start[first], hot_start])), pa.array(np.concatenate([start[last], hot_start])), pa.array(windows, pa.binary())], ["text_key", "low", "high", "window"])


def sorted_batches(rows: pa.RecordBatch, starts: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Whole groups of passages, sorted some SORTED bytes at a time; a passage alone with its anchor has no equal."""
    counts = np.diff(np.append(starts, rows.num_rows))
    used = (counts > 1) | (rows.column("chunks").to_numpy()[starts] > 1)
    rows, counts = rows.filter(pa.array(np.repeat(used, counts))), counts[used]
    ends = np.cumsum(counts)
    size = buffers(rows.column("passage"))[1]
    row = 0
    while row < rows.num_rows:
        full = np.searchsorted(size[ends], size[row] + SORTED)
        end = int(ends[min(full, len(ends) - 1)])
        yield sorted_batch(rows.slice(row, end - row), n)
        row = end


def found_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        key, chunk = rows.column("key").to_numpy(), rows.column("chunk").to_numpy()
        starts = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(chunk) != 0)))
        # the last group may go on in the next batch
        yield from sorted_batches(rows.slice(0, starts[-1]), starts[:-1], n)
        rest = rows.slice(starts[-1])
    if rest is not None:
        yield from sorted_batches(rest, np.zeros(1, np.int64), n)


def rest_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        out = ([], [], [], [], [])
        for digest, text, spans in zip(*(batch.column(c).to_pylist() for c in ("text_key", "text", "spans"))):
            data, kept, at = text.encode(), [], 0
            runs = merged([(s["low"], s["high"] + n) for s in spans])
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            rest = b"".join([*kept, data[at:]])
            for column, value in zip(out, (digest, len(data) - len(rest), len(runs), rest, hashlib.sha256(rest).hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()))], ["text_key", "n_removed", "n_spans", "kept", "kept_sha256"])


def text_key():
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def repeats(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """text_key, n_removed, n_spans, kept (bytes), kept_sha256 of the distinct texts that repeat a string within or elsewhere."""
    docs = docs.select(text_key().alias("text_key"), "text").filter(F.octet_length("text") >= n)
    heads = docs.mapInArrow(lambda it: head_rows(it, n), "text_key binary, keys array<long>, low array<int>, high array<int>")
    spread = keep(heads.dropDuplicates(["text_key"]).select("text_key", F.explode(F.arrays_zip("keys", "low", "high")).alias("s")).select("text_key", F.col("s.keys").alias("key"), F.col("s.low").alias("low"), F.col("s.high").alias("high")), "anchors")
    # as a written table, so that the join below has plain sides: a hot anchor's rows are split there
    shared = keep(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / CHUNK).alias("chunks")), "shared")
    spots = spread.join(shared, "key").withColumn("chunk", chunk_of(F.col("text_key"), F.col("low")))
    by_text = keep(spots.groupBy("text_key").agg(F.collect_list(F.struct("key", "chunk", "chunks", "low", "high")).alias("spots")), "spots")
    # copies of a text meet in the tasks that read them, before the join, and so do not meet in one task
    texts = keep(docs.dropDuplicates(["text_key"]).join(by_text, "text_key"), "passage-texts")
    dealt = texts.mapInArrow(lambda it: cut_rows(it, n), "key long, chunk long, chunks long, low int, text_key binary, passage binary").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "text_key", "low")
    found = keep(dealt.mapInArrow(lambda it: found_rows(it, n), "text_key binary, low long, high long, window binary"), "repeats")
    open_ = found.filter("window is not null")
    many = open_.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
    spans = found.filter("window is null").drop("window").unionByName(open_.join(many, "window", "left_semi").drop("window"))
    by_text = spans.groupBy("text_key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return keep(texts.select("text_key", "text").join(by_text, "text_key").mapInArrow(lambda it: rest_rows(it, n), "text_key binary, n_removed long, n_spans long, kept binary, kept_sha256 string"), "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = repeats(docs).drop("kept")
    text = F.coalesce("text", F.lit(""))
    rows = keep(docs.select("doc_id", text_key().alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha256")), "digests")
    copies = rows.filter(F.col("n_bytes") >= WINDOW).groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.min("n_bytes").alias("n_removed")).filter("copies > 1")
    gone = copies.select("text_key", "n_removed", F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    # as a written table, so that the join below has plain sides: the rows of a text with many copies are split there
    changed = keep(gone.unionByName(rest.join(gone, "text_key", "left_anti")), "changed")
    out = rows.join(changed, "text_key", "left")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )
