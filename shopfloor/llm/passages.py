"""Finding passages of at least n units (words or bytes) that occur more than once in a corpus.

Every window of n units owns one anchor: the smallest hash among its k-grams, the leftmost at a tie. The
choice depends on the window's content alone, so equal windows have equal anchors at the same distance,
and only occurrences of one anchor need be compared. A text has about 2 anchors in n - k + 2 units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shopfloor.llm.text import U, gram_starts, grams, mix, windows_min

def anchors(units: np.ndarray, first: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, low, high) rows: the windows that start at low to high (within the text) own the anchor with that key."""
    start, text = gram_starts(first, n)
    if not len(start):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    hashes = mix(grams(units, k))
    ranked = (hashes & U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    owner = (windows_min(ranked, n - k + 1)[start] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(owner)) - 1
    base = first[:-1][text[low]]
    return text[low], hashes[owner[low]], start[low] - base, start[high] - base


def shared(spread: DataFrame, holder: str, chunk: int) -> DataFrame:
    """key, chunks: keys that more than one `holder` has, and the number of tasks to deal their occurrences to."""
    grouped = spread.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min(holder).alias("_a"), F.max(holder).alias("_b"))
    return grouped.filter("_a < _b").select("key", F.ceil(F.col("_n") / chunk).alias("chunks"))


def chunk_of(*by: Column) -> Column:
    return F.pmod(F.xxhash64(*by), F.col("chunks"))


def grouped_rows(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal key from a partition sorted by key."""
    at, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[k] for k in key)
            if now != at:
                if rows:
                    yield at, rows
                at, rows = now, []
            rows.append(row)
    if rows:
        yield at, rows


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
