"""Quality rules: base counts of words and lines, then compression bands.

A text that passes the base rules is compressed with zstandard, whole and in fixed chunks. The ratio of
the whole text must lie in the band of its length: above it the text repeats itself, below it the text is
noise. Long texts can hide such parts, so the share of bytes in chunks outside the chunk band is limited too.
Every count covers the whole text; a batch is worked on in pieces, so memory follows the longest text.

Cases: null and empty texts have no words and fail the base rules; rows that repeat are judged one by
one; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from shopfloor.llm.stats import text_stats
from shopfloor.llm.store import table
from shopfloor.llm.text import pieces


@dataclass(frozen=True)
class Bands:
    """(bytes from which the band holds, least ratio, greatest ratio), chunk size and its band and share."""

    whole: tuple[tuple[int, float, float], ...] = ((0, 0.5, 3.0), (200, 1.1, 3.5), (800, 1.25, 4.0), (3200, 1.3, 4.5), (12800, 1.35, 5.0))
    chunk: int = 4096
    chunk_band: tuple[float, float] = (1.25, 5.0)
    chunk_share: float = 1 / 3
    level: int = 3


def in_bands(text: bytes, bands: Bands, zip_: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole, share of bytes in chunks outside their band, verdict. What full chunks leave over is judged by a
    last chunk that ends with the text, and counts with the bytes it adds."""
    ratio = len(text) / len(zip_.compress(text))
    _, low, high = max(b for b in bands.whole if b[0] <= len(text))
    starts = range(0, len(text) - bands.chunk + 1, bands.chunk)
    chunks = [(i, bands.chunk) for i in starts]
    if chunks and len(text) % bands.chunk:
        chunks.append((len(text) - bands.chunk, len(text) % bands.chunk))
    ratios = [(bands.chunk / len(zip_.compress(text[i : i + bands.chunk])), adds) for i, adds in chunks]
    out = sum(adds for r, adds in ratios if not bands.chunk_band[0] <= r <= bands.chunk_band[1]) / len(text) if chunks else 0.0
    return ratio, out, low <= ratio <= high and out <= bands.chunk_share


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, chunks_outside double"


def rule_rows(batches: Iterator[pa.RecordBatch], bands: Bands) -> Iterator[pa.RecordBatch]:
    zip_ = zstandard.ZstdCompressor(level=bands.level)
    for batch in batches:
        ids = batch.column("doc_id")
        for row, end, data, offsets in pieces(batch.column("text")):
            s = text_stats(data, offsets)
            failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
            ratio, outside, kept = np.full(end - row, np.nan), np.full(end - row, np.nan), np.zeros(end - row, bool)
            for i in np.flatnonzero(~failed):
                ratio[i], outside[i], kept[i] = in_bands(data[offsets[i] : offsets[i + 1]].tobytes(), bands, zip_)
            none = np.isnan(ratio)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, end - row), *(pa.array(s[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                 pa.array(failed), pa.array(kept), pa.array(ratio, mask=none), pa.array(outside, mask=none)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "zstd_ratio", "chunks_outside"],
            )


def quality_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lambda it: rule_rows(it, bands), SCHEMA)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
