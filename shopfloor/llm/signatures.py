"""Ranked lexical search over bit-sliced Bloom signatures.

Every text gets a signature: for each of its terms, and for each power of two that the term's count reaches,
three bits are set. Texts of similar size form blocks, whose signatures are stored as slices: one bitmap over
the block's texts for each bit position. The three slices of a term, intersected, show the texts that hold it
so often, and some more, but miss none. Weighted by the greatest score that a term can add at that count and
text length, summed slices bound the score of every text of a block from above.

A search first takes the texts with the highest bounds and scores them exactly; the k-th best of these scores
is a limit that the k-th best of all texts reaches too. Then every text whose bound is not below the limit is
scored exactly. Nothing else can be among the best, so the result is exact whatever the bits collide on.

The queries are the stated query set: their terms go to the tasks in blocks of `BLOCK_TERMS`, larger sets take
more passes. Scores need integers below 2^63 (the number of documents times the longest one's terms times 90).

Cases: null and empty texts have no terms, are not counted and never returned; queries without terms that
occur get no rows; rows of the queries with one id are one query of all their terms, a null id is an id;
repeated documents are ranked each, by id (null last); an empty corpus or query set gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from shopfloor.llm.store import keep, keep_counted, table
from shopfloor.llm.text import NOT_ALNUM, U, Words, mix, pieces, signed, split_words

TOP = 10
#: Bits of a signature for one (term, count level) entry at least, and the number of slices an entry is found by.
ENTRY_BITS, HASHES = 8, 3
#: Texts of a block, and bits of one: long texts make blocks of fewer texts.
BLOCK_TEXTS, BLOCK_BITS = 2048, 1 << 22
#: Query terms that go to the tasks at once.
BLOCK_TERMS = 20_000
#: Texts of the highest bounds that are scored first, for each query.
FIRST = 16
#: Found (text, query) pairs up to which the scan of the documents meets them by broadcast: some 30 bytes each.
SMALL = 500_000


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def text_terms(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, text, count) of the distinct terms of each text, by text."""
    text = w.text
    order = np.lexsort((w.hash, text))
    term, text = w.hash[order], text[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return term[first], text[first], np.diff(np.append(first, len(term)))


def entry(term: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    return mix(term ^ mix(np.atleast_1d(level).astype(np.uint64) + U(0xB10C)))


def slots(entries: np.ndarray, bits: int) -> list[np.ndarray]:
    """The slices of each entry in signatures of so many bits (a power of two)."""
    return [(mix(entries + U(i * 0x9E3779B97F4A7C15 % (1 << 64))) & U(bits - 1)).astype(np.int64) for i in range(HASHES)]


def block_texts(bits: int) -> int:
    return max(8, min(BLOCK_TEXTS, BLOCK_BITS // bits))


BLOCK_SCHEMA = "bits long, texts long, words long, keys array<binary>, lengths array<long>, slices binary"


def _block(bits: int, rows: list[tuple[bytes, int, np.ndarray]]) -> pa.RecordBatch:
    flags = np.zeros((bits, -(-len(rows) // 8) * 8), bool)
    for i, (_, _, entries) in enumerate(rows):
        for at in slots(entries, bits):
            flags[at, i] = True
    lengths = [n for _, n, _ in rows]
    columns = [pa.array([x]) for x in (bits, len(rows), sum(lengths))]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array([[k for k, _, _ in rows]], pa.list_(pa.binary())), pa.array([lengths], pa.list_(pa.int64())), pa.array([np.packbits(flags, axis=1).tobytes()], pa.binary())],
        ["bits", "texts", "words", "keys", "lengths", "slices"],
    )


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts whose signatures have equal length; a task holds one open block of each length."""
    waiting: dict[int, list] = {}
    for batch in batches:
        for row, end, data, offsets in pieces(batch.column("text")):
            w = split_words(data, offsets, NOT_ALNUM, lower=True)
            term, text, count = text_terms(w)
            level = np.frexp(count.astype(float))[1].astype(np.int64)  # levels 0, 1, ... below this one are reached
            spread = np.repeat(np.arange(len(term)), level)
            entries = entry(term[spread], np.arange(len(spread)) - np.repeat(np.cumsum(level) - level, level))
            bounds = np.searchsorted(text[spread], np.arange(end - row + 1))
            sizes, keys = np.diff(w.first), batch.column("text_key").slice(row, end - row).to_pylist()
            for i in np.flatnonzero(sizes).tolist():
                own = entries[bounds[i] : bounds[i + 1]]
                bits = max(64, 1 << int(ENTRY_BITS * len(own) - 1).bit_length())
                block = waiting.setdefault(bits, [])
                block.append((keys[i], int(sizes[i]), own.copy()))
                if len(block) == block_texts(bits):
                    yield _block(bits, waiting.pop(bits))
    for bits, rows in waiting.items():
        yield _block(bits, rows)


@dataclass
class Index:
    """blocks: the signatures; texts and words: how many there are with terms, and their terms with repeats."""

    blocks: DataFrame
    texts: int
    words: int

    @property
    def size(self) -> tuple[int, int]:
        return self.texts, self.words


def index(docs: DataFrame) -> Index:
    rows = docs.select(text_key(F.col("text")).alias("text_key"), "text")
    blocks, (_, texts, words) = keep_counted(rows.mapInArrow(index_rows, BLOCK_SCHEMA), "signatures", F.sum("texts"), F.sum("words"))
    return Index(blocks, texts or 0, words or 0)


@dataclass
class Asked:
    """A block of queries. Query i has the terms which[first[i] : first[i + 1]] of the sorted `terms`."""

    ids: pa.Array
    terms: np.ndarray
    first: np.ndarray
    which: np.ndarray
    weight: np.ndarray | None = None

    def of(self, i: int) -> np.ndarray:
        return self.which[self.first[i] : self.first[i + 1]]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `hashes` of terms, and which terms."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        at = np.flatnonzero(self.terms[which] == hashes)
        return at, which[at]


def query_terms(queries: DataFrame, id_column: str) -> DataFrame:
    """id, term: the distinct terms of each query."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in pieces(batch.column("text")):
                term, text, _ = text_terms(split_words(data, offsets, NOT_ALNUM, lower=True))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, end - row).take(pa.array(text)), pa.array(signed(term), pa.int64())], ["id", "term"])

    kind = queries.schema[id_column].dataType.simpleString()
    return queries.select(F.col(id_column).alias("id"), "text").mapInArrow(cut, f"id {kind}, term long").distinct()


def query_blocks(queries: DataFrame, id_column: str) -> Iterator[Asked]:
    """At most some BLOCK_TERMS terms at a time are on the driver and in the tasks."""
    rows, (total,) = keep_counted(query_terms(queries, id_column), "query-terms")
    blocks = -(-total // BLOCK_TERMS)
    for block in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id", "term").toArrow().combine_chunks()
        ids, term = part.column("id").combine_chunks(), part.column("term").combine_chunks().to_numpy().view(np.uint64)
        if not len(ids):
            continue
        codes = ids.dictionary_encode(null_encoding="encode")
        code = codes.indices.to_numpy()
        terms, which = np.unique(term, return_inverse=True)
        order = np.argsort(code, kind="stable")
        yield Asked(codes.dictionary, terms, np.searchsorted(code[order], np.arange(len(codes.dictionary) + 1)), which[order])


def held_by(docs: DataFrame, asked: Asked) -> np.ndarray:
    """Number of documents that hold each term; one partial count a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked.terms), np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text")):
                w = split_words(data, offsets, NOT_ALNUM, lower=True)
                at, which = asked.find(w.hash)
                pair = np.unique((np.searchsorted(w.first, at, "right") - 1) * len(asked.terms) + which)
                total += np.bincount(pair % len(asked.terms), minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["which", "n"])

    rows = docs.select("text").mapInArrow(count, "which long, n long").groupBy("which").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(asked.terms), np.int64)
    out[rows.column("which").to_numpy()] = rows.column("n").to_numpy()
    return out


def weights(held: np.ndarray, texts: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of terms that occur, else 0."""
    return np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * n + 1))) if n else 0 for n in held.tolist()], np.int64)


def long_texts(length, texts: int, words: int):
    """m of a text: from 10 upwards, 100 at mean length. Floor division of integers."""
    return 10 + 90 * length * texts // words


def saturated(count, m):
    return 1_000_000_000 * count // (1000 * count + 8 * m)


def bounds(block: dict, asked: Asked, texts: int, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, upper bounds of the scores of the block's texts)"""
    bits, n = block["bits"], block["texts"]
    slices = np.frombuffer(block["slices"], np.uint8).reshape(bits, -1)
    m = long_texts(np.array(block["lengths"], np.int64), texts, words)
    levels, live, before = [], np.flatnonzero(asked.weight > 0), None
    held = np.full((len(asked.terms), slices.shape[1]), 255, np.uint8)
    for level in range(31):  # a text has fewer than 2^31 terms
        one, *more = slots(entry(asked.terms[live], level), bits)
        rows = held[live] & slices[one]
        for at in more:
            rows &= slices[at]
        held[live] = rows
        some = rows.any(axis=1)
        live = live[some]
        if not len(live):
            break
        place = np.full(len(asked.terms), -1, np.int64)
        place[live] = np.arange(len(live))
        # what a term adds if its count lies between this level and the next
        most = saturated(np.int64((2 << level) - 1), m)
        levels.append((place, np.unpackbits(rows[some], axis=1)[:, :n], most if before is None else most - before))
        before = most
    for i in range(len(asked.ids)):
        own, total = asked.of(i), None
        for place, present, gain in levels:
            at = place[own]
            own, at = own[at >= 0], at[at >= 0]
            if not len(at):
                break
            added = gain * (asked.weight[own].astype(float) @ present[at]).astype(np.int64)
            total = added if total is None else total + added
        if total is not None:
            yield i, total


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "slices"} | {"slices": batch.column("slices")[i].as_buffer()}


def highest(ix: Index, asked: Asked, first: int) -> DataFrame:
    """query, bound, text_key: for each query the texts with the highest bounds of each task."""
    size = ix.size

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in range(len(asked.ids))]
        for block in blocks_of(batches):
            for i, bound in bounds(block, asked, *size):
                for at in np.argsort(-bound, kind="stable")[:first].tolist():
                    if not bound[at] or len(best[i]) == first and int(bound[at]) <= best[i][0][0]:
                        break
                    (heapq.heappush if len(best[i]) < first else heapq.heappushpop)(best[i], (int(bound[at]), block["keys"][at]))
        rows = [(i, b, k) for i, found in enumerate(best) for b, k in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["query", "bound", "text_key"])

    return ix.blocks.mapInArrow(search, "query int, bound long, text_key binary")


def not_excluded(ix: Index, asked: Asked, limit: np.ndarray) -> DataFrame:
    """query, text_key of all texts whose bound reaches the query's limit."""
    size = ix.size

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches):
            for i, bound in bounds(block, asked, *size):
                at = np.flatnonzero(bound >= limit[i])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array([block["keys"][a] for a in at], pa.binary())], ["query", "text_key"])

    return ix.blocks.mapInArrow(search, "query int, text_key binary")


def scored(docs: DataFrame, wanted: DataFrame, asked: Asked, ix: Index) -> DataFrame:
    """query, doc_id, score of every document with a wanted (query, text_key), where the score is above 0."""
    size = ix.size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists_ = batch.column("doc_id").to_pylist(), batch.column("queries")
            for row, end, data, offsets in pieces(batch.column("text")):
                w = split_words(data, offsets, NOT_ALNUM, lower=True)
                at, which = asked.find(w.hash)
                cuts, out = np.searchsorted(at, w.first), []
                for i in range(end - row):
                    counts = np.bincount(which[cuts[i] : cuts[i + 1]], minlength=len(asked.terms))
                    m = long_texts(int(w.first[i + 1] - w.first[i]), *size)
                    for query in lists_[row + i].as_py():
                        own = asked.of(query)
                        own = own[counts[own] > 0]
                        total = int((asked.weight[own] * saturated(counts[own], m)).sum())
                        if total > 0:
                            out.append((query, ids[row + i], total))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["query", "doc_id", "score"])

    pairs, (n,) = keep_counted(wanted.select("query", "text_key").distinct(), "candidates")
    by_text = pairs.groupBy("text_key").agg(F.collect_list("query").alias("queries"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return rows.join(F.broadcast(by_text) if n <= SMALL else by_text, "text_key").mapInArrow(score, "query int, doc_id long, score long")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank; Spark cuts each task's rows to k before the shuffle."""
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def limits(best: DataFrame, asked: Asked, k: int) -> np.ndarray:
    """For each query of the block the k-th best score found, or 1 while there are fewer."""
    rows = best.filter(F.col("rank") == k).select("query", "score").toArrow()
    out = np.ones(len(asked.ids), np.int64)
    out[rows.column("query").to_numpy()] = rows.column("score").to_numpy()
    return out


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_column: str = "item_id") -> DataFrame:
    """`id_column`, rank, doc_id, score: the k documents with the highest scores above 0 for every query."""
    kind = queries.schema[id_column].dataType.simpleString()
    ix, out = index(docs), None
    for asked in query_blocks(queries, id_column) if ix.texts else ():
        asked.weight = weights(held_by(docs, asked), ix.texts)
        by_bound = W.partitionBy("query").orderBy(F.desc("bound"), "text_key")
        first = highest(ix, asked, max(FIRST, k)).withColumn("place", F.row_number().over(by_bound)).filter(F.col("place") <= max(FIRST, k))
        limit = limits(ranked(scored(docs, first, asked, ix), k), asked, k)
        best = ranked(scored(docs, not_excluded(ix, asked, limit), asked, ix), k)

        def named(batches: Iterator[pa.RecordBatch], ids: pa.Array = asked.ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([ids.take(batch.column("query")), *(batch.column(c) for c in ("rank", "doc_id", "score"))], ["id", "rank", "doc_id", "score"])

        part = keep(best.select("query", "rank", "doc_id", "score").mapInArrow(named, f"id {kind}, rank int, doc_id long, score long"), "ranked")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"id {kind}, rank int, doc_id long, score long")
    return out.withColumnRenamed("id", id_column)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), TOP)


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents WHERE text IS NOT NULL
), c AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL
), n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY doc_id
), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM c GROUP BY term), s
), r AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN c USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id
), o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""
