"""Benchmark decontamination with a positional inverted index of the training texts.

The benchmark is cut into windows of 10 words. One pass counts how often the benchmark's terms occur in
the corpus; a window with a term that never occurs is done. A second pass stores the postings (term,
text, position) of the rarest terms of the remaining windows. The postings of a window's rarest term,
shifted by its offset, give candidate places, which are intersected with the shifted postings of the next
rarest terms; what is left is compared word by word with the text. Only lists of rare terms are ever
joined, however frequent the other words are, and a term's list is a join key, never one group.
Places are searched for each distinct window once, however many items share it; items are joined to
the distinct sets of windows that texts hold.

The benchmark is the stated query set. Its terms go to the tasks in blocks of at most `BLOCK_WORDS`
words; a larger benchmark takes more passes, not more memory.

Cases: null and empty texts have no words and hit nothing; copies of a text share their index rows by
digest; a benchmark item that repeats counts once; a null item id is the empty string; an empty corpus
or benchmark gives no hits; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shopfloor.llm.store import keep, keep_counted, meeting, table
from shopfloor.llm.text import LOWER, NOT_ALNUM, lists, pieces, signed, split_words

WINDOW = 10
RAREST = 3
BLOCK_WORDS = 200_000


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


class Terms:
    """Membership of hashes in a sorted list, behind a table of their low bits."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.unique(terms.astype(np.uint64))
        self.low = np.zeros(1 << 20, bool)
        self.low[self.terms & np.uint64((1 << 20) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `hashes` of terms, and which terms."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.low[hashes & np.uint64((1 << 20) - 1)])
        which = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        same = self.terms[which] == hashes[at]
        return at[same], which[same]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, n (words), terms (hashes in order), phrase (digest of its words in lower case, one space between them)"""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, out = batch.column("item").to_pylist(), ([], [], [], [])
            for row, _, data, offsets in pieces(batch.column("text")):
                w = split_words(data, offsets, NOT_ALNUM, lower=True)
                low = LOWER[data]
                names = [low[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
                for i in range(len(offsets) - 1):
                    first, last = int(w.first[i]), int(w.first[i + 1])
                    n = min(window, last - first)
                    for at in range(first, last - n + 1) if n else ():
                        for column, value in zip(out, (items[row + i], n, signed(w.hash[at : at + n]).tolist(), " ".join(names[at : at + n]))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.string())], ["item", "n", "terms", "phrase"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    windows = rows.mapInArrow(cut, "item string, n int, terms array<long>, phrase string")
    return windows.withColumn("phrase", F.unhex(F.md5("phrase"))).distinct()


def term_counts(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """term, n: occurrences in the corpus; one partial count a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(terms)
        total = np.zeros(len(known.terms), np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text")):
                total += np.bincount(known.find(split_words(data, offsets, NOT_ALNUM, lower=True).hash)[1], minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(signed(known.terms[met]), pa.int64()), pa.array(total[met])], ["term", "n"])

    return docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """One row a document: doc_id, text_key, n_words, and the postings of `terms` in it."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(terms)
        for batch in batches:
            for row, end, data, offsets in pieces(batch.column("text")):
                w = split_words(data, offsets, NOT_ALNUM, lower=True)
                at, which = known.find(w.hash)
                counts = np.diff(np.searchsorted(at, w.first))
                place = at - np.repeat(w.first[:-1], counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), batch.column("text_key").slice(row, end - row), pa.array(np.diff(w.first)),
                     lists(signed(known.terms[which]), counts, pa.int64()), lists(place, counts, pa.int64())],
                    ["doc_id", "text_key", "n_words", "terms", "places"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(index, "doc_id long, text_key binary, n_words long, terms array<long>, places array<long>")


def rare_windows(windows: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """Windows all of whose terms occur, with `rare`: the (count, offset, term) of their rarest terms."""
    keys = ["n", "phrase"]
    spread = windows.select(*keys, F.posexplode("terms").alias("offset", "term")).join(counts.withColumnRenamed("n", "count"), "term")
    found = spread.groupBy(keys).agg(F.array_sort(F.collect_list(F.struct("count", F.col("offset").cast("long").alias("offset"), "term"))).alias("rare"))
    return found.filter(F.size("rare") == F.col("n")).withColumn("rare", F.slice("rare", 1, rarest))


def candidates(windows: DataFrame, index: DataFrame, rarest: int = RAREST, slop: int = 0) -> DataFrame:
    """n, phrase, text_key, start: places at which the rarest terms of a window stand at their offsets,
    or with `slop` no more than so many words away from them."""
    listed = index.filter(F.size("terms") > 0).select("text_key", F.explode(F.arrays_zip("terms", "places")).alias("p")).select("text_key", F.col("p.terms").alias("term"), F.col("p.places").alias("place")).distinct()
    first = F.col("rare")[0]
    out = windows.withColumn("term", first["term"]).join(listed, "term").withColumn("start", F.col("place") - first["offset"]).drop("term", "place")
    for i in range(1, rarest):
        this, more = F.get("rare", F.lit(i)), F.size("rare") > i
        todo = out.filter(more).withColumns({"term": this["term"], "want": F.col("start") + this["offset"]})
        if slop:
            near = todo.join(listed, ["term", "text_key"]).filter(F.abs(F.col("place") - F.col("want")) <= slop).select(*out.columns).distinct()
        else:
            near = todo.join(listed.withColumnRenamed("place", "want"), ["term", "text_key", "want"], "left_semi").select(*out.columns)
        out = near.unionByName(out.filter(~more))
    return out.drop("rare").filter("start >= 0")


def verified(docs: DataFrame, found: DataFrame, numbers: int) -> DataFrame:
    """text_key, phrases (digests, sorted), n_hit (words inside any occurrence): candidates compared with the whole texts.
    `numbers`: how many the candidates hold; while they are few, texts stay where they are read."""
    by_text = found.groupBy("text_key").agg(F.collect_list(F.struct("n", "phrase", "start")).alias("found"))
    texts = meeting(docs.select(text_key(F.col("text")).alias("text_key"), "text"), by_text, "text_key", numbers)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found_rows = ([], [], []), batch.column("found")
            for row, _, data, offsets in pieces(batch.column("text")):
                w, low = split_words(data, offsets, NOT_ALNUM, lower=True), LOWER[data]
                for i in range(len(offsets) - 1):
                    first, last = int(w.first[i]), int(w.first[i + 1])
                    hit, phrases = np.zeros(last - first, bool), set()
                    for c in found_rows[row + i].as_py():
                        start, n = c["start"], c["n"]
                        if first + start + n > last:
                            continue
                        at = slice(first + start, first + start + n)
                        if hashlib.md5(b" ".join(low[a:b].tobytes() for a, b in zip(w.start[at], w.end[at]))).digest() == c["phrase"]:
                            hit[start : start + n] = True
                            phrases.add(c["phrase"])
                    if phrases:
                        for column, value in zip(rows, (batch.column("text_key")[row + i].as_py(), sorted(phrases), int(hit.sum()))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.list_(pa.binary())), pa.array(rows[2], pa.int64())], ["text_key", "phrases", "n_hit"])

    # texts of one digest have equal rows
    return texts.mapInArrow(compare, "text_key binary, phrases array<binary>, n_hit long").distinct()


def items_of(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """text_key, n_hit, items (sorted): the list is made once for each distinct set of phrases."""
    hits = keep(hits.withColumn("set", F.unhex(F.sha2(F.array_join(F.transform("phrases", F.hex), ","), 256))), "hits")
    members = windows.select("phrase", "item").distinct()
    sets = hits.select("set", "phrases").distinct().select("set", F.explode("phrases").alias("phrase"))
    items = sets.join(members, "phrase").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return hits.join(items, "set").select("text_key", "n_hit", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items for every document."""
    windows = keep(benchmark_windows(benchmark), "benchmark-windows")
    phrases = keep(windows.drop("item").distinct(), "phrases")
    words = phrases.agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = -(-words // (WINDOW * BLOCK_WORDS)) or 1
    found, index = None, None
    for block in range(blocks):
        part = phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block) if blocks > 1 else phrases
        counts = keep(term_counts(docs, driver_terms(part.select(F.explode("terms").alias("term")))), "term-counts")
        rare = keep(rare_windows(part, counts), "rare-windows")
        index = keep(postings(docs, driver_terms(rare.select(F.explode("rare.term").alias("term")))), "postings")
        at = candidates(rare, index)
        found = at if found is None else found.unionByName(at)
    found, (places,) = keep_counted(found, "candidates")
    hits = keep(items_of(verified(docs, found, places * 6), windows), "item-lists")
    return index.select("doc_id", "text_key", "n_words").join(hits, "text_key", "left").select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def driver_terms(terms: DataFrame) -> np.ndarray:
    """Term hashes of one block of the benchmark: at most WINDOW * BLOCK_WORDS of them by construction."""
    return np.array(terms.distinct().toArrow().column("term").combine_chunks(), np.int64).view(np.uint64)


def near_matches(docs: DataFrame, benchmark: DataFrame, slop: int) -> DataFrame:
    """Proximity matches: text_key, item, start of windows whose rarest terms stand within `slop` words of their places."""
    windows = keep(benchmark_windows(benchmark), "benchmark-windows")
    phrases = keep(windows.drop("item").distinct(), "phrases")
    counts = keep(term_counts(docs, driver_terms(phrases.select(F.explode("terms").alias("term")))), "term-counts")
    rare = keep(rare_windows(phrases, counts), "rare-windows")
    index = keep(postings(docs, driver_terms(rare.select(F.explode("rare.term").alias("term")))), "postings")
    return candidates(rare, index, slop=slop).join(windows.select("phrase", "item"), "phrase").select("text_key", "item", "start").distinct()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    hit = keep(decontaminate(docs, benchmark).filter("n_hit > 0").select("text_key").distinct(), "contaminated")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_key(F.col("text")).alias("text_key"))
    return rows.join(hit, "text_key", "left_anti").select("row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = r"""
WITH b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), h AS (
  SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, phrase)
), p AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
