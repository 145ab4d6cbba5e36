"""Substring dedup with suffix automata of reference passages.

A word is removed if a window of 50 words that covers it also starts in a document with a smaller id. The
reference of a document are thus the passages of all earlier documents, which grow with the corpus, so
whole-corpus automata can't be broadcast: passages are sharded by the anchor that their windows own, and a
shard's automaton is built in the task to which both its passages and the documents' windows go. There,
documents come in order of id: the matching statistics of a document's words against the automaton give
the windows that occurred before, then its own passage is added. An anchor with more than CHUNK
occurrences is dealt to several tasks; each then reports the first occurrence of each window, and a
grouping of window digests finds those that occurred before in another task.

Texts that are equal as a whole are met first: all but the first lose every word if they have 50.

Cases: null and empty texts have no words; fewer than 50 words are never removed; rows without doc_id
neither lose words nor cause a loss; rows that share doc_id don't affect each other; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shopfloor.llm.passages import anchors, chunk_of, grouped_rows, merged, shared
from shopfloor.llm.store import keep, table
from shopfloor.llm.text import lists, pieces, signed, slices, split_words

WINDOW, GRAM = 50, 8
#: Occurrences of one anchor that one task compares; more are dealt to several, and what those leave open is matched by digests of windows.
CHUNK = 4096


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            now, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = now

    def matches(self, words: list[bytes]) -> Iterator[int]:
        """Matching statistics: length of the longest suffix of the words read so far that occurs in the automaton."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield length


def head_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text_key, n_words, digest of all words, and the anchors of the text."""
    for batch in batches:
        for row, end, data, offsets in pieces(batch.column("text")):
            w = split_words(data, offsets)
            text, key, low, high = anchors(w.hash, w.first, n, GRAM)
            counts = np.bincount(text, minlength=end - row)
            joined = [b" ".join(data[a:b].tobytes().split()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, end - row), batch.column("text_key").slice(row, end - row), pa.array(np.diff(w.first)),
                 pa.array([hashlib.sha256(x).hexdigest() for x in joined], pa.string()), lists(signed(key), counts, pa.int64()), lists(low, counts, pa.int64()), lists(high, counts, pa.int64())],
                ["doc_id", "text_key", "n_words", "sha256", "keys", "low", "high"],
            )


def cut_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The words of each shared passage, joined by one space."""
    for batch in (part for whole in batches for part in slices(whole)):
        ids, keys, spots = (batch.column(c) for c in ("doc_id", "text_key", "spots"))
        for row, end, data, offsets in pieces(batch.column("text")):
            w = split_words(data, offsets)
            for i in range(row, end):
                first, found = int(w.first[i - row]), spots[i].values
                key, chunk, chunks, low, high = (found.field(c) for c in ("key", "chunk", "chunks", "low", "high"))
                passages = [
                    b" ".join(data[w.start[first + a] : w.end[first + b + n - 1]].tobytes().split()) for a, b in zip(low.to_pylist(), high.to_pylist())
                ]
                same = lambda x: pa.array([x.as_py()] * len(found), x.type)
                yield pa.RecordBatch.from_arrays([key, chunk, chunks, same(ids[i]), same(keys[i]), low, pa.array(passages, pa.binary())], ["key", "chunk", "chunks", "doc_id", "text_key", "low", "passage"])


CUT = "key long, chunk long, chunks long, doc_id long, text_key binary, low long, passage binary"
FOUND = "doc_id long, text_key binary, low long, high long, window binary"


def windows_before(rows: list[dict], n: int) -> Iterator[tuple[dict, int, int]]:
    """(row, first window, last window) of each run of windows that occur in a row with a smaller doc_id."""
    automaton, seen, same_doc, waiting = Automaton(), {}, None, []
    for row in rows:
        if row["doc_id"] != same_doc:
            for passage in waiting:
                if passage not in seen:
                    seen[passage] = True
                    automaton.add(passage.split(b" "))
            same_doc, waiting = row["doc_id"], []
        waiting.append(row["passage"])
        if row["passage"] in seen:
            yield row, 0, row["passage"].count(b" ") + 1 - n
            continue
        if not seen:
            continue
        first = None
        words = row["passage"].split(b" ")
        for end, length in enumerate(automaton.matches(words), 1):
            if length >= n:
                first = end - n if first is None else first
            elif first is not None:
                yield row, first, end - 1 - n
                first = None
        if first is not None:
            yield row, first, len(words) - n


def found_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for _, rows in grouped_rows(batches, ("key", "chunk")):
        covered: dict[int, set[int]] = {}
        for row, a, b in windows_before(rows, n):
            out.append((row["doc_id"], row["text_key"], row["low"] + a, row["low"] + b, None))
            if row["chunks"] > 1:
                covered.setdefault(id(row), set()).update(range(a, b + 1))
        if rows[0]["chunks"] > 1:
            for row in rows:
                words, known = row["passage"].split(b" "), covered.get(id(row), ())
                for s in range(len(words) - n + 1):
                    if s not in known:
                        out.append((row["doc_id"], row["text_key"], row["low"] + s, row["low"] + s, hashlib.md5(b" ".join(words[s : s + n])).digest()))
        if len(out) > 20_000:
            yield found_batch(out)
            out = []
    yield found_batch(out)


def found_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "text_key": pa.binary(), "low": pa.int64(), "high": pa.int64(), "window": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


def rest_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text_key, n_removed, kept text of documents with removed words."""
    for batch in (part for whole in batches for part in slices(whole)):
        out = ([], [], [], [], [])
        for doc, digest, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text", "spans"))):
            words, kept, at = text.encode().split(), [], 0
            for a, b in merged([(s["low"], s["high"] + n) for s in spans]):
                kept += words[at:a]
                at = b
            kept += words[at:]
            rest = b" ".join(kept)
            for column, value in zip(out, (doc, digest, len(words) - len(kept), rest.decode(), hashlib.sha256(rest).hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "text_key", "n_removed", "kept", "kept_sha256"])


def repeats(docs: DataFrame, heads: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(texts with shared anchors, spans (doc_id, text_key, low, high) of windows that occurred before)."""
    firsts = heads.filter("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    spread = heads.filter(F.size("keys") > 0).join(firsts, ["text_key", "doc_id"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    spread = spread.select("doc_id", "text_key", F.explode(F.arrays_zip("keys", "low", "high")).alias("s")).select("doc_id", "text_key", F.col("s.keys").alias("key"), F.col("s.low").alias("low"), F.col("s.high").alias("high"))
    # as a written table, so that the join has plain sides: a hot anchor's rows are split there
    spots = spread.join(keep(shared(spread, "doc_id", CHUNK), "shared"), "key").withColumn("chunk", chunk_of(F.col("doc_id")))
    by_text = keep(spots.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("key", "chunk", "chunks", "low", "high")).alias("spots")), "spots")
    texts = keep(docs.join(by_text, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", "text", "spots"), "passage-texts")
    dealt = texts.mapInArrow(lambda it: cut_rows(it, n), CUT).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "doc_id", "low")
    found = keep(dealt.mapInArrow(lambda it: found_rows(it, n), FOUND), "windows-before")
    open_ = found.filter("window is not null")
    least = open_.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("window", "first")
    late = open_.join(least, "window").filter(F.col("doc_id") > F.col("first"))
    cols = ["doc_id", "text_key", "low", "high"]
    return texts, found.filter("window is null").select(*cols).unionByName(late.select(*cols))


def dedup(docs: DataFrame, n: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_words, sha256, copy for every document; doc_id, text_key, n_removed, kept, kept_sha256 for those with removed words).
    A row with `copy` equals an earlier document as a whole."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"), "text")
    heads = keep(docs.mapInArrow(lambda it: head_rows(it, n), "doc_id long, text_key binary, n_words long, sha256 string, keys array<long>, low array<long>, high array<long>"), "heads")
    texts, spans = repeats(docs, heads, n)
    by_text = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    rest = keep(texts.select("doc_id", "text_key", "text").join(by_text, ["doc_id", "text_key"]).mapInArrow(lambda it: rest_rows(it, n), "doc_id long, text_key binary, n_removed long, kept string, kept_sha256 string"), "kept")
    firsts = heads.filter("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("first"))
    rows = heads.select("doc_id", "text_key", "n_words", "sha256").join(firsts, "text_key", "left")
    return rows.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.col("n_words") >= n)).drop("first"), rest


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, rest = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = rows.join(rest.drop("kept"), ["doc_id", "text_key"], "left")
    return out.select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM s
), k AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM f WHERE m < doc_id) GROUP BY doc_id
), e AS (
  SELECT d.doc_id, w, j FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS j)
), r AS (
  SELECT e.doc_id, string_agg(w[j], ' ' ORDER BY j) AS rest FROM e LEFT JOIN (SELECT doc_id, unnest(gone) AS j, true AS away FROM k) x USING (doc_id, j) WHERE away IS NULL GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)
"""
