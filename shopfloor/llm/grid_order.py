"""Embedding near-dedup by an epsilon grid order join.

Two vectors of length 1 have a cosine of at least c exactly if they lie no further apart than sqrt(2 - 2c). The
distinct vectors are turned to their principal axes, dealt into grid cells of that width on the leading ones,
and sorted by cell. The order is cut into intervals of consecutive vectors. Intervals are joined recursively:
a pair of intervals whose bounding boxes (leading coordinates and the length of what they leave) lie further
apart than that distance is skipped, any other one is taken apart into its parts, first by Spark joins down to
intervals of `INTERVAL` numbers, then inside the tasks down to leaves of `LEAF` vectors, whose cosines are
computed in double precision on the whole vectors.

A task returns, for each vector of its two intervals, the number of its links and a representative of what it is
connected to, never the pairs; so a group of thousands of near copies costs comparisons, not rows. Equal
vectors are met by digest first and are one vector of the join.

The axes are those of a bounded sample (`SAMPLE` numbers in all, the vectors with the smallest digests) and only
decide how much is skipped: any orthonormal axes give the same result. Random directions in many dimensions
can't be skipped by any grid: their boxes overlap, and all intervals are then compared.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't link (a join for each length that occurs); rows that repeat id and vector are linked
like any equal vectors, rows that repeat an id alone are vectors of their own; a row without id links with
nothing, has no component and is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from shopfloor.llm.components import components, unite
from shopfloor.llm.store import keep, keep_counted, table

COSINE = 0.9
#: Leading axes of the grid, and the margin that rounding of coordinates may use up.
AXES, MARGIN = 8, 1e-9
SAMPLE = 1 << 20
#: Numbers of the vectors of one interval, vectors of a leaf, parts of a node of intervals, partners that a task row takes.
INTERVAL, LEAF, FAN, PARTNERS = 1 << 19, 256, 32, 8


def reach_of(cosine: float) -> float:
    return math.sqrt(2 - 2 * cosine) + MARGIN


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by the greatest component first, so nothing overflows."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(vecs: pa.Array, dim: int, kind: type) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), kind) for v in vecs]) if len(vecs) else np.zeros((0, dim), kind)


def vector_rows(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
    """vec_id, dim, key (digest), vec (its numbers): the last three null where a row can't link."""
    for batch in batches:
        column, rows = batch.column("embedding"), ([], [], [])
        values = column.values.to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
        offsets = column.offsets.to_numpy()
        present = column.is_valid().to_numpy(zero_copy_only=False)
        for i in range(len(column)):
            x = values[offsets[i] : offsets[i + 1]].astype(kind) + kind(0) if present[i] else ()  # no -0
            good = len(x) > 0 and bool(np.isfinite(x).all()) and bool(np.any(x))
            raw = x.tobytes() if good else None
            for out, value in zip(rows, (len(x), hashlib.blake2b(raw, digest_size=16).digest(), raw) if good else (None, None, None)):
                out.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["vec_id", "dim", "key", "vec"])


def principal_axes(vectors: np.ndarray, axes: int = AXES) -> np.ndarray:
    """Orthonormal rows, by falling spread of the vectors; any number of vectors gives a whole set."""
    dim = vectors.shape[1]
    x = unit(vectors) if len(vectors) else vectors.astype(np.float64)
    spread = np.cov(x.T).reshape(dim, dim) if len(x) > 1 else np.eye(dim)
    return np.linalg.eigh(spread)[1].T[::-1][: min(axes, dim)].copy()


def coordinates(units: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Leading coordinates and the length of the rest: two vectors differ in each by no more than their distance, and in all together."""
    lead = units @ axes.T
    rest = np.sqrt(np.maximum(1 - (lead * lead).sum(axis=1), 0))
    return np.column_stack([lead, rest])


def cell_rows(batches: Iterator[pa.RecordBatch], dim: int, kind: type, axes: np.ndarray, reach: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        where = coordinates(unit(matrix(batch.column("vec"), dim, kind)), axes) if batch.num_rows else np.zeros((0, len(axes) + 1))
        cells = np.floor(where[:, :-1] / reach).astype(np.int64).clip(-30_000, 30_000)
        packed = (cells + 32_768).astype(">u2")
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in packed], pa.binary()), *(batch.column(c) for c in ("key", "vec", "copies"))], ["cell", "key", "vec", "copies"])


def interval_rows(batches: Iterator[pa.RecordBatch], dim: int, kind: type, axes: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """One row an interval, from rows sorted by position: its number, box, vectors and their copies."""

    def packed(number: int, vecs: list[bytes], copies: list[int]) -> pa.RecordBatch:
        where = coordinates(unit(np.frombuffer(b"".join(vecs), kind).reshape(-1, dim)), axes)
        columns = [pa.array([number]), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in (where.min(axis=0), where.max(axis=0))), pa.array([b"".join(vecs)], pa.binary()), pa.array([copies], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["interval", "low", "high", "vecs", "copies"])

    now, vecs, copies = -1, [], []
    for batch in batches:
        for number, vec, n in zip(*(batch.column(c).to_pylist() for c in ("interval", "vec", "copies"))):
            if number != now and vecs:
                yield packed(now, vecs, copies)
                vecs, copies = [], []
            now = number
            vecs.append(vec)
            copies.append(n)
    if vecs:
        yield packed(now, vecs, copies)


def apart(low_a, high_a, low_b, high_b):
    """Square of the distance of two boxes, for columns or arrays whose last axis are the coordinates."""
    gap = np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0)
    return (gap * gap).sum(axis=-1)


def near_leaves(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], reach: float, same: bool) -> np.ndarray:
    """Leaves of two intervals (lows, highs of their boxes) that may hold links, by recursion over halves of both."""
    near = np.zeros((len(a[0]), len(b[0])), bool)

    def join(i: int, j: int, k: int, m: int) -> None:
        if same and m <= i:
            return
        if apart(a[0][i:j].min(axis=0), a[1][i:j].max(axis=0), b[0][k:m].min(axis=0), b[1][k:m].max(axis=0)) > reach * reach:
            return
        if j - i == 1 and m - k == 1:
            near[i, k] = True
        elif j - i >= m - k:
            half = (i + j) // 2
            join(i, half, k, m)
            join(half, j, k, m)
        else:
            half = (k + m) // 2
            join(i, j, k, half)
            join(i, j, half, m)

    join(0, len(near), 0, near.shape[1])
    return near


class Interval:
    def __init__(self, row: dict, axes: np.ndarray, dim: int, kind: type):
        self.units = unit(np.frombuffer(row["vecs"], kind).reshape(-1, dim))
        self.copies = np.array(row["copies"], np.int64)
        where = coordinates(self.units, axes)
        cuts = np.arange(0, len(where), LEAF)
        self.cuts = np.append(cuts, len(where))
        self.boxes = (np.minimum.reduceat(where, cuts, axis=0), np.maximum.reduceat(where, cuts, axis=0))


def joined(a: Interval, b: Interval, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector of a and then b (of a alone, if they are the same), and the smallest place each is connected with."""
    n = len(a.units)
    total = n if same else n + len(b.units)
    links, parent = np.zeros(total, np.int64), np.arange(total)
    shift = 0 if same else n
    near = near_leaves(a.boxes, b.boxes, reach_of(cosine), same)
    for i in range(len(near)):
        leaves = np.flatnonzero(near[i])
        if not len(leaves):
            continue
        rows = slice(a.cuts[i], a.cuts[i + 1])
        whole = len(leaves) == near.shape[1]
        columns = np.arange(len(b.units)) if whole else np.concatenate([np.arange(b.cuts[j], b.cuts[j + 1]) for j in leaves])
        x, y = np.nonzero(a.units[rows] @ (b.units if whole else b.units[columns]).T >= cosine)
        x, y = x + rows.start, columns[y]
        if same:
            x, y = x[x < y], y[x < y]
        if len(x):
            links += np.bincount(x, weights=b.copies[y], minlength=total).astype(np.int64)
            links += np.bincount(y + shift, weights=a.copies[x], minlength=total).astype(np.int64)
            parent = unite(parent, x, y + shift)
    return links, parent


def join_rows(batches: Iterator[pa.RecordBatch], dim: int, kind: type, axes: np.ndarray, cosine: float, size: int) -> Iterator[pa.RecordBatch]:
    """node, links, root from rows (a, part, b, vecs, copies) in order: interval a (b is -1), then its partners."""
    first, number = None, -1
    for batch in batches:
        for i in range(batch.num_rows):
            row = {"a": batch.column("a")[i].as_py(), "b": batch.column("b")[i].as_py(), "vecs": batch.column("vecs")[i].as_buffer(), "copies": batch.column("copies")[i].as_py()}
            if row["b"] < 0:
                first, number = Interval(row, axes, dim, kind), row["a"]
                continue
            same = row["b"] == number
            links, parent = joined(first, first if same else Interval(row, axes, dim, kind), cosine, same)
            n = len(first.units)
            met = np.flatnonzero(links)
            node = lambda at: np.where(at < n, number * size + at, row["b"] * size + at - n)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(node(met)), pa.array(links[met]), pa.array(node(parent[met]))], ["node", "links", "root"])


def near_intervals(boxes: DataFrame, intervals: int, reach: float, axes: int) -> DataFrame:
    """(a, b) with a <= b: pairs of intervals that may hold links, by recursion over a tree of FAN parts a node."""
    depth = max(1, math.ceil(math.log(max(intervals, 2), FAN)))
    pairs = boxes.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    lows, highs = ([F.col(x)[i].alias(f"{x}{i}") for i in range(axes)] for x in ("low", "high"))
    flat = boxes.select("interval", *lows, *highs)
    for level in range(depth - 1, -1, -1):
        width = FAN**level
        sides = [F.min(f"low{i}").alias(f"low{i}") for i in range(axes)] + [F.max(f"high{i}").alias(f"high{i}") for i in range(axes)]
        nodes = flat.groupBy(F.floor(F.col("interval") / width).alias("node")).agg(*sides)
        side = lambda x: nodes.select(F.floor(F.col("node") / FAN).alias(x), F.col("node").alias(f"n{x}"), *(F.col(f"{c}{i}").alias(f"{c}{i}{x}") for c in ("low", "high") for i in range(axes)))  # noqa: B023, E731
        gap = lambda i: F.greatest(F.col(f"low{i}a") - F.col(f"high{i}b"), F.col(f"low{i}b") - F.col(f"high{i}a"), F.lit(0.0))
        distance = sum((gap(i) * gap(i) for i in range(1, axes)), gap(0) * gap(0))
        met = pairs.join(side("a"), "a").join(side("b"), "b").filter((F.col("na") <= F.col("nb")) & (distance <= reach * reach))
        pairs = keep(met.select(F.col("na").alias("a"), F.col("nb").alias("b")), "near-intervals")
    return pairs


def linked(classes: DataFrame, dim: int, count: int, kind: type, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(node, key) and (node, links, root) of the `count` classes of vectors of one length."""
    size = max(2 * LEAF, INTERVAL // dim)
    reach = reach_of(cosine)
    sample = classes.select("key", "vec").orderBy("key").limit(max(2, SAMPLE // dim)).toArrow().column("vec").combine_chunks()
    axes = principal_axes(matrix(sample, dim, kind))
    celled = classes.mapInArrow(lambda it: cell_rows(it, dim, kind, axes, reach), "cell binary, key binary, vec binary, copies long")
    # the digest follows the cell in the range key, so a cell with a third of all vectors is cut too
    order = keep(celled.repartitionByRange("cell", "key").sortWithinPartitions("cell", "key").withColumn("place", F.monotonically_increasing_id()), "grid-order")
    part, mask = F.shiftright("place", 33), (1 << 33) - 1
    counts = order.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    placed = order.withColumn("part", part).join(before, "part").withColumn("node", F.col("before") + F.col("place").bitwiseAND(F.lit(mask)))
    numbered = keep(placed.select("node", F.floor(F.col("node") / size).alias("interval"), "key", "vec", "copies"), "numbered")
    dealt = numbered.select("interval", "node", "vec", "copies").repartition("interval").sortWithinPartitions("interval", "node")
    blocks = keep(dealt.mapInArrow(lambda it: interval_rows(it, dim, kind, axes, size), "interval long, low array<double>, high array<double>, vecs binary, copies array<long>"), "intervals")
    pairs = near_intervals(blocks.select("interval", "low", "high"), -(-count // size), reach, len(axes) + 1)
    dealt_pairs = pairs.withColumn("part", F.floor(F.col("b") / PARTNERS))
    payload = blocks.select("interval", "vecs", "copies")
    ones = dealt_pairs.select("a", "part").distinct().join(payload.withColumnRenamed("interval", "a"), "a").select("a", "part", F.lit(-1).cast("long").alias("b"), "vecs", "copies")
    others = dealt_pairs.join(payload.withColumnRenamed("interval", "b"), "b").select("a", "part", "b", "vecs", "copies")
    tasks = ones.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", "b")
    found = keep(tasks.mapInArrow(lambda it: join_rows(it, dim, kind, axes, cosine, size), "node long, links long, root long"), "links")
    return numbered.select("node", "key"), found


def near_copies(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vec_id, embedding (an array of numbers)."""
    element = vectors.schema["embedding"].dataType.elementType
    kind, name = (np.float32, "float") if isinstance(element, T.FloatType) else (np.float64, "double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{name}>").alias("embedding"))
    rows = keep(rows.mapInArrow(lambda it: vector_rows(it, kind), "vec_id long, dim int, key binary, vec binary"), "vectors")
    usable = rows.filter("key is not null and vec_id is not null")
    classes, _ = keep_counted(usable.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "classes")
    named = None
    for dim, count in sorted(map(tuple, classes.groupBy("dim").count().collect())):  # the lengths of vectors that occur
        nodes, found = linked(classes.filter(F.col("dim") == dim).select("key", "vec", "copies"), dim, count, kind, cosine)
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        labels = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
        ids = nodes.join(classes.select("key", "copies", "least"), "key").join(links, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        ids = keep(ids.select("key", "component", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "linked")
        least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
        part = keep(ids.join(least, "component").select("key", "n_links", "component_id"), "named")
        named = part if named is None else named.unionByName(part)
    if named is None:
        named = rows.sparkSession.createDataFrame([], "key binary, n_links long, component_id long")
    known = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return known.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), COSINE)


OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a
), c AS (SELECT x AS vec_id, min(y) AS m FROM r GROUP BY x
), n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT t.vec_id, coalesce(n, 0) AS n_links, coalesce(m, t.vec_id) AS component_id, coalesce(m, t.vec_id) = t.vec_id AS kept
FROM embeddings t LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
