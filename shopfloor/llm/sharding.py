"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

At every level a document draws -ln(u) / weight for each child, with u from a hash of its id and the
child's name, and descends to the smallest draw. A child's draw depends on nothing but its own weight,
so a change moves documents only out of or into subtrees whose weights change. A shard added as a
region of its own changes no other draw: it only takes documents, into itself. The law is `key`.

Slots count from 0 in each shard, ordered by hash bucket and id. A shard is not gathered in one task:
rows are numbered within (shard, bucket) and shifted by the summed sizes of the earlier buckets.

Cases: a null id is a key like any other; rows with the same id share a shard; a null text is empty;
an empty table gives an empty result; columns of the result's names that the input has are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from shopfloor.llm.store import table

#: ((region, weight), ((rack, weight), ((shard number, weight), ...)), ...) with shards numbered in order.
Layout = tuple[tuple[str, tuple[tuple[str, tuple[tuple[int, float], ...]], ...]], ...]
SLOT_BUCKETS = 4096


def layout(regions: int = 5, racks: int = 2, shards: int = 4) -> Layout:
    """An even tree; 5 x 2 x 4 gives the shards 0 to 39."""
    return tuple((f"r{r}", tuple((f"r{r}k{k}", tuple(((r * racks + k) * shards + s, 1.0) for s in range(shards))) for k in range(racks))) for r in range(regions))


def grown(tree: Layout, weight: float = 1.0) -> Layout:
    """One more shard, as a region of its own."""
    n = sum(len(shards) for _, racks in tree for _, shards in racks)
    return (*tree, (f"r{len(tree)}+{n}", ((f"k+{n}", ((n, weight),)),)))


def _levels(tree: Layout) -> list[list[list[tuple[str, float, int]]]]:
    """For each level the children of each node: (name, weight, number of the node below or of the shard)."""
    regions, racks, shards = [], [], []
    for region, its_racks in tree:
        inside = []
        for rack, its_shards in its_racks:
            inside.append((rack, float(sum(w for _, w in its_shards)), len(shards)))
            shards.append([(f"s{n}", float(w), n) for n, w in its_shards])
        regions.append((region, sum(w for _, w, _ in inside), len(racks)))
        racks.append(inside)
    return [[regions], racks, shards]


def _draw(key: Column, child: Column) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", child["name"], key)), 1, 13), 16, 10).cast("double")
    return F.struct((-F.log((bits + 0.5) / float(1 << 52)) / child["weight"]).alias("d"), child["next"].alias("next"))


def shard_of(doc_id: Column, tree: Layout) -> Column:
    """Descends the tree; the smallest draw wins, at a tie the lower number."""
    key, node = F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(0)
    for nodes in _levels(tree):
        children = F.array(*(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(x).alias("next")) for n, w, x in c)) for c in nodes))
        node = F.array_min(F.transform(F.element_at(children, node + 1), lambda child: _draw(key, child)))["next"]
    return node.cast("int")


#: Buckets that the rows of a shard are numbered in.
BUCKETS = 4096


def shard(docs: DataFrame, tree: Layout, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds `shard` and `slot` (columns of these names are replaced, all others kept). Rows are shuffled once, by shard and a
    hash of `order`, by which slots are numbered within a bucket; the counts need these columns alone."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")))
    placed = docs.select(row.alias("row"), shard_of(F.col("doc_id"), tree).alias("shard"), F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    place = F.row_number().over(W.partitionBy("shard", "bucket").orderBy(*(F.col("row")[c] for c in order))) - 1
    numbered = placed.withColumn("place", place).join(first, ["shard", "bucket"])
    return numbered.select("row.*", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"))


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"size": (F.octet_length(text) + 16).cast("long"), "text_crc32": F.crc32(text.cast("binary")).cast("long")})


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = layout()
    docs = sized(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    out = shard(docs, tree, ("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("doc_id"), grown(tree)).alias("grown_shard"))
