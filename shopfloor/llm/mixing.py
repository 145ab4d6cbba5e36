"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Each source has a word budget. A document has a fixed 60-bit hash, and the mix takes an extra copy of
those below the hash threshold at which the running word count meets the budget. The threshold is found
without sorting documents: words are summed by source and the top hash bits, the bucket in which the
budget falls is summed again by its next bits, and the last one by single hash values. Budgets of the
first, second, ... copy are nested, so at most one copy of a source has a threshold within its hashes.

Cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own, last
in order; rows that repeat doc_id and text share a hash and are taken or left together; an empty table
gives an empty result; columns of the result's names that the input already has are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from shopfloor.llm.store import keep, table

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60


@dataclass(frozen=True)
class MixPlan:
    """`weights` repeat over the sources in code point order; `share` is the mix's size as a part of all
    words; no source gives more than `copies` times its words. `levels` are the bits of each histogram."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    copies: int = 2
    levels: tuple[int, ...] = (12, 12, 12, 12, 12)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of md5; the text takes part, so that rows without an id spread too."""
    seed = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(seed), 1, HASH_BITS // 4), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """The documents with `size` and `mix_hash`."""
    return docs.withColumns({"size": word_count(F.col("text")), "mix_hash": mix_hash(F.col("doc_id"), F.col("text"))})


def targets(sized: DataFrame, plan: MixPlan) -> DataFrame:
    """source, source_size, target. One row a source from the start; the level at which the sources
    not yet at their cap share the rest by weight is read off running sums in order of cap by weight."""
    size = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, plan.weights)), place % len(plan.weights) + 1).cast("double")
    cap = (plan.copies * F.col("source_size")).cast("double")
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every, before = W.partitionBy(), by_cap.rowsBetween(W.unboundedPreceding, -1)
    left = plan.share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("order", "level"))
    return (
        size.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("order", F.row_number().over(by_cap))
        .withColumn("level", level)
        .withColumn("level", F.min(open_).over(every)["level"])
        .select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def thresholds(sized: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """source, source_size, target, whole (copies of every document) and cut: hashes below it give one more."""
    spark = sized.sparkSession
    goals = keep(
        targets(sized, plan)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-targets",
    )
    bound = goals.filter("rest > 0").select(F.col("source").alias("of"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))
    shift = HASH_BITS
    for bits in plan.levels:
        above, shift = shift, shift - bits
        part = sized.join(bound, F.col("of").eqNullSafe(F.col("source")) & (F.shiftright("mix_hash", above) == F.col("prefix")))
        sums = part.groupBy("source", "rest", "base", F.shiftright("mix_hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = sums.withColumn("after", F.col("base") + F.sum("words").over(W.partitionBy("source").orderBy("bucket")))
        hit = run.filter("after > rest").groupBy("source", "rest").agg(F.min(F.struct("bucket", "after", "words")).alias("b"))
        bound = keep(hit.select(F.col("source").alias("of"), "rest", F.col("b.bucket").alias("prefix"), (F.col("b.after") - F.col("b.words")).alias("base"), F.col("b.after").alias("after")), "mix-bound")
    cut = F.col("prefix") + F.when(F.col("after") - F.col("rest") < F.col("rest") - F.col("base"), 1).otherwise(0)
    cuts = bound.select("of", cut.alias("cut"))
    goals = goals.join(cuts, F.col("of").eqNullSafe(F.col("source")), "left")
    return keep(goals.select(F.col("source").alias("of"), "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut")), "mix-cuts")


def take(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds source_size, target, taken (words) and copies. `cuts` has one row a source; Spark broadcasts it while small."""
    extra = sized.drop("source_size", "target", "taken", "copies").join(cuts, F.col("of").eqNullSafe(F.col("source")), "left")
    copies = F.col("whole") + F.when(F.col("mix_hash") < F.col("cut"), 1).otherwise(0)
    return extra.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("of", "whole", "cut")


def mix(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """The mix itself: the input's columns, each document as often as it is taken."""
    whole = measured(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")).drop("doc_id", "text")
    cuts = thresholds(keep(measured(docs.select("doc_id", "text", "source")).drop("doc_id", "text"), "mix-sizes"), plan)
    copies = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return take(whole, cuts).filter("copies > 0").select("row", F.explode(copies)).select("row.*")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sized = keep(measured(docs).drop("text"), "mix-sizes")
    return take(sized, thresholds(sized)).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS k FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev
  FROM o
), lam AS (SELECT lev AS height FROM l WHERE lev * weight <= cap ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT height FROM lam) * weight, cap)) AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), q AS (SELECT *, target - whole * source_size AS rest FROM r
), g AS (
  SELECT source, h, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source, h
), c AS (
  SELECT g.source, h, words, CAST(sum(words) OVER (PARTITION BY g.source ORDER BY h) AS BIGINT) AS aft FROM g
), x AS (
  SELECT c.source, h,
         CASE WHEN aft <= rest THEN 1 WHEN aft - words <= rest AND aft - rest < rest - (aft - words) THEN 1 ELSE 0 END AS extra
  FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source WHERE rest > 0
)
SELECT d.doc_id, d.size, q.source_size, q.target, CAST((q.whole + coalesce(x.extra, 0)) * d.size AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
"""
