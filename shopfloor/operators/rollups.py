"""Day-level rollups of the sales dataset, and the choice of the smallest one that covers a request.

A rollup holds the sums of every measure by day and some dimensions under the names of the sales dataset, so
a report that only needs these columns reads it in place of the sales and gives the same result: sums of exact
decimals don't depend on the grouping. Distinct goods of any range come from exact bitmaps by day, which merge by OR.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from shopfloor.functions.dates import MONTH
from shopfloor.functions.numeric import stored_sum
from shopfloor.operators.filters import IN_COLUMNS, NO_FILTER, SALES, SalesFilter, apply_sales_filter
from shopfloor.operators.sales import MEASURES, measure_sums, with_rates

DAY = "sales_date"


@dataclass(frozen=True)
class Rollup:
    name: str
    keys: tuple[str, ...]

    def build(self, sales: DataFrame) -> DataFrame:
        sums = [F.sum("qty").cast("bigint").alias("qty"), *(stored_sum(c).alias(c) for c in MEASURES if c != "qty")]
        return sales.groupBy(F.col(DAY).cast("date").alias(DAY), *self.keys).agg(*sums)


#: From the smallest to the largest.
ROLLUPS = (
    Rollup("sales_day", ()),
    Rollup("sales_day_store", ("store_name", "shop_type", "business_type")),
    Rollup("sales_day_brand", ("brand_nm", "business_type", "cat_top", "cat_large", "cat_medium")),
    Rollup("sales_day_store_brand", ("store_name", "shop_type", "business_type", "brand_nm", "cat_top", "cat_large", "cat_medium")),
)
GOODS = "goods_day"


def goods_bitmaps(sales: DataFrame) -> DataFrame:
    """The goods of each day as bitmaps: one row for each range of goods numbers that has any. Distinct pairs first, so a
    task adds a goods once."""
    pairs = sales.select(F.col(DAY).cast("date").alias(DAY), F.bitmap_bucket_number("goods_no").alias("bucket"), F.bitmap_bit_position("goods_no").alias("bit")).distinct()
    return pairs.filter("bucket is not null").groupBy(DAY, "bucket").agg(F.bitmap_construct_agg("bit").alias("goods"))


def distinct_goods(bitmaps: DataFrame, f: SalesFilter = NO_FILTER) -> DataFrame:
    """goods_count: number of different goods on the days of the filter."""
    merged = apply_sales_filter(bitmaps, f).groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("goods")).alias("n"))
    return merged.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("goods_count"))


def needed(f: SalesFilter, columns: tuple[str, ...] = ()) -> set[str]:
    """Dimensions that a filter and a report look at, the day apart."""
    out = {IN_COLUMNS[n] for n in SALES if getattr(f, n)} | set(columns)
    if f.goods:
        out.add("goods_no")
    if f.name_like and f.name_like.strip():
        out.add("goods_nm")
    return out - {DAY, MONTH, *MEASURES}


def covering(f: SalesFilter, columns: tuple[str, ...] = ()) -> str | None:
    """The smallest rollup that has these dimensions; None if only the sales do."""
    want = needed(f, columns)
    return next((r.name for r in ROLLUPS if want <= set(r.keys)), None)


def summary(day_store: DataFrame, bitmaps: DataFrame, f: SalesFilter = NO_FILTER) -> DataFrame:
    """As the KPI row over the sales, for a filter of days alone."""
    if needed(f):
        raise ValueError("bitmaps of goods are kept by day only")
    stores = apply_sales_filter(day_store, f).groupBy("store_name").agg(*measure_sums())
    totals = stores.agg(*measure_sums(), F.count("store_name").alias("store_count"))
    return with_rates(totals.withColumn("goods_count", distinct_goods(bitmaps, f).scalar()))
