"""Daily report: the last complete day against the days before it."""

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from shopfloor.functions import labels as L
from shopfloor.functions.dates import DateLike, as_date, prune
from shopfloor.functions.numeric import WIDE, change, dbl, money_sum, ratio, sum_if, total
from shopfloor.operators.dimensions import named_sums

RECENT_DATES = 21
TREND_DATES = 14
ISSUE_BELOW = -5.0


def recent_dates(sales: DataFrame, as_of: DateLike, n: int = RECENT_DATES) -> DataFrame:
    """Sale dates before `as_of`, newest first."""
    d = F.col("sales_date").cast("date")
    return prune(sales, None, as_of).filter(F.col("sales_date") < as_date(as_of)).select(d.alias("d")).distinct().orderBy(F.desc("d")).limit(n)


class ReportDays:
    """d0 (newest complete day) to d3, null where there are fewer, and the start of the trend. The
    at most 21 dates are fetched once; as literals they reach the scans of every section."""

    def __init__(self, sales: DataFrame, as_of: DateLike):
        found = [r["d"] for r in recent_dates(sales, as_of).collect()]
        self.days = [as_date(d) for d in [*found[:4], None, None, None, None][:4]]
        # the 14th date back, or the oldest one when there are fewer
        self.trend_from = as_date(found[: TREND_DATES][-1] if found else None)

    def __getitem__(self, i: int) -> Column:
        return self.days[i]


def _on(day: Column) -> Column:
    return F.col("sales_date") == day


def _span(sales: DataFrame, days: ReportDays, back: int) -> DataFrame:
    """Rows of the months between d<back> (or the oldest day there is) and d0."""
    return prune(sales, F.coalesce(*[days[i] for i in range(back, -1, -1)]), days[0])


def day_totals(sales: DataFrame, days: ReportDays) -> DataFrame:
    """Totals of d0 and the change against d1."""
    now, before = _on(days[0]), _on(days[1])
    cells = _span(sales, days, 1).filter(now | before).groupBy("goods_no", "store_name").agg(
        F.max(now).alias("_now"),
        *[sum_if(now, c).alias(c) for c in ("gmv", "qty", "foreign_gmv")],
        sum_if(before, "gmv").alias("gmv_prev"),
    )
    seen = F.col("_now")
    out = cells.agg(
        *[money_sum(c).alias(c) for c in ("gmv", "foreign_gmv", "gmv_prev")],
        total("qty").cast("bigint").alias("qty"),
        F.countDistinct(F.when(seen, F.col("goods_no"))).alias("goods"),
        F.countDistinct(F.when(seen, F.col("store_name"))).alias("stores"),
    )
    out = out.withColumn("gmv_delta", change("gmv", "gmv_prev")).withColumn("foreign_ratio", ratio("foreign_gmv", "gmv"))
    issue = F.coalesce(F.col("gmv_delta") < ISSUE_BELOW, F.lit(False))
    return out.select(days[0].alias("latest"), days[1].alias("prev"), "*", issue.alias("issue"))


def recent_trend(sales: DataFrame, days: ReportDays) -> DataFrame:
    """Amount and units by day from the 14th date back; the last four dates carry their label."""
    by = prune(sales, days.trend_from).filter(F.col("sales_date") >= days.trend_from).groupBy(F.col("sales_date").cast("date").alias("d")).agg(
        money_sum("gmv").alias("gmv"), total("qty").cast("bigint").alias("qty")
    )
    label = F.lit(None).cast("string")
    for i, name in enumerate(L.DAY_LABELS):
        label = F.when(F.col("d") == days[i], F.lit(name)).otherwise(label)
    return by.withColumn("label", label)


RANK_TEXTS = {"store_name": {"shop_type": "shop_type"}, "brand_nm": {}, "goods_no": {"goods_nm": "name", "brand_nm": "brand"}}


def rank_by(sales: DataFrame, days: ReportDays, key: str, n: int | None = None) -> DataFrame:
    """Largest members of d0 with their share of the day; the first row leads."""
    today = _span(sales, days, 0).filter(_on(days[0]))
    whole = today.agg(money_sum("gmv").alias("g")).scalar()
    out = named_sums(today, [key], RANK_TEXTS[key], {"gmv": money_sum("gmv"), "qty": total("qty").cast("bigint")})
    out = out.withColumn("share", ratio("gmv", whole)).orderBy(F.desc("gmv"), key)
    return out if n is None else out.limit(n)


def rank_in_category(sales: DataFrame, days: ReportDays, entity: str, cats: int = 10, n: int = 5) -> DataFrame:
    """Top n brands or goods in each of the top medium categories of d0.

    The ranking window runs over sums, and its `<= n` filter lets Spark keep n rows per category
    in every task before the shuffle, so a category with a third of all goods stays small."""
    d0 = days[0]
    d1 = F.coalesce(days[1], d0)
    now, before = _on(d0), _on(d1)
    sums = {"gmv": sum_if(now, "gmv").cast(WIDE), "gmv_prev": sum_if(before, "gmv").cast(WIDE)}
    g = named_sums(_span(sales, days, 1).filter(now | before), ["cat_medium", entity], RANK_TEXTS[entity], sums)
    g = g.filter(F.col("gmv") > 0)
    top = g.groupBy("cat_medium").agg(money_sum("gmv").alias("cat_total")).orderBy(F.desc("cat_total"), "cat_medium").limit(cats)
    rank = F.row_number().over(W.partitionBy("cat_medium").orderBy(F.desc("gmv"), entity))
    best = g.withColumn("pos", rank).filter(F.col("pos") <= n)
    out = best.join(top, "cat_medium")
    return out.withColumn("share", ratio("gmv", "cat_total")).withColumn("delta", change("gmv", "gmv_prev")).drop("gmv_prev")


def notable_goods(sales: DataFrame, stock_goods: DataFrame, days: ReportDays, n: int = 5) -> DataFrame:
    """Best sellers, biggest rises and biggest falls, one tag per goods in that order of
    precedence, with the units of four days and the stock."""
    seen = _on(days[0]) | _on(days[1]) | _on(days[2]) | _on(days[3])
    units = {f"q{i}": sum_if(_on(days[i]), "qty").cast("bigint") for i in range(4)}
    g = named_sums(_span(sales, days, 3).filter(seen), ["goods_no"], RANK_TEXTS["goods_no"], units)
    growth = (dbl("q0") - dbl("q1")) / F.nullif(dbl("q1"), F.lit(0.0)) * F.lit(100.0)
    moved = g.filter(F.col("q1") >= 2).select("goods_no", growth.alias("tag_pct"))
    none = F.lit(None).cast("double")
    pick = lambda df, order, tag, pos, pct: df.orderBy(order, "goods_no").limit(n).select(
        "goods_no", F.struct(F.lit(pos).alias("pos"), F.lit(tag).alias("tag"), pct.alias("tag_pct")).alias("t")
    )
    picks = (
        pick(g, F.desc("q0"), L.BEST_SELLER, 0, none)
        .unionByName(pick(moved, F.desc("tag_pct"), L.RISING, 1, F.col("tag_pct")))
        .unionByName(pick(moved, F.asc("tag_pct"), L.FALLING, 2, F.col("tag_pct")))
    )
    tags = picks.groupBy("goods_no").agg(F.min("t").alias("t")).select("goods_no", "t.pos", "t.tag", "t.tag_pct")
    out = g.join(tags, "goods_no").join(stock_goods.select("goods_no", "store_stock", *_HUB_COLS), "goods_no", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("store_stock", *_HUB_COLS)})


_HUB_COLS = ("hub1000", "hub1700", "mfs")


def restock(sales: DataFrame, stock_store: DataFrame, stock_goods: DataFrame, days: ReportDays) -> DataFrame:
    """Goods sold on d0 that the hub has and the store holds less than twice the day's units of."""
    today = _span(sales, days, 0).filter(_on(days[0]))
    texts = {"goods_nm": "goods_nm", "brand_nm": "brand_nm"}
    sold = named_sums(today, ["store_name", "goods_no"], texts, {"sold": total("qty").cast("bigint")})
    hub = stock_goods.filter(F.col("hub_total") > 0).select("goods_no", "hub_total")
    out = sold.filter(F.col("sold") > 0).join(hub, "goods_no")
    out = out.join(stock_store.select("store_name", "goods_no", F.col("stock").alias("store_stock")), ["store_name", "goods_no"], "left")
    out = out.withColumn("store_stock", F.coalesce("store_stock", F.lit(0)).cast("bigint"))
    out = out.filter(F.col("store_stock") < F.col("sold") * 2)
    return out.withColumn("urgent", F.col("store_stock") <= 0)


def urgent_restock(rows: DataFrame) -> DataFrame:
    """How many rows are out of stock, and the first of them in restock order."""
    first = F.min_by(F.struct("store_name", "goods_no", "brand_nm", "goods_nm", "sold"), F.struct(
        "store_stock", (-F.col("sold")).alias("s"), "store_name", "goods_no"
    ))
    out = rows.agg(
        F.count(F.lit(1)).alias("restock_count"),
        F.count(F.when(F.col("urgent"), 1)).alias("urgent_count"),
        first.alias("f"),
    )
    hit = F.col("urgent_count") > 0
    return out.select(
        "restock_count", "urgent_count",
        *[F.when(hit, F.col(f"f.{c}")).alias(c) for c in ("store_name", "brand_nm", "goods_nm", "sold")],
    )


def store_spikes(sales: DataFrame, days: ReportDays, minimum: int = 3) -> DataFrame:
    """Largest rise and largest fall of a store's units from d1 to d0."""
    g = _span(sales, days, 1).filter(_on(days[0]) | _on(days[1])).groupBy("store_name").agg(
        sum_if(_on(days[0]), "qty").cast("bigint").alias("q0"), sum_if(_on(days[1]), "qty").cast("bigint").alias("q1")
    )
    g = g.filter(F.col("q1") >= minimum).withColumn("pct", (dbl("q0") - dbl("q1")) / dbl("q1") * F.lit(100.0))
    pick = lambda tag, order: g.orderBy(order, "store_name").limit(1).select(F.lit(tag).alias("direction"), "store_name", "q0", "q1", "pct")
    return pick("up", F.desc("pct")).unionByName(pick("down", F.asc("pct")))
