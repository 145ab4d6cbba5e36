"""Profit from the settlement, joined to sales."""

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from shopfloor.functions.dates import DateLike, as_date, month_start, newest, prune, within
from shopfloor.functions.numeric import WIDE, change, dbl, money_sum, ratio, sum_if, total
from shopfloor.operators.facts import Aside, as_planned
from shopfloor.operators.filters import NO_FILTER, SalesFilter, apply_sales_filter, apply_settlement_filter

TAKE_RATE_DAYS = 45
VAT = 1.1


def _per_day(sales: DataFrame, settlement: DataFrame) -> DataFrame:
    """(day, goods) amounts beside settled profit; both sides are summed before they meet, so a
    hot goods joins as one row per day."""
    s = sales.groupBy("sales_date", "goods_no").agg(F.sum("gmv").alias("gmv"))
    t = settlement.groupBy("sales_date", "goods_no").agg(F.sum("net_take").alias("net_take"), F.sum("cp").alias("cp"))
    return s.join(t, ["sales_date", "goods_no"], "left")


def take_rate(
    sales: DataFrame, settlement: DataFrame, goods_scope: DataFrame, as_of: DateLike, days: int = TAKE_RATE_DAYS
) -> DataFrame:
    """Per goods over the last `days` days, all stores: profit / amount on settled days, the number
    of settled days, and beside them the rate over all goods."""
    start = F.date_sub(as_date(as_of), days)
    recent = prune(sales, start).filter(F.col("sales_date") >= start).join(goods_scope.select("goods_no").distinct(), "goods_no", "left_semi")
    rows = _per_day(recent, prune(settlement, start).filter(F.col("sales_date") >= start))
    settled = F.col("net_take").isNotNull()
    by = rows.groupBy("goods_no").agg(
        F.sum("net_take").alias("profit"),
        F.sum(F.when(settled, F.col("gmv"))).alias("base"),
        F.count("net_take").alias("settled_days"),
    )
    overall = by.agg(ratio(F.sum("profit"), F.sum("base"), None, None).alias("r")).scalar()
    return by.select(
        "goods_no", ratio("profit", "base", None, None).alias("rate"), "settled_days", overall.alias("overall_rate")
    )


def _covered(sales: DataFrame, settlement: DataFrame, f: SalesFilter, as_of: DateLike) -> DataFrame:
    """(day, goods) rows of the filter with the profit to report: the settled one, else the take
    rate times the amount. Goods without any settled day stay null; contribution is never estimated."""
    rows = apply_sales_filter(sales, f)
    out = _per_day(rows, apply_settlement_filter(settlement, f))
    out = out.join(take_rate(sales, settlement, rows, as_of), "goods_no", "left")
    known = F.col("settled_days") > 0
    estimate = F.coalesce("rate", "overall_rate") * dbl("gmv")
    return out.select(
        "goods_no",
        F.when(known, F.coalesce(dbl("net_take"), estimate)).cast("decimal(24,6)").alias("net_take"),
        F.when(known, F.col("cp")).alias("cp"),
    )


def profit_by_goods(sales: DataFrame, settlement: DataFrame, f: SalesFilter, as_of: DateLike) -> DataFrame:
    return _covered(sales, settlement, f, as_of).groupBy("goods_no").agg(
        F.sum("net_take").cast(WIDE).alias("net_take"), F.sum("cp").cast(WIDE).alias("cp")
    )


def profit_totals(sales: DataFrame, settlement: DataFrame, f: SalesFilter, as_of: DateLike) -> DataFrame:
    """Totals and the contribution margin on the amount without VAT."""
    t = profit_by_goods_sums(sales, settlement, f, as_of)
    gmv = apply_sales_filter(sales, f).agg(money_sum("gmv").alias("g")).scalar()
    t = t.withColumn("gmv", gmv)
    return t.withColumn("cp_rate", contribution_rate("cp", "gmv"))


def profit_by_goods_sums(sales: DataFrame, settlement: DataFrame, f: SalesFilter, as_of: DateLike) -> DataFrame:
    return _covered(sales, settlement, f, as_of).agg(money_sum("net_take").alias("net_take"), money_sum("cp").alias("cp"))


def contribution_rate(cp: str, gmv: str) -> Column:
    return F.when(dbl(gmv) != 0, dbl(cp) / (dbl(gmv) / F.lit(VAT)) * F.lit(100.0)).otherwise(F.lit(0.0))


def goods_owner(sales: DataFrame) -> DataFrame:
    """goods -> one (business, brand), so profit is counted once."""
    return sales.groupBy("goods_no").agg(F.min(F.struct("business_type", "brand_nm")).alias("o")).select("goods_no", "o.*")


def profit_by_brand(sales: DataFrame, settlement: DataFrame, f: SalesFilter, as_of: DateLike) -> DataFrame:
    owner = goods_owner(apply_sales_filter(sales, f))
    rows = _covered(sales, settlement, f, as_of).groupBy("goods_no").agg(F.sum("net_take").alias("net_take"), F.sum("cp").alias("cp"))
    return rows.join(owner, "goods_no").groupBy("business_type", "brand_nm").agg(
        F.sum("net_take").cast(WIDE).alias("net_take"), F.sum("cp").cast(WIDE).alias("cp")
    )


def covered_profit_rate(df: DataFrame) -> DataFrame:
    """Profit / amount over the rows whose profit is known."""
    known = F.col("net_take").isNotNull()
    return df.agg(money_sum("net_take").alias("net_take"), sum_if(known, "gmv").cast(WIDE).alias("gmv")).withColumn(
        "net_take_rate", ratio("net_take", "gmv")
    )


def allocate_profit(
    sales_option: DataFrame, settlement_option: DataFrame, stock_store: DataFrame, f: SalesFilter = NO_FILTER,
    aside: Aside = as_planned,
) -> DataFrame:
    """Settled profit of a (day, store, goods) shared over its options by amount; null where nothing
    is settled or the share is undefined.

    The rows are dealt once by (day, store, goods), which spreads a hot goods over days and stores; the sums by
    option and by goods and the join with the settlement then find their rows in place. `aside` takes the shared rows
    before they are dealt again for the stock."""
    keys = ["sales_date", "store_name", "goods_no"]
    option = [*keys, "business_type", "brand_nm", "cat_top", "cat_large", "cat_medium", "option_nm"]
    sums = [total("qty").cast("bigint").alias("qty"), *[money_sum(c).alias(c) for c in ("gmv", "normal_amt", "pay")]]
    named = apply_sales_filter(sales_option, f).repartition(*keys).groupBy(*option, "goods_nm").agg(*sums)
    so = named.groupBy(*option).agg(F.min("goods_nm").alias("goods_nm"), *sums)
    # rows without a day, store or goods have no goods sum to share in
    so = so.dropna(subset=keys).filter((F.col("qty") != 0) | (F.col("gmv") != 0))
    so = so.withColumn("_goods_gmv", F.sum("gmv").over(W.partitionBy(*keys)))
    settled = apply_settlement_filter(settlement_option, f).groupBy(*keys).agg(F.sum("net_take").alias("_nt"), F.sum("cp").alias("_cp"))
    # merged: both sides grow with the goods, and their files are far smaller than the tables Spark would send to all
    out = so.join(settled.hint("merge"), keys, "left")
    share = dbl("gmv") / F.nullif(dbl("_goods_gmv"), F.lit(0.0))
    out = out.withColumn("net_take", dbl("_nt") * share).withColumn("cp", dbl("_cp") * share)
    out = aside(out.drop("_goods_gmv", "_nt", "_cp")).join(stock_store.hint("merge"), ["goods_no", "store_name"], "left")
    return out.withColumn("stock", F.coalesce("stock", F.lit(0)).cast("bigint"))


# ---------------------------------------------------------------- profit and loss


def year_ago(d: Column) -> Column:
    """Same date a year earlier; 29 February has none and moves back 365 days."""
    leap = (F.month(d) == 2) & (F.day(d) == 29)
    return F.when(leap, F.date_sub(d, 365)).otherwise(F.add_months(d, -12))


def pnl_ranges(daily: DataFrame, mode: str, period: DateLike | None = None, date_to: DateLike | None = None) -> list[tuple[Column, Column]]:
    """Current, previous and last year's range of one view; the newest date when no period is given."""
    if period is None or (mode == "range" and date_to is None):
        last = newest(daily, "sales_date")
    if mode == "day":
        d = last if period is None else as_date(period)
        return [(d, d), (F.date_sub(d, 1), F.date_sub(d, 1)), (year_ago(d), year_ago(d))]
    if mode == "range":
        x = month_start(last) if period is None else as_date(period)
        y = last if date_to is None else as_date(date_to)
        a, b = F.least(x, y), F.greatest(x, y)
        return [(a, b), (F.date_sub(a, F.datediff(b, a) + 1), F.date_sub(a, 1)), (year_ago(a), year_ago(b))]
    m = month_start(last if period is None else period)
    whole = lambda s: (s, F.last_day(s))
    return [whole(m), whole(F.add_months(m, -1)), whole(F.add_months(m, -12))]


PNL_LEVELS = {"store": "store_name", "brand": "brand_nm"}


def _pnl_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "cp_rate": contribution_rate("cp", "gmv"),
        "nt_rate": ratio("net_take", "gmv"),
        "pm_delta": change("cp", "pm_cp", absolute=True),
        "py_delta": change("cp", "py_cp", absolute=True),
    })


def pnl(
    daily: DataFrame, mode: str = "month", period: DateLike | None = None, level: str = "store", date_to: DateLike | None = None,
    types=(), stores=(), brands=(),
) -> DataFrame:
    """Profit and loss by store or brand: one scan, conditional sums for the three ranges."""
    ranges = pnl_ranges(daily, mode, period, date_to)
    cur, prev, last = [within("sales_date", a, b) for a, b in ranges]
    starts, ends = zip(*ranges)
    rows = prune(daily, F.least(*starts), F.greatest(*ends)).filter(cur | prev | last)
    for col, vals in (("shop_type", types), ("store_name", stores), ("brand_nm", brands)):
        if vals:
            rows = rows.filter(F.col(col).isin(list(vals)))
    m = lambda c, name: sum_if(c, name).cast(WIDE)
    out = rows.groupBy(F.col(PNL_LEVELS[level]).alias("name")).agg(
        F.count(F.when(cur, 1)).alias("_n"),
        F.min(F.when(cur, F.col("shop_type"))).alias("shop_type"),
        *[m(cur, c).alias(c) for c in ("gmv", "net_take", "cp", "offline_cost", "normal_amt")],
        sum_if(cur, "qty").cast("bigint").alias("qty"),
        m(prev, "cp").alias("pm_cp"),
        m(last, "cp").alias("py_cp"),
    )
    return _pnl_rates(out.filter(F.col("_n") > 0).drop("_n"))


def pnl_totals(rows: DataFrame) -> DataFrame:
    cols = ("gmv", "net_take", "cp", "offline_cost", "normal_amt", "pm_cp", "py_cp")
    return _pnl_rates(rows.agg(*[money_sum(c).alias(c) for c in cols], total("qty").cast("bigint").alias("qty")))


def pnl_months(daily: DataFrame) -> DataFrame:
    """All months from the first to the last day of the dataset, gaps included."""
    span = daily.agg(F.min("sales_date").cast("date").alias("a"), F.max("sales_date").cast("date").alias("b"))
    months = F.sequence(month_start(F.col("a")), month_start(F.col("b")), F.expr("interval 1 month"))
    return span.select(F.explode(months).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))


def pnl_provisional(daily: DataFrame, mode: str = "month", period: DateLike | None = None, date_to: DateLike | None = None) -> DataFrame:
    """Costs of about two months are forecasts: is the range one of them?"""
    end = pnl_ranges(daily, mode, period, date_to)[0][1]
    top = daily.agg(F.max("sales_date").cast("date").alias("max_date"))
    return top.select("max_date", end.alias("range_end"), (end >= F.date_sub(month_start(F.col("max_date")), 62)).alias("provisional"))
