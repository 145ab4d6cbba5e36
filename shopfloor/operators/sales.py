"""Sales reports over the sales, receipts, visitor and customer datasets."""

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from shopfloor.functions import labels as L
from shopfloor.functions.dates import DateLike, as_date, bucket, prune, within
from shopfloor.functions.numeric import WIDE, change, dbl, discount_rate, money_sum, ratio, sum_if, total
from shopfloor.operators.dimensions import CATEGORIES
from shopfloor.operators.filters import (
    NO_FILTER, SalesFilter, apply_receipt_filter, apply_sales_filter, apply_settlement_filter, drill_stock_filter,
)

MEASURES = ("qty", "gmv", "normal_amt", "pay", "foreign_gmv")


def measure_sums(names=MEASURES) -> list[Column]:
    return [total("qty").cast("bigint").alias("qty") if n == "qty" else money_sum(n).alias(n) for n in names]


def with_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({"discount_rate": discount_rate("gmv", "normal_amt"), "foreign_ratio": ratio("foreign_gmv", "gmv")})


def sums_with_name(rows: DataFrame, keys: list[str], measures=MEASURES) -> DataFrame:
    """Sums per key with one goods name each. A text minimum would turn the whole aggregation into
    a sort of all rows; with the name as a key the rows are hashed, and the minimum is taken over
    the few groups left."""
    level = rows.groupBy(*keys, "goods_nm").agg(*measure_sums(measures))
    return level.groupBy(*keys).agg(F.min("goods_nm").alias("goods_nm"), *measure_sums(measures))


def facets(sales: DataFrame) -> DataFrame:
    """Every list the filter bar offers, as (facet, member, parent, gmv); gmv only for brands.

    One scan: combinations of the dimensions are summed, then each counts once per facet."""
    dims = ["store_name", "shop_type", "brand_nm", "business_type", *CATEGORIES, "off_md_id"]
    combos = sales.groupBy(*dims).agg(
        F.sum("gmv").alias("gmv"), F.min("sales_date").alias("lo"), F.max("sales_date").alias("hi")
    )
    entry = lambda facet, col, parent=None: F.struct(
        F.lit(facet).alias("facet"),
        F.col(col).alias("member"),
        (F.col(parent) if parent else F.lit(None).cast("string")).alias("parent"),
    )
    entries = [entry("store", "store_name", "shop_type"), entry("shop_type", "shop_type"), entry("brand", "brand_nm")]
    entries += [entry("business_type", "business_type"), *[entry(c, c) for c in CATEGORIES], entry("md", "off_md_id")]
    span = F.struct(F.lit("date").alias("facet"), F.lit("range").alias("member"), F.lit(None).cast("string").alias("parent"))
    rows = combos.select(F.explode(F.array(*entries, span)).alias("e"), "gmv", "lo", "hi")
    rows = rows.filter(F.col("e.member").isNotNull() & (F.col("e.member") != ""))
    out = rows.groupBy("e.facet", "e.member", "e.parent").agg(
        money_sum("gmv").alias("gmv"), F.min("lo").alias("date_min"), F.max("hi").alias("date_max")
    )
    only = lambda facet, c: F.when(F.col("facet") == facet, F.col(c)).alias(c)
    return out.select("facet", "member", "parent", only("brand", "gmv"), only("date", "date_min"), only("date", "date_max"))


def summary(sales: DataFrame, f: SalesFilter = NO_FILTER) -> DataFrame:
    """One row of KPIs from one scan: sums by goods and store first, then the totals and both distinct
    counts over those few rows."""
    pairs = apply_sales_filter(sales, f).groupBy("goods_no", "store_name").agg(*measure_sums())
    counts = [F.countDistinct(c).alias(n) for c, n in (("goods_no", "goods_count"), ("store_name", "store_count"))]
    return with_rates(pairs.agg(*measure_sums(), *counts))


def _orders(receipts: DataFrame, *keys: str) -> DataFrame:
    """One row per order (and keys): a distinct count becomes a plain count."""
    return receipts.groupBy(*keys, "order_id").agg(
        F.sum("gmv").alias("gmv"),
        sum_if(F.col("is_foreign") == 1, "gmv").alias("foreign_gmv"),
        F.max("is_foreign").alias("is_foreign"),
    )


def basket_value(receipts: DataFrame, f: SalesFilter = NO_FILTER) -> DataFrame:
    """Amount per distinct order: total, foreign, and domestic as the difference of the two."""
    t = _orders(apply_receipt_filter(receipts, f)).agg(
        F.count(F.lit(1)).alias("receipts"),
        money_sum("gmv").alias("gmv"),
        total(F.col("is_foreign").cast("bigint")).cast("bigint").alias("foreign_receipts"),
        money_sum("foreign_gmv").alias("foreign_gmv"),
    )
    t = t.withColumns({
        "domestic_receipts": F.col("receipts") - F.col("foreign_receipts"),
        "domestic_gmv": (F.col("gmv") - F.col("foreign_gmv")).cast(WIDE),
    })
    return t.withColumns({f"{p}aov": ratio(f"{p}gmv", f"{p}receipts", None) for p in ("", "foreign_", "domestic_")})


def hourly(receipts: DataFrame, f: SalesFilter = NO_FILTER, first: int = 0, last: int = 23) -> DataFrame:
    """Amount and orders per hour of the day, or of the hours asked for; hours without sales are 0."""
    rows = apply_receipt_filter(receipts, f).filter(F.col("hour").between(first, last))
    by = _orders(rows, "hour").groupBy("hour").agg(
        money_sum("gmv").alias("gmv"), money_sum("foreign_gmv").alias("foreign_gmv"), F.count(F.lit(1)).alias("receipts")
    )
    spine = receipts.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("hour"))
    zero = F.lit(0)
    return spine.join(by, "hour", "left").select(
        "hour",
        F.coalesce("gmv", zero).cast(WIDE).alias("gmv"),
        F.coalesce("foreign_gmv", zero).cast(WIDE).alias("foreign_gmv"),
        F.coalesce("receipts", zero).cast("bigint").alias("receipts"),
    )


def trend(sales: DataFrame, f: SalesFilter = NO_FILTER, grain: str = "day") -> DataFrame:
    """Buckets that have sales; empty ones are absent."""
    return (
        apply_sales_filter(sales, f)
        .groupBy(bucket("sales_date", grain).alias("bucket"))
        .agg(*measure_sums(("gmv", "qty", "foreign_gmv")))
    )


def trend_by_business(sales: DataFrame, f: SalesFilter = NO_FILTER, grain: str = "day", wide: bool = True) -> DataFrame:
    key = bucket("sales_date", grain).alias("bucket")
    rows = apply_sales_filter(sales, f)
    if not wide:
        return rows.groupBy(key, "business_type").agg(money_sum("gmv").alias("gmv"))
    return rows.groupBy(key).agg(
        *[sum_if(F.col("business_type") == b, "gmv").cast(WIDE).alias(b) for b in L.BUSINESS_TYPES]
    )


def previous_range(date_from: DateLike, date_to: DateLike) -> tuple[Column, Column]:
    """The range of the same length right before."""
    a, b = as_date(date_from), as_date(date_to)
    return F.date_sub(a, F.datediff(b, a) + 1), F.date_sub(a, 1)


def trend_overlay(sales: DataFrame, f: SalesFilter, grain: str = "day") -> DataFrame:
    """Each bucket beside the bucket at the same position in the previous range. Both ranges come
    from one scan; positions are numbered over calendar buckets, of which there are few."""
    prev_from, prev_to = previous_range(f.date_from, f.date_to)
    rows = apply_sales_filter(sales, f.without("date_from", "date_to"))
    rows = prune(rows, prev_from, f.date_to).filter(within("sales_date", prev_from, f.date_to))
    current = F.col("sales_date") >= as_date(f.date_from)
    by = rows.groupBy(current.alias("is_current"), bucket("sales_date", grain).alias("bucket")).agg(money_sum("gmv").alias("gmv"))
    by = by.withColumn("pos", F.row_number().over(W.partitionBy("is_current").orderBy("bucket")))
    out = by.groupBy("pos").agg(
        F.max(F.when(F.col("is_current"), F.col("bucket"))).alias("bucket"),
        F.max(F.when(F.col("is_current"), F.col("gmv"))).alias("gmv"),
        F.max(F.when(~F.col("is_current"), F.col("gmv"))).alias("prev_gmv"),
    )
    return out.filter(F.col("bucket").isNotNull())


DIMENSIONS = {
    "store": "store_name", "brand": "brand_nm", "business": "business_type", "cat_top": "cat_top",
    "cat_large": "cat_large", "cat_medium": "cat_medium",
}


def by_dimension(sales: DataFrame, f: SalesFilter = NO_FILTER, dim: str = "store", limit: int | None = None) -> DataFrame:
    """Members of a dimension, with the grand total of all members and the share in it. The rows are
    summed once, by member and goods; the total is a sum over the few members."""
    goods = apply_sales_filter(sales, f).groupBy(F.col(DIMENSIONS[dim]).alias("name"), "goods_no").agg(*measure_sums(("gmv", "qty", "foreign_gmv")))
    out = goods.groupBy("name").agg(*measure_sums(("gmv", "qty", "foreign_gmv")), F.count("goods_no").alias("goods_count"))
    out = out.withColumn("grand_total", F.sum("gmv").over(W.partitionBy()).cast(WIDE)).withColumn("share", ratio("gmv", "grand_total"))
    return out if limit is None else out.orderBy(F.desc("gmv"), "name").limit(limit)


def segment_split(sales: DataFrame, dim: str, topn: int | None = None) -> DataFrame:
    """Domestic and foreign part of each group, clipped at 0, long form."""
    g = sales.groupBy(F.col(dim).alias("name")).agg(*measure_sums(("gmv", "foreign_gmv")))
    if topn:
        g = g.orderBy(F.desc("gmv"), "name").limit(topn)
    zero = F.lit(0).cast(WIDE)
    g = g.select(
        "name", "gmv",
        F.greatest(zero, (F.col("gmv") - F.col("foreign_gmv")).cast(WIDE)).alias(L.DOMESTIC),
        F.greatest(zero, F.col("foreign_gmv")).alias(L.FOREIGN),
    )
    long = g.unpivot(["name", "gmv"], [L.DOMESTIC, L.FOREIGN], "segment", "value")
    return long.withColumn("ratio", ratio("value", "gmv"))


def top_plus_other(df: DataFrame, key: str, value: str, n: int, other: str = L.OTHER, counted: bool = False) -> DataFrame:
    """The first n positive groups plus one row for the rest. Only the n winners are ordered
    globally; the rest is the positive groups minus them. `counted` puts the number of merged
    groups into the label."""
    g = df.groupBy(F.col(key).alias("name")).agg(F.sum(value).alias("value")).filter(F.col("value") > 0)
    top = g.orderBy(F.desc("value"), "name").limit(n)
    rest = g.join(top.select("name"), g["name"].eqNullSafe(top["name"]), "left_anti")
    rest = rest.agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("k")).filter(F.col("value") > 0)
    label = F.format_string(f"{other} %d종", "k") if counted else F.lit(other)
    return top.unionByName(rest.select(label.alias("name"), F.col("value").cast(top.schema["value"].dataType).alias("value")))


def concept_share(sales: DataFrame) -> DataFrame:
    g = sales.groupBy("concept").agg(money_sum("gmv").alias("gmv")).filter(F.col("gmv") > 0)
    whole = g.agg(money_sum("gmv").alias("t")).scalar()
    return g.withColumn("share", ratio("gmv", whole))


LEVELS = {"shop": "store_name", "brand": "brand_nm", "cat_large": "cat_large", "cat_medium": "cat_medium", "goods": "goods_no"}
LEVEL_FILTERS = {"shop": "store", "brand": "brand", "cat_large": "cat_large", "cat_medium": "cat_medium", "goods": "goods"}


def drill(
    sales: DataFrame, stock_store: DataFrame, attributes: DataFrame, level: str, f: SalesFilter = NO_FILTER, limit: int | None = None
) -> DataFrame:
    """One level of store > brand > large category > medium category > goods, with stock.

    Stock reaches a brand or category through one row per goods, so it is never repeated."""
    col = LEVELS[level]
    key = F.col(col).cast("string").alias("key")
    rows, measures = apply_sales_filter(sales, f), ("qty", "gmv", "normal_amt", "foreign_gmv")
    if level == "goods":
        out = sums_with_name(rows, ["goods_no"], measures)
        out = out.select(key, F.col("goods_nm").alias("name"), *measures, F.lit(1).cast("bigint").alias("goods_count"))
    else:
        out = rows.groupBy(key).agg(*measure_sums(measures), F.countDistinct("goods_no").alias("goods_count"))
        out = out.withColumn("name", F.col("key"))
    stock = drill_stock_filter(stock_store, attributes, f).groupBy(key).agg(total("stock").cast("bigint").alias("stock"))
    out = with_rates(out.join(stock, "key", "left").withColumn("stock", F.coalesce("stock", F.lit(0)).cast("bigint")))
    return out if limit is None else out.orderBy(F.desc("gmv"), "key").limit(limit)


TOTAL_LEVEL = "total"


def _level_and_key(marks: dict[str, str]) -> tuple[Column, Column]:
    """Level and key of a row of grouping sets, by the column that only the sets of a level group by;
    a row of no level is the total."""
    level, key = F.lit(TOTAL_LEVEL), F.lit(L.TOTAL)
    for name, mark in marks.items():
        here = F.grouping(mark) == 0
        level = F.when(here, F.lit(name)).otherwise(level)
        key = F.when(here, F.col(LEVELS[name]).cast("string")).otherwise(key)
    return level.alias("level"), key.alias("key")


def drill_levels(sales: DataFrame, stock_store: DataFrame, attributes: DataFrame, f: SalesFilter = NO_FILTER) -> DataFrame:
    """All levels of `drill` and one total row, as (level, key, ...); no row for an empty selection.

    One scan of the sales and one of the stock: rows are summed once by goods and all dimensions, and
    grouping sets unfold these sums to (level, key, goods), so that goods are counted without a distinct."""
    dims, measures = list(LEVELS.values()), ("qty", "gmv", "normal_amt", "foreign_gmv")
    cells = apply_sales_filter(sales, f).groupBy(*dims, "goods_nm").agg(*measure_sums(measures))
    sets = [*[[c, "goods_no"] for c in dims if c != "goods_no"], ["goods_no", "goods_nm"], ["goods_no"]]
    goods = cells.groupingSets(sets, *dims, "goods_nm").agg(*_level_and_key({**LEVELS, "goods": "goods_nm"}), *measure_sums(measures))
    out = goods.groupBy("level", "key").agg(F.min("goods_nm").alias("_nm"), F.count("goods_no").alias("_n"), *measure_sums(measures))
    single = F.col("level") == "goods"
    out = out.select(
        "level", "key", F.when(single, F.col("_nm")).otherwise(F.col("key")).alias("name"), *measures,
        F.when(single, F.lit(1)).otherwise(F.col("_n")).cast("bigint").alias("goods_count"),
    )
    held = drill_stock_filter(stock_store, attributes, f).groupingSets([*[[c] for c in dims], []], *dims)
    stock = held.agg(*_level_and_key(LEVELS), total("stock").cast("bigint").alias("stock")).select("level", "key", "stock")
    return with_rates(out.join(stock, ["level", "key"], "left").withColumn("stock", F.coalesce("stock", F.lit(0)).cast("bigint")))


def drill_context(level: str, f: SalesFilter) -> dict[str, str]:
    """Parent filters with a single value, as context columns of a drill export."""
    out = {}
    for name in ("store", "brand", "cat_large", "cat_medium"):
        vals = getattr(f, name)
        if len(vals) == 1 and name != LEVEL_FILTERS[level]:
            out[f"in_{name}"] = vals[0]
    return out


def brand_detail(sales: DataFrame, profit_brand: DataFrame, stock_brand: DataFrame, f: SalesFilter = NO_FILTER) -> DataFrame:
    """business x brand with units sold: sums, goods, rates, profit and stock per store (the wide
    frame of `stock_by`, whose store columns are kept as they are)."""
    out = apply_sales_filter(sales, f).groupBy("business_type", "brand_nm").agg(
        *measure_sums(), F.countDistinct("goods_no").alias("goods")
    )
    out = with_rates(out.filter(F.col("qty") > 0)).join(profit_brand, ["business_type", "brand_nm"], "left")
    out = out.join(stock_brand, "brand_nm", "left")
    stores = [c for c in stock_brand.columns if c != "brand_nm"]
    return out.select(*[c for c in out.columns if c not in stores], *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("bigint").alias(c) for c in stores])


def goods_detail(
    sales: DataFrame, stock_goods: DataFrame, profit_goods: DataFrame, f: SalesFilter = NO_FILTER, limit: int | None = None
) -> DataFrame:
    """Goods with units sold: sums, unit prices, rates, profit, store and hub stock."""
    keys = ["business_type", *CATEGORIES, "brand_nm", "goods_no"]
    out = sums_with_name(apply_sales_filter(sales, f), keys).filter(F.col("qty") > 0)
    if limit is not None:
        out = out.orderBy(F.desc("gmv"), *keys).limit(limit)
    out = with_rates(out).withColumns({"sale_unit": ratio("gmv", "qty", None), "pay_unit": ratio("pay", "qty", None)})
    stock = stock_goods.select("goods_no", F.col("store_stock").alias("jaego"), F.col("hub_total").alias("hub"))
    out = out.join(stock, "goods_no", "left").join(profit_goods.select("goods_no", "net_take", "cp"), "goods_no", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("jaego", "hub")})


def goods_by_store(sales: DataFrame, stock_store: DataFrame, settlement: DataFrame, f: SalesFilter = NO_FILTER) -> DataFrame:
    """Long store x goods rows with stock and settled profit."""
    keys = ["store_name", "business_type", *CATEGORIES, "brand_nm", "goods_no"]
    out = sums_with_name(apply_sales_filter(sales, f), keys).filter((F.col("qty") != 0) | (F.col("gmv") != 0))
    pair = ["store_name", "goods_no"]
    settled = apply_settlement_filter(settlement, f).groupBy(*pair).agg(money_sum("net_take").alias("net_take"), money_sum("cp").alias("cp"))
    out = out.join(stock_store, pair, "left").join(settled, pair, "left")
    return out.withColumns({
        "stock": F.coalesce("stock", F.lit(0)).cast("bigint"), **{c: F.coalesce(c, F.lit(0)).cast(WIDE) for c in ("net_take", "cp")}
    })


def brand_by_store(sales: DataFrame, stock_store: DataFrame, attributes: DataFrame, f: SalesFilter = NO_FILTER) -> DataFrame:
    """Sales and stock by brand x store, full outer. Stock ignores the dates but keeps the goods of
    the other filters; a goods counts for one brand."""
    s = apply_sales_filter(sales, f).groupBy("business_type", "brand_nm", "store_name").agg(*measure_sums())
    s = s.filter((F.col("qty") != 0) | (F.col("gmv") != 0))
    biz = s.groupBy("brand_nm").agg(F.min("business_type").alias("brand_business"))
    in_scope = apply_sales_filter(sales, f.without("date_from", "date_to")).select("goods_no").distinct()
    owner = attributes.select("goods_no", "brand_nm").join(in_scope, "goods_no", "left_semi")
    k = stock_store.join(owner, "goods_no").join(biz.select("brand_nm"), "brand_nm", "left_semi")
    k = k.groupBy("brand_nm", "store_name").agg(total("stock").cast("bigint").alias("stock"))
    # one sales row per brand and store, so that stock is not repeated per business type
    s = s.groupBy("brand_nm", "store_name").agg(*measure_sums())
    out = s.join(k, ["brand_nm", "store_name"], "full_outer").join(biz, "brand_nm", "left")
    zero = F.lit(0)
    out = out.select(
        F.coalesce("brand_business", F.lit("")).alias("business_type"), "brand_nm", "store_name",
        *[F.coalesce(c, zero).cast("bigint" if c == "qty" else WIDE).alias(c) for c in MEASURES],
        F.coalesce("stock", zero).cast("bigint").alias("stock"),
    )
    return out.withColumn("discount_rate", discount_rate("gmv", "normal_amt"))


def demographic_gmv(customer: DataFrame, f: SalesFilter = NO_FILTER, col: str = "sex") -> DataFrame:
    return apply_settlement_filter(customer, f).groupBy(F.col(col).alias("name")).agg(money_sum("gmv").alias("gmv"))


def demographic_share(by: DataFrame, order: list[str] = ()) -> DataFrame:
    """Share without the 'other' label; `order` gives the positions of the known bands."""
    kept = by.filter(F.col("name") != L.SHARE_EXCLUDED)
    whole = kept.agg(money_sum("gmv").alias("t")).scalar()
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("name")).cast("int") if order else F.lit(None).cast("int")
    return kept.withColumn("share", ratio("gmv", whole)).withColumn("pos", pos)


def conversion(visitors: DataFrame, receipts: DataFrame, f: SalesFilter = NO_FILTER) -> DataFrame:
    """Per store with visitors: visitors, orders, amount, orders per visitor, amount per order."""
    v = apply_settlement_filter(visitors, f).groupBy("store_name").agg(
        F.min("shop_type").alias("shop_type"), total("visitors").cast("bigint").alias("visitors")
    )
    rows = apply_settlement_filter(receipts, f)
    r = _orders(rows, "store_name").groupBy("store_name").agg(F.count(F.lit(1)).alias("receipts"), money_sum("gmv").alias("gmv"))
    out = v.join(r, "store_name", "left")
    out = out.withColumns({"receipts": F.coalesce("receipts", F.lit(0)).cast("bigint"), "gmv": F.coalesce("gmv", F.lit(0)).cast(WIDE)})
    return conversion_rates(out)


def conversion_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({"conversion": ratio("receipts", "visitors"), "aov": ratio("gmv", "receipts", None)})


def conversion_totals(rows: DataFrame) -> DataFrame:
    t = rows.agg(
        total("visitors").cast("bigint").alias("visitors"),
        total("receipts").cast("bigint").alias("receipts"),
        money_sum("gmv").alias("gmv"),
    )
    return conversion_rates(t)


def country_sales(nationality: DataFrame, f: SalesFilter = NO_FILTER, limit: int | None = None) -> DataFrame:
    """Nationalities with their share in the total of all, and how many there are."""
    g = apply_settlement_filter(nationality, f).groupBy("nationality").agg(
        money_sum("gmv").alias("gmv"), total("buyers").cast("bigint").alias("buyers")
    )
    whole = g.agg(money_sum("gmv").alias("t")).scalar()
    kinds = g.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = g.withColumn("share", ratio("gmv", whole)).withColumn("total_gmv", whole).withColumn("countries", kinds)
    return out if limit is None else out.orderBy(F.desc("gmv"), "nationality").limit(limit)


def foreign_ratio_by(sales: DataFrame, dim: str) -> DataFrame:
    g = sales.groupBy(F.col(dim).alias("name")).agg(*measure_sums(("gmv", "foreign_gmv")))
    return g.withColumn("ratio", ratio("foreign_gmv", "gmv"))


def previous_period_growth(sales: DataFrame, f: SalesFilter) -> DataFrame:
    """KPIs of the range and of the equal range before it, from one pass; percent on |previous|."""
    prev_from, prev_to = previous_range(f.date_from, f.date_to)
    rows = apply_sales_filter(sales, f.without("date_from", "date_to"))
    rows = prune(rows, prev_from, f.date_to).filter(within("sales_date", prev_from, f.date_to))
    cur = within("sales_date", f.date_from, f.date_to)
    prev = within("sales_date", prev_from, prev_to)
    side = lambda cond, m: sum_if(cond, m).cast("bigint" if m == "qty" else WIDE)
    cols = [side(c, m).alias(f"{p}{m}") for p, c in (("", cur), ("prev_", prev)) for m in MEASURES]
    out = rows.agg(*cols)
    return out.withColumns({f"{m}_change": change(m, f"prev_{m}", absolute=True) for m in MEASURES})


def with_totals(df: DataFrame, label: str, sums: list[str], ratios: dict[str, Column], base: DataFrame | None = None) -> DataFrame:
    """Put a total row in front. Sums are summed over `base` (default: the rows shown) and the
    ratio expressions are evaluated on those sums, never averaged."""
    types = {x.name: x.dataType for x in df.schema.fields}
    t = (df if base is None else base).agg(*[total(c).cast(types[c]).alias(c) for c in sums])
    t = t.withColumns(ratios)
    known = {*sums, *ratios}
    t = t.select(
        *[
            F.lit(L.TOTAL).cast(types[c]).alias(c) if c == label
            else F.col(c).cast(types[c]).alias(c) if c in known
            else F.lit(None).cast(types[c]).alias(c)
            for c in df.columns
        ]
    )
    return t.withColumn("is_total", F.lit(True)).unionByName(df.withColumn("is_total", F.lit(False)))


def ab_label(a: Column, b: Column) -> Column:
    p = (dbl(a) - dbl(b)) / F.nullif(dbl(b), F.lit(0.0)) * F.lit(100.0)
    text = F.concat(F.when(p > 0, "+").otherwise(""), F.format_string("%.1f%%", p))
    return F.when(dbl(b) != 0, text).otherwise(F.when(dbl(a) > 0, L.GROWTH_NEW).otherwise(L.AB_NONE))


AB_DIMENSIONS = {"store": "store_name", "category": "cat_large", "brand": "brand_nm"}


def ab_compare(
    sales: DataFrame, a: tuple[DateLike, DateLike], b: tuple[DateLike, DateLike], dim: str, f: SalesFilter = NO_FILTER,
    category: str = "cat_large", limit: int | None = None,
) -> DataFrame:
    """Two free ranges side by side, from one pass. Groups are merged in full and cut afterwards,
    so a group never looks new because the other side was cut."""
    in_a, in_b = within("sales_date", *a), within("sales_date", *b)
    rows = apply_sales_filter(sales, f.without("date_from", "date_to"))
    starts, ends = zip(*[(as_date(x), as_date(y)) for x, y in (a, b)])
    rows = prune(rows, F.least(*starts), F.greatest(*ends)).filter(in_a | in_b)
    side = lambda c, m: sum_if(c, m)
    sums = [side(in_a, "gmv").cast(WIDE).alias("a_gmv"), side(in_b, "gmv").cast(WIDE).alias("b_gmv")]
    if dim == "goods":
        names = ("brand_nm", "goods_nm", "cat_medium")
        named = rows.groupBy("goods_no", *names).agg(*sums, side(in_a, "qty").alias("_qa"), side(in_b, "qty").alias("_qb"))
        out = named.groupBy("goods_no").agg(
            *[F.min(c).alias(c) for c in names], *[F.sum(c).cast(WIDE).alias(c) for c in ("a_gmv", "b_gmv")],
            *[F.sum(c).alias(c) for c in ("_qa", "_qb")],
        )
        # goods lists show goods with units sold only, on either side
        sold = lambda q, v: F.when(F.col(q) > 0, F.col(v)).otherwise(F.lit(0)).cast(WIDE)
        out = out.filter((F.col("_qa") > 0) | (F.col("_qb") > 0))
        out = out.withColumn("a_gmv", sold("_qa", "a_gmv")).withColumn("b_gmv", sold("_qb", "b_gmv")).drop("_qa", "_qb")
        tie = "goods_no"
    else:
        col = category if dim == "category" else AB_DIMENSIONS[dim]
        out = rows.groupBy(F.col(col).alias("name")).agg(*sums)
        tie = "name"
    out = out.withColumn("change", ab_label(F.col("a_gmv"), F.col("b_gmv")))
    return out if limit is None else out.orderBy(F.desc("a_gmv"), F.desc("b_gmv"), tie).limit(limit)
