"""Fact builders: signed sales, receipts, targets, visitors, settlement, customers, stock."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from shopfloor.functions import labels as L
from shopfloor.functions.dates import DateLike, as_date
from shopfloor.functions.numeric import MONEY, blank_to, cents_sum, stored_sum, total
from shopfloor.operators.dimensions import CATEGORIES, brand_override, supply_business_type, zero_qty_brand
from shopfloor.sources.tables import latest_snapshot

#: What puts rows aside in the middle of a long build: writes them and reads them back, or leaves the plan as it is.
Aside = Callable[[DataFrame], DataFrame]


def as_planned(df: DataFrame) -> DataFrame:
    return df


def order_time() -> Column:
    return F.coalesce("transaction_at", "created_at")


def order_date(orders: DataFrame) -> DataFrame:
    """Sale date = transaction time, else creation time."""
    return orders.withColumn("sales_date", order_time().cast("date"))


def foreign_flag(orders: DataFrame) -> DataFrame:
    """1 when a tax refund type is present and is not the 'none' code."""
    t = F.col("tax_refund_type")
    return orders.withColumn("is_foreign", F.when(t.isNotNull() & (t != L.TAX_REFUND_NONE), 1).otherwise(0))


def refund_claims(claims: DataFrame, since: DateLike | None = None) -> DataFrame:
    """Distinct (order, refund date); exchanges do not move money."""
    out = claims.filter(F.col("claim_type") == L.CLAIM_REFUND)
    if since is not None:
        out = out.filter(F.col("created_at") >= as_date(since))
    return out.select("order_id", F.col("created_at").cast("date").alias("refund_date")).distinct()


def ledger_events(orders: DataFrame, claims: DataFrame, stores: DataFrame, since: DateLike | None = None) -> DataFrame:
    """One row per booking of an order: +1 on the sale date of a completed order, -1 on each refund
    date of any non-dummy order.

    Orders are scanned once and meet their refund dates by order id; the bookings are unfolded in
    place, so the result is still partitioned by order id when the (large) lines are joined to it,
    once for both signs. The dates of an order form a set, whose size is bounded by the calendar.
    With `since` only orders sold or refunded from that day on go any further: the former by a test
    on the order scan, the latter by their ids, so neither old orders nor old lines are shuffled."""
    real = orders.filter(F.col("dummy_order") == 0)
    claimed = refund_claims(claims, since)
    booked = F.col("order_status") == L.STATUS_COMPLETE
    if since is not None:
        day = as_date(since)
        booked = booked & (F.col("sales_date") >= day)
        recent = (F.col("transaction_at") >= day) | (F.col("transaction_at").isNull() & (F.col("created_at") >= day))
        older = real.filter(~F.coalesce(recent, F.lit(False))).join(claimed.select("order_id").distinct(), "order_id", "left_semi")
        real = real.filter(recent).unionByName(older.select(*real.columns))
    head = order_date(foreign_flag(real)).join(stores, "shop_no")
    dates = claimed.groupBy("order_id").agg(F.collect_set("refund_date").alias("refund_dates"))
    sale = F.filter(F.array(F.struct(F.col("sales_date").alias("sales_date"), F.lit(1).alias("sign"))), lambda _: booked)
    refunds = F.transform(
        F.coalesce("refund_dates", F.array().cast("array<date>")),
        lambda d: F.struct(d.alias("sales_date"), F.lit(-1).alias("sign")),
    )
    return (
        head.join(dates, "order_id", "left")
        .select("order_id", "store_name", "shop_type", "is_foreign", F.explode(F.concat(sale, refunds)).alias("b"))
        .select("order_id", "b.sales_date", "store_name", "shop_type", "is_foreign", "b.sign")
    )


def _signed(col: str) -> Column:
    return F.when(F.col("sign") > 0, F.col(col)).otherwise(-F.col(col))


def _book(lines: DataFrame, events: DataFrame, keys: list[str], extra: list[Column] = ()) -> DataFrame:
    """Lines x events, summed at ledger grain before any dimension is joined, so a goods or brand
    with a third of all lines reaches the dimension joins as one row per day and store."""
    m = {"qty": "quantity", "gmv": "order_amount", "normal_amt": "normal_amount", "pay": "pay_amount"}
    sums = [
        F.sum(_signed("quantity")).alias("qty"),
        *[cents_sum(_signed(m[k])).alias(k) for k in ("gmv", "normal_amt", "pay")],
        cents_sum(F.when(F.col("is_foreign") == 1, _signed("order_amount")).otherwise(0)).alias("foreign_gmv"),
        *extra,
    ]
    return lines.join(events, "order_id").groupBy("sales_date", "store_name", "shop_type", *keys).agg(*sums)


def _with_brand(df: DataFrame, brands: DataFrame) -> DataFrame:
    b = brands.select(F.col("com_id").alias("company_id"), F.col("brand_code").alias("brand_id"), "brand_nm", "business_type")
    out = df.join(b, ["company_id", "brand_id"], "left")
    return out.withColumn("business_type", F.coalesce("business_type", F.lit(L.OTHER)))


SALES_KEYS = (
    "sales_date", "store_name", "shop_type", "business_type", "brand_nm", "goods_no", *CATEGORIES, "off_md_id",
    "company_id", "brand_id",
)
SALES_MEASURES = ("qty", "gmv", "normal_amt", "pay", "foreign_gmv")


def net_sales(
    orders: DataFrame, lines: DataFrame, claims: DataFrame, stores: DataFrame, brands: DataFrame, categories: DataFrame,
    goods: DataFrame, since: DateLike | None = None, bag_brand: str | None = None, aside: Aside = as_planned,
) -> DataFrame:
    """Signed daily sales: completed orders minus refunds at their claim date. The booked lines are put aside before they
    meet the dimensions, so that the shuffles of both halves never lie on the disks together."""
    events = ledger_events(orders, claims, stores, since)
    booked = aside(_book(lines, events, ["goods_no", "company_id", "brand_id"]))
    out = _with_brand(booked, brands).join(categories, "goods_no", "left")
    out = zero_qty_brand(brand_override(out, goods), bag_brand)
    return out.select(*SALES_KEYS, *SALES_MEASURES, "goods_nm", "reg_date", "style_no", "normal_price", "sale_price")


def option_since(since: DateLike | None, as_of: DateLike, floor_days: int | None) -> Column | None:
    """`since`, but with a floor never more than so many days back."""
    if floor_days is None:
        return None if since is None else as_date(since)
    floor = F.date_sub(as_date(as_of), floor_days)
    return floor if since is None else F.greatest(as_date(since), floor)


def net_sales_option(
    orders: DataFrame, lines: DataFrame, claims: DataFrame, stores: DataFrame, brands: DataFrame, categories: DataFrame,
    as_of: DateLike, since: DateLike | None = None, bag_brand: str | None = None, floor_days: int | None = None,
    aside: Aside = as_planned,
) -> DataFrame:
    """Signed daily sales by option, of all days or of the last `floor_days`."""
    events = ledger_events(orders, claims, stores, option_since(since, as_of, floor_days))
    label = F.coalesce(F.nullif(F.trim("option_name"), F.lit("")), F.lit(L.NO_OPTION))
    # the name is a key of the first sums: a text minimum there would sort all lines
    named = lines.withColumn("option_nm", label).withColumn("goods_nm", F.col("goods_name"))
    booked = aside(_book(named, events, ["goods_no", "option_nm", "company_id", "brand_id", "goods_nm"]))
    out = _with_brand(booked, brands).join(categories, "goods_no", "left")
    out = out.withColumns({
        "brand_nm": F.coalesce("brand_nm", F.lit(L.UNMATCHED_BRAND)),
        **{c: F.coalesce(c, F.lit("")) for c in (*CATEGORIES, "off_md_id")},
    })
    keys = ["sales_date", "store_name", "shop_type", "business_type", "brand_nm", "goods_no", "option_nm", *CATEGORIES, "off_md_id"]
    out = out.groupBy(keys).agg(
        F.coalesce(F.min("goods_nm"), F.lit("")).alias("goods_nm"),
        F.sum("qty").alias("qty"),
        *[stored_sum(c).alias(c) for c in ("gmv", "normal_amt", "pay")],
    )
    return zero_qty_brand(out, bag_brand)


def receipts(
    orders: DataFrame, lines: DataFrame, stores: DataFrame, brands: DataFrame, categories: DataFrame,
    goods_main: DataFrame, brand: DataFrame, since: DateLike | None = None, aside: Aside = as_planned,
) -> DataFrame:
    """Order-level amounts of completed orders with the hour; refunds are not booked back."""
    head = orders.filter((F.col("dummy_order") == 0) & (F.col("order_status") == L.STATUS_COMPLETE))
    head = order_date(foreign_flag(head)).withColumn("hour", F.hour(order_time()))
    if since is not None:
        head = head.filter(F.col("sales_date") >= as_date(since))
    head = head.join(stores, "shop_no").select("order_id", "sales_date", "hour", "store_name", "shop_type", "is_foreign")
    own = (
        goods_main.join(brand.select("brand", "brand_nm"), "brand", "left").groupBy("goods_no").agg(F.min("brand_nm").alias("_own"))
    )
    attrs = categories.select("goods_no", *CATEGORIES).join(own, "goods_no", "full_outer")
    # the lines meet their order first: that leaves one amount per (order, goods, company, brand)
    order_keys = ["order_id", "sales_date", "hour", "store_name", "shop_type", "is_foreign"]
    sold = (
        lines.select("order_id", "goods_no", "company_id", "brand_id", "order_amount")
        .join(head, "order_id")
        .groupBy(*order_keys, "goods_no", "company_id", "brand_id")
        .agg(F.sum("order_amount").alias("gmv"))
    )
    out = _with_brand(aside(sold), brands).join(attrs, "goods_no", "left")
    out = out.withColumns({
        "brand_nm": F.coalesce(F.nullif("_own", F.lit("")), "brand_nm", F.lit(L.UNMATCHED_BRAND)),
        **{c: F.coalesce(c, F.lit(L.UNCLASSIFIED)) for c in CATEGORIES},
    })
    return out.groupBy(
        "order_id", "sales_date", "store_name", "shop_type", "is_foreign", "business_type", "brand_nm", *CATEGORIES, "hour"
    ).agg(stored_sum("gmv").alias("gmv"))


def _by_store(df: DataFrame, stores: DataFrame) -> DataFrame:
    return df.withColumn("shop_no", F.col("shop_no").cast("int")).join(stores, "shop_no")


def daily_targets(targets: DataFrame, stores: DataFrame) -> DataFrame:
    """Daily goals of the known stores; unreadable dates are dropped."""
    d = F.try_to_date(F.col("dt").cast("string"), "yyyyMMdd")
    out = _by_store(targets.withColumn("sales_date", d).filter(F.col("sales_date").isNotNull()), stores)
    zero = F.lit(0)
    return out.select(
        "sales_date", "shop_no", "store_name", "shop_type",
        F.coalesce("gmv_goal", zero).cast(MONEY).alias("gmv_goal"),
        F.coalesce("contribution_profit_goal", zero).cast(MONEY).alias("cp_goal"),
    )


def footfall(visits: DataFrame, stores: DataFrame) -> DataFrame:
    """Visitors per day and store; summed by store number before the store join."""
    d = F.try_to_date(F.col("dt").cast("string"), "yyyyMMdd").alias("sales_date")
    daily = visits.groupBy(d, "shop_no").agg(F.sum(F.col("visitors_int").cast("bigint")).alias("v"))
    daily = daily.filter(F.col("sales_date").isNotNull())
    return _by_store(daily, stores).groupBy("sales_date", "store_name", "shop_type").agg(total("v").cast("bigint").alias("visitors"))


def nationality_sales(tax_free: DataFrame, orders: DataFrame, lines: DataFrame, stores: DataFrame) -> DataFrame:
    """Gross amounts and buyers per nationality. Lines are summed per order first, so the buyers
    count is a plain count of (order, nationality) pairs and needs no distinct."""
    tf = tax_free.filter(F.col("nationality").isNotNull()).select(F.col("order_id").alias("_oid"), "nationality").distinct()
    head = orders.filter((F.col("dummy_order") == 0) & (F.col("order_status") == L.STATUS_COMPLETE))
    head = order_date(head).join(stores, "shop_no").withColumn("_oid", F.col("order_id").cast("string"))
    pairs = head.join(tf, "_oid").select("order_id", "sales_date", "store_name", "shop_type", "nationality")
    per_order = (
        lines.select("order_id", "order_amount")
        .join(pairs, "order_id")
        .groupBy("order_id", "sales_date", "store_name", "shop_type", "nationality")
        .agg(F.sum("order_amount").alias("gmv"))
    )
    return per_order.groupBy("sales_date", "store_name", "shop_type", "nationality").agg(
        stored_sum("gmv").alias("gmv"), F.count(F.lit(1)).alias("buyers")
    )


def _settled(summary: DataFrame, stores: DataFrame, since: DateLike | None, goods: bool = True) -> DataFrame:
    out = summary.filter(F.col("ord_state_date").isNotNull())
    if goods:
        out = out.filter(F.col("goods_no").isNotNull())
    if since is not None:
        out = out.filter(F.col("ord_state_date") >= as_date(since))
    return _by_store(out.withColumnRenamed("ord_state_date", "sales_date"), stores)


def settlement(summary: DataFrame, stores: DataFrame, since: DateLike | None = None) -> DataFrame:
    return (
        _settled(summary, stores, since)
        .groupBy("sales_date", "store_name", "shop_type", "goods_no")
        .agg(stored_sum("profit").alias("net_take"), stored_sum("contribution_profit_pre").alias("cp"))
    )


def settlement_option(summary: DataFrame, stores: DataFrame, since: DateLike | None = None) -> DataFrame:
    """Names are filled before they are keys, so null and blank are one row. The rows are dealt once by (day, store, goods);
    both sums find theirs in place, and a hot goods is spread over days and stores."""
    names = {"brand_nm": "brand_nm", "large_nm": "cat_large", "medium_nm": "cat_medium", "option_nm": "option_nm"}
    keys = ["sales_date", "store_name", "shop_type", *names.values(), "goods_no"]
    measures = {"ord_amt": "gmv", "normal_amt": "normal_amt", "pay_amt": "pay", "profit": "net_take", "contribution_profit_pre": "cp"}
    rows = _settled(summary, stores, since).select(
        "sales_date", "store_name", "shop_type", *[F.coalesce(a, F.lit("")).alias(b) for a, b in names.items()], "goods_no", "goods_nm",
        "qty", *measures,
    )
    rows = rows.repartition("sales_date", "store_name", "goods_no")
    named = rows.groupBy(*keys, "goods_nm").agg(F.sum("qty").alias("qty"), *[F.sum(a).alias(b) for a, b in measures.items()])
    return named.groupBy(*keys).agg(
        F.coalesce(F.min("goods_nm"), F.lit("")).alias("goods_nm"),
        total("qty").cast("bigint").alias("qty"),
        *[stored_sum(c).alias(c) for c in measures.values()],
    )


def settlement_daily(summary: DataFrame, stores: DataFrame, since: DateLike | None = None) -> DataFrame:
    out = _settled(summary, stores, since, goods=False).withColumn("brand_nm", F.coalesce("brand_nm", F.lit("")))
    return out.groupBy("sales_date", "store_name", "shop_type", "brand_nm").agg(
        total("qty").cast("bigint").alias("qty"),
        stored_sum("ord_amt").alias("gmv"),
        stored_sum("normal_amt").alias("normal_amt"),
        stored_sum("profit").alias("net_take"),
        stored_sum("contribution_profit_pre").alias("cp"),
        stored_sum("offline_cost_fixed").alias("offline_cost"),
        stored_sum("additional_rev").alias("add_rev"),
    )


def customer_demographics(summary: DataFrame, stores: DataFrame) -> DataFrame:
    out = _by_store(summary.filter(F.col("summary_period_unit") == L.CUSTOMER_DAILY), stores)
    return out.groupBy(
        F.col("ord_state_date").alias("sales_date"), "store_name", "shop_type",
        blank_to("sex", L.OTHER_PERSON).alias("sex"),
        blank_to("age_band_custom", L.OTHER_PERSON).alias("age_band"),
        blank_to("mssid_yn", L.UNKNOWN_MEMBER).alias("member"),
    ).agg(
        stored_sum("gmv").alias("gmv"),
        stored_sum("normal_gmv").alias("normal_gmv"),
        stored_sum("tax_gmv").alias("foreign_gmv"),
        total("qty").cast("bigint").alias("qty"),
        total("buyer").cast("bigint").alias("buyer"),
        total("tax_buyer").cast("bigint").alias("foreign_buyer"),
    )


def store_stock(stock_summary: DataFrame, stores: DataFrame) -> DataFrame:
    """Latest sellable and available stock per business type, store, brand and goods."""
    now = _by_store(latest_snapshot(stock_summary, "ord_state_date"), stores)
    keys = ["business_type", "store_name", "shop_type", "brand_nm", "goods_no"]
    rows = now.withColumns({
        "business_type": supply_business_type("ord_com_type"), "brand_nm": F.coalesce("brand_nm", F.lit(L.UNMATCHED_BRAND))
    })
    sums = [
        F.max("snapshot_date").alias("snapshot_date"), total("sellable_qty").cast("bigint").alias("sellable_qty"),
        total("available_qty").cast("bigint").alias("available_qty"),
    ]
    named = rows.withColumnRenamed("ord_state_date", "snapshot_date").groupBy(*keys, "goods_nm").agg(*sums)
    return named.groupBy(*keys).agg(F.min("goods_nm").alias("goods_nm"), *sums)
