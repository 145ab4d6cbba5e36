"""One registered query per operator, over the whole of the driver's tables."""

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.roles import TestInputs
from shopfloor.functions import labels as L
from shopfloor.functions.dates import red_days
from shopfloor.functions.numeric import decimals_to_double, discount_rate, ratio
from shopfloor.operators import (
    compare as C, daily as G, dimensions as D, facts as A, filters as P, profit as R, sales as E, stock as H, targets as T, weekly as K,
)
from shopfloor.operators.filters import SalesFilter
from shopfloor.plans import datasets as X, exports
from shopfloor.session import tune
from shopfloor.sources import layout, tables

AS_OF = dt.date(2001, 7, 20)
SHOP_TYPES = ("america", "asia", "europe", "middle east")
SPECIAL = {7: "RUN"}
BAG = "Brand 7"
SCOPE = K.Scope(
    divisions=["ASIA", "EUROPE"],
    extra_companies=["3", "21", "33"],
    vendors=["6", "18", "27", "48"],
    excluded_companies=["9"],
    store_pairs=[("L1", "Loc 1"), ("L3", "Loc 3"), ("L2", "Loc 1")],
    platform="MAIN",
    location_prefix="3",
    non_store_names=["온라인몰", "홀세일"],
    used_division="유즈드",
)
# fixed values: plants and warehouses in the stock sources
PLANTS = H.Plants("1000", ("2000", "2010", "2020", "2060"), "1700", "2000")
# names of the stores in scope, as the store dimension builds them
STORES = [f"NATION_{n}" if n % 5 == 1 else f"NATION_{n} store" for n in range(25) if n % 5 != 0]
FILTER = SalesFilter(
    date_from="2000-07-01", date_to="2001-07-19", biz=[L.CONSIGNMENT, L.PURCHASE], type=["AMERICA", "ASIA", "RUN"],
    cat_top=["ECONOMY", "PROMO", "LARGE"], name_like="BOLT",
)
PERIOD = SalesFilter(date_from="2001-01-01", date_to="2001-06-30")
A_RANGE, B_RANGE = ("2001-01-01", "2001-06-30"), ("2000-01-01", "2000-06-30")
STOCK_FILTER = SalesFilter(biz=[L.CONSIGNMENT, L.PURCHASE], type=["ASIA", "EUROPE"], cat_top=["ECONOMY", "SMALL", L.UNCLASSIFIED])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


SETTINGS = X.Settings(AS_OF, SHOP_TYPES, SPECIAL, BAG, SCOPE, PLANTS)
_DATA: dict[tuple[str, str], X.Datasets] = {}


def data_for(spark: SparkSession, sf_dir: str) -> X.Datasets:
    """The datasets of one directory. Reports read them as tables, written on first use in a
    session; builder queries ask for the unwritten plan with `plan`."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DATA:
        _DATA[key] = X.Datasets(TestInputs(tune(spark), sf_dir), SETTINGS, layout.Store(spark))
    return _DATA[key]


def plan(x: X.Datasets, name: str) -> DataFrame:
    """The plan of a dataset, built from its inputs rather than read back."""
    return getattr(X.Datasets, name).build(x)


def query(name: str):
    """Register `fn(data)`; exact columns become DOUBLE in the result."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: decimals_to_double(fn(data_for(spark, sf_dir)).drop(layout.MONTH))
        return fn

    return register


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def tagged(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.withColumn(name, F.lit(value))


# ---------------------------------------------------------------- A: scans, sources, sinks


@query("a1_load")
def _(x):
    return x.inputs.raw("lineitem")


@query("a2_latest_snapshot")
def _(x):
    return tables.latest_snapshot(x.inputs["stock_summary"], "ord_state_date")


@query("a3_write_clustered")
def _(x):
    spark = x.inputs.spark
    return layout.write_clustered(x.settlement_daily_rows(), layout.scratch_path(spark, "clustered"), "sales_date")


@query("a4_replace_window")
def _(x):
    full = x.settlement
    since = layout.window_start(full, 90)
    # a copy whose last 90 days are out of date
    stale = full.withColumn("net_take", F.when(F.col("sales_date") >= since, F.lit(-1).cast("decimal(18,2)")).otherwise(F.col("net_take")))
    return layout.replace_window(stale, x.settlement_rows(since), since)


@query("a5_refresh")
def _(x):
    spark = x.inputs.spark
    root = layout.scratch_path(spark, "refresh")
    fresh = X.Datasets(x.inputs, x.settings, layout.Store(spark))
    X.refresh(spark, fresh, root, "sales")
    names = X.refresh(spark, fresh, root, "snap", ("settlement_daily", "target_daily", "footfall"))
    return union(
        *[
            X.read_dataset(spark, root, n).agg(F.count(F.lit(1)).alias("row_count"), F.max("sales_date").alias("max_date")).select(
                F.lit(n).alias("dataset"), "row_count", "max_date"
            )
            for n in (*X.SALES_TRIO, *names)
        ]
    )


@query("a6_freshness")
def _(x):
    done = x.inputs["order_header"].filter((F.col("dummy_order") == 0) & (F.col("order_status") == L.STATUS_COMPLETE))
    done = A.order_date(done.join(x.stores, "shop_no"))
    return union(
        layout.freshness("orders", done, "sales_date", A.order_time()),
        layout.stored_freshness(x.inputs.spark, "sales", x.stored("sales")),
        layout.stored_freshness(x.inputs.spark, "settlement", x.stored("settlement")),
        layout.freshness("target_daily", x.target_daily, "sales_date"),
        layout.freshness("goods_master", x.goods_master),
    )


def exported(x, df: DataFrame) -> DataFrame:
    """Written as CSV and read back under the same schema."""
    rows = decimals_to_double(df)
    path = tables.export_csv(rows, layout.scratch_path(x.inputs.spark, "csv"), rows.columns)
    # an empty text and a missing one are the same in CSV
    read = x.inputs.spark.read.schema(rows.schema).option("header", True).csv(path)
    return read.withColumns({f.name: F.coalesce(f.name, F.lit("")) for f in rows.schema if f.dataType.simpleString() == "string"})


@query("a7_export_options")
def _(x):
    with x.building():
        rows = R.allocate_profit(x.sales_option, x.settlement_option, x.stock_store, aside=x.aside)
        return exported(x, exports.option_export(x.aside(rows), x.goods_master))


@query("a7_export_brand_store")
def _(x):
    return exported(x, exports.brand_store_export(E.brand_by_store(x.sales, x.stock_store, x.goods_attr)))


@query("a7_export_stock")
def _(x):
    return exported(x, exports.stock_export(H.stock_export_long(P.apply_stock_filter(x.stock, P.NO_FILTER))))


@query("a7_export_restock")
def _(x):
    return exported(x, exports.restock_export(G.restock(x.sales, x.stock_store, x.stock_goods, G.ReportDays(x.sales, AS_OF))))


@query("a7_export_drill")
def _(x):
    cols = ["key", "qty", "gmv", "normal_amt", "foreign_gmv", "goods_count", "stock"]
    return exported(x, E.drill(x.sales, x.stock_store, x.goods_attr, "brand").select(*cols))


@query("a7_export_csv")
def _(x):
    spark = x.inputs.spark
    f = SalesFilter(store=[STORES[0]])
    rows = E.drill(x.sales, x.stock_store, x.goods_attr, "brand", f)
    cols = ["key", "qty", "gmv", "normal_amt", "foreign_gmv", "goods_count", "stock"]
    path = tables.export_csv(decimals_to_double(rows), layout.scratch_path(spark, "csv"), cols, E.drill_context("brand", f))
    ddl = "in_store STRING, key STRING, qty BIGINT, gmv DOUBLE, normal_amt DOUBLE, foreign_gmv DOUBLE, goods_count BIGINT, stock BIGINT"
    return spark.read.schema(ddl).option("header", True).csv(path)


# ---------------------------------------------------------------- B: dimensions and enrichment


@query("b1_dim_store")
def _(x):
    return plan(x, "stores")


@query("b2_dim_brand")
def _(x):
    return plan(x, "brands")


@query("b3_category_map")
def _(x):
    return plan(x, "categories")


@query("b4_sold_goods")
def _(x):
    return D.sold_goods(x.inputs["order_line"], x.inputs["order_header"], x.stores)


@query("b5_quarantine_prices")
def _(x):
    feed = x.inputs["price_feed"].filter(F.col("channel_id") == L.PRICE_CHANNEL)
    return D.quarantine_prices(feed)


@query("b6_latest_by_key")
def _(x):
    return D.latest_by_key(x.inputs["goods_secondary"], ["goods_id"], "updated_at")


@query("b7_goods_master")
def _(x):
    return plan(x, "goods_master")


@query("b8_concept_map")
def _(x):
    pairs = x.sales.select("company_id", "brand_id").distinct()
    return D.with_concept(pairs, x.concepts)


@query("b9_mode_name")
def _(x):
    i = x.inputs
    now = tables.latest_snapshot(i["stock_summary"], "ord_state_date")
    return D.mode_name([now, i["company"], i["goods_main"]], "md_id", "md_nm")


@query("b10_catalog_enrich")
def _(x):
    rows = x.inputs["goods_scope"].select("goods_no", F.col("brand").alias("brand_id"))
    return D.catalog_enrich(rows, x.goods_master)


@query("b11_brand_override")
def _(x):
    return x.sales.groupBy("goods_no", "company_id", "brand_id").agg(
        F.min("brand_nm").alias("brand_nm"), F.min("goods_nm").alias("goods_nm"), F.min("cat_top").alias("cat_top"),
        F.min("cat_large").alias("cat_large"), F.min("cat_medium").alias("cat_medium"), F.min("off_md_id").alias("off_md_id"),
    )


@query("b12_zero_qty_brand")
def _(x):
    return x.sales.groupBy("brand_nm").agg(F.sum("qty").alias("qty"), F.sum("gmv").alias("gmv"))


@query("b13_red_days")
def _(x):
    sold = x.inputs.raw("orders").select(F.col("o_orderdate").cast("date").alias("d"))
    seen = x.inputs.raw("events").select(F.col("ts").cast("date").alias("d"))
    # the same days 28 years later meet every listed holiday
    later = sold.select(F.add_months("d", 336).alias("d"))
    return red_days(sold.unionByName(seen).unionByName(later).distinct(), "d")


# ---------------------------------------------------------------- C: facts


@query("c1_net_sales")
def _(x):
    return x.net_sales()


@query("c1_net_sales_since")
def _(x):
    return x.net_sales("2001-05-01").select(*A.SALES_KEYS, *A.SALES_MEASURES)


@query("c2_order_date")
def _(x):
    return A.order_date(x.inputs["order_header"]).groupBy("sales_date").agg(F.count(F.lit(1)).alias("orders"))


@query("c3_refund_claims")
def _(x):
    return A.refund_claims(x.inputs["claim"])


@query("c4_foreign_flag")
def _(x):
    return A.foreign_flag(x.inputs["order_header"]).select("order_id", "is_foreign")


@query("c5_net_sales_option")
def _(x):
    return x.net_sales_option()


@query("c6_receipts")
def _(x):
    return x.receipt_rows()


@query("c7_daily_targets")
def _(x):
    return plan(x, "target_daily")


@query("c8_footfall")
def _(x):
    return plan(x, "footfall")


@query("c9_nationality_sales")
def _(x):
    return plan(x, "global_customer")


@query("c10_settlement")
def _(x):
    return x.settlement_rows()


@query("c11_settlement_option")
def _(x):
    return x.settlement_option_rows()


@query("c12_settlement_daily")
def _(x):
    return x.settlement_daily_rows()


@query("c13_customer_demographics")
def _(x):
    return plan(x, "customer")


@query("c14_store_stock")
def _(x):
    return A.store_stock(x.inputs["stock_summary"], x.stores)


# ---------------------------------------------------------------- D: filters


@query("d1_apply_sales_filter")
def _(x):
    return P.apply_sales_filter(x.sales, FILTER).select(*A.SALES_KEYS, *A.SALES_MEASURES, "goods_nm")


@query("d1_apply_concept_filter")
def _(x):
    rows = D.with_concept(x.sales, x.concepts)
    f = SalesFilter(concept=["C1", L.UNASSIGNED_CONCEPT], store=STORES[:5], brand=["Brand 1", "Brand 2"], md=["md1", "md2", ""])
    return P.apply_sales_filter(rows, f).select(*A.SALES_KEYS, *A.SALES_MEASURES, "concept")


@query("d2_apply_receipt_filter")
def _(x):
    return P.apply_receipt_filter(x.receipts, FILTER)


@query("d3_apply_settlement_filter")
def _(x):
    return P.apply_settlement_filter(x.settlement, FILTER)


@query("d4_apply_traffic_filter")
def _(x):
    return P.apply_traffic_filter(x.footfall, "2001-07-05", "2001-07-20", types=["ASIA", "EUROPE"])


@query("d5_apply_stock_filter")
def _(x):
    return P.apply_stock_filter(x.stock, STOCK_FILTER, x.stores).select("barcode", "location_kind", "location", "qty")


@query("d6_drill_stock_filter")
def _(x):
    f = SalesFilter(biz=[L.PURCHASE, L.OTHER], cat_top=["ECONOMY", L.UNCLASSIFIED], name_like="widget")
    return P.drill_stock_filter(x.stock_store, x.goods_attr, f).drop("goods_nm")


@query("d7_cross_facets")
def _(x):
    f = SalesFilter(
        date_from="2000-01-01", store=STORES[:4], brand=["Brand 1", "Brand 2", "Brand 3"], cat_top=["ECONOMY"], biz=[L.PURCHASE, L.OTHER]
    )
    return P.cross_facets(x.sales, f, ["store", "brand", "cat_top"])


@query("d8_kpis_by_preset")
def _(x):
    return P.kpis_by_preset(x.sales_for())


@query("d9_report_basis")
def _(x):
    rows = P.report_basis(x.sales, "ECONOMY", L.CONSIGNMENT)
    return rows.groupBy("cat_top", "business_type", "store_name").agg(F.sum("gmv").alias("gmv"))


@query("d10_weekly_search")
def _(x):
    return P.weekly_search(x.ips, kind=[L.PURCHASE], division=["ASIA", "EUROPE"], text="D 1").select("sil", "gubun", "brand_code", "brand_nm")


# ---------------------------------------------------------------- E: sales reports


@query("e1_facets")
def _(x):
    return E.facets(x.sales)


@query("e2_summary")
def _(x):
    return x.summary()


@query("e3_take_rate")
def _(x):
    return R.take_rate(x.sales, x.settlement, x.sales, AS_OF)


@query("e4_profit_by_goods")
def _(x):
    return R.profit_by_goods(x.sales, x.settlement, P.NO_FILTER, AS_OF)


@query("e5_profit_totals")
def _(x):
    return R.profit_totals(x.sales, x.settlement, P.NO_FILTER, AS_OF)


@query("e6_profit_by_brand")
def _(x):
    return R.profit_by_brand(x.sales, x.settlement, P.NO_FILTER, AS_OF)


PROFIT_FILTER = SalesFilter(date_from="2001-05-20", date_to="2001-06-25", store=STORES[:6])


@query("e4_profit_by_goods_filtered")
def _(x):
    return R.profit_by_goods(x.sales, x.settlement, PROFIT_FILTER, AS_OF)


@query("e5_profit_totals_filtered")
def _(x):
    return R.profit_totals(x.sales, x.settlement, PROFIT_FILTER, AS_OF)


@query("e7_basket_value")
def _(x):
    return E.basket_value(x.receipts)


@query("e8_hourly")
def _(x):
    return E.hourly(x.receipts)


@query("e9_trend")
def _(x):
    return union(*[tagged(E.trend(x.sales_for(), P.NO_FILTER, g), "grain", g) for g in ("day", "week", "month")])


@query("e10_trend_by_business")
def _(x):
    return E.trend_by_business(x.sales_for(P.NO_FILTER, "business_type"), P.NO_FILTER, "week")


@query("e10_trend_by_business_long")
def _(x):
    return E.trend_by_business(x.sales, P.NO_FILTER, "month", wide=False)


@query("e11_trend_overlay")
def _(x):
    return E.trend_overlay(x.sales, PERIOD, "week")


@query("e12_by_dimension")
def _(x):
    return union(*[tagged(E.by_dimension(x.sales, P.NO_FILTER, d), "dim", d) for d in ("store", "brand", "business", "cat_medium")])


@query("e13_segment_split")
def _(x):
    return E.segment_split(x.sales, "brand_nm", 10)


@query("e14_top_plus_other")
def _(x):
    return E.top_plus_other(x.sales, "cat_medium", "gmv", 10)


@query("e15_concept_share")
def _(x):
    return E.concept_share(D.with_concept(x.sales, x.concepts))


@query("e16_drill")
def _(x):
    return E.drill_levels(x.sales, x.stock_store, x.goods_attr).filter(F.col("level") != E.TOTAL_LEVEL)


@query("e16_drill_filtered")
def _(x):
    f = SalesFilter(store=[STORES[2]], brand=["Brand 1", "Brand 5"], date_from="2000-01-01")
    return E.drill(x.sales, x.stock_store, x.goods_attr, "cat_large", f, limit=50)


@query("e17_brand_detail")
def _(x):
    profit = R.profit_by_brand(x.sales, x.settlement, P.NO_FILTER, AS_OF)
    return E.brand_detail(x.sales, profit, H.stock_by(x.stock, "brand_nm", STORES))


@query("e18_goods_detail")
def _(x):
    profit = R.profit_by_goods(x.sales, x.settlement, P.NO_FILTER, AS_OF)
    rows = E.goods_detail(x.sales, x.stock_goods, profit)
    rows = D.catalog_enrich(rows, x.goods_master).join(H.operating_stores(x.stock_store), "goods_no", "left")
    return rows.withColumn("op_stores", F.coalesce("op_stores", F.lit(0)).cast("bigint"))


@query("e19_goods_by_store")
def _(x):
    return E.goods_by_store(x.sales, x.stock_store, x.settlement)


@query("e20_allocate_profit")
def _(x):
    return R.allocate_profit(x.sales_option, x.settlement_option, x.stock_store)


@query("e21_brand_by_store")
def _(x):
    return E.brand_by_store(x.sales, x.stock_store, x.goods_attr)


@query("e21_brand_by_store_filtered")
def _(x):
    return E.brand_by_store(x.sales, x.stock_store, x.goods_attr, SalesFilter(date_from="2001-01-01", cat_top=["ECONOMY", "PROMO"]))


@query("e22_target_attainment")
def _(x):
    return T.target_attainment(x.target_daily, x.sales, T.target_month(x.target_daily, x.sales, AS_OF))


@query("e23_target_totals")
def _(x):
    tm = T.target_month(x.target_daily, x.sales, AS_OF, "2001-05-01")
    return T.target_totals(T.target_attainment(x.target_daily, x.sales, tm), tm)


@query("e24_target_daily_curve")
def _(x):
    return T.target_daily_curve(x.target_daily, x.sales, T.target_month(x.target_daily, x.sales, AS_OF))


@query("e25_pnl")
def _(x):
    views = [
        tagged(R.pnl(x.settlement_daily, "month", None, "store"), "view", "month"),
        tagged(R.pnl(x.settlement_daily, "day", "2001-06-29", "brand"), "view", "day"),
        tagged(R.pnl(x.settlement_daily, "range", "2001-06-20", "store", "2001-05-10", types=["ASIA", "EUROPE"]), "view", "range"),
    ]
    return union(*views)


@query("e26_pnl_totals")
def _(x):
    return R.pnl_totals(R.pnl(x.settlement_daily, "month", "2001-05-01", "brand"))


@query("e26_pnl_months")
def _(x):
    return R.pnl_months(x.settlement_daily)


@query("e26_pnl_provisional")
def _(x):
    return R.pnl_provisional(x.settlement_daily, "month", "2001-04-01")


@query("e27_demographic_gmv")
def _(x):
    return union(*[tagged(E.demographic_gmv(x.customer, P.NO_FILTER, c), "attribute", c) for c in ("sex", "age_band", "member")])


@query("e28_demographic_share")
def _(x):
    return E.demographic_share(E.demographic_gmv(x.customer, P.NO_FILTER, "age_band"), ["A0", "A1", "A2", "A3", "A4"])


@query("e29_conversion")
def _(x):
    return E.conversion(x.footfall, x.receipts, P.NO_FILTER)


@query("e29_conversion_month")
def _(x):
    rows = E.conversion(x.footfall, x.receipts, SalesFilter(date_from="2001-07-01", date_to="2001-07-30"))
    totals = E.conversion_totals(rows).withColumn("store_name", F.lit(L.TOTAL)).withColumn("shop_type", F.lit(""))
    return rows.unionByName(totals)


@query("e30_country_sales")
def _(x):
    return E.country_sales(x.global_customer)


@query("e31_foreign_ratio_by")
def _(x):
    return E.foreign_ratio_by(x.sales, "store_name")


@query("e32_previous_period_growth")
def _(x):
    return E.previous_period_growth(x.sales, PERIOD)


@query("e33_with_totals")
def _(x):
    rows = E.with_rates(x.sales.groupBy("brand_nm").agg(*E.measure_sums()))
    rates = {"discount_rate": discount_rate("gmv", "normal_amt"), "foreign_ratio": ratio("foreign_gmv", "gmv")}
    return E.with_totals(rows, "brand_nm", list(E.MEASURES), rates)


@query("e34_covered_profit_rate")
def _(x):
    profit = R.profit_by_goods(x.sales, x.settlement, P.NO_FILTER, AS_OF)
    goods = x.sales.groupBy("goods_no").agg(F.sum("gmv").alias("gmv"))
    return R.covered_profit_rate(goods.join(profit, "goods_no", "left"))


@query("e35_ab_compare")
def _(x):
    return union(*[tagged(E.ab_compare(x.sales, A_RANGE, B_RANGE, d), "dim", d) for d in ("store", "category", "brand")])


@query("e35_ab_compare_goods")
def _(x):
    return E.ab_compare(x.sales, A_RANGE, B_RANGE, "goods")


# ---------------------------------------------------------------- F: reference-day comparison

REF = "2001-07-18"


@query("f1_compare_windows")
def _(x):
    span = x.stored("sales").span
    return union(*[C.windows_frame(x.sales, r, span) for r in (None, REF, "1995-01-05", "2001-03-31", "2000-12-31")])


@query("f2_compare_sums")
def _(x):
    return C.compare_sums(x.sales, C.sales_windows(x.sales, REF), ["store_name", "cat_top"])


@query("f3_add_growth")
def _(x):
    w = C.sales_windows(x.sales, "1995-01-20")
    return C.add_growth(C.compare_sums(x.sales, w, ["brand_nm"]), w)


@query("f4_compare_by")
def _(x):
    w = C.sales_windows(x.sales, REF)
    parts = [("store_name", None), ("cat_large", None), ("brand_nm", 10)]
    return union(*[tagged(C.compare_by(x.sales, w, k, cap=n), "dim", k) for k, n in parts])


@query("f5_compare_goods")
def _(x):
    return C.compare_goods(x.sales, x.goods_master, C.sales_windows(x.sales, REF))


@query("f6_compare_summary")
def _(x):
    return C.compare_summary(x.sales, C.sales_windows(x.sales))


# ---------------------------------------------------------------- G: daily report


@query("g1_recent_dates")
def _(x):
    return G.recent_dates(x.sales, AS_OF)


@query("g2_day_totals")
def _(x):
    return G.day_totals(x.sales, G.ReportDays(x.sales, AS_OF))


@query("g3_recent_trend")
def _(x):
    return G.recent_trend(x.sales, G.ReportDays(x.sales, AS_OF))


@query("g4_rank_by")
def _(x):
    days = G.ReportDays(x.sales, AS_OF)
    return union(
        G.rank_by(x.sales, days, "store_name").selectExpr("'store' entity", "store_name name", "shop_type detail", "gmv", "qty", "share"),
        G.rank_by(x.sales, days, "brand_nm", 100).selectExpr("'brand' entity", "brand_nm name", "cast(null as string) detail", "gmv", "qty", "share"),
        G.rank_by(x.sales, days, "goods_no", 100).selectExpr("'goods' entity", "cast(goods_no as string) name", "brand detail", "gmv", "qty", "share"),
    )


@query("g5_rank_in_category")
def _(x):
    return G.rank_in_category(x.sales, G.ReportDays(x.sales, AS_OF), "brand_nm", 10, 5)


@query("g5_rank_goods_in_category")
def _(x):
    return G.rank_in_category(x.sales, G.ReportDays(x.sales, AS_OF), "goods_no", 10, 10)


@query("g6_notable_goods")
def _(x):
    return G.notable_goods(x.sales, x.stock_goods, G.ReportDays(x.sales, AS_OF))


@query("g7_restock")
def _(x):
    return G.restock(x.sales, x.stock_store, x.stock_goods, G.ReportDays(x.sales, AS_OF))


@query("g8_urgent_restock")
def _(x):
    return G.urgent_restock(G.restock(x.sales, x.stock_store, x.stock_goods, G.ReportDays(x.sales, AS_OF)))


@query("g9_store_spikes")
def _(x):
    return G.store_spikes(x.sales, G.ReportDays(x.sales, AS_OF))


# ---------------------------------------------------------------- H: stock


@query("h1_stock_long")
def _(x):
    return plan(x, "stock_rows")


@query("h2_hub_stock")
def _(x):
    return plan(x, "hubs")


@query("h3_stock_meta")
def _(x):
    return plan(x, "stock_meta")


@query("h3_stock_pivot")
def _(x):
    return H.stock_pivot(x.stock_rows, x.stock_meta, STORES)


@query("h4_stock_by_goods")
def _(x):
    return plan(x, "stock_goods")


@query("h4_stock_store_long")
def _(x):
    return plan(x, "stock_store")


@query("h5_stock_by")
def _(x):
    return H.stock_by(x.stock, "brand_nm", STORES)


@query("h5_stock_by_goods_stores")
def _(x):
    return H.stock_by(x.stock, "goods_no", STORES)


@query("h6_operating_stores")
def _(x):
    return H.operating_stores(x.stock_store)


@query("h7_stock_kpis")
def _(x):
    return H.stock_kpis(P.apply_stock_filter(x.stock, P.NO_FILTER))


@query("h8_stock_by_store_business")
def _(x):
    return H.stock_by_store_business(P.apply_stock_filter(x.stock, P.NO_FILTER))


@query("h9_stock_category_share")
def _(x):
    return H.stock_category_share(P.apply_stock_filter(x.stock, P.NO_FILTER))


@query("h10_stock_table")
def _(x):
    return D.catalog_enrich(H.stock_table(P.apply_stock_filter(x.stock, P.NO_FILTER), STORES), x.goods_master)


@query("h11_stock_export_long")
def _(x):
    return H.stock_export_long(P.apply_stock_filter(x.stock, P.NO_FILTER))


# ---------------------------------------------------------------- I: weekly sell-through


@query("i1_week_frame")
def _(x):
    return K.weeks_row(AS_OF, x.inputs["stock_history"], x.inputs["stock_summary"])


@query("i2_store_locations")
def _(x):
    return plan(x, "locations")


@query("i3_purchase_brands")
def _(x):
    return plan(x, "purchase_brands")


@query("i4_weekly_sums")
def _(x):
    return plan(x, "offline")


@query("i4_weekly_sums_online")
def _(x):
    return plan(x, "online")


@query("i5_representative")
def _(x):
    return K.representative(x.online_divisions.filter(F.col("gmv4") > 0), ["brand_id", "ord_com_type"], "hier", "gmv4", ["AFRICA"])


@query("i6_brand_scope")
def _(x):
    return plan(x, "brand_scope")


@query("i7_classify_stock")
def _(x):
    return plan(x, "classified_stock")


@query("i8_stock_positions")
def _(x):
    parts = [tagged(K.stock_positions(x.classified_stock, x.weeks, p), "kind", k) for p, k in ((True, L.PURCHASE), (False, L.CONSIGNMENT))]
    return union(*parts)


@query("i9_axis")
def _(x):
    return x.axis


@query("i10_typical_price")
def _(x):
    return K.typical_price(x.inputs["goods_scope"], x.inputs["stock_summary"], x.weeks)


@query("i11_sell_through")
def _(x):
    return plan(x, "ips")


@query("i12_open_orders")
def _(x):
    i = x.inputs
    by_brand = K.open_orders(i["open_po"], i["goods_scope"], AS_OF, PLANTS.first).withColumnRenamed("brand_code", "key")
    by_goods = K.open_orders(i["open_po"], i["goods_scope"], AS_OF, PLANTS.first, "goods").withColumnRenamed("product_no", "key")
    return union(by_brand, by_goods)


@query("i13_sell_through_goods")
def _(x):
    return plan(x, "ips_goods")


@query("i14_sell_through_totals")
def _(x):
    return K.sell_through_totals(x.ips)


@query("i15_channel_view")
def _(x):
    return K.channel_view(x.ips, "tot")


@query("i15_channel_view_online")
def _(x):
    return K.channel_view(x.ips, "on")


@query("i15_channel_view_offline")
def _(x):
    return K.channel_view(x.ips, "off")


@query("i16_sell_through_drill")
def _(x):
    return K.sell_through_drill(x.ips_goods, "Brand#1", L.PURCHASE)
