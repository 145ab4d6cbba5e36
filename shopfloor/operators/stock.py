"""Stock by barcode and location. The long form is the primary product; wide forms take an
explicit list of locations."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shopfloor.functions import labels as L
from shopfloor.functions.numeric import total
from shopfloor.operators.dimensions import CATEGORIES, latest_by_key, least_texts, named_sums, supply_business_type, with_concept
from shopfloor.operators.sales import top_plus_other
from shopfloor.sources.tables import latest_snapshot


@dataclass(frozen=True)
class Plants:
    """Codes of both plants and of their warehouses, as the stock sources write them."""

    first: str
    first_warehouses: tuple[str, ...]
    second: str
    second_warehouse: str


def latest_in_stores(stock_summary: DataFrame, stores: DataFrame) -> DataFrame:
    """Rows of the newest store snapshot; every stock dataset starts from them, so keep them."""
    now = latest_snapshot(stock_summary, "ord_state_date").filter(F.col("barcode").isNotNull())
    return now.withColumn("shop_no", F.col("shop_no").cast("int")).join(stores, "shop_no").select(
        "barcode", "store_name", "goods_no", "goods_opt", "goods_nm", "brand", "brand_nm", "com_id", "ord_com_type", *CATEGORIES,
        "offline_md_id", "sellable_qty",
    )


def plant2_in_stores(plant_stock: DataFrame, shop_location: DataFrame, stores: DataFrame, plants: Plants) -> DataFrame:
    """Store stock the second plant keeps, placed through the location map."""
    rows = plant_stock.filter((F.col("plant_code") == plants.second) & F.col("barcode").isNotNull())
    where = shop_location.select(
        F.col("erp_plant_code").alias("plant_code"), F.col("erp_location_code").alias("storage_location"),
        F.col("shop_no").cast("int").alias("shop_no"),
    ).join(stores, "shop_no")
    return rows.join(where, ["plant_code", "storage_location"])


def _in_first(plants: Plants) -> Column:
    return (F.col("store_cd") == plants.first) & F.col("lgort").isin(list(plants.first_warehouses))


def _in_second(plants: Plants) -> Column:
    return (F.col("store_cd") == plants.second) & (F.col("lgort") == plants.second_warehouse)


def latest_in_plants(erp_stock: DataFrame, plants: Plants) -> DataFrame:
    """Rows of the newest warehouse snapshot in the hubs of both plants. `hub_stock` reads them three times, and each would
    scan all snapshots, so keep them."""
    now = latest_snapshot(erp_stock, "dt").filter(F.col("barcode").isNotNull())
    return now.filter(_in_first(plants) | _in_second(plants)).select("barcode", "store_cd", "lgort", "wqty")


def hub_stock(
    store_rows: DataFrame, erp_rows: DataFrame, fulfil_stock: DataFrame, hub_meta: DataFrame, plants: Plants
) -> DataFrame:
    """(barcode, hub, qty) of both plants and the fulfilment centre."""
    in_stores = store_rows.select("barcode").distinct().hint("merge")  # see `stock_dataset`
    plant1 = erp_rows.filter(_in_first(plants)).join(in_stores, "barcode", "left_semi")
    plant2 = erp_rows.filter(_in_second(plants))
    side = lambda df, hub: df.groupBy("barcode").agg(total("wqty").cast("bigint").alias("qty")).withColumn("hub", F.lit(hub))
    plant2 = side(plant2, L.HUB_PLANT2)
    barcode = latest_by_key(
        hub_meta.filter(F.col("supplier_barcode").isNotNull()).select("sku_id", "supplier_barcode", "strd_dt"), ["sku_id"], "strd_dt"
    ).select("sku_id", F.col("supplier_barcode").alias("barcode"))
    scope = in_stores.unionByName(plant2.select("barcode")).distinct()
    per_sku = fulfil_stock.groupBy("sku_id").agg(total("mfs_stock_qty").alias("wqty"))
    centre = side(per_sku.join(barcode, "sku_id").join(scope.hint("merge"), "barcode", "left_semi"), L.HUB_FULFILMENT)
    return reduce(DataFrame.unionByName, [side(plant1, L.HUB_PLANT1), plant2, centre]).select("barcode", "hub", "qty")


def stock_long(store_rows: DataFrame, plant_rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """barcode x location with its quantity, stores and hubs alike."""
    a = store_rows.select("barcode", "store_name", F.col("sellable_qty").alias("qty"))
    b = plant_rows.select("barcode", "store_name", F.col("available_stock").alias("qty"))
    s = a.unionByName(b).groupBy("barcode", F.col("store_name").alias("location")).agg(total("qty").cast("bigint").alias("qty"))
    s = s.withColumn("location_kind", F.lit(L.STORE))
    h = hubs.select("barcode", F.col("hub").alias("location"), "qty").withColumn("location_kind", F.lit(L.HUB))
    return s.unionByName(h).select("barcode", "location_kind", "location", "qty")


def stock_meta(
    store_rows: DataFrame, plant_rows: DataFrame, hubs: DataFrame, hub_meta: DataFrame, goods_main: DataFrame, brand: DataFrame,
    concepts: DataFrame,
) -> DataFrame:
    """Attributes per barcode from the store side, then the second plant, then the warehouse, with
    names from the goods master where it has them. Rows: barcodes in a store or in the hub of the
    second plant; a barcode only the first plant's hub holds gets none."""
    same = ("goods_no", "goods_opt", "brand_nm", "goods_nm", *CATEGORIES, "business_type")
    a = least_texts(
        store_rows.withColumn("business_type", supply_business_type("ord_com_type")), ["barcode"],
        {**{c: c for c in same}, "offline_md_id": "off_md_id", "com_id": "company_id", "brand": "brand_id"},
    )
    b = least_texts(plant_rows, ["barcode"], {"goods_no": "b_goods", "option_name": "b_opt"})
    hub2 = hubs.filter(F.col("hub") == L.HUB_PLANT2).select("barcode").distinct().hint("merge")
    wh = hub_meta.filter(F.col("supplier_barcode").isNotNull()).withColumnRenamed("supplier_barcode", "barcode")
    wh = latest_by_key(wh.join(hub2, "barcode", "left_semi"), ["barcode"], "strd_dt").select(
        "barcode", F.col("product_no").alias("w_goods"), F.col("option_name").alias("w_opt"),
        F.col("brand_name").alias("w_brand"), F.col("product_name").alias("w_nm"),
    )
    rows = a.join(b, "barcode", "full_outer").join(hub2, "barcode", "full_outer").join(wh, "barcode", "left")
    names = goods_main.join(brand.select("brand", F.col("brand_nm").alias("_bn")), "brand", "left").groupBy("goods_no").agg(
        F.min("goods_nm").alias("m_nm"), F.min("_bn").alias("m_brand")
    )
    blank = F.lit("")
    rows = rows.withColumn("goods_no", F.coalesce("goods_no", "b_goods", "w_goods", F.lit(0)).cast("bigint"))
    rows = rows.join(names, "goods_no", "left")
    rows = rows.select(
        "barcode", "goods_no",
        F.coalesce("goods_opt", "b_opt", "w_opt", blank).alias("goods_opt"),
        F.coalesce(F.nullif("m_brand", blank), "brand_nm", "w_brand", F.lit(L.UNKNOWN_BRAND)).alias("brand_nm"),
        F.coalesce(F.nullif("m_nm", blank), "goods_nm", "w_nm", blank).alias("goods_nm"),
        *[F.coalesce(c, F.lit(L.UNCLASSIFIED)).alias(c) for c in CATEGORIES],
        F.coalesce("off_md_id", blank).alias("off_md_id"),
        F.coalesce("company_id", blank).alias("company_id"), F.coalesce("brand_id", blank).alias("brand_id"),
        F.coalesce("business_type", F.lit(L.PURCHASE)).alias("business_type"),
    )
    return with_concept(rows, concepts.hint("merge"))


def stock_dataset(long: DataFrame, meta: DataFrame) -> DataFrame:
    """Long stock with the attributes of its barcode; barcodes without attributes have no row. The attributes have a row for
    each barcode, and as a file they are so small that Spark would send them whole through the driver; so they are merged."""
    return long.join(meta.hint("merge"), "barcode")


_kind = lambda kind: F.when(F.col("location_kind") == kind, F.col("qty"))
_at = lambda name: F.when((F.col("location_kind") == L.HUB) & (F.col("location") == name), F.col("qty"))
_sum = lambda c, name: total(c).cast("bigint").alias(name)


def _wide(stores: list[str]) -> list:
    """Explicit conditional sums: one pass, map-side combined, and no job to find the locations."""
    here = lambda s: F.when((F.col("location_kind") == L.STORE) & (F.col("location") == s), F.col("qty"))
    return [_sum(here(s), s) for s in stores] + [_sum(_at(h), h) for h in L.HUBS]


META = ("goods_no", "goods_opt", "brand_nm", "goods_nm", *CATEGORIES, "off_md_id", "company_id", "brand_id", "business_type", "concept")


def stock_pivot(long: DataFrame, meta: DataFrame, stores: list[str]) -> DataFrame:
    """One row per barcode: stores wide, three hubs, both totals and the attributes."""
    wide = long.groupBy("barcode").agg(*_wide(stores), _sum(_kind(L.STORE), "store_total"), _sum(_kind(L.HUB), "hub_total"))
    return meta.join(wide, "barcode")


def stock_by_goods(stock: DataFrame) -> DataFrame:
    """Stock summed to goods. goods 0 collects what no source could map."""
    parts = {
        "store_stock": _kind(L.STORE), "hub_total": _kind(L.HUB), "hub1000": _at(L.HUB_PLANT1), "hub1700": _at(L.HUB_PLANT2),
        "mfs": _at(L.HUB_FULFILMENT),
    }
    return named_sums(stock, ["goods_no"], {"goods_nm": "goods_nm"}, {n: total(c).cast("bigint") for n, c in parts.items()})


def stock_store_long(stock: DataFrame) -> DataFrame:
    """goods x store stock. Pairs without any stock row are absent and read as 0 in left joins."""
    s = stock.filter(F.col("location_kind") == L.STORE)
    return s.groupBy("goods_no", F.col("location").alias("store_name")).agg(_sum("qty", "stock"))


def stock_by(stock: DataFrame, key: str, stores: list[str]) -> DataFrame:
    """Store-wise stock per goods or brand."""
    s = stock.filter(F.col("location_kind") == L.STORE)
    return s.groupBy(key).agg(*[_sum(F.when(F.col("location") == n, F.col("qty")), n) for n in stores])


def operating_stores(stock_store: DataFrame) -> DataFrame:
    """Stores holding at least one unit, per goods."""
    return stock_store.groupBy("goods_no").agg(F.count(F.when(F.col("stock") >= 1, 1)).alias("op_stores"))


def stock_kpis(stock: DataFrame) -> DataFrame:
    """Store total, hub total, options and goods. Options are summed per barcode first, so both
    counts run on barcodes and not on locations."""
    b = stock.groupBy("barcode", "goods_no").agg(_sum(_kind(L.STORE), "s"), _sum(_kind(L.HUB), "h"))
    return b.agg(
        _sum("s", "jaego"), _sum("h", "hub"), F.count(F.lit(1)).alias("options"), F.countDistinct("goods_no").alias("goods")
    )


def stock_by_store_business(stock: DataFrame) -> DataFrame:
    s = stock.filter(F.col("location_kind") == L.STORE)
    by = [_sum(F.when(F.col("business_type") == b, F.col("qty")), b) for b in L.BUSINESS_TYPES]
    out = s.groupBy(F.col("location").alias("name")).agg(*by)
    out = out.withColumn("total", reduce(lambda x, y: x + y, [F.col(b) for b in L.BUSINESS_TYPES]))
    return out.filter(F.col("total") > 0).orderBy("total", "name")


def stock_category_share(stock: DataFrame, n: int = 8) -> DataFrame:
    """Store and hub stock per category level, the largest n and the rest with their number."""
    parts = []
    for level in CATEGORIES:
        name = F.coalesce(F.nullif(F.trim(level), F.lit("")), F.lit(L.UNCLASSIFIED_STOCK))
        parts.append(top_plus_other(stock.withColumn("_c", name), "_c", "qty", n, counted=True).withColumn("level", F.lit(level)))
    return reduce(DataFrame.unionByName, parts).select("level", "name", F.col("value").cast("bigint").alias("value"))


OPTION = ("barcode", "brand_nm", "goods_nm", "goods_no", "goods_opt", "business_type", *CATEGORIES)


def stock_table(stock: DataFrame, stores: list[str], limit: int | None = None) -> DataFrame:
    """Options with their wide stock; with a limit those with the most store stock, then hub stock."""
    out = stock.groupBy(*OPTION).agg(*_wide(stores), _sum(_kind(L.STORE), "store_total"), _sum(_kind(L.HUB), "hub_total"))
    return out if limit is None else out.orderBy(F.desc("store_total"), F.desc("hub_total"), "barcode").limit(limit)


def stock_export_long(stock: DataFrame) -> DataFrame:
    """option x location rows with the kind of location; empty ones are left out."""
    return stock.filter(F.col("qty") != 0).select(*OPTION, "location_kind", "location", "qty")
