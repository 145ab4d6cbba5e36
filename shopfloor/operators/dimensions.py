"""Dimensions and enrichment."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shopfloor.functions import labels as L
from shopfloor.functions.numeric import MONEY
from shopfloor.sources.tables import latest_snapshot

CATEGORIES = ("cat_top", "cat_large", "cat_medium")


def dim_store(shops: DataFrame, names: DataFrame, shop_types: Sequence[str], special: Mapping[int, str]) -> DataFrame:
    """One row per store of the allowed types; `special` gives single stores a type of their own."""
    base = (
        shops.filter(F.col("shop_type").isin(list(shop_types)))
        .select(F.col("shop_no").cast("int").alias("shop_no"), "shop_type", "shop_nm")
        .distinct()
    )
    own = names.select(F.col("shop_no").cast("int").alias("shop_no"), "shop_name")
    shop_type = F.upper("shop_type")
    for no, label in special.items():
        shop_type = F.when(F.col("shop_no") == no, F.lit(label)).otherwise(shop_type)
    name = F.regexp_replace(F.trim(F.coalesce("shop_name", "shop_nm")), " +", " ")
    return base.join(own, "shop_no", "left").select("shop_no", shop_type.alias("shop_type"), name.alias("store_name"))


def margin_business_type(col: str) -> Column:
    return (
        F.when(F.col(col) == L.MARGIN_CONSIGNMENT, L.CONSIGNMENT)
        .when(F.col(col) == L.MARGIN_PURCHASE, L.PURCHASE)
        .otherwise(L.OTHER)
    )


def supply_business_type(col: str) -> Column:
    return (
        F.when(F.col(col) == L.SUPPLY_CONSIGNMENT, L.CONSIGNMENT)
        .when(F.col(col) == L.SUPPLY_PURCHASE, L.PURCHASE)
        .otherwise(L.OTHER)
    )


def dim_brand(company_brand: DataFrame, brand: DataFrame, company: DataFrame) -> DataFrame:
    """(company, brand) -> brand name and business type, one row per pair."""
    names = brand.select(F.col("brand").alias("brand_code"), "brand_nm")
    return (
        company_brand.select("com_id", F.col("brand").alias("brand_code"))
        .distinct()
        .join(names, "brand_code", "left")
        .join(company.select("com_id", "margin_type"), "com_id", "left")
        .select("com_id", "brand_code", "brand_nm", margin_business_type("margin_type").alias("business_type"))
    )


def least_texts(rows: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """One row per key with the least value of each text (column -> name in the result).

    A text minimum over raw rows would sort all of them; combinations are hashed, and the minima run
    over the few that a key has. A plain distinct would be merged into the minima again, as these
    don't mind repeats; the test of its count keeps it."""
    few = rows.groupBy(*keys, *texts).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 0)
    return few.groupBy(*keys).agg(*[F.min(a).alias(b) for a, b in texts.items()])


def named_sums(rows: DataFrame, keys: list[str], texts: dict[str, str], sums: dict[str, Column]) -> DataFrame:
    """Sums per key with the least value of each text. The texts are keys of a first sum, which
    hashes the rows; see `least_texts`."""
    first = rows.groupBy(*keys, *texts).agg(*[c.alias(n) for n, c in sums.items()])
    if not texts:
        return first
    return first.groupBy(*keys).agg(*[F.min(a).alias(b) for a, b in texts.items()], *[F.sum(n).alias(n) for n in sums])


def category_map(stock_summary: DataFrame) -> DataFrame:
    """goods -> categories and MD from the latest stock snapshot."""
    now = latest_snapshot(stock_summary, "ord_state_date")
    return least_texts(now, ["goods_no"], {**{c: c for c in CATEGORIES}, "offline_md_id": "off_md_id"})


def sold_goods(lines: DataFrame, orders: DataFrame, stores: DataFrame) -> DataFrame:
    """Goods ever ordered in scope, whatever the order status; dummy orders do not count."""
    scope = orders.filter(F.col("dummy_order") == 0).join(stores.select("shop_no"), "shop_no", "left_semi").select("order_id")
    return lines.select("order_id", "goods_no").join(scope, "order_id").select("goods_no").distinct()


def quarantine_prices(prices: DataFrame) -> DataFrame:
    """Drop each (goods, time) batch with more than one distinct price.

    Min <> max says the same as count distinct > 1 but combines on the map side, so a goods with
    a very large batch never sends its rows to one task for the test."""
    key = ["goods_id", "created_at"]
    bad = prices.groupBy(key).agg(F.min("sale_price").alias("lo"), F.max("sale_price").alias("hi"))
    return prices.join(bad.filter(F.col("lo") < F.col("hi")).select(key), key, "left_anti")


def latest_by_key(df: DataFrame, keys: list[str], order_col: str, tie_break: list[str] = ()) -> DataFrame:
    """Most recent row per key. max over a struct combines on the map side, unlike row_number,
    so a hot key costs one row per task. Ties go to the greatest remaining columns."""
    rest = [c for c in df.columns if c not in keys and c != order_col and c not in tie_break]
    row = F.struct(order_col, *tie_break, *rest)
    return df.groupBy(*keys).agg(F.max(row).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in df.columns if c not in keys])


def latest_prices(price_feed: DataFrame, channel: int = L.PRICE_CHANNEL) -> DataFrame:
    """Newest trustworthy price of one channel per goods. The batches are reduced to one row each,
    and those with conflicting prices dropped, in the same pass, so the feed is read once."""
    batches = price_feed.filter(F.col("channel_id") == channel).groupBy("goods_id", "created_at").agg(
        F.min("sale_price").alias("lo"), F.max("sale_price").alias("sale_price"), F.max("basic_price").alias("basic_price")
    )
    good = batches.filter(F.col("lo").eqNullSafe(F.col("sale_price"))).drop("lo")
    return latest_by_key(good, ["goods_id"], "created_at")


def goods_master(
    sold: DataFrame, goods_main: DataFrame, brand: DataFrame, price_feed: DataFrame, goods_secondary: DataFrame
) -> DataFrame:
    """One row per sold goods, each field from the first source that has it.

    The large masters are cut to sold goods by a semi join before anything else touches them."""
    main = goods_main.join(sold, "goods_no", "left_semi").join(brand.select("brand", "brand_nm"), "brand", "left")
    main = main.groupBy("goods_no").agg(
        F.min("goods_nm").alias("m_nm"),
        F.min("brand_nm").alias("m_brand"),
        F.min(F.col("reg_dm").cast("date")).alias("reg_date"),
        F.min("style_no").alias("m_style"),
        F.min("normal_price").alias("m_list"),
        F.min("price").alias("m_price"),
    )
    scope = sold.select(F.col("goods_no").alias("goods_id"))
    px = latest_prices(price_feed.join(scope, "goods_id", "left_semi")).select(
        F.col("goods_id").alias("goods_no"), F.col("sale_price").alias("f_sale"), F.col("basic_price").alias("f_list")
    )
    second = latest_by_key(goods_secondary.join(scope, "goods_id", "left_semi"), ["goods_id"], "updated_at").select(
        F.col("goods_id").alias("goods_no"),
        F.col("goods_name").alias("s_nm"),
        F.col("brand_name").alias("s_brand"),
        F.col("basic_price").alias("s_list"),
        F.col("sale_price").alias("s_sale"),
    )
    zero = F.lit(0)
    return (
        sold.join(main, "goods_no", "left")
        .join(px, "goods_no", "left")
        .join(second, "goods_no", "left")
        .select(
            "goods_no",
            F.coalesce("m_nm", "s_nm", F.lit("")).alias("goods_nm"),
            F.coalesce("m_brand", "s_brand", F.lit("")).alias("brand_nm"),
            "reg_date",
            F.coalesce("m_style", F.lit("")).alias("style_no"),
            F.coalesce("m_list", "f_list", "s_list", zero).cast(MONEY).alias("normal_price"),
            F.coalesce("f_sale", "m_price", "s_sale", "m_list", "f_list", "s_list", zero).cast(MONEY).alias("sale_price"),
        )
    )


def concept_map(settlement_summary: DataFrame) -> DataFrame:
    """(company, brand) -> concept where one is given."""
    return (
        settlement_summary.filter(F.col("concept").isNotNull() & (F.col("concept") != ""))
        .groupBy("company_id", "brand_id")
        .agg(F.min("concept").alias("concept"))
    )


def with_concept(df: DataFrame, concepts: DataFrame) -> DataFrame:
    out = df.join(concepts, ["company_id", "brand_id"], "left")
    return out.withColumn("concept", F.coalesce("concept", F.lit(L.UNASSIGNED_CONCEPT)))


def mode_name(sources: list[DataFrame], key: str, name: str) -> DataFrame:
    """Most frequent non-blank name per id over the union of the sources; ties go to the first name.

    The counts are aggregated first, then the best of the few names per id is one more aggregate."""
    rows = reduce(DataFrame.unionByName, [s.select(key, name) for s in sources])
    rows = rows.filter(F.col(key).isNotNull() & (F.trim(name) != ""))
    counts = rows.groupBy(key, name).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min_by(name, F.struct(-F.col("n"), F.col(name))).alias(name))


def catalog_enrich(rows: DataFrame, goods: DataFrame) -> DataFrame:
    """Style number, list price and effective sale price (0 means no discount)."""
    cat = goods.select(
        "goods_no",
        "style_no",
        "normal_price",
        F.when(F.col("sale_price") > 0, F.col("sale_price")).otherwise(F.col("normal_price")).alias("sale_price"),
    )
    out = rows.join(cat, "goods_no", "left")
    zero = F.lit(0).cast(MONEY)
    return out.withColumns({
        "style_no": F.coalesce("style_no", F.lit("")),
        "normal_price": F.coalesce("normal_price", zero),
        "sale_price": F.coalesce("sale_price", zero),
    })


def brand_override(sales: DataFrame, goods: DataFrame) -> DataFrame:
    """Names from the goods master, then from the dimension, then the default label."""
    names = goods.select(
        "goods_no",
        F.col("brand_nm").alias("_brand"),
        F.col("goods_nm").alias("_nm"),
        "reg_date",
        "style_no",
        "normal_price",
        "sale_price",
    )
    out = sales.join(names, "goods_no", "left")
    return out.withColumns({
        "brand_nm": F.coalesce(F.nullif("_brand", F.lit("")), "brand_nm", F.lit(L.UNMATCHED_BRAND)),
        "goods_nm": F.coalesce("_nm", F.lit("")),
        **{c: F.coalesce(c, F.lit(L.UNCLASSIFIED)) for c in CATEGORIES},
        "off_md_id": F.coalesce("off_md_id", F.lit("")),
    }).drop("_brand", "_nm")


def zero_qty_brand(sales: DataFrame, brand: str | None) -> DataFrame:
    """The shopping-bag brand, if there is one, sells no units but keeps its money."""
    if brand is None:
        return sales
    return sales.withColumn("qty", F.when(F.col("brand_nm") == brand, F.lit(0).cast("bigint")).otherwise(F.col("qty")))
