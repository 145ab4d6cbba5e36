"""Scans with declared schemas, snapshots and CSV export."""

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from shopfloor.functions.dates import max_date
from shopfloor.session import released

# Schemas of the input roles, as DDL.
SCHEMAS = {
    "shop": "shop_no INT, shop_type STRING, shop_nm STRING",
    "shop_name": "shop_no INT, shop_name STRING",
    "order_header": "order_id BIGINT, shop_no INT, transaction_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, "
    "order_status INT, dummy_order INT, tax_refund_type STRING",
    "order_line": "order_id BIGINT, goods_no BIGINT, company_id STRING, brand_id STRING, goods_name STRING, "
    "option_name STRING, quantity BIGINT, order_amount DECIMAL(14,2), normal_amount DECIMAL(14,2), pay_amount DECIMAL(14,2)",
    "claim": "order_id BIGINT, claim_type STRING, created_at TIMESTAMP_NTZ",
    "company": "com_id STRING, margin_type STRING, md_id STRING, md_nm STRING",
    "company_brand": "com_id STRING, brand STRING",
    "brand": "brand STRING, brand_nm STRING",
    "stock_summary": "ord_state_date DATE, shop_no INT, barcode STRING, goods_no BIGINT, goods_opt STRING, goods_nm STRING, "
    "brand STRING, brand_nm STRING, com_id STRING, ord_com_type STRING, cat_top STRING, cat_large STRING, cat_medium STRING, "
    "offline_md_id STRING, md_id STRING, md_nm STRING, sellable_qty BIGINT, available_qty BIGINT, normal_price DECIMAL(14,2)",
    "goods_main": "goods_no BIGINT, goods_nm STRING, brand STRING, reg_dm DATE, style_no STRING, normal_price DECIMAL(14,2), "
    "price DECIMAL(14,2), md_id STRING, md_nm STRING",
    "goods_secondary": "goods_id BIGINT, goods_name STRING, brand_name STRING, basic_price DECIMAL(14,2), "
    "sale_price DECIMAL(14,2), updated_at DATE",
    "price_feed": "goods_id BIGINT, created_at TIMESTAMP_NTZ, channel_id INT, sale_price DECIMAL(14,2), basic_price DECIMAL(14,2)",
    "goods_scope": "goods_no BIGINT, goods_nm STRING, brand STRING, brand_nm STRING, com_id STRING, normal_price DECIMAL(14,2)",
    "target": "dt STRING, shop_no INT, gmv_goal DECIMAL(20,2), contribution_profit_goal DECIMAL(20,2)",
    "visits": "dt STRING, shop_no INT, visitors_int INT",
    "tax_free": "order_id STRING, nationality STRING",
    "settlement_summary": "ord_state_date DATE, shop_no INT, goods_no BIGINT, goods_nm STRING, option_nm STRING, brand_id STRING, "
    "brand_nm STRING, large_nm STRING, medium_nm STRING, company_id STRING, concept STRING, ord_com_type STRING, qty BIGINT, "
    "sell_qty BIGINT, clm_qty BIGINT, ord_amt DECIMAL(14,2), normal_amt DECIMAL(14,2), pay_amt DECIMAL(14,2), "
    "coupon_dc_amt DECIMAL(14,2), profit DECIMAL(14,2), contribution_profit_pre DECIMAL(14,2), "
    "contribution_profit DECIMAL(14,2), offline_cost_fixed DECIMAL(14,2), additional_rev DECIMAL(14,2)",
    "customer_summary": "ord_state_date DATE, shop_no INT, sex STRING, age_band_custom STRING, mssid_yn STRING, "
    "summary_period_unit STRING, gmv DECIMAL(14,2), normal_gmv DECIMAL(14,2), tax_gmv DECIMAL(14,2), qty BIGINT, "
    "buyer BIGINT, tax_buyer BIGINT",
    "erp_stock": "dt DATE, store_cd STRING, lgort STRING, barcode STRING, wqty BIGINT",
    "plant_stock": "barcode STRING, goods_no BIGINT, option_name STRING, plant_code STRING, storage_location STRING, available_stock BIGINT",
    "shop_location": "erp_plant_code STRING, erp_location_code STRING, shop_no INT",
    "fulfil_stock": "sku_id BIGINT, mfs_stock_qty BIGINT",
    "hub_meta": "sku_id BIGINT, supplier_barcode STRING, strd_dt DATE, brand_name STRING, product_no BIGINT, "
    "product_name STRING, option_name STRING",
    "online_orders": "ord_state_date DATE, brand STRING, com_id STRING, ord_com_type STRING, hier STRING, goods_no BIGINT, "
    "sell_sub_clm_qty BIGINT, normal_gmv DECIMAL(14,2), normal_ggmv DECIMAL(14,2), revenue DECIMAL(14,2), "
    "contribution_profit_pre DECIMAL(14,2), mem_dc DECIMAL(14,2), cou_dc DECIMAL(14,2), cart_cou_dc DECIMAL(14,2)",
    "stock_history": "base_date DATE, product_no STRING, com_id STRING, biz_type STRING, platform STRING, "
    "storage_loc_cd STRING, storage_loc_nm STRING, end_stock_qty BIGINT",
    "closing": "buper STRING, werks STRING, lgort STRING, lgobe STRING",
    "open_po": "s_matnr STRING, menge BIGINT, werks STRING, loekz STRING, eindt STRING",
}


def load(spark: SparkSession, directory: str, name: str, schema: str | None = None, suffix: str = "") -> DataFrame:
    """Scan one Parquet table. The schema is declared, so no job runs to infer it, and the
    projection and filters are left to the optimizer."""
    return spark.read.schema(schema or SCHEMAS[name]).parquet(os.path.join(directory, name + suffix))


class Tables:
    """Role name -> lazy DataFrame over a directory of Parquet tables, one per role."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __getitem__(self, role: str) -> DataFrame:
        return load(self.spark, self.directory, role)


def latest_snapshot(df: DataFrame, date_col: str) -> DataFrame:
    """Rows on the maximum snapshot date. The maximum is a scalar subquery, which Spark pushes
    into the scan as an equality filter, so other snapshots' row groups are skipped."""
    return df.filter(F.col(date_col) == max_date(df, date_col))


def export_csv(df: DataFrame, path: str, columns: list[str], context: dict[str, str] | None = None) -> str:
    """Header CSV in a fixed column order with plain numbers; `context` adds single-valued
    parent filters as leading columns. One file per task."""
    lead = [F.lit(v).alias(k) for k, v in (context or {}).items()]
    rows = df.select(*lead, *[F.col(c) for c in columns])
    with released(df.sparkSession):
        rows.write.mode("overwrite").option("header", True).csv(path)
    return path
