"""The CSV exports: rows of a report with catalogue columns, in a fixed column order."""

from pyspark.sql import DataFrame, functions as F

from shopfloor.functions.numeric import dbl
from shopfloor.operators.dimensions import catalog_enrich

# Column order of each export.
OPTION_COLUMNS = (
    "sales_date store_name cat_large cat_medium brand_nm goods_no style_no goods_nm option_nm normal_price sale_price unit_price "
    "qty gmv normal_amt pay net_take cp stock"
).split()
BRAND_STORE_COLUMNS = "business_type brand_nm store_name qty gmv normal_amt pay foreign_gmv discount_rate stock".split()
STOCK_COLUMNS = "barcode brand_nm goods_nm goods_no goods_opt business_type cat_top cat_large cat_medium location_kind location qty".split()
RESTOCK_COLUMNS = "store_name brand_nm goods_no goods_nm sold store_stock hub_total".split()


def option_export(allocated: DataFrame, goods: DataFrame) -> DataFrame:
    """Rows of `allocate_profit` with style, list and sale price and the price paid per unit (0 without units)."""
    unit = F.when(F.col("qty") != 0, dbl("gmv") / dbl("qty")).otherwise(F.lit(0.0))
    return catalog_enrich(allocated, goods).withColumn("unit_price", unit).select(*OPTION_COLUMNS)


def brand_store_export(rows: DataFrame) -> DataFrame:
    return rows.select(*BRAND_STORE_COLUMNS)


def stock_export(rows: DataFrame) -> DataFrame:
    return rows.select(*STOCK_COLUMNS)


def restock_export(rows: DataFrame) -> DataFrame:
    """All restock rows, none cut."""
    return rows.select(*RESTOCK_COLUMNS)
