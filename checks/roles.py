"""Input roles of the library, derived from the driver's tables.

Each role is one SELECT in the SQL that Spark and DuckDB share; `{name}` stands for a raw table.
The operators themselves are written twice: as DataFrames in `shopfloor`, as SQL in `checks.oracle`.
"""

from pyspark.sql import DataFrame, SparkSession

from shopfloor.functions import labels as L

RAW = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

_SUPPLY = (
    "case when {k} % 10 < 5 then '" + L.SUPPLY_CONSIGNMENT + "' when {k} % 10 < 9 then '" + L.SUPPLY_PURCHASE + "' else 'ETC' end"
)
_BRAND_NM = "case when {b} = 'Brand#13' then null else replace({b}, '#', ' ') end"
_CATS = (
    "p_type as cat_top, p_type || '-' || cast(cast(floor(p_size / 10) as int) as string) as cat_large, "
    "'S' || cast(p_size as string) as cat_medium"
)
_LIST = "cast(l_extendedprice as decimal(14,2))"
_AMT = f"cast({_LIST} * (1 - cast(l_discount as decimal(4,2))) as decimal(14,2))"
_PAY = f"cast({_AMT} * (1 - cast(l_tax as decimal(4,2))) as decimal(14,2))"
_YMD = "cast(year({d}) * 10000 + month({d}) * 100 + day({d}) as string)"
_YM = "cast(year({d}) * 100 + month({d}) as string)"
_BARCODE = "cast(l_partkey * 10 + l_linenumber as string)"
_PROFIT = f"cast({_AMT} * (cast(l_tax as decimal(4,2)) + 0.05) as decimal(14,2))"
_COST = f"cast({_LIST} * 0.02 as decimal(14,2))"
_EXTRA = f"cast({_LIST} * 0.005 as decimal(14,2))"
_LOC = "case when l_suppkey % 2 = 0 then '30' || cast(l_linenumber as string) || '0' else 'L' || cast(l_linenumber as string) end"

_CUSTOMER_DAY = """
        select cast(o_orderdate as date) as ord_state_date, c_nationkey as shop_no,
          case c_mktsegment when 'FURNITURE' then '' when 'MACHINERY' then 'F' when 'BUILDING' then 'M' else 'X' end as sex,
          case when c_custkey % 6 = 5 then null else 'A' || cast(c_custkey % 6 as string) end as age_band_custom,
          case when c_acctbal > 0 then 'Y' else '' end as mssid_yn, '[unit]' as summary_period_unit,
          cast(o_totalprice as decimal(14,2)) as gmv, cast(cast(o_totalprice as decimal(14,2)) * 1.1 as decimal(14,2)) as normal_gmv,
          case when o_orderpriority = '1-URGENT' then cast(o_totalprice as decimal(14,2)) else cast(0 as decimal(14,2)) end as tax_gmv,
          cast(1 as bigint) as qty, cast(1 as bigint) as buyer,
          cast(case when o_orderpriority = '1-URGENT' then 1 else 0 end as bigint) as tax_buyer
        from {orders} join {customer} on c_custkey = o_custkey"""

ROLES = {
    "shop": """
        select n_nationkey as shop_no, lower(r_name) as shop_type, n_name as shop_nm
        from {nation} join {region} on n_regionkey = r_regionkey""",
    "shop_name": """
        select n_nationkey as shop_no, '  ' || n_name || '   store ' as shop_name
        from {nation} where n_regionkey <> 1""",
    "order_header": """
        select o_orderkey as order_id, c_nationkey as shop_no,
          case when o_orderkey % 10 = 0 then null
               else o_orderdate + interval '1' hour * cast(o_orderkey * 7 % 24 as int) end as transaction_at,
          o_orderdate as created_at,
          case when o_orderstatus in ('F', 'O') then 50 else 10 end as order_status,
          case when o_orderpriority = '4-NOT SPECIFIED' then 1 else 0 end as dummy_order,
          case o_orderpriority when '1-URGENT' then 'IMMEDIATE' when '5-LOW' then null else 'NONE' end as tax_refund_type
        from {orders} join {customer} on c_custkey = o_custkey""",
    "order_line": f"""
        select l_orderkey as order_id, l_partkey as goods_no, cast(l_suppkey as string) as company_id,
          p_brand as brand_id, p_name as goods_name,
          case when l_linenumber = 7 then ' ' else 'L' || cast(l_linenumber as string) end as option_name,
          cast(l_quantity as bigint) as quantity, {_AMT} as order_amount, {_LIST} as normal_amount, {_PAY} as pay_amount
        from {{lineitem}} join {{part}} on p_partkey = l_partkey""",
    "claim": """
        select l_orderkey as order_id, case l_returnflag when 'R' then 'REFUND' else 'EXCHANGE' end as claim_type,
          l_shipdate as created_at
        from {lineitem} where l_linenumber = 1 and l_returnflag in ('R', 'A')""",
    "company": """
        select cast(s_suppkey as string) as com_id,
          case when s_suppkey % 10 < 5 then 'FEE' when s_suppkey % 10 < 9 then 'WONGA' else 'ETC' end as margin_type,
          'md' || cast(s_suppkey % 7 as string) as md_id,
          case when s_suppkey % 13 = 0 then null when s_suppkey % 3 = 0 then ' '
               else 'Name ' || cast(s_suppkey % 2 as string) end as md_nm
        from {supplier}""",
    "company_brand": """
        select distinct cast(l_suppkey as string) as com_id, p_brand as brand
        from {lineitem} join {part} on p_partkey = l_partkey where p_brand <> 'Brand#9'""",
    "brand": f"""
        select distinct p_brand as brand, {_BRAND_NM.format(b="p_brand")} as brand_nm from {{part}}""",
    "stock_summary": f"""
        select cast(date_trunc('year', l_shipdate) as date) as ord_state_date, s_nationkey as shop_no,
          case when l_suppkey % 50 = 7 then null else {_BARCODE} end as barcode, l_partkey as goods_no,
          'L' || cast(l_linenumber as string) as goods_opt, p_name as goods_nm, p_brand as brand,
          {_BRAND_NM.format(b="p_brand")} as brand_nm, cast(l_suppkey as string) as com_id,
          {_SUPPLY.format(k="l_suppkey")} as ord_com_type, {_CATS},
          'md' || cast(l_suppkey % 7 as string) as offline_md_id, 'md' || cast(l_suppkey % 7 as string) as md_id,
          'Name ' || cast(l_suppkey % 2 as string) as md_nm, cast(l_quantity as bigint) as sellable_qty,
          cast(floor(l_quantity / 2) as bigint) as available_qty,
          case when l_partkey % 40 = 0 then cast(0 as decimal(14,2)) else cast(p_retailprice as decimal(14,2)) end as normal_price
        from {{lineitem}} join {{part}} on p_partkey = l_partkey join {{supplier}} on s_suppkey = l_suppkey
        where l_linestatus = 'O'""",
    "goods_main": f"""
        select p_partkey as goods_no, case when p_partkey % 10 = 5 then null else p_name end as goods_nm, p_brand as brand,
          cast(date '1995-01-01' + interval '1' day * cast(p_partkey * 37 % 2400 as int) as date) as reg_dm,
          'ST' || cast(p_partkey as string) as style_no, cast(p_retailprice as decimal(14,2)) as normal_price,
          case when p_partkey % 6 = 0 then null
               else cast(cast(p_retailprice as decimal(14,2)) * 0.9 as decimal(14,2)) end as price,
          'md' || cast(p_partkey % 9 as string) as md_id, 'Name ' || cast(p_partkey % 2 as string) as md_nm
        from {{part}} where p_type <> 'SMALL'""",
    "goods_secondary": """
        select p_partkey as goods_id, p_name || ' v1' as goods_name, case when p_size < 10 then '' else replace(p_brand, '#', '-') end as brand_name,
          cast(p_retailprice as decimal(14,2)) as basic_price, cast(cast(p_retailprice as decimal(14,2)) * 0.80 as decimal(14,2)) as sale_price,
          cast(date '2000-01-01' + interval '1' day * p_size as date) as updated_at from {part}
        union all
        select p_partkey, p_name || ' v2', case when p_size < 10 then '' else replace(p_brand, '#', '-') end,
          cast(cast(p_retailprice as decimal(14,2)) * 0.95 as decimal(14,2)), cast(cast(p_retailprice as decimal(14,2)) * 0.75 as decimal(14,2)),
          cast(date '2000-01-02' + interval '1' day * p_size as date) from {part}""",
    "price_feed": """
        select l_partkey as goods_id, l_shipdate as created_at, case when l_linenumber <= 4 then 1 else 2 end as channel_id,
          cast(l_extendedprice as decimal(14,2)) as sale_price, cast(p_retailprice as decimal(14,2)) as basic_price
        from {lineitem} join {part} on p_partkey = l_partkey where p_type <> 'PROMO'""",
    "goods_scope": f"""
        select p_partkey as goods_no, p_name as goods_nm, p_brand as brand, {_BRAND_NM.format(b="p_brand")} as brand_nm,
          cast(p_partkey % 100 as string) as com_id,
          case when p_partkey % 50 = 0 then cast(0 as decimal(14,2)) else cast(p_retailprice as decimal(14,2)) end as normal_price
        from {{part}}""",
    "target": f"""
        select {_YMD.format(d="o_orderdate")} as dt, c_nationkey as shop_no,
          cast(cast(sum(cast(o_totalprice as decimal(14,2))) * 0.5 as decimal(18,0)) as decimal(20,2)) as gmv_goal,
          cast(cast(sum(cast(o_totalprice as decimal(14,2))) * 0.05 as decimal(18,0)) as decimal(20,2)) as contribution_profit_goal
        from {{orders}} join {{customer}} on c_custkey = o_custkey group by 1, 2""",
    "visits": f"""
        select {_YMD.format(d="v")} as dt, shop_no, visitors_int from (
          select cast(date '2001-07-01' + interval '1' day * cast(day(ts) - 1 as int) as date) as v,
            cast(user_id % 25 as int) as shop_no, 10 as visitors_int
          from {{events}} where event_type = 'view') t""",
    "tax_free": """
        select cast(o_orderkey as string) as order_id,
          case when c_custkey % 11 = 0 then null else n_name end as nationality
        from {orders} join {customer} on c_custkey = o_custkey join {nation} on n_nationkey = c_custkey % 25
        where o_orderpriority = '1-URGENT'
        union all
        select cast(o_orderkey as string), case when c_custkey % 11 = 0 then null else n_name end
        from {orders} join {customer} on c_custkey = o_custkey join {nation} on n_nationkey = c_custkey % 25
        where o_orderpriority = '1-URGENT' and o_orderstatus = 'O'""",
    "settlement_summary": f"""
        select cast(o_orderdate as date) as ord_state_date, c_nationkey as shop_no, l_partkey as goods_no, p_name as goods_nm,
          'L' || cast(l_linenumber as string) as option_nm, p_brand as brand_id, {_BRAND_NM.format(b="p_brand")} as brand_nm,
          p_type || '-' || cast(cast(floor(p_size / 10) as int) as string) as large_nm, 'S' || cast(p_size as string) as medium_nm,
          cast(l_suppkey as string) as company_id,
          case when l_suppkey % 4 = 0 then null when l_suppkey % 8 = 1 then '' else 'C' || cast(l_suppkey % 4 as string) end as concept,
          case when l_suppkey % 37 = 0 then null else {_SUPPLY.format(k="l_suppkey")} end as ord_com_type,
          cast(l_quantity as bigint) as qty, cast(l_quantity as bigint) as sell_qty, cast(floor(l_quantity / 10) as bigint) as clm_qty,
          {_AMT} as ord_amt, {_LIST} as normal_amt, {_PAY} as pay_amt, cast({_LIST} * 0.01 as decimal(14,2)) as coupon_dc_amt,
          {_PROFIT} as profit, {_PROFIT} - {_COST} + {_EXTRA} as contribution_profit_pre, {_PROFIT} - {_COST} as contribution_profit,
          {_COST} as offline_cost_fixed, {_EXTRA} as additional_rev
        from {{lineitem}} join {{orders}} on o_orderkey = l_orderkey join {{customer}} on c_custkey = o_custkey
          join {{part}} on p_partkey = l_partkey
        where o_orderstatus in ('F', 'O') and o_orderpriority <> '4-NOT SPECIFIED'
          and o_orderdate <= timestamp '2001-06-30 00:00:00' and p_size <> 1""",
    "customer_summary": " union all ".join(_CUSTOMER_DAY.replace("[unit]", u) for u in ("daily_total", "monthly")),
    "erp_stock": f"""
        select cast(date_trunc('year', l_shipdate) as date) as dt, case when l_suppkey % 3 = 0 then '1700' else '1000' end as store_cd,
          case l_linenumber when 1 then '2000' when 2 then '2010' when 3 then '2020' when 4 then '2060' else '2011' end as lgort,
          case when l_suppkey % 50 = 7 then null else {_BARCODE} end as barcode, cast(l_quantity as bigint) as wqty
        from {{lineitem}} where l_linestatus = 'F'""",
    "plant_stock": f"""
        select case when l_suppkey % 50 = 7 then null else {_BARCODE} end as barcode,
          case when l_partkey % 9 = 0 then null else l_partkey end as goods_no,
          'L' || cast(l_linenumber as string) as option_name, case when l_suppkey % 3 = 0 then '1700' else '1000' end as plant_code,
          case l_linenumber when 1 then '2000' when 2 then '2010' when 3 then '2020' when 4 then '2060' else '2011' end as storage_location,
          cast(floor(l_quantity / 3) as bigint) as available_stock
        from {{lineitem}} where l_linestatus = 'F' and l_shipdate >= timestamp '2001-01-01 00:00:00'""",
    "shop_location": """
        select '1700' as erp_plant_code, '2000' as erp_location_code, 6 as shop_no
        union all select '1700', '2010', 7 union all select '1700', '2020', 8
        union all select '1700', '2060', 10 union all select '1700', '2011', 12""",
    "fulfil_stock": """
        select p_partkey as sku_id, cast(p_size as bigint) as mfs_stock_qty from {part}""",
    "hub_meta": """
        select p_partkey as sku_id, cast(p_partkey * 10 + 1 as string) as supplier_barcode, date '2001-06-02' as strd_dt,
          replace(p_brand, '#', '~') as brand_name, p_partkey as product_no, p_name || ' hub' as product_name, 'H1' as option_name from {part}
        union all
        select p_partkey, cast(p_partkey * 10 + 2 as string), date '2001-06-01', replace(p_brand, '#', '~'), p_partkey, p_name || ' old', 'H2'
        from {part}""",
    "online_orders": f"""
        select cast(o_orderdate as date) as ord_state_date, p_brand as brand,
          case when l_suppkey % 17 = 0 then null else cast(l_suppkey as string) end as com_id,
          {_SUPPLY.format(k="l_suppkey")} as ord_com_type, r_name as hier, l_partkey as goods_no,
          cast(l_quantity as bigint) as sell_sub_clm_qty, {_AMT} as normal_gmv, {_LIST} as normal_ggmv,
          cast({_AMT} * 0.3 as decimal(14,2)) as revenue, {_PROFIT} as contribution_profit_pre,
          cast({_LIST} * 0.01 as decimal(14,2)) as mem_dc, cast({_LIST} * 0.02 as decimal(14,2)) as cou_dc,
          cast({_LIST} * 0.005 as decimal(14,2)) as cart_cou_dc
        from {{lineitem}} join {{orders}} on o_orderkey = l_orderkey join {{part}} on p_partkey = l_partkey
          join {{supplier}} on s_suppkey = l_suppkey join {{nation}} on n_nationkey = s_nationkey
          join {{region}} on r_regionkey = n_regionkey
        where o_orderpriority in ('1-URGENT', '2-HIGH')""",
    "stock_history": f"""
        select cast(date_trunc('week', l_shipdate) as date) as base_date, cast(l_partkey as string) as product_no,
          case when l_suppkey % 17 = 0 then null else cast(l_suppkey as string) end as com_id,
          case l_suppkey % 3 when 0 then '1P' when 1 then '3P' else 'MFS' end as biz_type,
          case when l_linenumber = 6 then 'SIDE' else 'MAIN' end as platform, {_LOC} as storage_loc_cd,
          'Loc ' || cast(l_suppkey % 4 as string) as storage_loc_nm, cast(l_quantity as bigint) as end_stock_qty
        from {{lineitem}}""",
    "closing": f"""
        select distinct {_YM.format(d="l_shipdate")} as buper, case when l_suppkey % 3 = 0 then '1700' else '1000' end as werks,
          {_LOC} as lgort,
          case l_linenumber when 5 then '지점 온라인몰 A' when 4 then '홀세일' else 'Branch ' || cast(l_linenumber as string) end as lgobe
        from {{lineitem}}""",
    "open_po": f"""
        select cast(l_partkey as string) as s_matnr, cast(l_quantity as bigint) as menge,
          case when l_suppkey % 4 = 0 then '1700' else '1000' end as werks,
          case l_returnflag when 'R' then 'X' when 'A' then '' else null end as loekz, {_YMD.format(d="l_shipdate")} as eindt
        from {{lineitem}}""",
}


class TestInputs:
    """Role name -> lazy DataFrame over one directory of the driver's tables."""

    __test__ = False

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        from shopfloor.sources.tables import load

        if name not in self._cache:
            self._cache[name] = load(self.spark, self.directory, name, RAW[name], suffix=".parquet")
        return self._cache[name]

    def __getitem__(self, role: str) -> DataFrame:
        if role not in self._cache:
            tables = {t: self.raw(t) for t in RAW if "{" + t + "}" in ROLES[role]}
            self._cache[role] = self.spark.sql(ROLES[role], **tables)
        return self._cache[role]


def role_sql() -> dict[str, str]:
    """The same roles as DuckDB text."""
    return {r: s.format(**{t: t for t in RAW}) for r, s in ROLES.items()}
