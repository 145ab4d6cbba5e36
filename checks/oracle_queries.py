"""One SQL statement per registered query, over the views of `checks.oracle`."""

from checks.oracle import (
    VIEWS,
    AS_OF, G_COLS, G_TOTAL, HUBS_WIDE, KEYS, KIND_TOTALS, OFF_W, OFF_X, ON_W, ON_X, POS, RANGES, RATES, SALES_OUT, STORES, SUMS,
    T_COLS, T_RATES, V_COLS, big, change, change_abs, compare_by, cp_rate, dbl, day, disc, money, pnl, ratio, target_month, target_rows,
    v_of, w_labels, w_sums, wide, windows,
)

SQL: dict[str, str] = {}
ORDERS = "SELECT order_id, max(is_foreign) is_foreign, sum(gmv) gmv, sum(CASE WHEN is_foreign = 1 THEN gmv ELSE 0 END) foreign_gmv FROM d_receipts"
CATS = "cat_top, cat_large, cat_medium"

# ---------------------------------------------------------------- A
SQL["a1_load"] = "SELECT * FROM lineitem"
SQL["a2_latest_snapshot"] = f"SELECT * REPLACE ({dbl('normal_price')} AS normal_price) FROM d_stock_now"
_DAILY = f"""SELECT sales_date, store_name, shop_type, brand_nm, qty, {", ".join(f"{dbl(c)} {c}" for c in
    ("gmv", "normal_amt", "net_take", "cp", "offline_cost", "add_rev"))} FROM d_settlement_daily"""
_SETTLED = f"SELECT sales_date, store_name, shop_type, goods_no, {dbl('net_take')} net_take, {dbl('cp')} cp FROM d_settlement"
SQL["a3_write_clustered"] = _DAILY
SQL["a4_replace_window"] = _SETTLED
SQL["a5_refresh"] = " UNION ALL ".join(
    f"SELECT '{n}' dataset, count(*) row_count, max(sales_date) max_date FROM {v}"
    for n, v in (
        ("sales", "d_sales"), ("receipts", "d_receipts"), ("sales_option", "d_sales_option"),
        ("settlement_daily", "d_settlement_daily"), ("target_daily", "d_target"), ("footfall", "d_footfall"),
    )
)
_NO_TS = "CAST(NULL AS TIMESTAMP) max_ts, count(*) row_count"
SQL["a6_freshness"] = f"""
  SELECT 'orders' dataset, max(sold_on) max_date, max(sold_at) max_ts, count(*) row_count FROM d_order WHERE order_status = 50
  UNION ALL SELECT 'sales', max(sales_date), {_NO_TS} FROM d_sales
  UNION ALL SELECT 'settlement', max(sales_date), {_NO_TS} FROM d_settlement
  UNION ALL SELECT 'target_daily', max(sales_date), {_NO_TS} FROM d_target
  UNION ALL SELECT 'goods_master', CAST(NULL AS DATE), {_NO_TS} FROM d_goods_master"""


def drill(level: str, sales_where: str = "TRUE", stock_where: str = "TRUE") -> str:
    k, s = {"shop": ("store_name", "i.store_name"), "goods": ("goods_no", "i.goods_no")}.get(level, (level, f"a.{level}"))
    name = "min(goods_nm)" if level == "goods" else f"CAST({k} AS VARCHAR)"
    return f"""SELECT s.key, s.name, s.qty, s.gmv, s.normal_amt, s.foreign_gmv, s.goods_count, CAST(coalesce(t.stock, 0) AS BIGINT) stock,
        s.discount_rate, s.foreign_ratio
      FROM (SELECT CAST({k} AS VARCHAR) AS key, {name} AS name, {big('sum(qty)')} qty, {dbl('sum(gmv)')} gmv, {dbl('sum(normal_amt)')} normal_amt,
          {dbl('sum(foreign_gmv)')} foreign_gmv, count(DISTINCT goods_no) goods_count, {RATES} FROM d_sales WHERE {sales_where} GROUP BY {k}) s
      LEFT JOIN (SELECT CAST({s} AS VARCHAR) AS key, sum(i.stock) stock FROM d_stock_store i LEFT JOIN d_goods_attr a ON a.goods_no = i.goods_no
          WHERE {stock_where} GROUP BY {s}) t ON t.key = s.key"""


SQL["a7_export_csv"] = f"""SELECT '{STORES[0]}' in_store, key, qty, gmv, normal_amt, foreign_gmv, goods_count, stock
  FROM ({drill('brand_nm', f"store_name = '{STORES[0]}'", f"i.store_name = '{STORES[0]}'")})"""

# ---------------------------------------------------------------- B
_PRICES = f"{dbl('sale_price')} sale_price, {dbl('basic_price')} basic_price"
SQL["b1_dim_store"] = "SELECT shop_no, shop_type, store_name FROM d_store"
SQL["b2_dim_brand"] = "SELECT * FROM d_brand"
SQL["b3_category_map"] = "SELECT * FROM d_cat"
SQL["b4_sold_goods"] = "SELECT * FROM d_sold"
SQL["b5_quarantine_prices"] = f"SELECT goods_id, created_at, channel_id, {_PRICES} FROM d_feed"
SQL["b6_latest_by_key"] = f"SELECT goods_id, goods_name, brand_name, updated_at, {_PRICES} FROM d_second"
SQL["b7_goods_master"] = f"""SELECT goods_no, goods_nm, brand_nm, reg_date, style_no, {dbl('normal_price')} normal_price,
  {dbl('sale_price')} sale_price FROM d_goods_master"""
SQL["b8_concept_map"] = """SELECT s.company_id, s.brand_id, coalesce(c.concept, '미지정') concept
  FROM (SELECT DISTINCT company_id, brand_id FROM d_sales) s LEFT JOIN d_concept c ON c.company_id = s.company_id AND c.brand_id = s.brand_id"""
SQL["b9_mode_name"] = """SELECT md_id, md_nm FROM (SELECT md_id, md_nm, count(*) n FROM (
    SELECT md_id, md_nm FROM d_stock_now UNION ALL SELECT md_id, md_nm FROM r_company UNION ALL SELECT md_id, md_nm FROM r_goods_main)
  WHERE md_id IS NOT NULL AND trim(md_nm) <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY md_id ORDER BY n DESC, md_nm) = 1"""
_CATALOG = f"""coalesce(gm.style_no, '') style_no, {money('gm.normal_price')} normal_price,
  {money('CASE WHEN gm.sale_price > 0 THEN gm.sale_price ELSE gm.normal_price END')} sale_price"""
SQL["b10_catalog_enrich"] = f"""SELECT g.goods_no, g.brand brand_id, {_CATALOG}
  FROM r_goods_scope g LEFT JOIN d_goods_master gm ON gm.goods_no = g.goods_no"""
SQL["b11_brand_override"] = """SELECT goods_no, company_id, brand_id, min(brand_nm) brand_nm, min(goods_nm) goods_nm, min(cat_top) cat_top,
  min(cat_large) cat_large, min(cat_medium) cat_medium, min(off_md_id) off_md_id FROM d_sales GROUP BY ALL"""
SQL["b12_zero_qty_brand"] = f"SELECT brand_nm, {big('sum(qty)')} qty, {dbl('sum(gmv)')} gmv FROM d_sales GROUP BY brand_nm"
from shopfloor.functions.dates import HOLIDAYS as _LISTED  # noqa: E402  fixed values

SQL["b13_red_days"] = f"""SELECT d, sun is_sunday, hol is_holiday, sun OR hol is_red_day FROM (
  SELECT d, dayofweek(d) = 0 sun, d IN ({", ".join(f"DATE '{x}'" for x in _LISTED)}) OR (year(d) NOT BETWEEN 2023 AND 2026 AND
    strftime(d, '%m-%d') IN ('01-01','03-01','05-05','06-06','08-15','10-03','10-09','12-25')) hol
  FROM (SELECT CAST(o_orderdate AS DATE) d FROM orders UNION SELECT CAST(ts AS DATE) FROM events
    UNION SELECT CAST(CAST(o_orderdate AS DATE) + INTERVAL 336 MONTH AS DATE) FROM orders))"""

# ---------------------------------------------------------------- C
SQL["c1_net_sales"] = f"""SELECT {SALES_OUT}, goods_nm, reg_date, style_no, {dbl('normal_price')} normal_price, {dbl('sale_price')} sale_price
  FROM d_sales"""
SQL["c1_net_sales_since"] = f"SELECT {SALES_OUT} FROM d_sales WHERE sales_date >= DATE '2001-05-01'"
SQL["c2_order_date"] = """SELECT CAST(coalesce(transaction_at, created_at) AS DATE) sales_date, count(*) orders FROM r_order_header GROUP BY 1"""
SQL["c3_refund_claims"] = "SELECT * FROM d_refund"
SQL["c4_foreign_flag"] = """SELECT order_id, CASE WHEN tax_refund_type IS NOT NULL AND tax_refund_type <> 'NONE' THEN 1 ELSE 0 END is_foreign
  FROM r_order_header"""
_OPT = "sales_date, store_name, shop_type, business_type, brand_nm, goods_no, option_nm, cat_top, cat_large, cat_medium, off_md_id, goods_nm"
SQL["c5_net_sales_option"] = f"""SELECT {_OPT}, qty, {dbl('gmv')} gmv, {dbl('normal_amt')} normal_amt, {dbl('pay')} pay FROM d_sales_option"""
_RCPT = f"SELECT * REPLACE ({dbl('gmv')} AS gmv) FROM d_receipts"
SQL["c6_receipts"] = _RCPT
SQL["c7_daily_targets"] = f"SELECT sales_date, shop_no, store_name, shop_type, {dbl('gmv_goal')} gmv_goal, {dbl('cp_goal')} cp_goal FROM d_target"
SQL["c8_footfall"] = "SELECT * FROM d_footfall"
SQL["c9_nationality_sales"] = f"SELECT * REPLACE ({dbl('gmv')} AS gmv) FROM d_nationality"
SQL["c10_settlement"] = _SETTLED
SQL["c11_settlement_option"] = f"""SELECT sales_date, store_name, shop_type, brand_nm, cat_large, cat_medium, goods_no, goods_nm, option_nm, qty,
  {", ".join(f"{dbl(c)} {c}" for c in ("gmv", "normal_amt", "pay", "net_take", "cp"))} FROM d_settlement_option"""
SQL["c12_settlement_daily"] = _DAILY
SQL["c13_customer_demographics"] = f"""SELECT sales_date, store_name, shop_type, sex, age_band, member, {dbl('gmv')} gmv,
  {dbl('normal_gmv')} normal_gmv, {dbl('foreign_gmv')} foreign_gmv, qty, buyer, foreign_buyer FROM d_customer"""
SQL["c14_store_stock"] = f"""SELECT CASE ord_com_type WHEN '입점(위탁)' THEN '위탁' WHEN '공급(매입)' THEN '매입' ELSE '기타' END business_type,
    st.store_name, st.shop_type, coalesce(s.brand_nm, '(미매칭)') brand_nm, s.goods_no, min(s.goods_nm) goods_nm, max(s.ord_state_date) snapshot_date,
    {big('sum(sellable_qty)')} sellable_qty, {big('sum(available_qty)')} available_qty
  FROM d_stock_now s JOIN d_store st ON st.shop_no = s.shop_no GROUP BY 1, 2, 3, 4, 5"""

# ---------------------------------------------------------------- D
_D = "sales_date >= DATE '2000-07-01' AND sales_date < DATE '2001-07-19' + 1"
_T = "shop_type IN ('AMERICA','ASIA','RUN')"
_B = "business_type IN ('위탁','매입') AND cat_top IN ('ECONOMY','PROMO','LARGE')"
SQL["d1_apply_sales_filter"] = f"SELECT {SALES_OUT}, goods_nm FROM d_sales WHERE {_D} AND {_T} AND {_B} AND lower(goods_nm) LIKE '%bolt%'"
SQL["d1_apply_concept_filter"] = f"""SELECT * FROM (SELECT {", ".join("s." + c.strip() for c in KEYS.split(","))}, s.qty, {dbl('s.gmv')} gmv,
    {dbl('s.normal_amt')} normal_amt, {dbl('s.pay')} pay, {dbl('s.foreign_gmv')} foreign_gmv, coalesce(c.concept, '미지정') concept
  FROM d_sales s LEFT JOIN d_concept c ON c.company_id = s.company_id AND c.brand_id = s.brand_id)
  WHERE concept IN ('C1', '미지정') AND store_name IN ({", ".join(f"'{x}'" for x in STORES[:5])}) AND brand_nm IN ('Brand 1', 'Brand 2')
    AND off_md_id IN ('md1', 'md2', '')"""
SQL["d2_apply_receipt_filter"] = f"{_RCPT} WHERE {_D} AND {_T} AND {_B}"
SQL["d3_apply_settlement_filter"] = f"{_SETTLED} WHERE {_D} AND {_T}"
SQL["d4_apply_traffic_filter"] = """SELECT * FROM d_footfall WHERE sales_date BETWEEN DATE '2001-07-05' AND DATE '2001-07-20'
  AND shop_type IN ('ASIA','EUROPE')"""
SQL["d5_apply_stock_filter"] = """
  SELECT barcode, location_kind, "location", qty FROM (
    SELECT s.*, sum(CASE WHEN location_kind = '매장' THEN qty END) OVER (PARTITION BY barcode) st,
      sum(CASE WHEN location_kind = '허브' THEN qty END) OVER (PARTITION BY barcode) hb
    FROM d_stock s WHERE business_type IN ('위탁','매입') AND cat_top IN ('ECONOMY','SMALL','미분류') AND trim(goods_nm) <> ''
      AND (location_kind = '허브' OR "location" IN (SELECT store_name FROM d_store WHERE shop_type IN ('ASIA','EUROPE'))))
  WHERE st > 0 OR hb > 0"""
SQL["d6_drill_stock_filter"] = """SELECT i.*, a.* EXCLUDE (goods_no) FROM d_stock_store i JOIN d_goods_attr a ON a.goods_no = i.goods_no
  WHERE a.business_type IN ('매입','기타') AND a.cat_top IN ('ECONOMY','미분류')
    AND i.goods_no IN (SELECT goods_no FROM d_sales WHERE lower(goods_nm) LIKE '%widget%')"""
_F7 = {
    "store": "store_name IN (" + ", ".join(f"'{x}'" for x in STORES[:4]) + ")",
    "brand": "brand_nm IN ('Brand 1','Brand 2','Brand 3')",
    "cat_top": "cat_top = 'ECONOMY'",
}
_C7 = {"store": "store_name", "brand": "brand_nm", "cat_top": "cat_top"}
SQL["d7_cross_facets"] = " UNION ALL ".join(
    f"SELECT '{d}' dim, {_C7[d]} AS member, {dbl('sum(gmv)')} gmv FROM d_sales WHERE sales_date >= DATE '2000-01-01' "
    f"AND business_type IN ('매입','기타') AND {' AND '.join(v for k, v in _F7.items() if k != d)} GROUP BY {_C7[d]}"
    for d in _F7
)
SQL["d8_kpis_by_preset"] = f"""
  SELECT p.preset, p.pos, p.date_from, p.date_to, {big('coalesce(sum(qty), 0)')} qty, {money('sum(gmv)')} gmv, {money('sum(normal_amt)')} normal_amt,
    {money('sum(pay)')} pay, {money('sum(foreign_gmv)')} foreign_gmv
  FROM (SELECT preset, pos, CASE WHEN pos = 0 THEN a ELSE greatest(a, dmin) END date_from, b date_to FROM (
      SELECT dmin, unnest(['오늘','이번주','지난주','이번달','지난달','올해','전년']) preset, unnest([0,1,2,3,4,5,6]) pos,
        unnest([d, w, w - 7, m, CAST(m - INTERVAL 1 MONTH AS DATE), y, CAST(y - INTERVAL 12 MONTH AS DATE)]) a,
        unnest([d, d, w - 1, d, m - 1, d, y - 1]) b
      FROM (SELECT max(sales_date) d, min(sales_date) dmin, CAST(date_trunc('week', max(sales_date)) AS DATE) w,
              CAST(date_trunc('month', max(sales_date)) AS DATE) m, CAST(date_trunc('year', max(sales_date)) AS DATE) y FROM d_sales))) p
  LEFT JOIN d_sales s ON s.sales_date BETWEEN p.date_from AND p.date_to GROUP BY 1, 2, 3, 4"""
SQL["d9_report_basis"] = f"""SELECT cat_top, business_type, store_name, {dbl('sum(gmv)')} gmv FROM d_sales
  WHERE cat_top = 'ECONOMY' AND business_type = '위탁' GROUP BY ALL"""
SQL["d10_weekly_search"] = """SELECT sil, gubun, brand_code, brand_nm FROM d_ips WHERE gubun = '매입' AND sil IN ('ASIA','EUROPE')
  AND (lower(brand_nm) LIKE '%d 1%' OR lower(brand_code) LIKE '%d 1%')"""

# ---------------------------------------------------------------- E
_NUL = "CAST(NULL AS VARCHAR) parent, CAST(NULL AS DOUBLE) gmv, CAST(NULL AS DATE) date_min, CAST(NULL AS DATE) date_max"
SQL["e1_facets"] = f"""
  SELECT DISTINCT 'store' facet, store_name AS member, shop_type parent, CAST(NULL AS DOUBLE) gmv, CAST(NULL AS DATE) date_min,
    CAST(NULL AS DATE) date_max FROM d_sales
  UNION ALL SELECT 'brand', brand_nm, NULL, {dbl('sum(gmv)')}, NULL, NULL FROM d_sales GROUP BY brand_nm
  UNION ALL SELECT 'date', 'range', NULL, NULL, min(sales_date), max(sales_date) FROM d_sales
  """ + " ".join(
    f"UNION ALL SELECT DISTINCT '{n}', {c}, {_NUL} FROM d_sales WHERE {c} <> ''"
    for n, c in (
        ("shop_type", "shop_type"), ("business_type", "business_type"), ("cat_top", "cat_top"), ("cat_large", "cat_large"),
        ("cat_medium", "cat_medium"), ("md", "off_md_id"),
    )
)
SQL["e2_summary"] = f"SELECT {SUMS}, count(DISTINCT goods_no) goods_count, count(DISTINCT store_name) store_count, {RATES} FROM d_sales"
SQL["e3_take_rate"] = "SELECT goods_no, rate, settled_days, overall_rate FROM d_rate"
_NT = f"{dbl('net_take')} net_take, {dbl('cp')} cp"
SQL["e4_profit_by_goods"] = f"SELECT goods_no, {_NT} FROM d_profit_goods"
SQL["e5_profit_totals"] = f"""SELECT {_NT}, {dbl('gmv')} gmv, {cp_rate('cp', 'gmv')} cp_rate FROM (
  SELECT CAST(coalesce(sum(net_take), 0) AS DECIMAL(20,2)) net_take, coalesce(sum(cp), 0) cp, (SELECT sum(gmv) FROM d_sales) gmv FROM d_covered)"""
SQL["e6_profit_by_brand"] = f"SELECT business_type, brand_nm, {_NT} FROM d_profit_brand"
# the rate comes from the last 45 days and all stores, whatever the filter of the report
_PF = f"sales_date BETWEEN DATE '2001-05-20' AND DATE '2001-06-25' AND store_name IN ({', '.join(repr(x) for x in STORES[:6])})"
_COVERED_F = f"""(
    SELECT goods_no, if(settled_days > 0, CAST(ifnull({dbl('nt')}, ifnull(rate, overall_rate) * {dbl('amount')}) AS DECIMAL(24,6)), NULL) AS net_take,
      if(settled_days > 0, cp, NULL) AS cp
    FROM (SELECT sales_date, goods_no, sum(gmv) AS amount FROM d_sales WHERE {_PF} GROUP BY ALL)
    LEFT JOIN (SELECT sales_date, goods_no, sum(net_take) AS nt, sum(cp) AS cp FROM d_settlement WHERE {_PF} GROUP BY ALL) USING (sales_date, goods_no)
    LEFT JOIN d_rate_f USING (goods_no))"""
VIEWS["d_rate_f"] = f"""
  SELECT goods_no, {dbl('sum(net_take)')} / nullif({dbl('sum(gmv) FILTER (net_take IS NOT NULL)')}, 0) AS rate, count(net_take) AS settled_days,
    sum(sum(net_take)) OVER () / nullif({dbl('sum(sum(gmv) FILTER (net_take IS NOT NULL)) OVER ()')}, 0) AS overall_rate
  FROM d_day_goods WHERE sales_date >= {AS_OF} - 45 AND goods_no IN (SELECT goods_no FROM d_sales WHERE {_PF}) GROUP BY goods_no"""
SQL["e4_profit_by_goods_filtered"] = f"""SELECT goods_no, {dbl('CAST(sum(net_take) AS DECIMAL(20,2))')} AS net_take, {dbl('sum(cp)')} AS cp FROM {_COVERED_F} GROUP BY goods_no"""
SQL["e5_profit_totals_filtered"] = f"""SELECT {_NT}, {dbl('gmv')} AS gmv, {cp_rate('cp', 'gmv')} AS cp_rate FROM (
  SELECT CAST(ifnull(sum(net_take), 0) AS DECIMAL(20,2)) AS net_take, ifnull(sum(cp), 0) AS cp, (SELECT sum(gmv) FROM d_sales WHERE {_PF}) AS gmv FROM {_COVERED_F})"""
SQL["e7_basket_value"] = f"""SELECT receipts, foreign_receipts, receipts - foreign_receipts domestic_receipts, {dbl('gmv')} gmv,
    {dbl('foreign_gmv')} foreign_gmv, {dbl('gmv - foreign_gmv')} domestic_gmv, {ratio('gmv', 'receipts', '')} aov,
    {ratio('foreign_gmv', 'foreign_receipts', '')} foreign_aov, {ratio('gmv - foreign_gmv', 'receipts - foreign_receipts', '')} domestic_aov
  FROM (SELECT count(DISTINCT order_id) receipts, count(DISTINCT CASE WHEN is_foreign = 1 THEN order_id END) foreign_receipts, sum(gmv) gmv,
    sum(CASE WHEN is_foreign = 1 THEN gmv ELSE 0 END) foreign_gmv FROM d_receipts)"""
SQL["e8_hourly"] = f"""SELECT CAST(h AS INTEGER) "hour", {money('sum(r.gmv)')} gmv, {money('sum(CASE WHEN is_foreign = 1 THEN r.gmv END)')} foreign_gmv,
    count(DISTINCT r.order_id) receipts FROM range(0, 24) t(h) LEFT JOIN d_receipts r ON r."hour" = h GROUP BY h"""
_BK = {"day": "sales_date", "week": "CAST(date_trunc('week', sales_date) AS DATE)", "month": "CAST(date_trunc('month', sales_date) AS DATE)"}
SQL["e9_trend"] = " UNION ALL ".join(
    f"SELECT {b} AS bucket, {dbl('sum(gmv)')} gmv, {big('sum(qty)')} qty, {dbl('sum(foreign_gmv)')} foreign_gmv, '{g}' grain FROM d_sales GROUP BY 1"
    for g, b in _BK.items()
)
SQL["e10_trend_by_business"] = f"""SELECT {_BK['week']} bucket, {", ".join(
    f"{money(chr(115) + 'um(CASE WHEN business_type = ' + chr(39) + b + chr(39) + ' THEN gmv END)')} " + '"' + b + '"' for b in ("위탁", "매입", "기타"))}
  FROM d_sales GROUP BY 1"""
SQL["e10_trend_by_business_long"] = f"SELECT {_BK['month']} bucket, business_type, {dbl('sum(gmv)')} gmv FROM d_sales GROUP BY 1, 2"
_LEN = "CAST(DATE '2001-06-30' - DATE '2001-01-01' + 1 AS INTEGER)"
_POS = "row_number() OVER (ORDER BY bucket)"
SQL["e11_trend_overlay"] = f"""SELECT CAST(c.pos AS INTEGER) pos, c.bucket, {dbl('c.gmv')} gmv, {dbl('p.gmv')} prev_gmv FROM
  (SELECT bucket, gmv, {_POS} pos FROM (SELECT {_BK['week']} bucket, sum(gmv) gmv FROM d_sales
     WHERE sales_date BETWEEN DATE '2001-01-01' AND DATE '2001-06-30' GROUP BY 1)) c
  LEFT JOIN (SELECT bucket, gmv, {_POS} pos FROM (SELECT {_BK['week']} bucket, sum(gmv) gmv FROM d_sales
     WHERE sales_date BETWEEN DATE '2001-01-01' - {_LEN} AND DATE '2001-06-30' - {_LEN} GROUP BY 1)) p ON p.pos = c.pos"""
SQL["e12_by_dimension"] = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT {c} AS name, {dbl('sum(gmv)')} gmv, {big('sum(qty)')} qty, {dbl('sum(foreign_gmv)')} foreign_gmv,
      count(DISTINCT goods_no) goods_count, {dbl('sum(sum(gmv)) OVER ()')} grand_total, {ratio('sum(gmv)', 'sum(sum(gmv)) OVER ()')} AS share,
      '{d}' dim FROM d_sales GROUP BY {c})"""
    for d, c in (("store", "store_name"), ("brand", "brand_nm"), ("business", "business_type"), ("cat_medium", "cat_medium"))
)
_SEG = """(SELECT brand_nm AS name, sum(gmv) gmv, sum(foreign_gmv) f FROM d_sales GROUP BY brand_nm ORDER BY gmv DESC, name LIMIT 10)"""
SQL["e13_segment_split"] = " UNION ALL ".join(
    f"SELECT name, {dbl('gmv')} gmv, '{s}' AS segment, {dbl(v)} AS value, {ratio(v, 'gmv')} ratio FROM {_SEG}"
    for s, v in (("내국인", "greatest(0, gmv - f)"), ("외국인", "greatest(0, f)"))
)
_RK = "row_number() OVER (ORDER BY v DESC, name) rk"
SQL["e14_top_plus_other"] = f"""SELECT CASE WHEN rk <= 10 THEN name ELSE '기타' END AS name, {dbl('sum(v)')} AS value
  FROM (SELECT name, v, {_RK} FROM (SELECT cat_medium AS name, sum(gmv) v FROM d_sales GROUP BY 1 HAVING sum(gmv) > 0)) GROUP BY 1"""
SQL["e15_concept_share"] = f"""SELECT concept, {dbl('gmv')} gmv, {ratio('gmv', 'sum(gmv) OVER ()')} AS share FROM (
  SELECT coalesce(c.concept, '미지정') concept, sum(s.gmv) gmv FROM d_sales s LEFT JOIN d_concept c
    ON c.company_id = s.company_id AND c.brand_id = s.brand_id GROUP BY 1 HAVING sum(s.gmv) > 0)"""
SQL["e16_drill"] = " UNION ALL ".join(
    f"SELECT *, '{lv}' AS level FROM ({drill(k)})"
    for lv, k in (("shop", "shop"), ("brand", "brand_nm"), ("cat_large", "cat_large"), ("cat_medium", "cat_medium"), ("goods", "goods"))
)
SQL["e16_drill_filtered"] = drill(
    "cat_large",
    f"store_name = '{STORES[2]}' AND brand_nm IN ('Brand 1','Brand 5') AND sales_date >= DATE '2000-01-01'",
    f"i.store_name = '{STORES[2]}' AND a.brand_nm IN ('Brand 1','Brand 5')",
) + " ORDER BY s.gmv DESC, s.key LIMIT 50"
SQL["e17_brand_detail"] = f"""SELECT s.*, {dbl('p.net_take')} net_take, {dbl('p.cp')} cp, {", ".join(f'coalesce(k."{x}", 0) "{x}"' for x in STORES)}
  FROM (SELECT business_type, brand_nm, {SUMS}, count(DISTINCT goods_no) goods, {RATES} FROM d_sales GROUP BY ALL HAVING sum(qty) > 0) s
  LEFT JOIN d_profit_brand p ON p.business_type = s.business_type AND p.brand_nm = s.brand_nm
  LEFT JOIN (SELECT brand_nm, {wide()} FROM d_stock WHERE location_kind = '매장' GROUP BY brand_nm) k ON k.brand_nm = s.brand_nm"""
SQL["e18_goods_detail"] = f"""SELECT s.*, CAST(coalesce(k.store_stock, 0) AS BIGINT) jaego, CAST(coalesce(k.hub_total, 0) AS BIGINT) hub,
    {dbl('p.net_take')} net_take, {dbl('p.cp')} cp, {_CATALOG}, CAST(coalesce(o.n, 0) AS BIGINT) op_stores
  FROM (SELECT business_type, {CATS}, brand_nm, goods_no, min(goods_nm) goods_nm, {SUMS}, {RATES}, {ratio('sum(gmv)', 'sum(qty)', '')} sale_unit,
      {ratio('sum(pay)', 'sum(qty)', '')} pay_unit FROM d_sales GROUP BY business_type, {CATS}, brand_nm, goods_no HAVING sum(qty) > 0) s
  LEFT JOIN d_stock_goods k ON k.goods_no = s.goods_no LEFT JOIN d_profit_goods p ON p.goods_no = s.goods_no
  LEFT JOIN d_goods_master gm ON gm.goods_no = s.goods_no
  LEFT JOIN (SELECT goods_no, count(*) FILTER (stock >= 1) n FROM d_stock_store GROUP BY 1) o ON o.goods_no = s.goods_no"""
SQL["e19_goods_by_store"] = f"""SELECT s.*, CAST(coalesce(k.stock, 0) AS BIGINT) stock, {money('t.net_take')} net_take, {money('t.cp')} cp
  FROM (SELECT store_name, business_type, {CATS}, brand_nm, goods_no, min(goods_nm) goods_nm, {SUMS} FROM d_sales
    GROUP BY store_name, business_type, {CATS}, brand_nm, goods_no HAVING sum(qty) <> 0 OR sum(gmv) <> 0) s
  LEFT JOIN d_stock_store k ON k.store_name = s.store_name AND k.goods_no = s.goods_no
  LEFT JOIN (SELECT store_name, goods_no, sum(net_take) net_take, sum(cp) cp FROM d_settlement GROUP BY ALL) t
    ON t.store_name = s.store_name AND t.goods_no = s.goods_no"""
_SO = f"sales_date, store_name, business_type, brand_nm, {CATS}, goods_no, option_nm"
_SHARE = f"({dbl('s.gmv')} / nullif({dbl('sum(s.gmv) OVER (PARTITION BY s.sales_date, s.store_name, s.goods_no)')}, 0))"
SQL["e20_allocate_profit"] = f"""SELECT s.* REPLACE ({dbl('s.gmv')} AS gmv, {dbl('s.normal_amt')} AS normal_amt, {dbl('s.pay')} AS pay),
    {dbl('t.nt')} * {_SHARE} net_take, {dbl('t.cp')} * {_SHARE} cp, CAST(coalesce(k.stock, 0) AS BIGINT) stock
  FROM (SELECT {_SO}, min(goods_nm) goods_nm, {big('sum(qty)')} qty, sum(gmv) gmv, sum(normal_amt) normal_amt, sum(pay) pay FROM d_sales_option
    GROUP BY {_SO} HAVING sum(qty) <> 0 OR sum(gmv) <> 0) s
  LEFT JOIN (SELECT sales_date, store_name, goods_no, sum(net_take) nt, sum(cp) cp FROM d_settlement_option GROUP BY 1, 2, 3) t
    ON t.sales_date = s.sales_date AND t.store_name = s.store_name AND t.goods_no = s.goods_no
  LEFT JOIN d_stock_store k ON k.store_name = s.store_name AND k.goods_no = s.goods_no"""


def _brand_store(dates: str, members: str) -> str:
    sold = f"""(SELECT business_type, brand_nm, store_name, {", ".join(f"sum({m}) AS {m}" for m in ("qty", "gmv", "normal_amt", "pay", "foreign_gmv"))}
      FROM d_sales WHERE {dates} AND {members} GROUP BY 1, 2, 3 HAVING sum(qty) <> 0 OR sum(gmv) <> 0)"""
    return f"""
  WITH sold AS {sold}, per_store AS (
    SELECT brand_nm, store_name, {", ".join(f"sum({m}) AS {m}" for m in ("qty", "gmv", "normal_amt", "pay", "foreign_gmv"))} FROM sold GROUP BY 1, 2
  ), held AS (
    SELECT brand_nm, store_name, sum(stock) AS stock FROM d_stock_store JOIN (SELECT goods_no, brand_nm FROM d_goods_attr) USING (goods_no)
    WHERE goods_no IN (SELECT goods_no FROM d_sales WHERE {members}) AND brand_nm IN (SELECT brand_nm FROM sold) GROUP BY 1, 2
  ), kinds AS (SELECT brand_nm, min(business_type) AS kind FROM sold GROUP BY brand_nm)
  SELECT ifnull(kind, '') AS business_type, brand_nm, store_name, CAST(ifnull(qty, 0) AS BIGINT) AS qty, {money('gmv')} AS gmv,
    {money('normal_amt')} AS normal_amt, {money('pay')} AS pay, {money('foreign_gmv')} AS foreign_gmv, CAST(ifnull(stock, 0) AS BIGINT) AS stock,
    {disc('gmv', 'normal_amt')} AS discount_rate
  FROM per_store FULL JOIN held USING (brand_nm, store_name) LEFT JOIN kinds USING (brand_nm)"""


_WHOLE21 = _brand_store("TRUE", "TRUE")
SQL["e21_brand_by_store"] = f"SELECT * FROM ({_WHOLE21})"
SQL["e21_brand_by_store_filtered"] = f"""SELECT * FROM ({_brand_store("sales_date >= DATE '2001-01-01'", "cat_top IN ('ECONOMY','PROMO')")})"""
_TC = ", ".join(f"{dbl(c)} {c}" for c in T_COLS)
SQL["e22_target_attainment"] = f"SELECT shop_type, store_name, {_TC}, {T_RATES} FROM {target_rows(None)}, {target_month(None)}"
SQL["e23_target_totals"] = f"""SELECT {_TC}, {T_RATES} FROM (SELECT {", ".join(f"sum({c}) {c}" for c in T_COLS)} FROM {target_rows('2001-05-01')}),
  {target_month('2001-05-01')}"""
SQL["e24_target_daily_curve"] = f"""SELECT coalesce(g.d, a.d) d, {money('g.goal')} goal, {dbl('a.actual')} actual
  FROM (SELECT sales_date d, sum(gmv_goal) goal FROM d_target, {target_month(None)} WHERE sales_date BETWEEN m_start AND m_end GROUP BY 1) g
  FULL JOIN (SELECT sales_date d, round_even({dbl('sum(gmv)')}, 0) actual FROM d_sales, {target_month(None)}
     WHERE sales_date BETWEEN m_start AND last_actual GROUP BY 1) a ON a.d = g.d"""
_MX = "(SELECT date_trunc('month', max(sales_date)) FROM d_settlement_daily)"
_MON = [
    (f"CAST({_MX} - INTERVAL {n} MONTH AS DATE)", f"last_day(CAST({_MX} - INTERVAL {n} MONTH AS DATE))") for n in (0, 1, 12)
]
SQL["e25_pnl"] = " UNION ALL ".join([
    pnl("month", "store_name", _MON),
    pnl("day", "brand_nm", [(f"DATE '{d}'", f"DATE '{d}'") for d in ("2001-06-29", "2001-06-28", "2000-06-29")]),
    pnl("range", "store_name", [("DATE '2001-05-10'", "DATE '2001-06-20'"), ("DATE '2001-03-29'", "DATE '2001-05-09'"),
        ("DATE '2000-05-10'", "DATE '2000-06-20'")], "shop_type IN ('ASIA','EUROPE')"),
])
_MAY = [(f"DATE '{a}'", f"DATE '{b}'") for a, b in (("2001-05-01", "2001-05-31"), ("2001-04-01", "2001-04-30"), ("2000-05-01", "2000-05-31"))]
_PT = ("gmv", "net_take", "cp", "offline_cost", "normal_amt", "pm_cp", "py_cp")
# exact column sums over the rows that have a current period, taken from the same conditional sums
SQL["e26_pnl_totals"] = f"""SELECT {", ".join(f"{dbl(c)} {c}" for c in _PT)}, CAST(qty AS BIGINT) qty, {cp_rate('cp', 'gmv')} cp_rate,
    {ratio('net_take', 'gmv')} nt_rate, {change_abs('cp', 'pm_cp')} pm_delta, {change_abs('cp', 'py_cp')} py_delta
  FROM (SELECT {", ".join(f"sum(CASE WHEN sales_date BETWEEN {_MAY[0][0]} AND {_MAY[0][1]} THEN {c} ELSE 0 END) {c}" for c in (*_PT[:5], "qty"))},
    sum(CASE WHEN sales_date BETWEEN {_MAY[1][0]} AND {_MAY[1][1]} THEN cp ELSE 0 END) pm_cp,
    sum(CASE WHEN sales_date BETWEEN {_MAY[2][0]} AND {_MAY[2][1]} THEN cp ELSE 0 END) py_cp
  FROM d_settlement_daily WHERE brand_nm IN (SELECT brand_nm FROM d_settlement_daily WHERE sales_date BETWEEN {_MAY[0][0]} AND {_MAY[0][1]}))"""
SQL["e26_pnl_months"] = """SELECT strftime(m, '%Y-%m') "month" FROM (SELECT unnest(generate_series(date_trunc('month', min(sales_date)),
  date_trunc('month', max(sales_date)), INTERVAL 1 MONTH)) m FROM d_settlement_daily)"""
SQL["e26_pnl_provisional"] = """SELECT max(sales_date) max_date, DATE '2001-04-30' range_end,
  DATE '2001-04-30' >= CAST(date_trunc('month', max(sales_date)) AS DATE) - 62 provisional FROM d_settlement_daily"""
SQL["e27_demographic_gmv"] = " UNION ALL ".join(
    f"SELECT {c} AS name, {dbl('sum(gmv)')} gmv, '{c}' AS attribute FROM d_customer GROUP BY 1" for c in ("sex", "age_band", "member")
)
SQL["e28_demographic_share"] = f"""SELECT name, {dbl('gmv')} gmv, {ratio('gmv', 'sum(gmv) OVER ()')} AS share,
  CAST(coalesce(list_position(['A0','A1','A2','A3','A4'], name), 0) AS INTEGER) pos
  FROM (SELECT age_band AS name, sum(gmv) gmv FROM d_customer WHERE age_band <> '기타' GROUP BY 1)"""
_J = "sales_date BETWEEN DATE '2001-07-01' AND DATE '2001-07-30'"
_CV = f"{ratio('receipts', 'visitors')} conversion, {ratio('gmv', 'receipts', '')} aov"
_CR = f"""(SELECT v.store_name, v.shop_type, v.visitors, coalesce(r.receipts, 0) receipts, coalesce(r.gmv, 0) gmv
  FROM (SELECT store_name, min(shop_type) shop_type, sum(visitors) visitors FROM d_footfall WHERE {_J} GROUP BY 1) v
  LEFT JOIN (SELECT store_name, count(DISTINCT order_id) receipts, sum(gmv) gmv FROM d_receipts WHERE {_J} GROUP BY 1) r ON r.store_name = v.store_name)"""
SQL["e29_conversion_month"] = f"""
  SELECT store_name, shop_type, {big('visitors')} visitors, {big('receipts')} receipts, {dbl('gmv')} gmv, {_CV} FROM {_CR}
  UNION ALL SELECT '합계', '', {big('visitors')}, {big('receipts')}, {dbl('gmv')}, {_CV}
  FROM (SELECT sum(visitors) visitors, sum(receipts) receipts, sum(gmv) gmv FROM {_CR})"""
SQL["e29_conversion"] = f"""SELECT store_name, shop_type, {big('visitors')} AS visitors, {big('receipts')} AS receipts, {dbl('gmv')} AS gmv, {_CV} FROM (
    SELECT store_name, min(shop_type) AS shop_type, sum(visitors) AS visitors, any_value(receipts) AS receipts, any_value(gmv) AS gmv FROM d_footfall LEFT JOIN
      (SELECT store_name, count(DISTINCT order_id) AS receipts, sum(gmv) AS gmv FROM d_receipts GROUP BY store_name) USING (store_name) GROUP BY store_name)"""
SQL["e30_country_sales"] = f"""SELECT nationality, {dbl('gmv')} gmv, buyers, {ratio('gmv', 't')} AS share, {dbl('t')} total_gmv, n countries
  FROM (SELECT nationality, gmv, buyers, sum(gmv) OVER () t, count(*) OVER () n FROM (
    SELECT nationality, sum(gmv) gmv, {big('sum(buyers)')} buyers FROM d_nationality GROUP BY 1))"""
SQL["e31_foreign_ratio_by"] = f"""SELECT store_name AS name, {dbl('sum(gmv)')} gmv, {dbl('sum(foreign_gmv)')} foreign_gmv,
  {ratio('sum(foreign_gmv)', 'sum(gmv)')} ratio FROM d_sales GROUP BY 1"""
_MS = ("qty", "gmv", "normal_amt", "pay", "foreign_gmv")
_CURR = "sales_date BETWEEN DATE '2001-01-01' AND DATE '2001-06-30'"
_PREV = f"sales_date BETWEEN DATE '2001-01-01' - {_LEN} AND DATE '2000-12-31'"
_cast = lambda m, c: big(c) if m == "qty" else dbl(c)
SQL["e32_previous_period_growth"] = f"""SELECT {", ".join(f"{_cast(m, m)} {m}, {_cast(m, 'prev_' + m)} prev_{m}, {change_abs(m, 'prev_' + m)} {m}_change" for m in _MS)}
  FROM (SELECT {", ".join(f"sum(CASE WHEN {_CURR} THEN {m} ELSE 0 END) {m}, sum(CASE WHEN {_PREV} THEN {m} ELSE 0 END) prev_{m}" for m in _MS)} FROM d_sales)"""
SQL["e33_with_totals"] = f"""SELECT '합계' brand_nm, {SUMS}, {RATES}, TRUE is_total FROM d_sales
  UNION ALL SELECT brand_nm, {SUMS}, {RATES}, FALSE FROM d_sales GROUP BY brand_nm"""
SQL["e34_covered_profit_rate"] = f"""SELECT {money('sum(p.net_take)')} net_take, {money('sum(CASE WHEN p.net_take IS NOT NULL THEN s.gmv END)')} gmv,
    {ratio('sum(p.net_take)', 'sum(CASE WHEN p.net_take IS NOT NULL THEN s.gmv END)')} net_take_rate
  FROM (SELECT goods_no, sum(gmv) gmv FROM d_sales GROUP BY 1) s LEFT JOIN d_profit_goods p ON p.goods_no = s.goods_no"""
_A, _BR = "sales_date BETWEEN DATE '2001-01-01' AND DATE '2001-06-30'", "sales_date BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'"
_P35 = f"(({dbl('a')} - {dbl('b')}) / nullif({dbl('b')}, 0) * 100)"
_AB = f"""{dbl('a')} a_gmv, {dbl('b')} b_gmv, CASE WHEN b <> 0 THEN (CASE WHEN {_P35} > 0 THEN '+' ELSE '' END) || printf('%.1f%%', {_P35})
  WHEN a > 0 THEN '신규' ELSE '-' END AS change"""
_S35 = f"sum(CASE WHEN {_A} THEN gmv ELSE 0 END) a, sum(CASE WHEN {_BR} THEN gmv ELSE 0 END) b"
SQL["e35_ab_compare"] = " UNION ALL ".join(
    f"SELECT name, {_AB}, '{d}' dim FROM (SELECT {c} AS name, {_S35} FROM d_sales WHERE {_A} OR {_BR} GROUP BY 1)"
    for d, c in (("store", "store_name"), ("category", "cat_large"), ("brand", "brand_nm"))
)
SQL["e35_ab_compare_goods"] = f"""SELECT goods_no, brand_nm, goods_nm, cat_medium, {_AB} FROM (
  SELECT goods_no, brand_nm, goods_nm, cat_medium, CASE WHEN qa > 0 THEN a ELSE 0 END a, CASE WHEN qb > 0 THEN b ELSE 0 END b FROM (
    SELECT goods_no, min(brand_nm) brand_nm, min(goods_nm) goods_nm, min(cat_medium) cat_medium, {_S35},
      sum(CASE WHEN {_A} THEN qty ELSE 0 END) qa, sum(CASE WHEN {_BR} THEN qty ELSE 0 END) qb
    FROM d_sales WHERE {_A} OR {_BR} GROUP BY 1) WHERE qa > 0 OR qb > 0)"""

# ---------------------------------------------------------------- F
_REF = "DATE '2001-07-18'"
_F1 = ", ".join(f"{a} {n}_from, {b} {n}_to" for n, (a, b) in RANGES.items())
SQL["f1_compare_windows"] = " UNION ALL ".join(
    f"""SELECT "day" ref, {_F1}, {V_COLS.replace(') v_', ') valid_')}, CAST(isoyear("day") AS INTEGER) iso_year, CAST(weekofyear("day") AS INTEGER) iso_week,
      ['월','화','수','목','금','토','일'][isodow("day")] wday FROM {windows(r)}"""
    for r in ("(SELECT max(sales_date) FROM d_sales)", _REF, "DATE '1995-01-05'", "DATE '2001-03-31'", "DATE '2000-12-31'")
)
_FLOOR = 'sales_date BETWEEN "year" - 364 AND "day"'
SQL["f2_compare_sums"] = f"""SELECT store_name, cat_top, {G_COLS} FROM (SELECT store_name, cat_top, {w_sums()} FROM d_sales, {windows(_REF)}
  WHERE {_FLOOR} GROUP BY ALL)"""
_R3 = "DATE '1995-01-20'"
SQL["f3_add_growth"] = f"""SELECT brand_nm, {G_COLS}, {w_labels()} FROM (SELECT brand_nm, {w_sums()} FROM d_sales, {windows(_R3)} WHERE {_FLOOR} GROUP BY 1), {v_of(_R3)}"""
SQL["f4_compare_by"] = " UNION ALL ".join([compare_by("store_name", _REF, ""), compare_by("cat_large", _REF, ""), compare_by("brand_nm", _REF, "LIMIT 10")])
_ROWS5 = f"""(SELECT s.*, n.goods_no IS NOT NULL is_new FROM (
    SELECT brand_nm, goods_no, min(goods_nm) FILTER ({_FLOOR}) goods_nm, min(cat_top) FILTER ({_FLOOR}) cat_top,
      min(cat_medium) FILTER ({_FLOOR}) cat_medium, {w_sums()} FROM d_sales, {windows(_REF)} GROUP BY 1, 2 HAVING g_day > 0) s
  LEFT JOIN (SELECT DISTINCT goods_no FROM d_goods_master WHERE reg_date >= {_REF} - 90) n ON n.goods_no = s.goods_no)"""
SQL["f5_compare_goods"] = f"""SELECT * FROM (SELECT brand_nm, goods_no, goods_nm, cat_top, cat_medium, {G_COLS}, {w_labels('is_new')}, FALSE is_total
    FROM {_ROWS5}, {v_of(_REF)})
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, {G_COLS}, {w_labels()}, TRUE FROM (SELECT {G_TOTAL} FROM {_ROWS5}), {v_of(_REF)}"""
_MXD = "(SELECT max(sales_date) FROM d_sales)"
SQL["f6_compare_summary"] = f"SELECT {G_COLS}, {w_labels()} FROM (SELECT {w_sums()} FROM d_sales, {windows(_MXD)}), {v_of(_MXD)}"

# ---------------------------------------------------------------- G
D0, D1, D2, D3 = (day(i) for i in range(4))
SQL["g1_recent_dates"] = f"SELECT d FROM (SELECT DISTINCT sales_date d FROM d_sales WHERE sales_date < {AS_OF}) ORDER BY d DESC LIMIT 21"
SQL["g2_day_totals"] = f"""SELECT latest, prev, {dbl('gmv')} gmv, {dbl('foreign_gmv')} foreign_gmv, {dbl('gmv_prev')} gmv_prev, qty, goods, stores,
    {change('gmv', 'gmv_prev')} gmv_delta, {ratio('foreign_gmv', 'gmv')} foreign_ratio, coalesce({change('gmv', 'gmv_prev')} < -5, FALSE) issue
  FROM (SELECT {D0} latest, {D1} prev, sum(gmv) gmv, sum(foreign_gmv) foreign_gmv, {big('sum(qty)')} qty, count(DISTINCT goods_no) goods,
    count(DISTINCT store_name) stores, (SELECT sum(gmv) FROM d_sales WHERE sales_date = {D1}) gmv_prev FROM d_sales WHERE sales_date = {D0})"""
SQL["g3_recent_trend"] = f"""SELECT sales_date d, {dbl('sum(gmv)')} gmv, {big('sum(qty)')} qty, CASE sales_date WHEN {D0} THEN '전일' WHEN {D1} THEN '-2일'
    WHEN {D2} THEN '-3일' WHEN {D3} THEN '-4일' END AS label
  FROM d_sales WHERE sales_date >= {day(13)} GROUP BY sales_date"""
_SH = f"{ratio('sum(gmv)', f'(SELECT sum(gmv) FROM d_sales WHERE sales_date = {D0})')} AS share"
_GQ = f"{dbl('sum(gmv)')} gmv, {big('sum(qty)')} qty, {_SH} FROM d_sales WHERE sales_date = {D0}"
SQL["g4_rank_by"] = f"""SELECT 'store' entity, store_name AS name, min(shop_type) detail, {_GQ} GROUP BY store_name
  UNION ALL SELECT * FROM (SELECT 'brand', brand_nm, NULL, {_GQ} GROUP BY brand_nm ORDER BY sum(gmv) DESC, brand_nm LIMIT 100)
  UNION ALL SELECT * FROM (SELECT 'goods', CAST(goods_no AS VARCHAR), min(brand_nm), {_GQ} GROUP BY goods_no ORDER BY sum(gmv) DESC, goods_no LIMIT 100)"""


def rank_in(entity: str, texts: str, names: str, n: int) -> str:
    g = f"""(SELECT cat_medium, {entity}{texts}, sum(CASE WHEN sales_date = {D0} THEN gmv ELSE 0 END) g0,
      sum(CASE WHEN sales_date = {D1} THEN gmv ELSE 0 END) g1 FROM d_sales WHERE sales_date IN ({D0}, {D1}) GROUP BY cat_medium, {entity} HAVING g0 > 0)"""
    return f"""SELECT r.cat_medium, {entity}{names}, {dbl('g0')} gmv, CAST(pos AS INTEGER) pos, {dbl('t')} cat_total, {ratio('g0', 't')} AS share,
        {change('g0', 'g1')} delta
      FROM (SELECT *, row_number() OVER (PARTITION BY cat_medium ORDER BY g0 DESC, {entity}) pos FROM {g}) r
      JOIN (SELECT cat_medium, sum(g0) t FROM {g} GROUP BY 1 ORDER BY t DESC, cat_medium LIMIT 10) c ON c.cat_medium = r.cat_medium WHERE pos <= {n}"""


SQL["g5_rank_in_category"] = rank_in("brand_nm", "", "", 5)
SQL["g5_rank_goods_in_category"] = rank_in("goods_no", ", min(goods_nm) nm, min(brand_nm) br", ", nm AS name, br brand", 10)
_Q = ", ".join(f"CAST(sum(CASE WHEN sales_date = {d} THEN qty ELSE 0 END) AS BIGINT) q{i}" for i, d in enumerate((D0, D1, D2, D3)))
_G6 = f"(SELECT goods_no, min(goods_nm) AS name, min(brand_nm) brand, {_Q} FROM d_sales WHERE sales_date IN ({D0}, {D1}, {D2}, {D3}) GROUP BY goods_no)"
_GR = f"({dbl('q0')} - {dbl('q1')}) / {dbl('q1')} * 100"
SQL["g6_notable_goods"] = f"""SELECT g.*, t.pos, t.tag, t.tag_pct, {", ".join(f"CAST(coalesce(k.{c}, 0) AS BIGINT) {c}" for c in ("store_stock", "hub1000", "hub1700", "mfs"))}
  FROM {_G6} g JOIN (
    SELECT * FROM (
      SELECT * FROM (SELECT goods_no, 0 pos, '판매TOP' tag, CAST(NULL AS DOUBLE) tag_pct FROM {_G6} ORDER BY q0 DESC, goods_no LIMIT 5)
      UNION ALL SELECT * FROM (SELECT goods_no, 1, '급등', {_GR} p FROM {_G6} WHERE q1 >= 2 ORDER BY p DESC, goods_no LIMIT 5)
      UNION ALL SELECT * FROM (SELECT goods_no, 2, '급락', {_GR} p FROM {_G6} WHERE q1 >= 2 ORDER BY p, goods_no LIMIT 5))
    QUALIFY row_number() OVER (PARTITION BY goods_no ORDER BY pos) = 1) t ON t.goods_no = g.goods_no
  LEFT JOIN d_stock_goods k ON k.goods_no = g.goods_no"""
_RS = f"""(SELECT s.store_name, s.goods_no, s.goods_nm, s.brand_nm, s.sold, k.hub_total, CAST(coalesce(i.stock, 0) AS BIGINT) store_stock,
    coalesce(i.stock, 0) <= 0 urgent
  FROM (SELECT store_name, goods_no, min(goods_nm) goods_nm, min(brand_nm) brand_nm, {big('sum(qty)')} sold FROM d_sales WHERE sales_date = {D0}
    GROUP BY 1, 2 HAVING sum(qty) > 0) s
  JOIN d_stock_goods k ON k.goods_no = s.goods_no AND k.hub_total > 0
  LEFT JOIN d_stock_store i ON i.store_name = s.store_name AND i.goods_no = s.goods_no WHERE coalesce(i.stock, 0) < s.sold * 2)"""
SQL["g7_restock"] = f"SELECT * FROM {_RS}"
_U = f"(SELECT * FROM {_RS} WHERE urgent ORDER BY store_stock, sold DESC, store_name, goods_no LIMIT 1)"
SQL["g8_urgent_restock"] = f"""SELECT n restock_count, u urgent_count, store_name, brand_nm, goods_nm, sold
  FROM (SELECT count(*) n, count(*) FILTER (urgent) u FROM {_RS}) LEFT JOIN {_U} ON TRUE"""
_SP = f"""(SELECT *, ({dbl('q0')} - {dbl('q1')}) / {dbl('q1')} * 100 pct FROM (SELECT store_name,
  CAST(sum(CASE WHEN sales_date = {D0} THEN qty ELSE 0 END) AS BIGINT) q0, CAST(sum(CASE WHEN sales_date = {D1} THEN qty ELSE 0 END) AS BIGINT) q1
  FROM d_sales WHERE sales_date IN ({D0}, {D1}) GROUP BY 1) WHERE q1 >= 3)"""
SQL["g9_store_spikes"] = f"""SELECT * FROM (SELECT 'up' direction, * FROM {_SP} ORDER BY pct DESC, store_name LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'down', * FROM {_SP} ORDER BY pct, store_name LIMIT 1)"""

# ---------------------------------------------------------------- H
SQL["h1_stock_long"] = "SELECT * FROM d_stock_long"
SQL["h2_hub_stock"] = "SELECT * FROM d_hubs"
SQL["h3_stock_meta"] = "SELECT * FROM d_stock_meta"
SQL["h3_stock_pivot"] = f"""SELECT m.*, w.* EXCLUDE (barcode) FROM d_stock_meta m JOIN (
  SELECT barcode, {wide()}, {HUBS_WIDE}, {KIND_TOTALS} FROM d_stock_long GROUP BY barcode) w ON w.barcode = m.barcode"""
SQL["h4_stock_by_goods"] = "SELECT * FROM d_stock_goods"
SQL["h4_stock_store_long"] = "SELECT * FROM d_stock_store"
SQL["h5_stock_by"] = f"SELECT brand_nm, {wide()} FROM d_stock WHERE location_kind = '매장' GROUP BY brand_nm"
SQL["h5_stock_by_goods_stores"] = f"SELECT goods_no, {wide()} FROM d_stock WHERE location_kind = '매장' GROUP BY goods_no"
SQL["h6_operating_stores"] = "SELECT goods_no, count(*) FILTER (stock >= 1) op_stores FROM d_stock_store GROUP BY goods_no"
SQL["h7_stock_kpis"] = f"""SELECT CAST(coalesce(sum(qty) FILTER (location_kind = '매장'), 0) AS BIGINT) jaego,
  CAST(coalesce(sum(qty) FILTER (location_kind = '허브'), 0) AS BIGINT) hub, count(DISTINCT barcode) AS options, count(DISTINCT goods_no) goods FROM d_stock_all"""
_BW = ", ".join(f"CAST(sum(CASE WHEN business_type = '{b}' THEN qty ELSE 0 END) AS BIGINT) \"{b}\"" for b in ("위탁", "매입", "기타"))
SQL["h8_stock_by_store_business"] = f"""SELECT "location" AS name, {_BW}, {big('sum(qty)')} total FROM d_stock_all WHERE location_kind = '매장'
  GROUP BY 1 HAVING sum(qty) > 0"""
SQL["h9_stock_category_share"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS level, CASE WHEN rk <= 8 THEN name ELSE '기타 ' || CAST(n - 8 AS VARCHAR) || '종' END AS name, {big('sum(v)')} AS value
      FROM (SELECT name, v, {_RK}, count(*) OVER () n FROM (SELECT coalesce(nullif(trim({c}), ''), '(미분류)') AS name, sum(qty) v
        FROM d_stock_all GROUP BY 1 HAVING sum(qty) > 0)) GROUP BY 1, 2"""
    for c in ("cat_top", "cat_large", "cat_medium")
)
_OP = f"barcode, brand_nm, goods_nm, goods_no, goods_opt, business_type, {CATS}"
SQL["h10_stock_table"] = f"""SELECT t.*, {_CATALOG} FROM (SELECT {_OP}, {wide()}, {HUBS_WIDE}, {KIND_TOTALS} FROM d_stock_all GROUP BY {_OP}) t LEFT JOIN d_goods_master gm ON gm.goods_no = t.goods_no"""
SQL["h11_stock_export_long"] = f'SELECT {_OP}, location_kind, "location", qty FROM d_stock_all WHERE qty <> 0'

# ---------------------------------------------------------------- I
_WL = ", ".join(f"strftime(w{i}s, '%m/%d') || '~' || strftime(w{i}e, '%m/%d') label_w{i}" for i in range(4))
SQL["i1_week_frame"] = f"SELECT *, {_WL} FROM d_wk"
SQL["i2_store_locations"] = "SELECT * FROM d_loc"
SQL["i3_purchase_brands"] = "SELECT * FROM d_purchase"


def _out(cols: list[str]) -> str:
    return ", ".join(f"{big(c) if '_qty_' in c or c.startswith('qty') else dbl(c)} {c}" for c in cols)


SQL["i4_weekly_sums"] = f"SELECT brand_id, ord_com_type, {_out(OFF_W + OFF_X)} FROM d_offl"
SQL["i4_weekly_sums_online"] = f"SELECT brand_id, ord_com_type, hier, com_id, {_out(ON_W + ON_X)} FROM d_onl"
SQL["i5_representative"] = """SELECT brand_id, ord_com_type, hier FROM d_onl_div WHERE gmv4 > 0 AND coalesce(hier, '') <> 'AFRICA'
  QUALIFY row_number() OVER (PARTITION BY brand_id, ord_com_type ORDER BY gmv4 DESC, hier) = 1"""
SQL["i6_brand_scope"] = "SELECT * FROM d_scope"
SQL["i7_classify_stock"] = "SELECT * FROM d_stk"
_PC = "brand_id, " + ", ".join(POS)
SQL["i8_stock_positions"] = f"SELECT {_PC}, '매입' kind FROM d_pos_own UNION ALL SELECT {_PC}, '위탁' FROM d_pos_con"
SQL["i9_axis"] = "SELECT * FROM d_axis"
SQL["i10_typical_price"] = """SELECT brand_id, normal_price, '매입' gubun FROM d_price_own UNION ALL SELECT brand_id, normal_price, '위탁' FROM d_price_con"""
SQL["i11_sell_through"] = "SELECT * FROM d_ips"
SQL["i12_open_orders"] = """SELECT brand_code AS key, inbound_po FROM d_po_brand UNION ALL SELECT product_no, inbound_po FROM d_po_goods"""
SQL["i13_sell_through_goods"] = "SELECT * FROM d_ips_goods"
_TOT = ["inbound", *POS, *[f"{m}_{c}_w{i}" for i in range(4) for m in ("qty", "gmv", "nt", "cp") for c in ("tot", "on", "off")], "normal_gmv_4w", "inbound_po"]
_q4, _o4 = (" + ".join(f"sum(qty_{c}_w{i})" for i in range(4)) for c in ("tot", "off"))
SQL["i14_sell_through_totals"] = f"""SELECT {", ".join(f"{dbl(f'sum({c})') if c.startswith(('gmv', 'nt', 'cp', 'normal')) else big(f'sum({c})')} {c}" for c in _TOT)},
  round({dbl(f'({_q4})')} / nullif({dbl(f'({_q4})')} + {dbl('sum(total_cur)')}, 0) * 100, 1) sell_through,
  round({dbl('sum(total_cur)')} / (nullif({dbl(f'({_q4})')}, 0) / 28), 1) days_all,
  round({dbl('sum(store_cur)')} / (nullif({dbl(f'({_o4})')}, 0) / 28), 1) days_off FROM d_ips"""
_CW = ", ".join(f"{m}_tot_w{i}" for m in ("qty", "gmv", "nt") for i in range(4))
_CS = ", ".join(f"{' + '.join(f'{m}_tot_w{i}' for i in range(4))} {m}_tot_sum" for m in ("qty", "gmv", "nt"))
SQL["i15_channel_view"] = f"SELECT sil, gubun, brand_code, brand_nm, {_CW}, {_CS} FROM d_ips"
for _name, _c in (("i15_channel_view_online", "on"), ("i15_channel_view_offline", "off")):
    SQL[_name] = f"SELECT sil, gubun, brand_code, brand_nm, {_CW.replace('_tot_', f'_{_c}_')}, {_CS.replace('_tot_', f'_{_c}_')} FROM d_ips"
SQL["i16_sell_through_drill"] = """SELECT * FROM d_ips_goods WHERE brand_code = 'Brand#1' AND gubun = '매입'"""

# ---------------------------------------------------------------- exports
_UNIT = f"CASE WHEN qty <> 0 THEN gmv / {dbl('qty')} ELSE 0 END"
SQL["a7_export_options"] = f"""SELECT sales_date, store_name, cat_large, cat_medium, brand_nm, goods_no, ifnull(style_no, '') AS style_no, goods_nm, option_nm,
    {money('normal_price')} AS normal_price, {money('CASE WHEN sale_price > 0 THEN sale_price ELSE normal_price END')} AS sale_price, {_UNIT} AS unit_price,
    qty, gmv, normal_amt, pay, net_take, cp, stock
  FROM ({SQL["e20_allocate_profit"]}) LEFT JOIN (SELECT goods_no, style_no, normal_price, sale_price FROM d_goods_master) USING (goods_no)"""
SQL["a7_export_brand_store"] = SQL["e21_brand_by_store"]
SQL["a7_export_stock"] = f"SELECT * FROM ({SQL['h11_stock_export_long']})"
SQL["a7_export_restock"] = f"SELECT store_name, brand_nm, goods_no, goods_nm, sold, store_stock, hub_total FROM ({SQL['g7_restock']})"
SQL["a7_export_drill"] = f"SELECT key, qty, gmv, normal_amt, foreign_gmv, goods_count, stock FROM ({drill('brand_nm')})"
