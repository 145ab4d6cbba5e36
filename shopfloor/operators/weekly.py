"""Weekly integrated sell-through: online and offline sales beside stock snapshots."""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shopfloor.functions import labels as L
from shopfloor.functions.dates import DateLike, as_date, max_date, newest, week_start
from shopfloor.functions.numeric import WIDE, dbl, money_sum, total

BIZ_OWN = "1P"
BIZ_KINDS = ("1P", "3P", "MFS")
KIND = {L.CONSIGNMENT: L.SUPPLY_CONSIGNMENT, L.PURCHASE: L.SUPPLY_PURCHASE}


@dataclass
class Scope:
    """What one business looks at: all lists are parameters."""

    divisions: list[str] = field(default_factory=list)
    extra_companies: list[str] = field(default_factory=list)
    vendors: list[str] = field(default_factory=list)
    excluded_companies: list[str] = field(default_factory=list)
    store_pairs: list[tuple[str, str]] = field(default_factory=list)
    platform: str = ""
    # store-like locations: how their codes begin, and what their names must not hold
    location_prefix: str = ""
    non_store_names: list[str] = field(default_factory=list)
    # division that never represents a brand
    used_division: str | None = None


@dataclass
class Weeks:
    """Dates of the last four complete weeks (w0 newest), the four before, and the snapshots."""

    monday: Column
    sales: list[tuple[Column, Column]]
    prev_four: tuple[Column, Column]
    snapshots: list[Column]
    base: Column
    consignment: Column

    @property
    def four(self) -> tuple[Column, Column]:
        return self.sales[3][0], self.sales[0][1]

    @property
    def span(self) -> tuple[Column, Column]:
        return self.prev_four[0], self.sales[0][1]


def week_frame(as_of: DateLike, newest_history: Column, newest_stock: Column) -> Weeks:
    """Current snapshots are capped by the newest one there is."""
    m = week_start(as_of)
    back = lambda n: F.date_sub(m, n)
    return Weeks(
        monday=m,
        sales=[(back(7 * (i + 1)), back(7 * i + 1)) for i in range(4)],
        prev_four=(back(56), back(29)),
        snapshots=[F.least(m, newest_history), back(7), back(14), back(21)],
        base=back(28),
        consignment=F.least(m, newest_stock),
    )


def weeks_of(as_of: DateLike, stock_history: DataFrame, stock_summary: DataFrame) -> Weeks:
    return week_frame(as_of, newest(stock_history, "base_date"), newest(stock_summary, "ord_state_date"))


def weeks_row(as_of: DateLike, stock_history: DataFrame, stock_summary: DataFrame) -> DataFrame:
    """The same as one row, with the week labels."""
    row = stock_history.agg(F.max("base_date").cast("date").alias("h"))
    w = week_frame(as_of, F.col("h"), max_date(stock_summary, "ord_state_date"))
    cols = [w.monday.alias("ws")]
    for i, (a, b) in enumerate(w.sales):
        text = F.concat(F.date_format(a, "MM/dd"), F.lit("~"), F.date_format(b, "MM/dd"))
        cols += [a.alias(f"w{i}s"), b.alias(f"w{i}e"), text.alias(f"label_w{i}")]
    cols += [w.prev_four[0].alias("p4s"), w.prev_four[1].alias("p4e")]
    cols += [s.alias(f"w{i}") for i, s in enumerate(w.snapshots)]
    return row.select(*cols, w.base.alias("base_mon"), w.consignment.alias("con_dt"))


def store_locations(closing: DataFrame, as_of: DateLike, plant: str, scope: Scope) -> DataFrame:
    """Store-like location codes of a plant in this and the last closing month."""
    ym = lambda d: F.date_format(d, "yyyyMM")
    months = [ym(as_date(as_of)), ym(F.add_months(as_date(as_of), -1))]
    rows = closing.filter(F.col("buper").isin(months) & (F.col("werks") == plant) & F.col("lgort").startswith(scope.location_prefix))
    for part in scope.non_store_names:
        rows = rows.filter(~F.col("lgobe").contains(part))
    return rows.select("lgort").distinct()


def _not_excluded(scope: Scope, col: str = "com_id") -> Column:
    if not scope.excluded_companies:
        return F.lit(True)
    return ~F.coalesce(F.col(col), F.lit("")).isin(list(scope.excluded_companies))


def _with_location_flag(history: DataFrame, locations: DataFrame) -> DataFrame:
    loc = locations.select(F.col("lgort").alias("storage_loc_cd"), F.lit(True).alias("_listed"))
    return history.join(loc, "storage_loc_cd", "left").withColumn("_listed", F.coalesce("_listed", F.lit(False)))


def _members(col: str, values) -> Column:
    """NULL-safe membership: null is not a member."""
    return F.coalesce(F.col(col).isin(list(values)), F.lit(False)) if values else F.lit(False)


def purchase_brands(history: DataFrame, goods: DataFrame, locations: DataFrame, weeks: Weeks, scope: Scope) -> DataFrame:
    """Brands with own stock now, by vendor or by store-like location of the second plant. Stock is
    reduced to distinct goods before it meets the goods table."""
    rows = history.filter(
        (F.col("base_date") == weeks.snapshots[0]) & (F.col("platform") == scope.platform) & (F.col("biz_type") == BIZ_OWN)
    ).filter(_not_excluded(scope))
    rows = _with_location_flag(rows, locations).filter(_members("com_id", scope.vendors) | F.col("_listed"))
    own = rows.select("product_no").distinct()
    g = goods.filter(F.col("brand").isNotNull()).select(F.col("goods_no").cast("string").alias("product_no"), "brand")
    return g.join(own, "product_no", "left_semi").select("brand").distinct()


def weekly_sums(facts: DataFrame, weeks: Weeks, measures: dict[str, Column], keys: list, date_col: str = "ord_state_date", extra=()) -> DataFrame:
    """Four week columns per measure from one pass. The scan is bounded by the eight weeks."""
    d = F.col(date_col)
    rows = facts.filter(d.between(*weeks.span))
    cols = []
    for name, expr in measures.items():
        for i, (a, b) in enumerate(weeks.sales):
            cols.append(F.coalesce(F.sum(F.when(d.between(a, b), expr)), F.lit(0)).alias(f"{name}_w{i}"))
    return rows.groupBy(*keys).agg(*cols, *extra)


def range_sum(weeks_range: tuple[Column, Column], expr: Column, name: str, date_col: str = "ord_state_date") -> Column:
    return F.coalesce(F.sum(F.when(F.col(date_col).between(*weeks_range), expr)), F.lit(0)).alias(name)


def brand_scope(by_division: DataFrame, purchase: DataFrame) -> DataFrame:
    """Brands by division, by company, or purchased; excluded companies out. The online sums hold
    exactly the brands of the rows in scope, so the orders are not read again."""
    hit = by_division.select(F.col("brand_id").alias("brand"))
    return hit.unionByName(purchase.select("brand")).distinct()


def in_scope_online(online: DataFrame, purchase: DataFrame, weeks: Weeks, scope: Scope) -> DataFrame:
    """Online rows of the eight weeks that belong to the scope."""
    rows = online.filter(F.col("ord_state_date").between(*weeks.span)).filter(_not_excluded(scope))
    bought = purchase.select("brand", F.lit(True).alias("_bought"))
    rows = rows.join(bought, "brand", "left")
    own = (F.col("ord_com_type") == L.SUPPLY_PURCHASE) & F.coalesce("_bought", F.lit(False))
    keep = _members("hier", scope.divisions) | _members("com_id", scope.extra_companies) | F.coalesce(own, F.lit(False))
    return rows.filter(keep).drop("_bought")


def _online_measures() -> dict[str, Column]:
    return {
        "on_qty": F.col("sell_sub_clm_qty"), "on_gmv": F.col("normal_gmv"), "on_nt": F.col("revenue"),
        "on_cp": F.col("contribution_profit_pre"),
    }


def _offline_measures() -> dict[str, Column]:
    return {
        "off_qty": F.col("sell_qty") - F.col("clm_qty"), "off_gmv": F.col("ord_amt"), "off_nt": F.col("profit"),
        "off_cp": F.col("contribution_profit"),
    }


def online_by_division(online: DataFrame, purchase: DataFrame, weeks: Weeks, scope: Scope) -> DataFrame:
    """Weekly online measures per brand, supply type and division."""
    m = _online_measures()
    rows = in_scope_online(online, purchase, weeks, scope)
    coupon = F.col("mem_dc") + F.col("cou_dc") + F.col("cart_cou_dc")
    return weekly_sums(
        rows, weeks, m, [F.col("brand").alias("brand_id"), "ord_com_type", "hier"],
        extra=[
            F.max("com_id").alias("com_id"),
            range_sum(weeks.four, m["on_gmv"], "gmv4"),
            F.coalesce(F.sum(F.when(F.col("ord_state_date") >= weeks.base, coupon)), F.lit(0)).alias("coupon_m0"),
            range_sum(weeks.four, F.col("normal_ggmv"), "on_nggmv_4w"),
            range_sum(weeks.prev_four, m["on_gmv"], "gmv_prev4w"),
            range_sum(weeks.prev_four, m["on_qty"], "qty_prev4w"),
        ],
    )


def online_weekly(by_division: DataFrame) -> DataFrame:
    """The divisions of a brand and supply type together."""
    skip = ("brand_id", "ord_com_type", "hier", "com_id", "gmv4")
    sums = [F.sum(c).alias(c) for c in by_division.columns if c not in skip]
    return by_division.groupBy("brand_id", "ord_com_type").agg(F.max("hier").alias("hier"), F.max("com_id").alias("com_id"), *sums)


def offline_weekly(settlement: DataFrame, weeks: Weeks) -> DataFrame:
    m = _offline_measures()
    return weekly_sums(
        settlement.filter(F.col("ord_com_type").isNotNull()), weeks, m, ["brand_id", "ord_com_type"],
        extra=[
            range_sum(weeks.four, F.col("normal_amt"), "off_namt_4w"),
            range_sum(weeks.four, F.col("coupon_dc_amt"), "off_coupon_4w"),
            range_sum(weeks.prev_four, m["off_gmv"], "off_gmv_prev4w"),
            range_sum(weeks.prev_four, m["off_qty"], "off_qty_prev4w"),
        ],
    )


def representative(df: DataFrame, keys: list[str], label: str, weight: str, exclude=()) -> DataFrame:
    """Label with the greatest weight per key, the first label on a tie. An aggregate, not a window."""
    if exclude:
        df = df.filter(~F.coalesce(F.col(label), F.lit("")).isin(list(exclude)))
    return df.groupBy(*keys).agg(F.min_by(label, F.struct((-F.col(weight)).alias("w"), F.col(label))).alias(label))


def classify_stock(
    history: DataFrame, goods: DataFrame, brands: DataFrame, locations: DataFrame, weeks: Weeks, scope: Scope
) -> DataFrame:
    """Snapshots of the five dates for the goods of the scope, flagged as store or logistics stock.
    A location counts as a store by its (code, name) pair or by the list of the second plant.
    Rows are summed at the grain the later steps need before the goods join."""
    goods = goods.join(brands, "brand", "left_semi")
    companies = goods.filter(F.col("com_id").isNotNull()).select("com_id").distinct().withColumn("_known", F.lit(True))
    dates = [*weeks.snapshots, weeks.base]
    on_date = reduce(lambda x, y: x | y, [F.col("base_date") == d for d in dates])
    rows = history.filter((F.col("platform") == scope.platform) & F.col("biz_type").isin(list(BIZ_KINDS)) & on_date)
    rows = _with_location_flag(rows.filter(_not_excluded(scope)), locations)
    pair = F.lit(False)
    for code, name in scope.store_pairs:
        pair = pair | ((F.col("storage_loc_cd") == code) & (F.col("storage_loc_nm") == name))
    store = F.when(F.coalesce(pair, F.lit(False)) | F.col("_listed"), 1).otherwise(0)
    rows = rows.groupBy("product_no", "biz_type", "com_id", "base_date", store.alias("is_store")).agg(
        F.sum("end_stock_qty").alias("end_stock_qty")
    )
    rows = rows.join(companies, "com_id", "left").filter(F.col("com_id").isNull() | F.col("_known")).drop("_known")
    g = goods.select(F.col("goods_no").cast("string").alias("product_no"), F.col("brand").alias("brand_id"))
    # a row for each goods: merged, not sent whole through the driver
    return rows.join(g.hint("merge"), "product_no").groupBy("brand_id", "biz_type", "com_id", "is_store", "base_date").agg(
        F.sum("end_stock_qty").cast("bigint").alias("end_stock_qty")
    )


def stock_positions(stock: DataFrame, weeks: Weeks, purchased: bool) -> DataFrame:
    """Stock per brand now and at the base date, and in the stores at the four snapshots."""
    rows = stock.filter((F.col("biz_type") == BIZ_OWN) if purchased else (F.col("biz_type") != BIZ_OWN))
    return rows.groupBy("brand_id").agg(*_position_sums(weeks))


def _position_sums(weeks: Weeks) -> list[Column]:
    q, d, s = F.col("end_stock_qty"), F.col("base_date"), F.col("is_store") == 1
    at = lambda cond, name: F.coalesce(F.sum(F.when(cond, q)), F.lit(0)).alias(name)
    now, base = d == weeks.snapshots[0], d == weeks.base
    return [
        at(now, "total_cur"), at(now & s, "store_cur"), at(now & ~s, "logi_cur"), at(base, "total_base"),
        at(base & s, "store_base"), *[at((d == w) & s, f"st_w{i}") for i, w in enumerate(weeks.snapshots)],
    ]


def axis(online: DataFrame, offline: DataFrame, stock: DataFrame, purchase: DataFrame) -> DataFrame:
    """(brand, supply type) seen online, offline (within the scope) or in stock."""
    pair = ["brand_id", "ord_com_type"]
    scope = online.select("brand_id").unionByName(purchase.select(F.col("brand").alias("brand_id"))).distinct()
    kind = F.when(F.col("biz_type") == BIZ_OWN, L.SUPPLY_PURCHASE).otherwise(L.SUPPLY_CONSIGNMENT)
    parts = [
        online.select(pair),
        offline.select(pair).join(scope, "brand_id", "left_semi"),
        stock.select("brand_id", kind.alias("ord_com_type")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def _mean(x: Column) -> Column:
    return dbl(F.sum(x)) / F.nullif(F.count(x), F.lit(0))


def purchase_price(goods: DataFrame) -> DataFrame:
    """Rounded mean list price per brand, zero prices out."""
    p = F.nullif("normal_price", F.lit(0).cast("decimal(14,2)"))
    return goods.groupBy(F.col("brand").alias("brand_id")).agg(F.max("brand_nm").alias("brand_nm"), F.round(_mean(p)).alias("normal_price"))


def consignment_source(stock_summary: DataFrame, weeks: Weeks) -> DataFrame:
    rows = stock_summary.filter((F.col("ord_state_date") == weeks.consignment) & (F.col("ord_com_type") == L.SUPPLY_CONSIGNMENT))
    p = F.nullif("normal_price", F.lit(0).cast("decimal(14,2)"))
    return rows.groupBy(F.col("brand").alias("brand_id"), "com_id").agg(
        F.sum("sellable_qty").alias("sellable_qty"), _mean(p).cast("decimal(20,6)").alias("avg_price")
    )


def consignment_price(source: DataFrame) -> DataFrame:
    """Rounded mean of the company means per brand."""
    return source.filter(F.col("avg_price") > 0).groupBy("brand_id").agg(F.round(_mean(F.col("avg_price"))).alias("normal_price"))


def typical_price(goods: DataFrame, stock_summary: DataFrame, weeks: Weeks) -> DataFrame:
    own = purchase_price(goods).select("brand_id", "normal_price").withColumn("gubun", F.lit(L.PURCHASE))
    con = consignment_price(consignment_source(stock_summary, weeks)).withColumn("gubun", F.lit(L.CONSIGNMENT))
    return own.unionByName(con.select(own.columns))


def open_orders(po: DataFrame, goods: DataFrame, as_of: DateLike, plant: str, key: str = "brand") -> DataFrame:
    """Quantity on order and due on or after `as_of`. Orders are summed per goods before the join."""
    due = po.filter(
        (F.col("werks") == plant) & (F.col("loekz").isNull() | (F.col("loekz") == ""))
        & (F.col("eindt") >= F.date_format(as_date(as_of), "yyyyMMdd"))
    )
    by_goods = due.groupBy(F.col("s_matnr").alias("product_no")).agg(F.sum("menge").cast("bigint").alias("inbound_po"))
    if key == "goods":
        return by_goods
    g = goods.filter(F.col("brand").isNotNull()).select(F.col("goods_no").cast("string").alias("product_no"), F.col("brand").alias("brand_code"))
    return by_goods.join(g.hint("merge"), "product_no").groupBy("brand_code").agg(F.sum("inbound_po").cast("bigint").alias("inbound_po"))


def _add(parts: list[str]) -> Column:
    return reduce(lambda x, y: x + y, [F.col(p) for p in parts])


W4 = range(4)


def rates(df: DataFrame, sold: Column, off: Column | None = None) -> DataFrame:
    """Sell-through and cover days on the four-week sales; null where undefined."""
    cur = dbl("total_cur")
    cols = {
        "sell_through": F.round(dbl(sold) / F.nullif(dbl(sold) + cur, F.lit(0.0)) * F.lit(100.0), 1),
        "days_all": F.when(sold > 0, F.round(cur / (dbl(sold) / F.lit(28.0)), 1)),
    }
    if off is not None:
        cols["days_off"] = F.when(off > 0, F.round(dbl("store_cur") / (dbl(off) / F.lit(28.0)), 1))
    return df.withColumns(cols)


STOCK_COLUMNS = ("total_cur", "store_cur", "logi_cur", "total_base", "store_base", "st_w0", "st_w1", "st_w2", "st_w3")


def sell_through(
    axis: DataFrame, online: DataFrame, divisions: DataFrame, offline: DataFrame, stock: DataFrame, goods: DataFrame,
    consignment: DataFrame, po_brand: DataFrame, weeks: Weeks, scope: Scope,
) -> DataFrame:
    """The report: brand x supply kind with stock, inflow, weekly sales by channel, sell-through and
    cover days. Both kinds go through one set of joins, on (brand, kind)."""
    pair = ["brand_id", "ord_com_type"]
    kinds = [L.SUPPLY_CONSIGNMENT, L.SUPPLY_PURCHASE]
    purchased = F.col("ord_com_type") == L.SUPPLY_PURCHASE
    tag = lambda df, kind: df.withColumn("ord_com_type", F.lit(kind))
    con = consignment
    own_price = purchase_price(goods)
    prices = tag(own_price.select("brand_id", "normal_price"), kinds[1]).unionByName(tag(consignment_price(con), kinds[0]))
    kind = F.when(F.col("biz_type") == BIZ_OWN, kinds[1]).otherwise(kinds[0]).alias("ord_com_type")
    positions = stock.groupBy("brand_id", kind).agg(*_position_sums(weeks))
    vendors = stock.filter((F.col("biz_type") == BIZ_OWN) & (F.col("base_date") == weeks.snapshots[0]))
    vendors = vendors.groupBy("brand_id", "com_id").agg(F.sum("end_stock_qty").alias("w"))
    reps = tag(representative(vendors, ["brand_id"], "com_id", "w"), kinds[1]).unionByName(
        tag(representative(con, ["brand_id"], "com_id", "sellable_qty", scope.excluded_companies), kinds[0])
    ).withColumnRenamed("com_id", "rep_com")
    heads = divisions.filter(F.col("hier").isNotNull() & (F.col("gmv4") > 0))
    heads = representative(heads, pair, "hier", "gmv4", [scope.used_division] if scope.used_division else ()).withColumnRenamed("hier", "rep_hier")
    names = own_price.select("brand_id", "brand_nm")

    rows = axis.filter(F.col("ord_com_type").isin(kinds))
    for side in (online, offline, positions, prices, reps, heads):
        rows = rows.join(side, pair, "left")
    rows = rows.join(names, "brand_id", "left")
    zero = F.lit(0)
    value_cols = [f"{ch}_{m}_w{i}" for ch in ("on", "off") for m in ("qty", "gmv", "nt", "cp") for i in W4]
    filled = {c: F.coalesce(c, zero) for c in [*value_cols, "on_nggmv_4w", "off_namt_4w", *STOCK_COLUMNS]}
    rows = rows.withColumns({**filled, "normal_price": F.coalesce("normal_price", F.lit(0.0))})

    week = lambda ch, m: [f"{ch}_{m}_w{i}" for i in W4]
    on_gmv, off_gmv = _add(week("on", "gmv")), _add(week("off", "gmv"))
    rows = rows.filter((on_gmv > 0) | (off_gmv > 0) | (F.col("total_cur") > 0))
    off_qty = _add(week("off", "qty"))
    sold = _add(week("on", "qty")) + off_qty
    rows = rows.withColumn("inbound", F.greatest(F.col("store_cur") - F.col("store_base") + off_qty, zero))
    rows = rates(rows, sold, off_qty)
    out = [
        F.coalesce("rep_hier", "hier", F.lit("")).alias("sil"),
        F.when(purchased, L.PURCHASE).otherwise(L.CONSIGNMENT).alias("gubun"),
        F.col("brand_id").alias("brand_code"),
        F.coalesce("rep_com", "com_id", F.lit("")).alias("com_id"),
        F.coalesce("brand_nm", "brand_id").alias("brand_nm"),
        *[F.col(c).cast("bigint").alias(c) for c in ("inbound", *STOCK_COLUMNS)],
        "sell_through", "days_all", "days_off",
    ]
    whole = lambda c: F.round(c, 0).cast(WIDE)
    for i in W4:
        on, off = F.col(f"on_qty_w{i}"), F.col(f"off_qty_w{i}")
        out += [x.cast("bigint").alias(f"qty_{n}_w{i}") for n, x in (("tot", on + off), ("on", on), ("off", off))]
        for m in ("gmv", "nt", "cp"):
            on, off = F.col(f"on_{m}_w{i}"), F.col(f"off_{m}_w{i}")
            out += [whole(x).alias(f"{m}_{n}_w{i}") for n, x in (("tot", on + off), ("on", on), ("off", off))]
    out += ["normal_price", whole(F.col("on_nggmv_4w") + F.col("off_namt_4w")).alias("normal_gmv_4w")]
    rows = rows.select(*out)
    due = po_brand.withColumn("gubun", F.lit(L.PURCHASE))
    rows = rows.join(due, ["brand_code", "gubun"], "left")
    return rows.withColumn("inbound_po", F.coalesce("inbound_po", zero).cast("bigint"))


def sell_through_goods(
    online: DataFrame, settlement: DataFrame, history: DataFrame, goods: DataFrame, brands: DataFrame, locations: DataFrame,
    po_goods: DataFrame, weeks: Weeks, scope: Scope,
) -> DataFrame:
    """The same at brand x kind x goods, four weeks only. The three sides are stacked and summed
    once instead of joined pairwise, so one shuffle on the key serves all of them."""
    key = ["brand_id", "product_no", "gubun"]
    kind = F.when(F.col("ord_com_type") == L.SUPPLY_PURCHASE, L.PURCHASE).otherwise(L.CONSIGNMENT).alias("gubun")
    product = F.col("goods_no").cast("string").alias("product_no")
    in_scope = lambda df, col: df.join(brands.select(F.col("brand").alias(col)), col, "left_semi")
    four = F.col("ord_state_date").between(*weeks.four)
    g = in_scope(goods.filter(F.col("goods_no").isNotNull()), "brand").groupBy(F.col("brand").alias("brand_id"), product).agg(
        F.min("goods_nm").alias("goods_nm"), F.min("brand_nm").alias("brand_nm")
    )
    on = in_scope(online.filter(four & F.col("goods_no").isNotNull() & _not_excluded(scope)), "brand").select(
        F.col("brand").alias("brand_id"), product, kind,
        F.col("sell_sub_clm_qty").alias("on_qty"), F.col("normal_gmv").alias("on_gmv"), F.col("revenue").alias("on_nt"),
    )
    off = in_scope(settlement.filter(four & F.col("goods_no").isNotNull() & F.col("ord_com_type").isNotNull()), "brand_id").select(
        "brand_id", product, kind,
        (F.col("sell_qty") - F.col("clm_qty")).alias("off_qty"), F.col("ord_amt").alias("off_gmv"), F.col("profit").alias("off_nt"),
    )
    rows = history.filter(
        (F.col("platform") == scope.platform) & F.col("biz_type").isin(list(BIZ_KINDS)) & (F.col("base_date") == weeks.snapshots[0])
    ).filter(_not_excluded(scope))
    rows = _with_location_flag(rows, locations)
    pair = F.lit(False)
    for code, name in scope.store_pairs:
        pair = pair | ((F.col("storage_loc_cd") == code) & (F.col("storage_loc_nm") == name))
    is_store = F.coalesce(pair, F.lit(False)) | F.col("_listed")
    own = F.when(F.col("biz_type") == BIZ_OWN, L.PURCHASE).otherwise(L.CONSIGNMENT).alias("gubun")
    held = rows.groupBy("product_no", own).agg(
        F.sum("end_stock_qty").alias("total_cur"), F.sum(F.when(is_store, F.col("end_stock_qty")).otherwise(0)).alias("store_cur")
    )
    held = held.join(g.select("product_no", "brand_id").hint("merge"), "product_no").select(*key, "total_cur", "store_cur")
    stack = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [on, off, held])
    out = stack.groupBy(*key).agg(
        *[total(c).cast("bigint").alias(c) for c in ("total_cur", "store_cur", "on_qty", "off_qty")],
        *[money_sum(c).alias(c) for c in ("on_gmv", "off_gmv", "on_nt", "off_nt")],
    )
    out = out.filter((F.col("on_gmv") + F.col("off_gmv") > 0) | (F.col("total_cur") > 0))
    out = out.join(g.hint("merge"), ["brand_id", "product_no"], "left")
    out = rates(out, F.col("on_qty") + F.col("off_qty"))
    whole = lambda c: F.round(c, 0).cast(WIDE)
    blank = F.lit("")
    cols = [
        F.col("brand_id").alias("brand_code"), "gubun", "product_no", F.coalesce("goods_nm", blank).alias("goods_nm"),
        F.coalesce("brand_nm", blank).alias("brand_nm"), "total_cur", "store_cur",
        (F.col("total_cur") - F.col("store_cur")).alias("logi_cur"), F.col("on_qty").alias("qty_on"), F.col("off_qty").alias("qty_off"),
        (F.col("on_qty") + F.col("off_qty")).alias("qty_tot"),
    ]
    for m in ("gmv", "nt"):
        on_m, off_m = F.col(f"on_{m}"), F.col(f"off_{m}")
        cols += [whole(x).alias(f"{m}_{n}") for n, x in (("on", on_m), ("off", off_m), ("tot", on_m + off_m))]
    out = out.select(*cols, "sell_through", "days_all")
    out = out.join(po_goods.withColumn("gubun", F.lit(L.PURCHASE)), ["product_no", "gubun"], "left")
    return out.withColumn("inbound_po", F.coalesce("inbound_po", F.lit(0)).cast("bigint"))


IDS = ("sil", "gubun", "brand_code", "com_id", "brand_nm")
DERIVED = ("sell_through", "days_all", "days_off", "normal_price")


def sell_through_totals(df: DataFrame) -> DataFrame:
    """Column sums; rates and cover days are recomputed from the sums."""
    types = {x.name: x.dataType for x in df.schema.fields}
    t = df.agg(*[total(c).cast(types[c]).alias(c) for c in df.columns if c not in IDS + DERIVED])
    q4, off4 = _add([f"qty_tot_w{i}" for i in W4]), _add([f"qty_off_w{i}" for i in W4])
    cur = dbl("total_cur")
    t = t.withColumn("sell_through", F.round(dbl(q4) / F.nullif(dbl(q4) + cur, F.lit(0.0)) * F.lit(100.0), 1))
    t = t.withColumn("days_all", F.round(cur / (F.nullif(dbl(q4), F.lit(0.0)) / F.lit(28.0)), 1))
    return t.withColumn("days_off", F.round(dbl("store_cur") / (F.nullif(dbl(off4), F.lit(0.0)) / F.lit(28.0)), 1))


def channel_view(df: DataFrame, channel: str) -> DataFrame:
    """Week columns and four-week sums of one channel: tot, on or off."""
    weeks = [f"{m}_{channel}_w{i}" for m in ("qty", "gmv", "nt") for i in W4]
    out = df.select("sil", "gubun", "brand_code", "brand_nm", *weeks)
    return out.withColumns({f"{m}_{channel}_sum": _add([f"{m}_{channel}_w{i}" for i in W4]) for m in ("qty", "gmv", "nt")})


def sell_through_drill(goods_rows: DataFrame, brand_code: str, kind: str, limit: int | None = None) -> DataFrame:
    """Goods of a brand and kind; with a limit those with the largest amount."""
    out = goods_rows.filter((F.col("brand_code") == brand_code) & (F.col("gubun") == kind))
    return out if limit is None else out.orderBy(F.desc("gmv_tot"), "product_no").limit(limit)
