"""Filters: lists of column predicates that Spark pushes to the scan."""

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from shopfloor.functions import labels as L
from shopfloor.functions.dates import add_days, as_date, date_span, month_start, prune, week_start, year_start
from shopfloor.functions.numeric import money_sum, total
from shopfloor.operators.dimensions import CATEGORIES, least_texts

# fixed values: filter name -> column
IN_COLUMNS = {
    "biz": "business_type", "type": "shop_type", "store": "store_name", "brand": "brand_nm", "cat_top": "cat_top",
    "cat_large": "cat_large", "cat_medium": "cat_medium", "md": "off_md_id", "concept": "concept",
}
SALES = ("biz", "type", "store", "brand", "cat_top", "cat_large", "cat_medium", "md", "concept")
RECEIPTS = ("biz", "type", "store", "brand", "cat_top", "cat_large", "cat_medium")
STORES = ("type", "store")


@dataclass(frozen=True)
class SalesFilter:
    date_from: dt.date | str | None = None
    date_to: dt.date | str | None = None
    biz: list[str] = field(default_factory=list)
    type: list[str] = field(default_factory=list)
    store: list[str] = field(default_factory=list)
    brand: list[str] = field(default_factory=list)
    cat_top: list[str] = field(default_factory=list)
    cat_large: list[str] = field(default_factory=list)
    cat_medium: list[str] = field(default_factory=list)
    md: list[str] = field(default_factory=list)
    goods: list[int] = field(default_factory=list)
    name_like: str | None = None
    concept: list[str] = field(default_factory=list)

    def without(self, *names: str) -> "SalesFilter":
        empty = {n: None if n in ("date_from", "date_to", "name_like") else [] for n in names}
        return replace(self, **empty)


NO_FILTER = SalesFilter()


def _dates(f: SalesFilter) -> list[Column]:
    out = []
    if f.date_from:
        out.append(F.col("sales_date") >= as_date(f.date_from))
    if f.date_to:
        out.append(F.col("sales_date") < add_days(f.date_to, 1))
    return out


def _members(f: SalesFilter, names, columns=IN_COLUMNS) -> list[Column]:
    return [F.col(columns[n]).isin(list(getattr(f, n))) for n in names if getattr(f, n)]


def _goods(f: SalesFilter) -> list[Column]:
    out = []
    if f.goods:
        out.append(F.col("goods_no").isin([int(g) for g in f.goods]))
    if f.name_like and f.name_like.strip():
        out.append(F.lower("goods_nm").contains(f.name_like.strip().lower()))
    return out


def _where(df: DataFrame, preds: list[Column]) -> DataFrame:
    for p in preds:
        df = df.filter(p)
    return df


def _pruned(df: DataFrame, f: SalesFilter) -> DataFrame:
    return prune(df, f.date_from or None, f.date_to or None)


def apply_sales_filter(df: DataFrame, f: SalesFilter = NO_FILTER) -> DataFrame:
    return _where(_pruned(df, f), _dates(f) + _members(f, SALES) + _goods(f))


def apply_receipt_filter(df: DataFrame, f: SalesFilter = NO_FILTER) -> DataFrame:
    """The receipt grain has no MD, goods or name."""
    return _where(_pruned(df, f), _dates(f) + _members(f, RECEIPTS))


def apply_settlement_filter(df: DataFrame, f: SalesFilter = NO_FILTER) -> DataFrame:
    return _where(_pruned(df, f), _dates(f) + _members(f, STORES))


def apply_traffic_filter(df: DataFrame, date_from=None, date_to=None, stores=(), types=()) -> DataFrame:
    return apply_settlement_filter(df, SalesFilter(date_from, date_to, store=list(stores), type=list(types)))


def apply_stock_filter(stock: DataFrame, f: SalesFilter, store_types: DataFrame | None = None) -> DataFrame:
    """Filter a long stock frame (barcode x location). Store rows are cut to the visible stores
    (store list, else store type, else all), hub rows stay; options left without any positive
    store or hub total drop out, as do blank names."""
    df = _where(stock, _members(f, ("biz", "brand", "cat_top", "cat_large", "cat_medium", "md")) + _goods(f))
    df = df.filter(F.trim("goods_nm") != "")
    is_store = F.col("location_kind") == L.STORE
    if f.store:
        df = df.filter(~is_store | F.col("location").isin(list(f.store)))
    elif f.type:
        seen = store_types.filter(F.col("shop_type").isin(list(f.type))).select(F.col("store_name").alias("location")).distinct()
        df = df.filter(~is_store).unionByName(df.filter(is_store).join(seen, "location", "left_semi"))
    qty = lambda kind: F.sum(F.when(F.col("location_kind") == kind, F.col("qty")))
    keep = df.groupBy("barcode").agg(qty(L.STORE).alias("_s"), qty(L.HUB).alias("_h"))
    keep = keep.filter((F.col("_s") > 0) | (F.col("_h") > 0)).select("barcode")
    return df.join(keep, "barcode", "left_semi")


def goods_attributes(sales: DataFrame) -> DataFrame:
    """One row per goods with its dimensions and name, so that joining it to stock cannot repeat
    stock. Worth keeping as a table: the stock side of every drill reads it instead of the sales."""
    cols = ["goods_nm", "brand_nm", *CATEGORIES, "business_type"]
    return least_texts(sales, ["goods_no"], {c: c for c in cols})


def drill_stock_filter(stock_store: DataFrame, attributes: DataFrame, f: SalesFilter) -> DataFrame:
    """goods x store stock under the stock-side filters: no date, store type or MD. The attributes have a row for each goods
    and are merged, not sent whole through the driver, however small their file."""
    df = stock_store.join(attributes.hint("merge"), "goods_no", "left")
    return _where(df, _members(f, ("biz", "store", "brand", "cat_top", "cat_large", "cat_medium")) + _goods(f))


def cross_facets(sales: DataFrame, f: SalesFilter, dims: list[str]) -> DataFrame:
    """Amount per member of each dimension, where a dimension ignores the selection on itself.

    One scan: the filters of the listed dimensions become flags, each row is expanded once per
    dimension it still counts for, and one aggregate combines on the map side."""
    base = apply_sales_filter(sales, f.without(*dims))
    flags = {d: (F.col(IN_COLUMNS[d]).isin(list(getattr(f, d))) if getattr(f, d) else F.lit(True)) for d in dims}
    slots = []
    for d in dims:
        others = F.lit(True)
        for o in dims:
            if o != d:
                others = others & flags[o]
        slots.append(F.when(others, F.struct(F.lit(d).alias("dim"), F.col(IN_COLUMNS[d]).alias("member"))))
    cols = [IN_COLUMNS[d] for d in dims]
    grouped = base.groupBy(*dict.fromkeys(cols)).agg(F.sum("gmv").alias("gmv"))
    tagged = grouped.select(F.explode(F.array_compact(F.array(*slots))).alias("s"), "gmv")
    return tagged.groupBy(F.col("s.dim").alias("dim"), F.col("s.member").alias("member")).agg(money_sum("gmv").alias("gmv"))


def preset_ranges(last: Column, first: Column) -> dict[str, tuple[Column, Column]]:
    """The seven quick ranges relative to the newest date; starts are clamped to the oldest."""
    monday, month, year = week_start(last), month_start(last), year_start(last)
    prev_month, prev_year = F.add_months(month, -1), F.add_months(year, -12)
    ranges = [
        (last, last),
        (monday, last),
        (F.date_sub(monday, 7), F.date_sub(monday, 1)),
        (month, last),
        (prev_month, F.date_sub(month, 1)),
        (year, last),
        (prev_year, F.date_sub(year, 1)),
    ]
    clamp = lambda c: F.greatest(c, first)
    return {n: (a if i == 0 else clamp(a), b) for i, (n, (a, b)) in enumerate(zip(L.PRESET_LABELS, ranges))}


def kpis_by_preset(sales: DataFrame, f: SalesFilter = NO_FILTER) -> DataFrame:
    """KPI sums of each quick range. Days are summed first; each day then counts for the ranges
    that hold it, so no row is multiplied before aggregation."""
    first, last, _ = date_span(sales, "sales_date")
    ranges = preset_ranges(last, first)
    earliest = F.least(*[a for a, _ in ranges.values()])
    rows = prune(apply_sales_filter(sales, f.without("date_from", "date_to")), earliest).filter(F.col("sales_date") >= earliest)
    measures = ["gmv", "normal_amt", "pay", "foreign_gmv"]
    days = rows.groupBy(F.col("sales_date").cast("date").alias("d")).agg(
        F.sum("qty").alias("qty"), *[F.sum(m).alias(m) for m in measures]
    )
    entries = [
        F.struct(F.lit(n).alias("preset"), F.lit(i).alias("pos"), a.alias("date_from"), b.alias("date_to"))
        for i, (n, (a, b)) in enumerate(ranges.items())
    ]
    spread = days.select("*", F.explode(F.array(*entries)).alias("p"))
    inside = F.col("d").between(F.col("p.date_from"), F.col("p.date_to"))
    keys = [F.col(f"p.{c}").alias(c) for c in ("preset", "pos", "date_from", "date_to")]
    return spread.groupBy(*keys).agg(
        total(F.when(inside, F.col("qty"))).cast("bigint").alias("qty"),
        *[money_sum(F.when(inside, F.col(m))).alias(m) for m in measures],
    )


def report_basis(df: DataFrame, cat_top: str | None = None, business: str | None = None) -> DataFrame:
    """Two optional equality filters of the daily report; the 'all' label disables one."""
    if cat_top and cat_top != L.ALL:
        df = df.filter(F.col("cat_top") == cat_top)
    if business and business != L.ALL:
        df = df.filter(F.col("business_type") == business)
    return df


def weekly_search(df: DataFrame, kind=(), division=(), text: str = "") -> DataFrame:
    if kind:
        df = df.filter(F.col("gubun").isin(list(kind)))
    if division:
        df = df.filter(F.col("sil").isin(list(division)))
    t = text.strip().lower()
    if t:
        df = df.filter(F.lower("brand_nm").contains(t) | F.lower("brand_code").contains(t))
    return df
