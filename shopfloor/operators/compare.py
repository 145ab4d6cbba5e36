"""Reference-day comparison: eight windows, four growth labels."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shopfloor.functions import labels as L
from shopfloor.functions.dates import DateLike, as_date, date_span, month_start, prune, within, week_start, year_start
from shopfloor.functions.numeric import WIDE, dbl, money_sum, sum_if
from shopfloor.operators.filters import NO_FILTER, SalesFilter, apply_sales_filter

YEAR_SHIFT = 364
NEW_GOODS_DAYS = 90
WINDOW_NAMES = ("day", "prev_day", "week", "prev_week", "month", "prev_month", "year", "prev_year")
GROWTH = (("day", "prev_day"), ("week", "prev_week"), ("month", "prev_month"), ("year", "prev_year"))


@dataclass
class Windows:
    """Closed ranges and validity flags of one reference day."""

    ref: Column
    ranges: dict[str, tuple[Column, Column]]
    valid: dict[str, Column]

    @property
    def floor(self) -> Column:
        return F.least(*[a for a, _ in self.ranges.values()])


def compare_windows(ref: DateLike, dmin: Column, dmax: Column) -> Windows:
    ref = as_date(ref)
    yesterday, week, month, year = F.date_sub(ref, 1), week_start(ref), month_start(ref), year_start(ref)
    prev_month = F.add_months(month, -1)
    # same number of elapsed days, clipped to the end of the previous month
    prev_month_end = F.least(F.date_add(prev_month, F.datediff(ref, month)), F.date_sub(month, 1))
    ranges = {
        "day": (ref, ref),
        "prev_day": (yesterday, yesterday),
        "week": (week, ref),
        "prev_week": (F.date_sub(week, 7), F.date_sub(ref, 7)),
        "month": (month, ref),
        "prev_month": (prev_month, prev_month_end),
        "year": (year, ref),
        "prev_year": (F.date_sub(year, YEAR_SHIFT), F.date_sub(ref, YEAR_SHIFT)),
    }
    valid = {
        "day": yesterday.between(dmin, dmax),
        "week": dmin <= ranges["prev_week"][0],
        "month": dmin <= prev_month,
        "year": dmin <= ranges["prev_year"][0],
    }
    return Windows(ref, ranges, valid)


def sales_windows(sales: DataFrame, ref: DateLike | None = None, span: tuple[DateLike, DateLike] | None = None) -> Windows:
    """Windows over one sales dataset; the newest day is the default reference."""
    dmin, dmax = map(as_date, span) if span else date_span(sales, "sales_date")[:2]
    return compare_windows(dmax if ref is None else ref, dmin, dmax)


def windows_frame(sales: DataFrame, ref: DateLike | None = None, span: tuple[DateLike, DateLike] | None = None) -> DataFrame:
    """The windows as one row, with the ISO year and week and the weekday of the reference day. A stored dataset knows its
    `span` (oldest and newest day); else the days of its first and last month are asked for."""
    lo, hi = span or date_span(sales, "sales_date")[:2]
    span = sales.sparkSession.range(1).select(as_date(lo).alias("dmin"), as_date(hi).alias("dmax"))
    w = compare_windows(F.col("dmax") if ref is None else ref, F.col("dmin"), F.col("dmax"))
    weekday = F.element_at(F.array(*[F.lit(x) for x in L.WEEKDAY_LABELS]), F.weekday(w.ref) + 1)
    cols = [w.ref.alias("ref")]
    for n, (a, b) in w.ranges.items():
        cols += [a.alias(f"{n}_from"), b.alias(f"{n}_to")]
    cols += [v.alias(f"valid_{n}") for n, v in w.valid.items()]
    iso_year = F.extract(F.lit("YEAROFWEEK"), w.ref).cast("int")
    return span.select(*cols, iso_year.alias("iso_year"), F.weekofyear(w.ref).alias("iso_week"), weekday.alias("wday"))


def compare_sums(sales: DataFrame, windows: Windows, keys: list[str], extra: list[Column] = ()) -> DataFrame:
    """Eight conditional sums in a single scan from the earliest window to the reference day. A group
    without rows in that span is absent."""
    sums = [sum_if(within("sales_date", *windows.ranges[n]), "gmv").cast(WIDE).alias(f"g_{n}") for n in WINDOW_NAMES]
    rows = prune(sales, windows.floor, windows.ref).filter(within("sales_date", windows.floor, windows.ref))
    return rows.groupBy(*keys).agg(*sums, *extra) if keys else rows.agg(*sums, *extra)


def growth_label(cur: Column, base: Column, valid: Column, new_ok: Column) -> Column:
    p = (dbl(cur) - dbl(base)) / F.nullif(dbl(base), F.lit(0.0)) * F.lit(100.0)
    fresh = F.when((dbl(cur) > 0) & new_ok, L.GROWTH_NEW).otherwise(L.GROWTH_NONE)
    return F.when(~valid, L.GROWTH_INVALID).when(dbl(base) == 0, fresh).otherwise(F.format_string("%+.1f%%", p))


def add_growth(df: DataFrame, windows: Windows, new_ok: Column | None = None) -> DataFrame:
    ok = F.lit(True) if new_ok is None else new_ok
    labels = {f"growth_{c}": growth_label(F.col(f"g_{c}"), F.col(f"g_{b}"), windows.valid[c], ok) for c, b in GROWTH}
    return df.withColumns(labels)


def _capped_with_total(
    rows: DataFrame, windows: Windows, keys: list[str], cap: int | None, new_ok: Column | None = None
) -> DataFrame:
    """Total over all rows, then all rows or the largest `cap`."""
    total = rows.agg(*[money_sum(f"g_{n}").alias(f"g_{n}") for n in WINDOW_NAMES]).withColumn("is_total", F.lit(True))
    shown = rows if cap is None else rows.orderBy(F.desc("g_day"), *keys).limit(cap)
    both = shown.withColumn("is_total", F.lit(False)).unionByName(total, allowMissingColumns=True)
    ok = None if new_ok is None else F.col("is_total") | new_ok
    return add_growth(both, windows, ok).drop("is_new")


def compare_by(
    sales: DataFrame, windows: Windows, key: str, f: SalesFilter = NO_FILTER, cap: int | None = None
) -> DataFrame:
    """Groups with sales on the reference day, and their total taken before the cap."""
    rows = compare_sums(apply_sales_filter(sales, f.without("date_from", "date_to")), windows, [key]).filter(F.col("g_day") > 0)
    return _capped_with_total(rows.withColumnRenamed(key, "name"), windows, ["name"], cap)


def compare_goods(
    sales: DataFrame, goods: DataFrame, windows: Windows, f: SalesFilter = NO_FILTER, cap: int | None = None
) -> DataFrame:
    """By brand and goods; only goods registered in the last 90 days may be called new."""
    names = ("goods_nm", "cat_top", "cat_medium")
    named = compare_sums(apply_sales_filter(sales, f.without("date_from", "date_to")), windows, ["brand_nm", "goods_no", *names])
    # names as keys first: the rows are hashed, and the text minimum is taken over the few groups left
    rows = named.groupBy("brand_nm", "goods_no").agg(
        *[F.min(c).alias(c) for c in names], *[F.sum(f"g_{n}").cast(WIDE).alias(f"g_{n}") for n in WINDOW_NAMES]
    )
    fresh = goods.filter(F.col("reg_date") >= F.date_sub(windows.ref, NEW_GOODS_DAYS)).select("goods_no").distinct()
    rows = rows.filter(F.col("g_day") > 0).join(fresh.withColumn("is_new", F.lit(True)), "goods_no", "left")
    return _capped_with_total(rows, windows, ["brand_nm", "goods_no"], cap, F.coalesce("is_new", F.lit(False)))


def compare_summary(sales: DataFrame, windows: Windows, f: SalesFilter = NO_FILTER) -> DataFrame:
    return add_growth(compare_sums(apply_sales_filter(sales, f.without("date_from", "date_to")), windows, []), windows)
