"""Goals against actual sales."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shopfloor.functions.dates import DateLike, as_date, month_start, newest, prune, within
from shopfloor.functions.numeric import WIDE, dbl, money_sum, ratio, sum_if
from shopfloor.operators.filters import SalesFilter, apply_settlement_filter


@dataclass
class TargetMonth:
    """Dates of one goal month as columns. The running day is never counted as actual."""

    start: Column
    end: Column
    last_actual: Column
    elapsed: Column
    days: Column


def target_month(targets: DataFrame, sales: DataFrame, as_of: DateLike, month: DateLike | None = None) -> TargetMonth:
    """The given month if it has goals, else the month of the last complete day if it has, else the
    newest month with goals."""
    done = F.least(newest(sales, "sales_date"), F.date_sub(as_date(as_of), 1))
    m = month_start(F.col("sales_date"))
    picks = [F.max(F.when(m == month_start(done), m)), F.max(m)]
    if month is not None:
        picks.insert(0, F.max(F.when(m == month_start(month), m)))
    start = as_date(targets.agg(F.coalesce(*picks)).first()[0])
    end = F.last_day(start)
    reached = done >= start
    last = F.when(reached, F.least(end, done)).otherwise(start)
    return TargetMonth(start, end, last, F.when(reached, F.day(last)).otherwise(0), F.day(end))


def _rates(df: DataFrame, tm: TargetMonth) -> DataFrame:
    proj = F.coalesce(dbl("actual_mtd") / F.nullif(dbl(tm.elapsed), F.lit(0.0)) * dbl(tm.days), F.lit(0.0))
    rates = {"rate_day": ratio("actual_day", "goal_day"), "rate_mtd": ratio("actual_mtd", "goal_mtd"), "proj": proj}
    return df.withColumns(rates).withColumn("proj_rate", ratio("proj", "goal_full"))


def target_attainment(targets: DataFrame, sales: DataFrame, tm: TargetMonth, stores=(), types=()) -> DataFrame:
    """Per store: month goal, goal and actual to date and for the last complete day, projection at
    the daily rate so far, previous month and same month last year. Sales are scanned once."""
    f = SalesFilter(store=list(stores), type=list(types))
    m = lambda c, v: sum_if(c, v).cast(WIDE)
    to_date, that_day = F.col("sales_date") <= tm.last_actual, F.col("sales_date").cast("date") == tm.last_actual
    goals = apply_settlement_filter(targets, f).filter(within("sales_date", tm.start, tm.end)).groupBy("store_name").agg(
        F.min("shop_type").alias("goal_type"),
        money_sum("gmv_goal").alias("goal_full"),
        m(to_date, "gmv_goal").alias("goal_mtd"),
        m(that_day, "gmv_goal").alias("goal_day"),
    )
    prev, last = F.add_months(tm.start, -1), F.add_months(tm.start, -12)
    cur = within("sales_date", tm.start, tm.end)
    in_prev, in_last = within("sales_date", prev, F.last_day(prev)), within("sales_date", last, F.last_day(last))
    actual = prune(apply_settlement_filter(sales, f), last, tm.end).filter(cur | in_prev | in_last).groupBy("store_name").agg(
        F.count(F.when(cur, 1)).alias("_n"),
        F.min(F.when(cur, F.col("shop_type"))).alias("actual_type"),
        m(cur & (F.col("sales_date").cast("date") <= tm.last_actual), "gmv").alias("actual_mtd"),
        m(cur & that_day, "gmv").alias("actual_day"),
        m(in_prev, "gmv").alias("pm_actual"),
        m(in_last, "gmv").alias("py_actual"),
    )
    out = goals.join(actual, "store_name", "full_outer").filter(F.col("goal_full").isNotNull() | (F.col("_n") > 0))
    zero = F.lit(0)
    cols = ("goal_full", "goal_day", "actual_day", "goal_mtd", "actual_mtd", "pm_actual", "py_actual")
    out = out.select(
        F.coalesce("goal_type", "actual_type", F.lit("")).alias("shop_type"), "store_name",
        *[F.coalesce(c, zero).cast(WIDE).alias(c) for c in cols],
    )
    return _rates(out, tm)


def target_totals(rows: DataFrame, tm: TargetMonth) -> DataFrame:
    cols = ("goal_full", "goal_day", "actual_day", "goal_mtd", "actual_mtd", "pm_actual", "py_actual")
    return _rates(rows.agg(*[money_sum(c).alias(c) for c in cols]), tm)


def target_daily_curve(targets: DataFrame, sales: DataFrame, tm: TargetMonth, stores=(), types=()) -> DataFrame:
    """Goal and actual per day of the month; actual stays null for days not complete yet."""
    f = SalesFilter(store=list(stores), type=list(types))
    day = F.col("sales_date").cast("date").alias("d")
    g = apply_settlement_filter(targets, f).filter(within("sales_date", tm.start, tm.end)).groupBy(day).agg(money_sum("gmv_goal").alias("goal"))
    a = prune(apply_settlement_filter(sales, f), tm.start, tm.last_actual).filter(within("sales_date", tm.start, tm.last_actual)).groupBy(day).agg(
        F.bround(F.sum("gmv").cast(WIDE), 0).alias("actual")
    )
    return g.join(a, "d", "full_outer").select("d", F.coalesce("goal", F.lit(0)).cast(WIDE).alias("goal"), "actual")
