"""Guarded arithmetic. Money stays DECIMAL through every sum and becomes DOUBLE last: stored rows hold
MONEY, the sums of a report WIDE."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

# 18 digits fit a long: Parquet stores them as INT64 with statistics, and rows carry no byte arrays
MONEY = T.DecimalType(18, 2)
# totals of any number of stored rows
WIDE = T.DecimalType(38, 2)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money(x) -> Column:
    return _c(x).cast(MONEY)


def dbl(x) -> Column:
    return _c(x).cast("double")


def total(x) -> Column:
    """Exact sum, 0 for an empty input."""
    return F.coalesce(F.sum(_c(x)), F.lit(0))


def money_sum(x) -> Column:
    """Sum of a report; a wide input keeps its exact sum beyond the range of stored money."""
    return F.coalesce(F.sum(_c(x)), F.lit(0)).cast(WIDE)


def stored_sum(x) -> Column:
    """Sum at the grain of a stored dataset."""
    return F.coalesce(F.sum(_c(x)), F.lit(0)).cast(MONEY)


def cents_sum(x) -> Column:
    """Sum of DECIMAL(14,2) line amounts as stored money, null for an empty input. The buffers are long cents: a decimal sum
    carries 16 bytes and a flag for each amount through the map and the shuffle of a ledger. Longs overflow beyond MONEY only."""
    cents = F.sum((_c(x) * F.lit(100)).cast("bigint"))
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def sum_if(cond: Column, x) -> Column:
    """Conditional sum that keeps the exact type of x."""
    return F.coalesce(F.sum(F.when(cond, _c(x))), F.lit(0))


def ratio(num, den, scale: float | None = 100.0, empty=0.0) -> Column:
    """num / den in double arithmetic; `empty` (None = null) when den is null or 0."""
    q = dbl(num) / F.nullif(dbl(den), F.lit(0.0))
    if scale is not None:
        q = q * F.lit(float(scale))
    return q if empty is None else F.coalesce(q, F.lit(float(empty)))


def discount_rate(gmv, list_amount) -> Column:
    q = (F.lit(1.0) - dbl(gmv) / F.nullif(dbl(list_amount), F.lit(0.0))) * F.lit(100.0)
    return F.coalesce(q, F.lit(0.0))


def change(cur, prev, absolute: bool = False) -> Column:
    """Percent change; null when prev is 0 or null. `absolute` divides by |prev|."""
    c, p = dbl(cur), dbl(prev)
    if absolute:
        return (c - p) / F.nullif(F.abs(p), F.lit(0.0)) * F.lit(100.0)
    return (c / F.nullif(p, F.lit(0.0)) - F.lit(1.0)) * F.lit(100.0)


def blank_to(x, default: str) -> Column:
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(default))


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Last step of a report: every exact column becomes DOUBLE."""
    return df.select(
        [
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
