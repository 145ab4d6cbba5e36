"""Operators on small hand-made frames, against results worked out by hand or by brute force."""

import datetime as dt
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shopfloor.functions import labels as L
from shopfloor.functions.dates import bucket, red_days
from shopfloor.functions.numeric import change, discount_rate, ratio
from shopfloor.operators import compare as C, daily as G, dimensions as D, facts as A, filters as P, profit as R, sales as E, weekly as K
from shopfloor.sources.tables import SCHEMAS, export_csv

D1, D2, D3 = dt.date(2024, 3, 1), dt.date(2024, 3, 2), dt.date(2024, 3, 5)


def ts(d, h=9):
    return dt.datetime(d.year, d.month, d.day, h)


def money(x):
    return Decimal(x).quantize(Decimal("0.01"))


@pytest.fixture
def ledger(frame):
    stores = frame("shop_no INT, shop_type STRING, store_name STRING", [(1, "KICKS", "S1"), (2, "RUN", "S2")])
    orders = frame(
        SCHEMAS["order_header"],
        [
            (1, 1, ts(D2), ts(D1), 50, 0, "IMMEDIATE"),
            (2, 1, None, ts(D1), 50, 0, None),
            (3, 2, None, ts(D1), 10, 0, "NONE"),  # not completed, refunded
            (4, 2, None, ts(D1), 50, 1, None),  # dummy
            (5, 9, None, ts(D1), 50, 0, None),  # store out of scope
        ],
    )
    lines = frame(
        SCHEMAS["order_line"],
        [(o, g, "c", "b", "nm", " " if g == 11 else "M", 2, money(100), money(120), money(90)) for o in range(1, 6) for g in (10, 11)],
    )
    claims = frame(
        SCHEMAS["claim"],
        [
            (1, "REFUND", ts(D2)), (1, "REFUND", ts(D2, 15)), (1, "REFUND", ts(D3)), (2, "EXCHANGE", ts(D3)), (3, "REFUND", ts(D3)),
            (4, "REFUND", ts(D3)),
        ],
    )
    return orders, lines, claims, stores


def test_bookings(ledger):
    orders, _, claims, stores = ledger
    got = sorted((r["order_id"], r["sales_date"], r["sign"], r["is_foreign"]) for r in A.ledger_events(orders, claims, stores).collect())
    # two refund dates book back twice; the refund of an open order counts, that of a dummy order does not
    assert got == [(1, D2, -1, 1), (1, D2, 1, 1), (1, D3, -1, 1), (2, D1, 1, 0), (3, D3, -1, 0)]


def test_bookings_since_use_the_claim_date(ledger):
    orders, _, claims, stores = ledger
    got = sorted((r["order_id"], r["sales_date"], r["sign"]) for r in A.ledger_events(orders, claims, stores, D3).collect())
    assert got == [(1, D3, -1), (3, D3, -1)]


def test_option_sales(ledger, frame):
    orders, lines, claims, stores = ledger
    brands = frame("com_id STRING, brand_code STRING, brand_nm STRING, business_type STRING", [])
    cats = frame("goods_no BIGINT, cat_top STRING, cat_large STRING, cat_medium STRING, off_md_id STRING", [])
    out = A.net_sales_option(orders, lines, claims, stores, brands, cats, as_of=dt.date(2024, 3, 20)).collect()
    got = {(r["sales_date"], r["store_name"], r["goods_no"]): (r["option_nm"], r["qty"], r["gmv"], r["brand_nm"]) for r in out}
    assert got[(D1, "S1", 11)] == (L.NO_OPTION, 2, money(100), L.UNMATCHED_BRAND)
    assert got[(D2, "S1", 10)] == ("M", 0, money(0), L.UNMATCHED_BRAND)
    assert got[(D3, "S1", 10)][1] == -2
    late = dict(as_of=dt.date(2024, 6, 20))
    assert A.net_sales_option(orders, lines, claims, stores, brands, cats, **late).count() == len(out)  # no floor: all days
    assert A.net_sales_option(orders, lines, claims, stores, brands, cats, **late, floor_days=60).count() == 0


def test_store_dimension(frame):
    shops = frame("shop_no INT, shop_type STRING, shop_nm STRING", [(1, "kicks", "a"), (1, "kicks", "a"), (90, "outlet", " x   y "), (3, "web", "z")])
    names = frame("shop_no INT, shop_name STRING", [(1, "  Big    Shop ")])
    got = sorted(tuple(r) for r in D.dim_store(shops, names, ("kicks", "outlet"), {90: "RUN"}).collect())
    assert got == [(1, "KICKS", "Big Shop"), (90, "RUN", "x y")]


def test_prices_with_conflicting_batches(frame):
    t1, t2 = ts(D1), ts(D2)
    feed = frame(
        SCHEMAS["price_feed"],
        [(1, t1, 1, money(10), money(20)), (1, t2, 1, money(11), money(20)), (1, t2, 1, money(99), money(20)), (1, t2, 2, money(5), money(20)),
         (2, t2, 1, money(7), money(9)), (2, t2, 1, money(7), money(9))],
    )
    assert D.quarantine_prices(feed.filter("channel_id = 1")).count() == 3
    got = {r["goods_id"]: r["sale_price"] for r in D.latest_prices(feed).collect()}
    assert got == {1: money(10), 2: money(7)}


def test_mode_name_ties_and_blanks(frame):
    a = frame("md_id STRING, md_nm STRING", [("m", "B"), ("m", "A"), ("m", " "), ("m", " "), ("m", " "), (None, "Z")])
    assert [tuple(r) for r in D.mode_name([a], "md_id", "md_nm").collect()] == [("m", "A")]


def test_latest_by_key_with_a_hot_key(frame, spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("t"), (F.col("id") * 2).alias("v"))
    want = defaultdict(lambda: (-1, None))
    for i in range(3000):
        k = 0 if i < 2000 else i % 7
        want[k] = max(want[k], (i, i * 2))
    assert {r["k"]: (r["t"], r["v"]) for r in D.latest_by_key(df, ["k"], "t").collect()} == dict(want)


def test_guarded_arithmetic(spark):
    r = spark.range(1).select(
        ratio(F.lit(1), F.lit(0)).alias("a"), ratio(F.lit(1), F.lit(0), empty=None).alias("b"), discount_rate(F.lit(80), F.lit(100)).alias("c"),
        change(F.lit(5), F.lit(-10), absolute=True).alias("d"), change(F.lit(5), F.lit(-10)).alias("e"), change(F.lit(5), F.lit(0)).alias("f"),
    ).first()
    assert r["a"] == 0 and r["b"] is None and abs(r["c"] - 20) < 1e-9 and r["d"] == 150 and r["e"] == -150 and r["f"] is None


def test_red_days(frame):
    days = ["2024-02-12", "2024-02-13", "2024-02-18", "2001-03-01", "2001-03-02", "2030-12-25", "2025-05-06"]
    df = frame("d DATE", [(dt.date.fromisoformat(d),) for d in days])
    got = {str(r["d"]): r["is_red_day"] for r in red_days(df, "d").collect()}
    assert got == dict(zip(days, [True, False, True, True, False, True, True]))


def brute_windows(ref):
    """The eight ranges with plain dates."""
    one = dt.timedelta(days=1)
    week, month, year = ref - one * ref.weekday(), ref.replace(day=1), ref.replace(month=1, day=1)
    last = month - one
    pm = last.replace(day=1)
    return {
        "day": (ref, ref), "prev_day": (ref - one, ref - one), "week": (week, ref), "prev_week": (week - 7 * one, ref - 7 * one),
        "month": (month, ref), "prev_month": (pm, min(pm + (ref - month), last)), "year": (year, ref),
        "prev_year": (year - 364 * one, ref - 364 * one),
    }


@pytest.mark.parametrize("ref", ["2024-03-31", "2024-02-29", "2023-01-01", "2024-12-30"])
def test_compare_windows(spark, ref):
    ref = dt.date.fromisoformat(ref)
    w = C.compare_windows(ref, F.lit(dt.date(2000, 1, 1)), F.lit(ref))
    row = spark.range(1).select(*[c.alias(f"{n}{i}") for n, ab in w.ranges.items() for i, c in enumerate(ab)]).first()
    assert {n: (row[f"{n}0"], row[f"{n}1"]) for n in w.ranges} == brute_windows(ref)


def test_growth_labels(spark):
    t, f = F.lit(True), F.lit(False)
    cases = [
        (C.growth_label(F.lit(1), F.lit(0), f, t), "X"), (C.growth_label(F.lit(1), F.lit(0), t, t), "신규"),
        (C.growth_label(F.lit(1), F.lit(0), t, f), "—"), (C.growth_label(F.lit(0), F.lit(0), t, t), "—"),
        (C.growth_label(F.lit(15), F.lit(10), t, t), "+50.0%"), (C.growth_label(F.lit(5), F.lit(10), t, t), "-50.0%"),
        (E.ab_label(F.lit(15), F.lit(10)), "+50.0%"), (E.ab_label(F.lit(0), F.lit(0)), "-"), (E.ab_label(F.lit(3), F.lit(0)), "신규"),
        (E.ab_label(F.lit(10), F.lit(10)), "0.0%"),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [w for _, w in cases]


def test_pnl_dates(spark):
    leap = dt.date(2024, 2, 29)
    (a, b), (c, d), (e, f) = R.pnl_ranges(None, "range", leap, dt.date(2024, 2, 20))  # given in the wrong order
    row = spark.range(1).select(*[x.alias(f"x{i}") for i, x in enumerate((a, b, c, d, e, f))]).first()
    day = dt.date
    assert list(row) == [day(2024, 2, 20), leap, day(2024, 2, 10), day(2024, 2, 19), day(2023, 2, 20), leap - dt.timedelta(days=365)]


def sales_frame(frame, rows):
    ddl = (
        "sales_date DATE, store_name STRING, shop_type STRING, business_type STRING, brand_nm STRING, goods_no BIGINT, cat_top STRING, "
        "cat_large STRING, cat_medium STRING, off_md_id STRING, goods_nm STRING, qty BIGINT, gmv DECIMAL(18,2), normal_amt DECIMAL(18,2), "
        "pay DECIMAL(18,2), foreign_gmv DECIMAL(18,2)"
    )
    full = [(d, s, "T", b, br, g, "t", "l", m, "", f"goods {g}", q, money(v), money(v * 2), money(v), money(fv)) for d, s, b, br, g, m, q, v, fv in rows]
    return frame(ddl, full)


@pytest.fixture
def small_sales(frame):
    return sales_frame(
        frame,
        [
            (D1, "S1", "위탁", "A", 1, "m1", 5, 50, 10), (D1, "S2", "매입", "B", 2, "m2", 1, 30, 0), (D2, "S1", "위탁", "A", 1, "m1", 2, 20, 0),
            (D2, "S1", "매입", "B", 3, "m1", 4, 80, 0), (D3, "S2", "매입", "B", 2, "m2", -1, -30, 0), (D3, "S1", "위탁", "A", 1, "m1", 9, 90, 95),
        ],
    )


def test_take_rate_and_estimates(frame, small_sales):
    settled = frame(
        "sales_date DATE, store_name STRING, shop_type STRING, goods_no BIGINT, net_take DECIMAL(18,2), cp DECIMAL(18,2)",
        [(D1, "S1", "T", 1, money(5), money(1)), (D2, "S1", "T", 3, money(8), money(2))],
    )
    as_of = dt.date(2024, 3, 6)
    rate = {r["goods_no"]: r for r in R.take_rate(small_sales, settled, small_sales, as_of).collect()}
    assert abs(rate[1]["rate"] - 0.1) < 1e-12 and rate[1]["settled_days"] == 1 and rate[2]["rate"] is None
    assert abs(rate[2]["overall_rate"] - 13 / 130) < 1e-12
    got = {r["goods_no"]: (r["net_take"], r["cp"]) for r in R.profit_by_goods(small_sales, settled, P.NO_FILTER, as_of).collect()}
    # goods 1: 5 settled + 10 % of 20 and 90; goods 2 never settled
    assert got == {1: (money(16), money(1)), 2: (None, None), 3: (money(8), money(2))}


def test_segments_are_clipped(small_sales):
    got = {(r["name"], r["segment"]): r["value"] for r in E.segment_split(small_sales.filter(F.col("sales_date") == D3), "store_name").collect()}
    assert got[("S1", L.DOMESTIC)] == 0 and got[("S1", L.FOREIGN)] == money(95) and got[("S2", L.DOMESTIC)] == 0


def test_trend_overlay_matches_by_position(small_sales):
    f = P.SalesFilter(date_from=D2, date_to=D3)
    got = sorted((r["bucket"], r["gmv"], r["prev_gmv"]) for r in E.trend_overlay(small_sales, f).collect())
    assert got == [(D2, money(100), money(80)), (D3, money(60), None)]


def test_cross_facets_ignore_their_own_selection(small_sales):
    f = P.SalesFilter(store=["S1"], brand=["B"])
    got = {(r["dim"], r["member"]): r["gmv"] for r in P.cross_facets(small_sales, f, ["store", "brand"]).collect()}
    assert got == {("store", "S1"): money(80), ("store", "S2"): money(0), ("brand", "A"): money(160), ("brand", "B"): money(80)}


def test_notable_goods_precedence(frame, small_sales):
    stock = frame("goods_no BIGINT, store_stock BIGINT, hub_total BIGINT, hub1000 BIGINT, hub1700 BIGINT, mfs BIGINT", [(1, 3, 9, 4, 5, 0)])
    days = G.ReportDays(small_sales, dt.date(2024, 3, 6))
    got = {r["goods_no"]: (r["tag"], r["q0"], r["q1"], r["hub1700"]) for r in G.notable_goods(small_sales, stock, days, n=1).collect()}
    # goods 1 sells most and rises most: best seller wins; goods 3 falls
    assert got == {1: (L.BEST_SELLER, 9, 2, 5), 3: (L.FALLING, 0, 4, 0)}


def test_report_days_with_short_history(frame, small_sales):
    days = G.ReportDays(small_sales.filter(F.col("sales_date") == D1), dt.date(2024, 3, 6))
    row = G.day_totals(small_sales.filter(F.col("sales_date") == D1), days).first()
    assert row["latest"] == D1 and row["prev"] is None and row["gmv"] == money(80) and row["gmv_delta"] is None and not row["issue"]


def test_restock(frame, small_sales):
    stock = frame("goods_no BIGINT, store_name STRING, stock BIGINT", [(1, "S1", 17)])
    goods = frame("goods_no BIGINT, hub_total BIGINT", [(1, 4)])
    days = G.ReportDays(small_sales, dt.date(2024, 3, 6))
    rows = G.restock(small_sales, stock, goods, days)
    assert [(r["store_name"], r["goods_no"], r["sold"], r["store_stock"], r["urgent"]) for r in rows.collect()] == [("S1", 1, 9, 17, False)]
    assert G.urgent_restock(rows).first()["urgent_count"] == 0


def test_representative_ties(frame):
    df = frame("k STRING, v STRING, w BIGINT", [("a", "y", 5), ("a", "x", 5), ("a", "z", 9), ("b", "q", 1)])
    assert {tuple(r) for r in K.representative(df, ["k"], "v", "w", ["z"]).collect()} == {("a", "x"), ("b", "q")}


def test_bucket_weeks_start_on_monday(frame):
    df = frame("sales_date DATE", [(dt.date(2024, 3, 3),), (dt.date(2024, 3, 4),)])
    assert [r[0] for r in df.select(bucket("sales_date", "week")).collect()] == [dt.date(2024, 2, 26), dt.date(2024, 3, 4)]


def test_name_filter_is_literal(small_sales):
    assert P.apply_sales_filter(small_sales, P.SalesFilter(name_like="GOODS 1")).count() == 3
    assert P.apply_sales_filter(small_sales, P.SalesFilter(name_like="%")).count() == 0


def test_csv_export(spark, frame, tmp_path):
    df = frame("key STRING, qty BIGINT, x INT", [("a,b", 3, 1)])
    path = export_csv(df, str(tmp_path / "csv"), ["key", "qty"], {"in_store": "S1"})
    assert [tuple(r) for r in spark.read.option("header", True).csv(path).collect()] == [("S1", "a,b", "3")]


def test_skewed_ledger_matches_brute_force(spark, frame):
    """A third of all lines in one order and one goods."""
    stores = frame("shop_no INT, shop_type STRING, store_name STRING", [(1, "KICKS", "S1")])
    orders = frame(SCHEMAS["order_header"], [(o, 1, None, ts(D1), 50, 0, None) for o in range(200)])
    line = [(0 if i % 3 == 0 else i % 200, 7 if i % 3 == 0 else i % 50, "c", "b", "n", "o", 1, money(i % 90), money(100), money(1)) for i in range(6000)]
    lines = frame(SCHEMAS["order_line"], line)
    claims = frame(SCHEMAS["claim"], [(0, "REFUND", ts(D3)), (5, "REFUND", ts(D3))])
    got = A._book(lines, A.ledger_events(orders, claims, stores), ["goods_no"])
    want = defaultdict(lambda: [0, Decimal(0)])
    for o, g, *_, q, v, _n, _p in line:
        for day, sign in [(D1, 1)] + ([(D3, -1)] if o in (0, 5) else []):
            want[(day, g)][0] += sign * q
            want[(day, g)][1] += sign * v
    assert {(r["sales_date"], r["goods_no"]): [r["qty"], r["gmv"]] for r in got.collect()} == dict(want)


def test_cents_are_summed_exactly_and_empty_is_null(frame):
    from decimal import Decimal as Dec

    from shopfloor.functions.numeric import cents_sum

    rows = [("a", Dec("0.10")), ("a", Dec("0.20")), ("a", Dec("-999999999999.99")), ("a", None), ("b", None)]
    df = frame("k string, v decimal(14,2)", rows).groupBy("k").agg(cents_sum("v").alias("v"))
    assert df.schema["v"].dataType.simpleString() == "decimal(18,2)"
    assert {r.k: r.v for r in df.collect()} == {"a": Dec("-999999999999.69"), "b": None}


def test_profit_is_shared_within_a_day_store_and_goods(frame):
    import datetime as dt
    from decimal import Decimal as Dec

    from shopfloor.operators.profit import allocate_profit

    day = dt.date(2001, 1, 1)
    ddl = "sales_date date, store_name string, shop_type string, business_type string, brand_nm string, goods_no long, option_nm string, " \
          "cat_top string, cat_large string, cat_medium string, off_md_id string, goods_nm string, qty long, " \
          "gmv decimal(18,2), normal_amt decimal(18,2), pay decimal(18,2)"
    row = lambda goods, option, gmv, store="s": (day, store, "T", "b", "n", goods, option, "c", "l", "m", "", f"g{option}", 1, Dec(gmv), Dec(gmv), Dec(gmv))
    sold = frame(ddl, [row(1, "x", "30.00"), row(1, "x", "30.00"), row(1, "y", "20.00"), row(None, "x", "5.00"), row(1, "x", "7.00", None), row(2, "x", "9.00")])
    settled = frame("sales_date date, store_name string, shop_type string, goods_no long, net_take decimal(18,2), cp decimal(18,2)", [(day, "s", "T", 1, Dec("8.00"), Dec("4.00"))])
    stock = frame("goods_no long, store_name string, stock long", [(1, "s", 3)])
    out = {(r.goods_no, r.option_nm): (r.net_take, r.cp, r.stock) for r in allocate_profit(sold, settled, stock).collect()}
    assert out == {(1, "x"): (6.0, 3.0, 3), (1, "y"): (2.0, 1.0, 3), (2, "x"): (None, None, 0)}
