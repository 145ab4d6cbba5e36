"""Invariants of the datasets and reports."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.queries import AS_OF
from shopfloor.functions import labels as L
from shopfloor.operators import compare as C, filters as P, profit as R, rollups as U, sales as E, stock as H
from shopfloor.plans import datasets as X
from shopfloor.sources import layout


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def total(df, col):
    return df.agg(F.sum(col)).first()[0]


def test_window_replacement_equals_full_build(spark, data):
    full = data.settlement_rows()
    since = layout.window_start(full, 90)
    stale = full.filter(F.col("sales_date") < F.date_add(since, 5)).withColumn("cp", F.lit(0).cast("decimal(18,2)"))
    stale = full.filter(F.col("sales_date") < since).unionByName(stale.filter(F.col("sales_date") >= since))
    assert rows(layout.replace_window(stale, data.settlement_rows(since), since)) == rows(full.drop(layout.MONTH))


def test_window_replacement_on_disk_keeps_old_months(spark, data):
    path = layout.scratch_path(spark, "t")
    full = data.settlement_daily_rows()
    newest = full.agg(F.max("sales_date")).first()[0]
    start = newest - dt.timedelta(days=90)
    broken = full.withColumn("qty", F.when(F.col("sales_date") >= F.lit(start), F.lit(0).cast("bigint")).otherwise(F.col("qty")))
    layout.write_monthly(broken, path)
    layout.replace_window_on_disk(spark, path, data.settlement_daily_rows, 90)
    got = layout.read_monthly(spark, path).drop(layout.MONTH)
    assert rows(got.select(full.columns)) == rows(full)


def test_window_replacement_drops_a_month_without_rows(spark, frame):
    path = layout.scratch_path(spark, "gone")
    day = dt.date
    old = frame("sales_date DATE, v INT", [(day(2024, 1, 5), 1), (day(2024, 2, 20), 2), (day(2024, 3, 1), 3), (day(2024, 3, 9), 4)])
    layout.write_monthly(old, path)
    fresh = frame("sales_date DATE, v INT", [(day(2024, 2, 25), 9)])
    layout.replace_window_on_disk(spark, path, lambda since: fresh if since is None else fresh.filter(F.col("sales_date") >= since), 15)
    got = layout.read_monthly(spark, path).select("sales_date", "v")
    assert rows(got) == [(day(2024, 1, 5), 1), (day(2024, 2, 20), 2), (day(2024, 2, 25), 9)]


def test_late_option_refresh_leaves_no_gap(spark, data, tmp_path):
    early = X.Settings(**{**data.settings.__dict__, "as_of": AS_OF, "option_floor_days": 60})
    late = X.Settings(**{**data.settings.__dict__, "as_of": dt.date(2001, 12, 20), "option_floor_days": 60})
    root = str(tmp_path)
    X.refresh(spark, X.Datasets(data.inputs, early), root, "snap", ("sales_option",))
    before = rows(X.read_dataset(spark, root, "sales_option"))
    X.refresh(spark, X.Datasets(data.inputs, late), root, "snap", ("sales_option",))
    after = rows(X.read_dataset(spark, root, "sales_option"))
    floor = dt.date(2001, 12, 20) - dt.timedelta(days=60)
    assert [r for r in after if r[0] < floor] == [r for r in before if r[0] < floor]


def test_refresh_modes(spark, data, tmp_path):
    x = X.Datasets(data.inputs, data.settings, layout.Store(spark))
    root = str(tmp_path)
    assert X.refresh(spark, x, root, "sales") == list(X.SALES_TRIO)
    before = {n: rows(X.read_dataset(spark, root, n)) for n in X.SALES_TRIO}
    X.refresh(spark, x, root, "sales")  # a second run replaces the window with the same rows
    assert {n: rows(X.read_dataset(spark, root, n)) for n in X.SALES_TRIO} == before
    assert X.refresh(spark, x, root, "snap", ("footfall", "unknown")) == ["footfall"]
    assert "ips" not in X.refresh(spark, x, root, "full")


def test_month_partitions_are_pruned(spark, data):
    path = layout.scratch_path(spark, "p")
    layout.write_monthly(data.settlement_daily, path)
    stored = layout.read_monthly(spark, path)
    f = P.SalesFilter(date_from="2000-03-05", date_to="2000-04-10")
    got = P.apply_settlement_filter(stored, f)
    plan = got._jdf.queryExecution().executedPlan().toString()
    part = plan[plan.index("PartitionFilters") :]
    assert "sales_month" in part.split("PushedFilters")[0] and "2000-03" in part and "2000-04" in part
    assert rows(got.drop(layout.MONTH)) == rows(P.apply_settlement_filter(data.settlement_daily, f).drop(layout.MONTH))


def test_option_profits_sum_to_goods_profit(data):
    out = R.allocate_profit(data.sales_option, data.settlement_option, data.stock_store)
    got = out.filter(F.col("net_take").isNotNull()).groupBy("sales_date", "store_name", "goods_no").agg(F.sum("net_take").alias("a"))
    want = data.settlement_option.groupBy("sales_date", "store_name", "goods_no").agg(F.sum("net_take").cast("double").alias("b"))
    pairs = got.join(want, ["sales_date", "store_name", "goods_no"], "left").collect()
    assert pairs and all(abs(p["a"] - p["b"]) < 1e-6 for p in pairs)


def test_total_row_is_the_total_of_the_rows(data):
    rows_ = E.with_rates(data.sales.groupBy("brand_nm").agg(*E.measure_sums()))
    out = E.with_totals(rows_, "brand_nm", list(E.MEASURES), {"discount_rate": R.ratio("gmv", "normal_amt")})
    top = out.filter("is_total").first()
    assert top["brand_nm"] == L.TOTAL and top["gmv"] == total(rows_, "gmv") and top["qty"] == total(rows_, "qty")


def test_distinct_orders_do_not_depend_on_brand_fan_out(data):
    whole = E.basket_value(data.receipts).first()
    merged = data.receipts.withColumn("brand_nm", F.lit("x")).groupBy("order_id", "is_foreign").agg(F.sum("gmv").alias("gmv"))
    again = E.basket_value(merged).first()
    assert (whole["receipts"], whole["gmv"], whole["foreign_receipts"]) == (again["receipts"], again["gmv"], again["foreign_receipts"])


def test_top_plus_other_keeps_the_sum(data):
    by = data.sales.groupBy("cat_medium").agg(F.sum("gmv").alias("v")).filter("v > 0")
    for n in (1, 5, 1000):
        assert total(E.top_plus_other(data.sales, "cat_medium", "gmv", n), "value") == total(by, "v")


def test_compare_total_does_not_depend_on_the_cap(data):
    w = C.sales_windows(data.sales, "2001-07-18")
    totals = [C.compare_by(data.sales, w, "brand_nm", cap=c).filter("is_total").select("g_day", "g_year").first() for c in (1, 3, None)]
    assert totals[0] == totals[1] == totals[2]


def test_contribution_identity(data):
    d = data.settlement_daily
    bad = d.filter(F.abs(F.col("cp") - (F.col("net_take") - F.col("offline_cost") + F.col("add_rev"))) > Decimal("0.001"))
    assert bad.count() == 0


def test_pivot_and_long_stock_agree(data):
    stores = [r[0] for r in data.stores.select("store_name").collect()]
    wide = H.stock_pivot(data.stock_rows, data.stock_meta, stores)
    assert wide.agg(F.sum("store_total")).first()[0] == total(data.stock.filter(F.col("location_kind") == L.STORE), "qty")
    names = [F.col(f"`{s}`") for s in stores]
    assert wide.filter(sum(names[1:], names[0]) != F.col("store_total")).count() == 0
    assert wide.count() == data.stock_meta.count()


def test_written_and_unwritten_datasets_agree(data):
    lazy = X.Datasets(data.inputs, data.settings)
    for name in ("goods_master", "stock_goods", "sales"):
        assert rows(getattr(lazy, name).drop("reg_date")) == rows(getattr(data, name).drop("reg_date", layout.MONTH)), name


def test_refresh_of_an_empty_dataset_builds_it(spark, data, tmp_path):
    path, full = str(tmp_path / "d"), data.settlement_daily_rows()
    layout.write_monthly(full.limit(0), path)
    layout.replace_window_on_disk(spark, path, data.settlement_daily_rows, 90)
    assert rows(layout.read_monthly(spark, path).select(full.columns)) == rows(full)


def test_snapshots_switch_by_pointer(spark, frame, tmp_path):
    path = str(tmp_path / "s")
    for n in (1, 2, 3):
        layout.publish(frame("v INT", [(n,)]), path)
        assert rows(layout.read_published(spark, path)) == [(n,)]
    assert len(list((tmp_path / "s").glob("v-*"))) == 2


def test_a_second_refresh_sees_new_inputs(spark, data, frame, tmp_path):
    inputs = {k: data.inputs[k] for k in ("shop", "shop_name", "visits")}
    x = X.Datasets(inputs, data.settings, layout.Store(spark))
    X.refresh(spark, x, str(tmp_path), "snap", ("footfall",))
    assert X.read_dataset(spark, str(tmp_path), "footfall").count()
    inputs["visits"] = inputs["visits"].limit(0)
    X.refresh(spark, x, str(tmp_path), "snap", ("footfall",))
    assert X.read_dataset(spark, str(tmp_path), "footfall").count() == 0


def test_totals_beyond_the_range_of_stored_money(spark, frame):
    big = Decimal("9000000000000000.00")
    ddl = "sales_date DATE, store_name STRING, shop_type STRING, business_type STRING, brand_nm STRING, goods_no BIGINT, goods_nm STRING, cat_top STRING, cat_large STRING, cat_medium STRING, off_md_id STRING, qty BIGINT, gmv DECIMAL(18,2), normal_amt DECIMAL(18,2), pay DECIMAL(18,2), foreign_gmv DECIMAL(18,2)"
    day = dt.date(2024, 3, 5)
    sales = frame(ddl, [(day, "s", "T", "b", "x", g, "n", "c", "c", "c", "m", 1, big, big, big, big) for g in (1, 2, 3)])
    want = 3 * big
    assert E.summary(sales).first()["gmv"] == want
    assert E.by_dimension(sales).first()["grand_total"] == want
    assert E.with_totals(sales.groupBy("brand_nm").agg(*E.measure_sums()), "brand_nm", list(E.MEASURES), {}).first()["gmv"] == want
    w = C.sales_windows(sales)
    assert C.compare_by(sales, w, "brand_nm").filter("is_total").first()["g_day"] == want
    assert C.compare_summary(sales, w).first()["g_year"] == want


def test_null_and_blank_names_are_one_row(frame, data):
    day = dt.date(2024, 1, 2)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in data.inputs["settlement_summary"].schema)
    base = {f.name: None for f in data.inputs["settlement_summary"].schema} | {"ord_state_date": day, "shop_no": 6, "goods_no": 1, "qty": 1}
    rows_ = [tuple((base | {"brand_nm": b, "large_nm": b, "option_nm": b}).values()) for b in (None, "")]
    summary = frame(ddl, rows_)
    from shopfloor.operators import facts as A

    assert [r["qty"] for r in A.settlement_option(summary, data.stores).collect()] == [2]
    assert [r["qty"] for r in A.settlement_daily(summary, data.stores).collect()] == [2]


def test_since_bounds_orders_and_keeps_old_orders_refunded_later(frame):
    from shopfloor.operators import facts as A

    ts = dt.datetime
    orders = frame("order_id BIGINT, shop_no INT, transaction_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, order_status INT, dummy_order INT, tax_refund_type STRING",
                   [(1, 1, ts(2024, 1, 1), ts(2024, 1, 1), 50, 0, None), (2, 1, None, ts(2024, 3, 1), 50, 0, None), (3, 1, None, ts(2023, 5, 1), 50, 0, None),
                    (4, 1, ts(2024, 1, 9), ts(2024, 3, 9), 50, 0, None)])
    claims = frame("order_id BIGINT, claim_type STRING, created_at TIMESTAMP_NTZ", [(1, "REFUND", ts(2024, 3, 2)), (3, "REFUND", ts(2024, 3, 3)), (2, "REFUND", ts(2024, 1, 3))])
    stores = frame("shop_no INT, store_name STRING, shop_type STRING", [(1, "a", "T")])
    got = A.ledger_events(orders, claims, stores, "2024-02-01").select("order_id", "sales_date", "sign")
    assert rows(got) == [(1, dt.date(2024, 3, 2), -1), (2, dt.date(2024, 3, 1), 1), (3, dt.date(2024, 3, 3), -1)]


def day_rows(frame, *days):
    return frame("sales_date DATE, v INT", [(dt.date.fromisoformat(d), v) for d, v in days])


def test_a_reader_meets_a_whole_window(spark, frame, tmp_path):
    path = str(tmp_path / "d")
    layout.write_monthly(day_rows(frame, ("2024-01-05", 1), ("2024-02-20", 2), ("2024-03-01", 3)), path)
    opened = layout.read_monthly(spark, path)
    old = rows(opened.select("sales_date", "v"))
    before = layout.manifest(spark, path)
    fresh = layout.stage(day_rows(frame, ("2024-02-21", 8), ("2024-03-02", 9)), path)
    # staged, not committed: as before, for new readers too, and for good if the job dies here
    assert rows(layout.read_monthly(spark, path).select("sales_date", "v")) == old
    layout.commit(spark, path, before, day_rows(frame).schema, before.months | fresh)
    assert rows(layout.read_monthly(spark, path).select("v")) == [(1,), (8,), (9,)]
    assert rows(opened.select("sales_date", "v")) == old  # its files stay
    assert rows(layout.read_monthly(spark, path).filter(F.col(layout.MONTH) >= "2024-03").select("v")) == [(9,)]


def test_a_refresh_that_dies_changes_nothing(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "d")
    old = day_rows(frame, ("2024-01-05", 1), ("2024-02-20", 2))
    layout.write_monthly(old, path)
    monkeypatch.setattr(layout, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    try:
        layout.replace_window_on_disk(spark, path, lambda since: day_rows(frame, ("2024-02-22", 7)), 30)
    except KeyboardInterrupt:
        pass
    monkeypatch.undo()
    assert rows(layout.read_monthly(spark, path).select("sales_date", "v")) == rows(old)
    layout.replace_window_on_disk(spark, path, lambda since: day_rows(frame, ("2024-02-22", 7)), 10)
    assert rows(layout.read_monthly(spark, path).select("v")) == [(1,), (7,)]


def test_two_refreshes_of_one_commit_conflict(spark, frame, tmp_path):
    path = str(tmp_path / "d")
    layout.write_monthly(day_rows(frame, ("2024-01-05", 1)), path)
    before = layout.manifest(spark, path)
    schema = day_rows(frame).schema
    one, two = (layout.stage(day_rows(frame, ("2024-01-06", v)), path) for v in (5, 6))
    layout.commit(spark, path, before, schema, one)
    with pytest.raises(layout.CommitConflict):
        layout.commit(spark, path, before, schema, two)
    assert rows(layout.read_monthly(spark, path).select("v")) == [(5,)]


def test_old_versions_go_and_live_ones_stay(spark, frame, tmp_path):
    path = str(tmp_path / "d")
    layout.write_monthly(day_rows(frame, ("2024-01-05", 0), ("2024-02-05", 0)), path)
    for v in range(1, 5):
        layout.write_monthly(day_rows(frame, ("2024-02-05", v)), path)
    assert rows(layout.read_monthly(spark, path).select("v")) == [(0,), (4,)]
    left = [p for p in (tmp_path / "d").glob("version=*/sales_month=*")]
    assert len(left) == 1 + layout.KEPT_COMMITS and len(list((tmp_path / "d" / "_commits").glob("*.json"))) == layout.KEPT_COMMITS


def test_a_commit_knows_rows_and_days(spark, frame, data, tmp_path):
    path = str(tmp_path / "d")
    layout.write_monthly(day_rows(frame), path)
    assert layout.read_monthly(spark, path).columns == ["sales_date", "v", layout.MONTH] and layout.manifest(spark, path).span == (None, None)
    rows_with_a_gap = frame("sales_date DATE, v INT", [(dt.date(2024, 5, 2), 1), (None, 2), (dt.date(2023, 1, 9), 3)])
    now = layout.write_monthly(rows_with_a_gap, path)
    assert now.rows == 3 and now.span == (dt.date(2023, 1, 9), dt.date(2024, 5, 2))
    assert sorted(r.v for r in layout.read_monthly(spark, path).collect()) == [1, 2, 3]
    stored = data.stored("sales")
    assert (stored.rows, *stored.span) == tuple(data.sales.agg(F.count(F.lit(1)), F.min("sales_date").cast("date"), F.max("sales_date").cast("date")).first())
    for df in (layout.stored_freshness(spark, "sales", stored), C.windows_frame(data.sales, None, stored.span)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan and "Exchange" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


ROLLUP_FILTERS = [
    (P.NO_FILTER, "sales_day"), (P.SalesFilter("2000-07-03", "2001-05-19"), "sales_day"), (P.SalesFilter("2001-01-01", biz=[L.CONSIGNMENT]), "sales_day_store"),
    (P.SalesFilter(type=["ASIA"], store=["NATION_21"]), "sales_day_store"), (P.SalesFilter(cat_top=["ECONOMY", "PROMO"]), "sales_day_brand"),
    (P.SalesFilter(cat_top=["ECONOMY"], type=["ASIA"]), "sales_day_store_brand"), (P.SalesFilter(name_like="BOLT"), "sales"), (P.SalesFilter(md=["1"]), "sales"), (P.SalesFilter(goods=[3, 5]), "sales"),
]


@pytest.mark.parametrize(("f", "name"), ROLLUP_FILTERS)
def test_the_smallest_table_that_covers_a_filter_gives_the_same(data, f, name):
    part = data.sales_for(f)
    assert part is getattr(data, name) and f"/{name}/version" in plan_of(E.trend(part, f))
    for grain in ("day", "month"):
        assert rows(E.trend(part, f, grain)) == rows(E.trend(data.sales, f, grain))
    assert rows(P.kpis_by_preset(part, f)) == rows(P.kpis_by_preset(data.sales, f))
    columns = sorted(E.summary(data.sales, f).columns)
    assert rows(data.summary(f).select(columns)) == rows(E.summary(data.sales, f).select(columns))


def test_rollups_read_no_sales(data):
    f = P.SalesFilter("2001-01-01", "2001-06-30")
    for df in (data.summary(f), E.trend(data.sales_for(f), f), P.kpis_by_preset(data.sales_for())):
        assert "/sales/version" not in plan_of(df)
    by = data.sales_for(P.NO_FILTER, "business_type")
    assert rows(E.trend_by_business(by)) == rows(E.trend_by_business(data.sales)) and by is data.sales_day_store


def test_distinct_goods_over_any_range(spark, frame):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    goods = [1, 2, 32767, 32768, 32769, 65536, 10**9, 10**12, 0]
    sales = frame("sales_date DATE, goods_no BIGINT", [(day(i % 40), goods[(i * i) % 9]) for i in range(300)] + [(day(3), None)])
    bits = U.goods_bitmaps(sales)
    for a, b in ((0, 39), (3, 3), (5, 17), (60, 70)):
        f = P.SalesFilter(day(a), day(b))
        want = len({r.goods_no for r in sales.collect() if r.goods_no is not None and day(a) <= r.sales_date <= day(b)})
        assert U.distinct_goods(bits, f).first()[0] == want


def test_a_refresh_keeps_rollups_with_the_sales(spark, data, tmp_path):
    root = str(tmp_path)
    x = X.Datasets(data.inputs, data.settings, layout.Store(spark))
    for _ in range(2):  # built, then the window replaced
        X.refresh(spark, x, root, "snap", ("sales",))
        sales = X.read_dataset(spark, root, "sales")
        for name, build in X.DERIVED.items():
            stored = X.read_dataset(spark, root, name).drop(layout.MONTH)
            assert rows(stored) == rows(build(sales).select(stored.columns)), name


@pytest.mark.parametrize("f", [P.NO_FILTER, P.SalesFilter(date_from="2000-01-01", cat_top=["ECONOMY", "PROMO"]), P.SalesFilter(goods=[-1])])
def test_levels_of_a_drill_agree(data, f):
    """One pass over all levels gives the rows of each level, and its total is the summary."""
    from shopfloor.operators import sales as E

    got = E.drill_levels(data.sales, data.stock_store, data.goods_attr, f).collect()
    for level in E.LEVELS:
        want = E.drill(data.sales, data.stock_store, data.goods_attr, level, f)
        assert sorted(tuple(r[c] for c in want.columns) for r in got if r["level"] == level) == sorted(map(tuple, want.collect()))
    whole = [r for r in got if r["level"] == E.TOTAL_LEVEL]
    kpis = E.summary(data.sales, f).first()
    assert len(whole) == (kpis["goods_count"] > 0)
    for r in whole:
        assert all(r[c] == kpis[c] for c in ("qty", "gmv", "normal_amt", "foreign_gmv", "goods_count", "discount_rate", "foreign_ratio"))


def test_a_monthly_write_builds_its_rows_once(spark, frame, tmp_path):
    built = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            built.add(b.num_rows)
            yield b

    days = day_rows(frame, *[(f"2024-{1 + i % 9:02d}-{1 + i % 28:02d}", i) for i in range(500)]).repartition(4)
    layout.write_monthly(days.mapInArrow(counted, days.schema), str(tmp_path / "d"))
    assert built.value == 500
    assert sorted(v for (v,) in rows(layout.read_monthly(spark, str(tmp_path / "d")).select("v"))) == list(range(500))


def test_a_hot_day_is_written_by_several_tasks(spark, tmp_path):
    path, size = str(tmp_path / "d"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    day = F.when(F.col("id") % 50 > 0, F.lit("2024-02-21")).when(F.col("id") % 100 > 0, F.lit("2024-01-05")).cast("date")
    spark.conf.set(size, "64k")
    try:
        layout.write_monthly(spark.range(0, 100_000, 1, 8).select(day.alias("sales_date"), F.xxhash64("id").alias("v")), path)
    finally:
        spark.conf.set(size, before)
    months = layout.manifest(spark, path).months
    assert {n: m.rows for n, m in months.items()} == {"2024-01": 1000, "2024-02": 98_000, layout.NO_MONTH: 1000}
    assert layout.read_monthly(spark, path).filter("sales_date = date'2024-02-21'").select(F.input_file_name()).distinct().count() > 4
