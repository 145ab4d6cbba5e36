"""Physical plans: what must reach the scan and what must not be repeated."""

import re
import time

import pytest

from shopfloor.operators import compare as C, daily as G, dimensions as D, facts as A, filters as P, sales as E, stock as H, weekly as K


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sales_filter_reaches_the_scan(data):
    f = P.SalesFilter(date_from="2000-07-01", date_to="2000-07-31", store=["NATION_1"])
    text = plan(E.trend(data.sales, f, "day"))
    scan = next(x for x in text.splitlines() if "FileScan" in x)
    assert "GreaterThanOrEqual(sales_date,2000-07-01)" in scan and "LessThan(sales_date,2000-08-01)" in scan
    columns = re.search(r"ReadSchema: struct<(.*)", scan).group(1)
    assert "goods_nm" not in columns and "normal_amt" not in columns and "gmv" in columns


def test_comparison_scans_once_from_the_earliest_window(data):
    w = C.sales_windows(data.sales)
    text = plan(C.compare_sums(data.sales, w, ["store_name"]))
    assert text.count("FileScan") == 1 and "GreaterThanOrEqual(sales_date," in text


def test_ledger_lines_are_scanned_and_shuffled_once(spark, data):
    """Both signs of the ledger come from one join of the lines."""
    i = data.inputs
    lines = spark.read.schema("order_id BIGINT, goods_no BIGINT, company_id STRING, brand_id STRING, quantity BIGINT, "
                              "order_amount DECIMAL(14,2), normal_amount DECIMAL(14,2), pay_amount DECIMAL(14,2)").parquet(_lines(spark, i))
    text = plan(A._book(lines, A.ledger_events(i["order_header"], i["claim"], data.stores), ["goods_no"]))
    assert len(re.findall(r"FileScan parquet \[order_id", text)) == 1


def _lines(spark, inputs):
    from shopfloor.sources.layout import scratch_path

    path = scratch_path(spark, "lines")
    inputs["order_line"].write.parquet(path)
    return path


@pytest.mark.parametrize("name", ["d1_apply_sales_filter", "e11_trend_overlay", "e24_target_daily_curve", "e35_ab_compare", "f4_compare_by", "g4_rank_by", "g7_restock"])
def test_date_bounds_reach_the_month_folders(spark, data, name):
    from checks.queries import QUERIES
    from conftest import SF_DIR

    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert any("sales_month" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])


@pytest.mark.parametrize("name", ["c5_net_sales_option", "c11_settlement_option", "c14_store_stock", "e20_allocate_profit", "f5_compare_goods"])
def test_raw_rows_are_hashed_not_sorted(spark, data, name):
    """Text minima are taken after a first sum by name: the first aggregation over the rows is a hash one."""
    from checks.queries import QUERIES
    from conftest import SF_DIR

    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    partial = [line for line in plan.splitlines() if "partial_sum" in line]
    assert partial and any("HashAggregate" in line and "partial_min" not in line for line in partial)


def _texts(data):
    days = G.ReportDays(data.sales, "2001-07-20")
    return {
        "category_map": D.category_map(data.inputs["stock_summary"]),
        "goods_attributes": P.goods_attributes(data.sales),
        "rank_by": G.rank_by(data.sales, days, "goods_no"),
        "rank_in_category": G.rank_in_category(data.sales, days, "goods_no"),
        "notable_goods": G.notable_goods(data.sales, data.stock_goods, days),
        "restock": G.restock(data.sales, data.stock_store, data.stock_goods, days),
        "stock_by_goods": H.stock_by_goods(data.stock),
    }


@pytest.mark.parametrize("name", ["category_map", "goods_attributes", "rank_by", "rank_in_category", "notable_goods", "restock", "stock_by_goods"])
def test_texts_are_taken_from_combinations(data, name):
    """Below every sort for a text minimum there is a hash aggregate by the texts."""
    lines = plan(_texts(data)[name]).split("== Initial Plan ==")[-1].splitlines()
    sorting = [i for i, line in enumerate(lines) if "SortAggregate" in line and "partial_min" in line]
    assert sorting
    for i in sorting:
        below = next(line for line in lines[i + 1 :] if "Aggregate" in line or "FileScan" in line)
        assert "HashAggregate" in below and ("count(1)" in below or "sum(" in below)


def test_all_levels_come_from_one_scan(data):
    text = plan(E.drill_levels(data.sales, data.stock_store, data.goods_attr)).split("== Initial Plan ==")[-1]
    assert text.count("FileScan") == 3  # sales, stock, attributes
    assert len(re.findall(r"\bExpand\b", text)) == 2


@pytest.mark.parametrize("name", ["e12_by_dimension", "e16_drill", "e35_ab_compare"])
def test_no_global_sort_without_a_limit(spark, data, name):
    from checks.queries import QUERIES
    from conftest import SF_DIR

    assert "rangepartitioning" not in QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def test_ledger_sums_travel_as_long_cents(data):
    """The first sums of a ledger hold longs only: decimal buffers take twice the shuffle and memory."""
    i = data.inputs
    text = plan(A._book(i["order_line"], A.ledger_events(i["order_header"], i["claim"], data.stores), ["goods_no"]))
    first = next(x for x in text.splitlines() if "partial_sum" in x)
    assert len(re.findall(r"sum#\d+L", first)) == 5 and "isEmpty" not in first


def test_partitions_are_small_enough_to_sort_in_memory(spark, data):
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_profit_is_allocated_where_the_options_lie(data):
    """Both option sums, the goods sums and the settled join share one deal of the rows."""
    from shopfloor.operators.profit import allocate_profit

    text = plan(allocate_profit(data.sales_option, data.settlement_option, data.stock_store))
    assert text.count("hashpartitioning(sales_date") == 2  # the options and the settled sums
    text = plan(A.settlement_option(data.inputs["settlement_summary"], data.stores))
    assert text.count("hashpartitioning(sales_date") + text.count("hashpartitioning(ord_state_date") == 1


def test_sides_with_a_row_for_each_barcode_or_goods_are_merged(data):
    """Such a side is a small file and a large hash table; sent to all it goes through the driver."""
    for df in (H.stock_dataset(data.stock_rows, data.stock_meta), P.drill_stock_filter(data.stock_store, data.goods_attr, P.NO_FILTER)):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)


def test_open_orders_are_merged_with_the_goods(data):
    """The goods have a row each; as a small file they would be sent whole through the driver."""
    i = data.inputs
    text = plan(K.open_orders(i["open_po"], i["goods_scope"], "2001-07-20", "1000"))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_concepts_are_merged_with_the_barcodes(data):
    """Concepts have a row for each company and brand, and grow with both."""
    i = data.inputs
    text = plan(H.stock_meta(data.store_rows, data.plant_rows, data.hubs, i["hub_meta"], i["goods_main"], i["brand"], data.concepts))
    assert "SortMergeJoin [company_id" in text


def test_warehouse_snapshot_is_scanned_once_for_all_hubs(data):
    """The hubs start from kept rows, not from the scan of all warehouse rows."""
    from shopfloor.plans.datasets import Datasets

    text = plan(Datasets.hubs.build(data))
    assert "l_linestatus" not in text and "l_shipdate" not in text


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def _left_behind(spark, before):
    """Shuffle files that are new and stay; Spark removes them in the background."""
    for _ in range(100):
        if not (new := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return new


def test_writes_leave_no_shuffle_files(spark, frame, tmp_path):
    from shopfloor.session import RELEASE
    from shopfloor.sources import layout, tables

    setting = spark.conf.get(RELEASE, None)
    rows = frame("k INT, sales_date DATE", []).unionByName(spark.range(1000).selectExpr("cast(id % 7 as int) k", "date '2001-01-01' sales_date"))
    sums = rows.groupBy("sales_date", "k").count()
    before = _shuffle_files(spark)
    store = layout.Store(spark, str(tmp_path / "store"))
    kept = [store.keep("plain", sums), store.keep("monthly", sums, "sales_date")]
    layout.publish(sums, str(tmp_path / "snapshot"))
    layout.write_clustered(sums, str(tmp_path / "clustered"), "sales_date")
    tables.export_csv(sums, str(tmp_path / "csv"), ["k", "count"])
    assert not _left_behind(spark, before)
    assert spark.conf.get(RELEASE, None) == setting
    assert all(sorted((r["k"], r["count"]) for r in df.collect())[0] == (0, 143) for df in kept)


def _watched(spark, data):
    """Datasets of their own, and the rows that their builds put aside, with the plan and the number of rows of each."""
    from shopfloor.plans.datasets import Datasets
    from shopfloor.sources import layout

    seen = []

    class Watched(layout.Store):
        def aside(self, df):
            out = super().aside(df)
            if out is not df:
                seen.append((out.inputFiles(), plan(df), out.count()))
            return out

    return Datasets(data.inputs, data.settings, Watched(spark)), seen


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name, build", [("sales", "net_sales"), ("sales_option", "net_sales_option"), ("receipts", "receipt_rows")])
def test_booked_lines_are_put_aside_before_the_dimensions(spark, data, name, build):
    """The join of the lines and the joins of the dimensions are two executions; what lies between them is removed."""
    from shopfloor.sources.layout import path_exists

    own, seen = _watched(spark, data)
    kept = getattr(own, name)
    assert len(seen) == 1 and seen[0][2] > 0
    files, text, _ = seen[0]
    assert "order_id" in text and "cat_top" not in text and "business_type" not in text
    assert not any(path_exists(spark, f) for f in files)
    lazy = getattr(own, build)()
    assert len(seen) == 1  # a plan that is not written puts nothing aside
    assert _rows(kept.select(*lazy.columns)) == _rows(lazy)


def test_refresh_puts_booked_lines_aside(spark, data, tmp_path):
    from shopfloor.plans.datasets import read_dataset, refresh
    from shopfloor.sources.layout import path_exists

    own, seen = _watched(spark, data)
    refresh(spark, own, str(tmp_path), "snap", ("receipts",))
    whole = _rows(read_dataset(spark, str(tmp_path), "receipts"))
    refresh(spark, own, str(tmp_path), "snap", ("receipts",))  # the trailing window
    assert len(seen) == 2 and not any(path_exists(spark, f) for files, _, _ in seen for f in files)
    assert _rows(read_dataset(spark, str(tmp_path), "receipts")) == whole


def test_option_export_puts_rows_aside_before_stock_and_catalogue(spark, data):
    from checks.queries import QUERIES, _DATA
    from conftest import SF_DIR

    from shopfloor.sources.layout import path_exists

    own, seen = _watched(spark, data)
    own.__dict__.update({n: getattr(data, n) for n in ("sales_option", "settlement_option", "stock_store", "goods_master")})
    key = (spark.sparkContext.applicationId, SF_DIR)
    _DATA[key] = own
    try:
        rows = QUERIES["a7_export_options"](spark, SF_DIR)
    finally:
        _DATA[key] = data
    (shared, text, n), (stocked, then, m) = seen
    assert "stock_store" not in text and "stock_store" in then and "style_no" not in then
    assert rows.count() == n == m > 0
    assert not any(path_exists(spark, f) for f in (*shared, *stocked))
