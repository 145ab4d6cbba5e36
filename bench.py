"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`build_*` times a dataset from the raw tables to a written table; the others time a report over the
written datasets, each from a fresh plan to its last row (noop sink)."""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

BUILDS = ["stores", "brands", "categories", "goods_master", "sales", "receipts", "sales_option", "settlement", "settlement_option",
          "settlement_daily", "target_daily", "footfall", "global_customer", "customer", "stock", "stock_goods", "stock_store",
          "goods_attr", "ips", "ips_goods"]
REPORTS = ["d1_apply_sales_filter", "d7_cross_facets", "d8_kpis_by_preset", "e1_facets", "e2_summary", "e4_profit_by_goods",
           "e6_profit_by_brand", "e7_basket_value", "e8_hourly", "e9_trend", "e12_by_dimension", "e16_drill", "e18_goods_detail",
           "e20_allocate_profit", "e22_target_attainment", "e25_pnl", "e35_ab_compare", "f4_compare_by", "f5_compare_goods",
           "g4_rank_by", "g5_rank_in_category", "g6_notable_goods", "g7_restock", "h3_stock_pivot", "h9_stock_category_share",
           "h11_stock_export_long", "i14_sell_through_totals"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from checks.queries import QUERIES, data_for

    # warm the JVM and the codegen on the smallest directory, never on the measured one
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small) and small != sf_dir:
        for name in ("e2_summary", "e7_basket_value", "h7_stock_kpis"):
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    data, times = data_for(spark, sf_dir), {}
    for name in BUILDS:
        t0 = time.time()
        getattr(data, name)
        times[f"build_{name}"] = round(time.time() - t0, 3)
    for name in REPORTS:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
