"""Datasets: lazy builders over the input roles, and the refresh job that stores them."""

import os
from collections.abc import Callable, Mapping
from contextlib import nullcontext
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from shopfloor.functions.dates import DateLike, prune
from shopfloor.operators import dimensions as D, facts as A, filters as P, rollups as U, sales as E, stock as S, weekly as K
from shopfloor.session import tune
from shopfloor.sources import layout


@dataclass
class Settings:
    """Everything that depends on the business or the day. What names a company's own stores, plants
    and brands has no default."""

    as_of: DateLike
    shop_types: tuple[str, ...]
    special_shops: dict[int, str]
    bag_brand: str | None
    scope: K.Scope
    plants: S.Plants
    # days that the option dataset reaches back; None: all
    option_floor_days: int | None = None


def kept(date_col: str | None = None):
    """A dataset: built once per instance, and written to the instance's store if it has one.
    `Datasets.<name>.build(data)` gives the unwritten plan."""

    def wrap(fn):
        def get(self):
            if self.store is None:
                return fn(self)
            with self.building():
                return self.store.keep(fn.__name__, fn(self), date_col)

        prop = cached_property(get)
        prop.build = fn
        return prop

    return wrap


class Datasets:
    """Datasets over `inputs` (role name -> DataFrame). Without a store they are lazy plans and
    building one runs no job; with a store each is written on first use and read back."""

    def __init__(self, inputs: Mapping[str, DataFrame], settings: Settings, store: layout.Store | None = None):
        self.inputs, self.settings, self.store = inputs, settings, store

    def stored(self, name: str) -> layout.Manifest | None:
        """Row count and date bounds of a stored monthly dataset, without a scan; written first if it is not yet. None without a store."""
        getattr(self, name)
        return None if self.store is None else self.store.manifest(name)

    def building(self):
        """See `Store.building`; without a store nothing is put aside."""
        return nullcontext() if self.store is None else self.store.building()

    def aside(self, df: DataFrame) -> DataFrame:
        """See `Store.aside`: rows written in the middle of a build, if there is a store."""
        return df if self.store is None else self.store.aside(df)

    def forget(self) -> None:
        """Drop what was built, so that the next use sees the inputs of that moment."""
        for name, prop in vars(type(self)).items():
            if isinstance(prop, cached_property):
                self.__dict__.pop(name, None)
        if self.store is not None:
            self.store.done.clear()

    # dimensions
    @kept()
    def stores(self) -> DataFrame:
        return D.dim_store(self.inputs["shop"], self.inputs["shop_name"], self.settings.shop_types, self.settings.special_shops)

    @kept()
    def brands(self) -> DataFrame:
        return D.dim_brand(self.inputs["company_brand"], self.inputs["brand"], self.inputs["company"])

    @kept()
    def categories(self) -> DataFrame:
        return D.category_map(self.inputs["stock_summary"])

    @kept()
    def goods_master(self) -> DataFrame:
        i = self.inputs
        sold = D.sold_goods(i["order_line"], i["order_header"], self.stores)
        return D.goods_master(sold, i["goods_main"], i["brand"], i["price_feed"], i["goods_secondary"])

    @kept()
    def concepts(self) -> DataFrame:
        return D.concept_map(self.inputs["settlement_summary"])

    # facts; `since` bounds a rebuild of the trailing window
    def net_sales(self, since: DateLike | None = None) -> DataFrame:
        i = self.inputs
        return A.net_sales(
            i["order_header"], i["order_line"], i["claim"], self.stores, self.brands, self.categories, self.goods_master,
            since, self.settings.bag_brand, self.aside,
        )

    def net_sales_option(self, since: DateLike | None = None) -> DataFrame:
        i, s = self.inputs, self.settings
        return A.net_sales_option(
            i["order_header"], i["order_line"], i["claim"], self.stores, self.brands, self.categories, s.as_of, since, s.bag_brand,
            s.option_floor_days, self.aside,
        )

    def receipt_rows(self, since: DateLike | None = None) -> DataFrame:
        i = self.inputs
        return A.receipts(i["order_header"], i["order_line"], self.stores, self.brands, self.categories, i["goods_main"], i["brand"], since, self.aside)

    def settlement_rows(self, since: DateLike | None = None) -> DataFrame:
        return A.settlement(self.inputs["settlement_summary"], self.stores, since)

    def settlement_option_rows(self, since: DateLike | None = None) -> DataFrame:
        return A.settlement_option(self.inputs["settlement_summary"], self.stores, since)

    def settlement_daily_rows(self, since: DateLike | None = None) -> DataFrame:
        return A.settlement_daily(self.inputs["settlement_summary"], self.stores, since)

    @kept("sales_date")
    def sales(self) -> DataFrame:
        return self.net_sales()

    # rollups of the sales, by day
    @kept(U.DAY)
    def sales_day(self) -> DataFrame:
        return U.ROLLUPS[0].build(self.sales_day_store)

    @kept(U.DAY)
    def sales_day_store(self) -> DataFrame:
        return U.ROLLUPS[1].build(self.sales_day_store_brand)

    @kept(U.DAY)
    def sales_day_brand(self) -> DataFrame:
        return U.ROLLUPS[2].build(self.sales_day_store_brand)

    @kept(U.DAY)
    def sales_day_store_brand(self) -> DataFrame:
        return U.ROLLUPS[3].build(self.sales)

    @kept(U.DAY)
    def goods_day(self) -> DataFrame:
        return U.goods_bitmaps(self.sales)

    def sales_for(self, f: P.SalesFilter = P.NO_FILTER, *columns: str) -> DataFrame:
        """The smallest stored table that answers a request over sums by these dimensions: a rollup, or the sales."""
        return getattr(self, U.covering(f, columns) or "sales")

    def summary(self, f: P.SalesFilter = P.NO_FILTER) -> DataFrame:
        """KPI row: from the rollups by day where the filter is of days alone, else from the sales."""
        return E.summary(self.sales, f) if U.needed(f) else U.summary(self.sales_day_store, self.goods_day, f)

    @kept()
    def goods_attr(self) -> DataFrame:
        """goods -> the one set of attributes stock is reported under."""
        return P.goods_attributes(self.sales)

    @kept("sales_date")
    def sales_option(self) -> DataFrame:
        return self.net_sales_option()

    @kept("sales_date")
    def receipts(self) -> DataFrame:
        return self.receipt_rows()

    @kept("sales_date")
    def settlement(self) -> DataFrame:
        return self.settlement_rows()

    @kept("sales_date")
    def settlement_option(self) -> DataFrame:
        return self.settlement_option_rows()

    @kept("sales_date")
    def settlement_daily(self) -> DataFrame:
        return self.settlement_daily_rows()

    @kept()
    def target_daily(self) -> DataFrame:
        return A.daily_targets(self.inputs["target"], self.stores)

    @kept()
    def footfall(self) -> DataFrame:
        return A.footfall(self.inputs["visits"], self.stores)

    @kept()
    def global_customer(self) -> DataFrame:
        i = self.inputs
        return A.nationality_sales(i["tax_free"], i["order_header"], i["order_line"], self.stores)

    @kept()
    def customer(self) -> DataFrame:
        return A.customer_demographics(self.inputs["customer_summary"], self.stores)

    # stock
    @kept()
    def store_rows(self) -> DataFrame:
        return S.latest_in_stores(self.inputs["stock_summary"], self.stores)

    @kept()
    def plant_rows(self) -> DataFrame:
        return S.plant2_in_stores(self.inputs["plant_stock"], self.inputs["shop_location"], self.stores, self.settings.plants)

    @kept()
    def erp_rows(self) -> DataFrame:
        return S.latest_in_plants(self.inputs["erp_stock"], self.settings.plants)

    @kept()
    def hubs(self) -> DataFrame:
        i = self.inputs
        return S.hub_stock(self.store_rows, self.erp_rows, i["fulfil_stock"], i["hub_meta"], self.settings.plants)

    @kept()
    def stock_rows(self) -> DataFrame:
        return S.stock_long(self.store_rows, self.plant_rows, self.hubs)

    @kept()
    def stock_meta(self) -> DataFrame:
        i = self.inputs
        return S.stock_meta(self.store_rows, self.plant_rows, self.hubs, i["hub_meta"], i["goods_main"], i["brand"], self.concepts)

    @kept()
    def stock(self) -> DataFrame:
        return S.stock_dataset(self.stock_rows, self.stock_meta)

    @kept()
    def stock_goods(self) -> DataFrame:
        return S.stock_by_goods(self.stock)

    @kept()
    def stock_store(self) -> DataFrame:
        return S.stock_store_long(self.stock)

    # weekly sell-through
    @cached_property
    def weeks(self) -> K.Weeks:
        return K.weeks_of(self.settings.as_of, self.inputs["stock_history"], self.inputs["stock_summary"])

    @kept()
    def locations(self) -> DataFrame:
        return K.store_locations(self.inputs["closing"], self.settings.as_of, self.settings.plants.second, self.settings.scope)

    @kept()
    def purchase_brands(self) -> DataFrame:
        i = self.inputs
        return K.purchase_brands(i["stock_history"], i["goods_scope"], self.locations, self.weeks, self.settings.scope)

    @kept()
    def brand_scope(self) -> DataFrame:
        return K.brand_scope(self.online_divisions, self.purchase_brands)

    @kept()
    def online_divisions(self) -> DataFrame:
        return K.online_by_division(self.inputs["online_orders"], self.purchase_brands, self.weeks, self.settings.scope)

    @kept()
    def online(self) -> DataFrame:
        return K.online_weekly(self.online_divisions)

    @kept()
    def offline(self) -> DataFrame:
        return K.offline_weekly(self.inputs["settlement_summary"], self.weeks)

    @kept()
    def classified_stock(self) -> DataFrame:
        i = self.inputs
        return K.classify_stock(i["stock_history"], i["goods_scope"], self.brand_scope, self.locations, self.weeks, self.settings.scope)

    @kept()
    def consignment(self) -> DataFrame:
        """Consigned stock and mean price per brand and company: prices and vendors both come from it."""
        return K.consignment_source(self.inputs["stock_summary"], self.weeks)

    @cached_property
    def axis(self) -> DataFrame:
        return K.axis(self.online, self.offline, self.classified_stock, self.purchase_brands)

    @kept()
    def ips(self) -> DataFrame:
        i = self.inputs
        po = K.open_orders(i["open_po"], i["goods_scope"], self.settings.as_of, self.settings.plants.first)
        return K.sell_through(
            self.axis, self.online, self.online_divisions, self.offline, self.classified_stock, i["goods_scope"],
            self.consignment, po, self.weeks, self.settings.scope,
        )

    @kept()
    def ips_goods(self) -> DataFrame:
        i = self.inputs
        po = K.open_orders(i["open_po"], i["goods_scope"], self.settings.as_of, self.settings.plants.first, "goods")
        return K.sell_through_goods(
            i["online_orders"], i["settlement_summary"], i["stock_history"], i["goods_scope"], self.brand_scope, self.locations,
            po, self.weeks, self.settings.scope,
        )


# name -> (builder of the rows since a date, trailing window in days)
WINDOWED: dict[str, tuple[Callable, int]] = {
    "sales": (Datasets.net_sales, 45),
    "receipts": (Datasets.receipt_rows, 45),
    "sales_option": (Datasets.net_sales_option, 45),
    "settlement": (Datasets.settlement_rows, 90),
    "settlement_option": (Datasets.settlement_option_rows, 90),
    "settlement_daily": (Datasets.settlement_daily_rows, 90),
}
SALES_TRIO = ("sales", "receipts", "sales_option")
# name -> builder from the stored sales; a refresh of the sales replaces the same window in each
DERIVED: dict[str, Callable[[DataFrame], DataFrame]] = {**{r.name: r.build for r in U.ROLLUPS}, U.GOODS: U.goods_bitmaps}
SNAPSHOTS = {
    "goods_master": "goods_master", "inventory": "stock", "inventory_goods": "stock_goods", "inventory_store_long": "stock_store",
    "customer": "customer", "target_daily": "target_daily", "footfall": "footfall", "global_customer": "global_customer",
    "ips": "ips", "ips_goods": "ips_goods",
}
# heavy ones: only by name
DECOUPLED = ("ips", "ips_goods")


def read_dataset(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = os.path.join(root, name)
    return layout.read_monthly(spark, path) if name in WINDOWED or name in DERIVED else layout.read_published(spark, path)


def refresh_derived(spark: SparkSession, root: str, days: int | None) -> None:
    """Rollups of the stored sales: the trailing window, or all if `days` is None or a rollup does not exist yet. Each is a
    commit of its own after that of the sales; until then it answers for the sales as they were."""
    sales = read_dataset(spark, root, "sales")
    for name, build in DERIVED.items():
        path = os.path.join(root, name)
        if days is None or layout.manifest(spark, path) is None:
            layout.write_monthly(build(sales), path, replace=True)
        else:
            layout.replace_window_on_disk(spark, path, lambda since: build(sales if since is None else prune(sales, since).filter(F.col(U.DAY) >= since)), days)  # noqa: B023


def refresh(
    spark: SparkSession, data: Datasets, root: str, mode: str = "sales", names: tuple[str, ...] = ()
) -> list[str]:
    """Batch job over the registry; returns the datasets written.

    sales: trailing window of the three sales datasets. full: also the snapshots and the windows of
    the settlement. rebuild: the same without windows. snap: the named ones. A windowed dataset that
    does not exist yet is built in full. Snapshots are built from the inputs of this moment, written
    once and published by a pointer."""
    tune(spark)
    data.forget()
    if mode == "snap":
        todo = [n for n in names if n in WINDOWED or n in SNAPSHOTS]
    elif mode == "sales":
        todo = list(SALES_TRIO)
    elif mode in ("full", "rebuild"):
        todo = [*WINDOWED, *[n for n in SNAPSHOTS if n not in DECOUPLED]]
    else:
        raise ValueError(f"unknown mode: {mode}")
    for name in todo:
        path = os.path.join(root, name)
        if name in SNAPSHOTS:
            layout.publish(getattr(type(data), SNAPSHOTS[name]).build(data), path)
            continue
        build, days = WINDOWED[name]
        with data.building():
            if mode == "rebuild" or layout.manifest(spark, path) is None:
                layout.write_monthly(build(data, None), path, replace=True)
            else:
                s = data.settings
                clip = (lambda since: A.option_since(since, s.as_of, s.option_floor_days)) if name == "sales_option" else None
                layout.replace_window_on_disk(spark, path, lambda since: build(data, since), days, clip=clip)
        if name == "sales":
            refresh_derived(spark, root, None if mode == "rebuild" else days)
    return todo
