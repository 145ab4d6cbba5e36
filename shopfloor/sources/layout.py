"""Dataset layout on disk: clustering by date, versioned months under a commit log, window replacement, freshness.

A monthly dataset is a folder of versions, each partitioned by month, and a log of commits:

    <path>/version=<id>/sales_month=2026-08/part-...
    <path>/_commits/00000000000000000007.json

The last commit names the live version of every month with its row count and date bounds. A refresh writes
the months it touches as a new version and then adds one commit, so a reader meets all of the window before or
all of it after, and a job that dies before its commit leaves nothing that is read. Two refreshes that start
from the same commit can't both add the next one: the second fails and changes nothing.
"""

import datetime as dt
import json
import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shopfloor.functions.dates import MONTH, as_date, max_date, month_key
from shopfloor.session import released

ROW_GROUP_BYTES = 32 * 1024 * 1024
# days of a month that lie together in a monthly dataset
RUN_DAYS = 4


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder the cluster names. Only a session within one machine may do
    without that setting; on a cluster, executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), f"shopfloor-{spark.sparkContext.applicationId}")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def write_clustered(df: DataFrame, path: str, date_col: str, mode: str = "overwrite") -> DataFrame:
    """Write range-partitioned and sorted by date, so date filters skip files and row groups,
    and return the read-back. A row hash follows the date in the range key, so a day with a third
    of all rows spreads over tasks; unlike a random number it is the same when a task is retried."""
    spark = df.sparkSession
    rows = df.repartitionByRange(F.col(date_col), F.xxhash64(*df.columns)).sortWithinPartitions(date_col)
    with released(spark):
        rows.write.mode(mode).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def window_start(current: DataFrame, days: int, date_col: str = "sales_date") -> Column:
    """First day of the window to rebuild: the watermark minus `days`."""
    return F.date_sub(max_date(current, date_col), days)


def replace_window(current: DataFrame, fresh: DataFrame, since: Column, date_col: str = "sales_date") -> DataFrame:
    """Keep rows before `since`, take everything from `since` on from the rebuilt side. The same
    bound is applied to both sides, so a builder that clips its own window cannot leave a gap."""
    keep = current.drop(MONTH).filter(F.col(date_col) < since)
    return keep.unionByName(fresh.filter(F.col(date_col) >= since).select(keep.columns))


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """On whatever file system the path names, not only the driver's disk."""
    target, fs = _file_system(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target, fs = _file_system(spark, path)
    fs.delete(target, True)


POINTER = "_CURRENT"


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the published version of a snapshot."""
    pointer = os.path.join(path, POINTER)
    return os.path.join(path, _read_text(spark, pointer)) if path_exists(spark, pointer) else None


def publish(df: DataFrame, path: str) -> None:
    """Write a snapshot as a new version and then switch the pointer, so a reader meets the old or the
    new one and never a part. The version before stays for readers that already opened it."""
    spark, before = df.sparkSession, current_version(df.sparkSession, path)
    name = f"v-{uuid.uuid4().hex}"
    with released(spark):
        df.write.parquet(os.path.join(path, name))
    target, fs = _file_system(spark, os.path.join(path, POINTER))
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(name.encode()))
    finally:
        stream.close()
    keep = {name, POINTER, os.path.basename(before or "")}
    for status in fs.listStatus(target.getParent()):
        if status.getPath().getName() not in keep and status.isDirectory():
            fs.delete(status.getPath(), True)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(version)


VERSION, COMMITS = "version", "_commits"
#: Spark's folder name for rows without a date.
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"
#: Commits whose files stay for readers that opened them.
KEPT_COMMITS = 2


@dataclass
class Month:
    """The live version of one month, its rows and its days."""

    version: str
    rows: int
    first: str | None
    last: str | None


@dataclass
class Manifest:
    """One commit: schema (JSON) of the rows, and the live months."""

    number: int
    schema: str
    months: dict[str, Month] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(m.rows for m in self.months.values())

    @property
    def span(self) -> tuple[dt.date | None, dt.date | None]:
        """Oldest and newest day."""
        days = [dt.date.fromisoformat(d) for m in self.months.values() for d in (m.first, m.last) if d]
        return (min(days), max(days)) if days else (None, None)

    @property
    def folders(self) -> set[str]:
        return {f"{VERSION}={m.version}/{MONTH}={name}" for name, m in self.months.items()}


class CommitConflict(RuntimeError):
    """Another refresh has committed since this one read the dataset."""


def _read_text(spark: SparkSession, path: str) -> str:
    target, fs = _file_system(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _commit_numbers(spark: SparkSession, path: str) -> list[int]:
    target, fs = _file_system(spark, os.path.join(path, COMMITS))
    names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d{20}\.json", n))


def _commit_path(path: str, number: int) -> str:
    return os.path.join(path, COMMITS, f"{number:020d}.json")


def manifest(spark: SparkSession, path: str, number: int | None = None) -> Manifest | None:
    """The last commit of a dataset (or that of a number); None where nothing was committed."""
    numbers = _commit_numbers(spark, path) if number is None else [number]
    if not numbers:
        return None
    stored = json.loads(_read_text(spark, _commit_path(path, numbers[-1])))
    return Manifest(numbers[-1], stored["schema"], {name: Month(**m) for name, m in stored["months"].items()})


def stage(df: DataFrame, path: str, date_col: str = "sales_date") -> dict[str, Month]:
    """Write rows as a new version that no reader sees yet; returns its months with their rows and days, counted from the
    written date column. Rows are dealt by `RUN_DAYS` days of a month and balanced by measured size, so a hot day spreads over
    tasks. A shuffle by range would build the rows twice, once to sample them."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    folder = os.path.join(path, f"{VERSION}={version}")
    run = (F.year(date_col) * 12 + F.month(date_col)) * 31 + F.floor((F.dayofmonth(date_col) - 1) / RUN_DAYS)
    rows = (
        df.withColumn("_run", run.cast("int"))
        .hint("rebalance", "_run")
        .drop("_run")
        .withColumn(MONTH, month_key(F.col(date_col)))
        .sortWithinPartitions(MONTH, date_col)
    )
    with released(spark):
        rows.write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy(MONTH).parquet(folder)
    day = F.col(date_col).cast("date").cast("string")
    written = spark.read.schema(T.StructType([df.schema[date_col], T.StructField(MONTH, T.StringType())])).parquet(folder)
    with released(spark):
        counts = written.groupBy(MONTH).agg(F.count(F.lit(1)), F.min(day), F.max(day)).collect()  # a row for each month
    return {name or NO_MONTH: Month(version, rows, first, last) for name, rows, first, last in counts}


def commit(spark: SparkSession, path: str, before: Manifest | None, schema: T.StructType, months: dict[str, Month]) -> Manifest:
    """Publish `months` as the whole of the dataset, if `before` is still its last commit."""
    after = Manifest(before.number + 1 if before else 1, schema.json(), months)
    staged = os.path.join(path, COMMITS, f"_{uuid.uuid4().hex}")
    target, fs = _file_system(spark, _commit_path(path, after.number))
    source, _ = _file_system(spark, staged)
    stream = fs.create(source, False)
    try:
        stream.write(bytearray(json.dumps({"schema": after.schema, "months": {n: vars(m) for n, m in sorted(months.items())}}).encode()))
    finally:
        stream.close()
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, False)
        raise CommitConflict(f"{path}: commit {after.number} exists")
    _forget(spark, path)
    return after


def _forget(spark: SparkSession, path: str) -> None:
    """Remove commits beyond the kept ones, and month folders that only they name. What a running refresh has staged is in no commit and stays."""
    numbers = _commit_numbers(spark, path)
    old, kept = numbers[:-KEPT_COMMITS], numbers[-KEPT_COMMITS:]
    live = set().union(*(manifest(spark, path, n).folders for n in kept))
    for n in old:
        for folder in manifest(spark, path, n).folders - live:
            remove(spark, os.path.join(path, folder))
        remove(spark, _commit_path(path, n))


def write_monthly(df: DataFrame, path: str, date_col: str = "sales_date", replace: bool = False) -> Manifest:
    """Partition by month. Only the months present in `df` are replaced; the others stay, unless all are to be replaced."""
    before = manifest(df.sparkSession, path)
    fresh = stage(df, path, date_col)
    return commit(df.sparkSession, path, before, df.schema, fresh if replace or before is None else before.months | fresh)


def read_monthly(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last commit, from the folders it names. The month column stays in the frame: `prune` turns a date
    range into a partition filter."""
    now = manifest(spark, path)
    if now is None:
        raise FileNotFoundError(path)
    schema = T.StructType([*T.StructType.fromJson(json.loads(now.schema)).fields, T.StructField(MONTH, T.StringType())])
    if not now.months:
        return spark.createDataFrame([], schema)
    folders = [os.path.join(path, f) for f in sorted(now.folders)]
    versioned = T.StructType([*schema.fields[:-1], T.StructField(VERSION, T.StringType()), schema.fields[-1]])
    return spark.read.schema(versioned).option("basePath", path).parquet(*folders).drop(VERSION)


def replace_window_on_disk(spark: SparkSession, path: str, build, days: int, date_col: str = "sales_date", clip=None) -> Manifest:
    """Rebuild the trailing window of a monthly dataset. `build(since)` returns the fresh rows; a builder that
    never reaches back further than some date passes that rule as `clip`, and rows before it are kept. The newest
    day and the months the window touches come from the last commit; only those months are read and written
    anew, and one commit switches all of them. A month left without rows is dropped. A dataset without rows has
    no window and is built in full."""
    before = manifest(spark, path)
    watermark = before.span[1] if before else None
    if watermark is None:
        return write_monthly(build(None), path, date_col, replace=True)
    since = as_date(watermark - dt.timedelta(days))
    if clip is not None:  # a rule in columns: one row on the driver
        since = as_date(spark.range(1).select(clip(since)).first()[0])
    month = spark.range(1).select(month_key(since)).first()[0]
    current = read_monthly(spark, path)
    touched = current.filter(F.col(MONTH) >= month)
    fresh = stage(replace_window(touched, build(since), since, date_col), path, date_col)
    kept = {name: m for name, m in before.months.items() if name < month or name == NO_MONTH}
    return commit(spark, path, before, current.drop(MONTH).schema, kept | fresh)


class Store:
    """Datasets written once under a shared folder and read back as tables: reports then start from
    a pruned columnar scan, and a lost executor costs a re-read instead of the whole lineage."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or scratch_path(spark, "store")
        self.done: dict[str, DataFrame] = {}
        self.steps: list[list[str]] = []

    @contextmanager
    def building(self):
        """The build of one dataset; what it writes aside goes when it ends, so the dataset must be written by then."""
        self.steps.append([])
        try:
            yield
        finally:
            for path in self.steps.pop():
                remove(self.spark, path)

    def aside(self, df: DataFrame) -> DataFrame:
        """Rows in the middle of a long build, written and read back: the shuffles before them leave the disks, and those after
        them never lie beside the former. Outside `building` the plan as it is."""
        if not self.steps:
            return df
        path = scratch_path(self.spark, "step")
        self.steps[-1].append(path)
        with released(self.spark):
            df.write.option("parquet.block.size", ROW_GROUP_BYTES).option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, name: str, df: DataFrame, date_col: str | None = None) -> DataFrame:
        if name not in self.done:
            path = os.path.join(self.root, name)
            if date_col:  # by month, so that reports over a range of days open only its folders
                write_monthly(df, path, date_col, replace=True)
                self.done[name] = read_monthly(self.spark, path)
            else:
                with released(self.spark):
                    df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
                self.done[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.done[name]


    def manifest(self, name: str) -> Manifest | None:
        """What the last commit of a monthly dataset says of it."""
        return manifest(self.spark, os.path.join(self.root, name))


def stored_freshness(spark: SparkSession, name: str, now: Manifest) -> DataFrame:
    """As `freshness`, from the commit of a monthly dataset: nothing is scanned."""
    row = (name, now.span[1], None, now.rows)
    return spark.createDataFrame([row], "dataset string, max_date date, max_ts timestamp_ntz, row_count long")


def freshness(name: str, df: DataFrame, date_col: str | None = None, event_time: Column | None = None) -> DataFrame:
    """Row count, newest date and newest event time of one dataset, in one pass."""
    newest = F.max(date_col).cast("date") if date_col else F.lit(None).cast("date")
    ts = F.max(event_time) if event_time is not None else F.lit(None).cast("timestamp_ntz")
    return df.agg(newest.alias("max_date"), ts.alias("max_ts"), F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("dataset"), "max_date", "max_ts", "row_count"
    )
