"""Intermediate tables of the operators: written Parquet in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Only a session within one machine (tests) may leave it
    unset; on a cluster, executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/corpus-{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and return a scan of it. Cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_counted(df: DataFrame, name: str, *sums: Column) -> tuple[DataFrame, tuple]:
    """As `keep`, with the row count and sums over the rows, taken while they are written."""
    seen = Observation()
    columns = [F.count(F.lit(1)), *sums]
    out = keep(df.observe(seen, *(c.alias(f"_{i}") for i, c in enumerate(columns))), name)
    return out, tuple(seen.get[f"_{i}"] for i in range(len(columns)))


#: Numbers in a side up to which a scan meets it by broadcast: some 16 MB.
SMALL = 2_000_000


def meeting(rows: DataFrame, side: DataFrame, key: str, numbers: int, how: str = "inner") -> DataFrame:
    """Join of wide rows with a narrow side that holds so many numbers: by broadcast while that is little, else by shuffle."""
    return rows.join(F.broadcast(side) if numbers <= SMALL else side, key, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
