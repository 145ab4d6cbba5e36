"""Session settings the operators are written for."""

from contextlib import contextmanager

from pyspark.sql import SparkSession

RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    # re-plan at run time: partition counts, join strategy by measured size, skewed join partitions
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # what a task sorts and sums at once; a partition of the default size, 64 MB compressed, is spilled by a ledger's rows
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


#: Spark then removes the shuffle files of an execution when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for k, v in RUNTIME.items():
        spark.conf.set(k, v)
    return spark


@contextmanager
def released(spark: SparkSession):
    """For writes: what they shuffled leaves the disks with them and not when the driver's memory is collected, which may be
    after the last of many datasets. Frames that a caller runs are outside: run again, they would build their shuffles again."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)
