"""Session settings the library counts on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on, on a laptop and on a cluster alike.  Joins are
# left to Spark's own size checks: a side is broadcast only when its measured
# size is under autoBroadcastJoinThreshold, and a skewed join partition is
# split at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed partition even where that costs one more shuffle later.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Building an expression need not record where in the code it was built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


@contextmanager
def applied(spark: SparkSession) -> Iterator[None]:
    """Run with the settings of the library, and set back what they were."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS if spark.conf.isModifiable(key)}
    try:
        for key in before:
            spark.conf.set(key, SETTINGS[key])
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def local_session(cores: str = "8", shuffle_partitions: str = "8") -> SparkSession:
    """A small local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("civicflow")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
