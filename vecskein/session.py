"""Engine settings kept on the Spark session, with the order in which they apply, and the dealing of small scans."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PREFIX = "vecskein."


def set_option(spark: SparkSession, name: str, value) -> None:
    spark.conf.set(PREFIX + name, str(value))


def unset_option(spark: SparkSession, name: str) -> None:
    spark.conf.unset(PREFIX + name)


def get_option(spark: SparkSession, name: str) -> str | None:
    return spark.conf.get(PREFIX + name, None)


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings for the actions inside; afterwards they are what they were."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over the cores if it scans so few and small files that most cores would idle.

    Files and sizes come from the plan: nothing runs. A scan as large as the cores' splits is never dealt anew.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    if not files or files * 2 > cores:
        return df
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < split * cores else df
