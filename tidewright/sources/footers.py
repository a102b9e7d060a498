"""Counts and extremes from Parquet footers: the aggregate is pushed to the scan, no data page is read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def _session(spark: SparkSession) -> SparkSession:
    """A session of the same application in which Parquet is read by the source that takes aggregates."""
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    for name, value in SETTINGS.items():
        own.conf.set(name, value)
    return own


def extremes(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """One row: rows, and for each column its least, its largest and how many are not null. Columns of numbers or dates; texts are not pushed."""
    df = _session(spark).read.parquet(path)
    found = [(F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.count(c).alias(f"n_{c}")) for c in columns]
    return df.agg(F.count(F.lit(1)).alias("rows"), *[x for three in found for x in three])


def table_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table, rows) of several tables."""
    own = _session(spark)
    counts = [own.read.parquet(p).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, p in paths.items()]
    return reduce(DataFrame.unionByName, counts)
