"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.plans.stage import write_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the cluster's shared checkpoint folder and read back."""
    return write_table(df, name)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` is the same for pure ASCII and faster)."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def scan_partitions(df: DataFrame, rows_per_task: int, least: int = 1) -> int:
    """Task count for a row-bounded exchange (one count over the input's narrowest column)."""
    return max(least, -(-df.count() // rows_per_task))


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of the stored frame ``df``, those with the smallest hash of ``key``.

    A threshold on the hash, from the row count, leaves about one and a half
    times as many rows before they are ordered, whatever the size of ``df``.
    """
    at = F.xxhash64(key)
    n = df.count()
    if n > 2 * rows:
        df = df.where(F.pmod(at, F.lit(1 << 40)) < int((1 << 40) * 1.5 * rows / n))
    return df.orderBy(F.pmod(at, F.lit(1 << 40)), key).limit(rows)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows: texts can be very long, and a batch is held whole in a task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
