"""Materialised pipeline stages.

The reference has a process boundary after cleaning (the cleaned table is
written and every analysis step reads it back). The Spark equivalent is
:func:`materialize`: write the stage once as Parquet under the cluster's shared
checkpoint folder (``spark.checkpoint.dir``) and read it back. That cuts the
lineage (a lost executor never recomputes dedup and fitted fences), and the
Parquet read gives column pruning and predicate pushdown to every downstream
query. Stages are memoised per application and key; the key holds the version
of the input files, so rewritten input is never answered from an old stage.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.session import checkpoint_subdir

_LOCK = threading.Lock()  # guards the two tables only, never held while a job runs
_PATHS: dict[tuple[str, str], str] = {}
_BUILDING: dict[tuple[str, str], threading.Lock] = {}


def materialize(df: DataFrame | Callable[[], DataFrame], key: str, spark: SparkSession | None = None) -> DataFrame:
    """Write a stage once per (application, key) and return the Parquet-backed frame.

    ``df`` may be a builder (``lambda: ...``) so that the stage's plan - which
    can itself run jobs, e.g. cleaning - is only built on the first use.
    """
    if callable(df):
        if spark is None:
            raise ValueError("pass spark when the stage is given as a builder")
    else:
        spark = df.sparkSession
    app = spark.sparkContext.applicationId
    with _LOCK:
        building = _BUILDING.setdefault((app, key), threading.Lock())
    with building:  # two callers of one stage wait for each other, other stages do not
        path = _PATHS.get((app, key))
        if path is None:
            frame = df() if callable(df) else df
            digest = hashlib.sha1(key.encode()).hexdigest()[:16]
            path = checkpoint_subdir(spark, f"stages/{digest}")
            frame.write.mode("overwrite").parquet(path)
            _PATHS[(app, key)] = path
    return spark.read.parquet(path)


def input_version(*tables: DataFrame) -> str:
    """A digest of the files behind ``tables``: path, size and modification time (metadata columns only)."""
    parts = []
    for t in tables:
        files = t.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        row = files.agg(F.count("*"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first()
        parts.append(f"{row[0]}:{row[1]}")
    return ",".join(parts)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder under the shared checkpoint folder and read it back.

    Used for intermediates that are referenced many times (the plan would
    otherwise inline their whole lineage at every reference) or that must
    survive executor loss without recomputation.
    """
    spark = df.sparkSession
    path = checkpoint_subdir(spark, f"tables/{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
