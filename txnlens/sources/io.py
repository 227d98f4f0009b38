"""Sources and sinks (IO-1, IO-2, RS-6).

Reading applies an explicit schema when the layout is known (no inference
pass over the data) and turns NaN into NULL so that missing values behave like
pandas' skipna. Writing produces a directory of part files (never a single
coalesced file, which would funnel the table through one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from txnlens.functions.columns import nans_to_nulls


def transaction_schema(n_features: int = 28, time: str = "Time", amount: str = "Amount", label: str = "Class") -> StructType:
    """Schema of the raw transaction file: time, V1..Vn, amount (double), label (int)."""
    fields = [StructField(time, DoubleType())]
    fields += [StructField(f"V{i}", DoubleType()) for i in range(1, n_features + 1)]
    fields += [StructField(amount, DoubleType()), StructField(label, IntegerType())]
    return StructType(fields)


def read_transactions(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: StructType | None = None,
    header: bool = True,
    nan_to_null: bool = True,
) -> DataFrame:
    """Read a transaction table (CSV with header, or Parquet/ORC/JSON).

    CSV uses ``schema`` (default: :func:`transaction_schema`) instead of
    inferring types; ``schema=False``-like behaviour is available by passing an
    explicit StructType of your own.
    """
    if fmt == "csv":
        df = spark.read.schema(schema or transaction_schema()).option("header", header).csv(path)
    else:
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.format(fmt).load(path)
    return nans_to_nulls(df) if nan_to_null else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, header: bool = True) -> None:
    """Write a table as a directory of part files (overwrite)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", header).csv(path)
    else:
        w.format(fmt).save(path)


def save_splits(
    full: DataFrame, train: DataFrame, test: DataFrame, out_dir: str, fmt: str = "parquet"
) -> dict[str, str]:
    """RS-6: save the full wrangled table, the (balanced) train set and the test set."""
    paths = {name: f"{out_dir.rstrip('/')}/{name}" for name in ("wrangled", "train", "test")}
    write_table(full, paths["wrangled"], fmt)
    write_table(train, paths["train"], fmt)
    write_table(test, paths["test"], fmt)
    return paths


def write_lines(lines: DataFrame, header: str, path: str) -> None:
    """Text lines (column ``value``) as part files that each begin with the header."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of the row in its part
    first = F.concat(F.lit(header + "\n"), F.col("value"))
    lines.select(F.when(place == 0, first).otherwise(F.col("value")).alias("value")).write.text(path)
