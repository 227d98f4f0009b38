"""CSV without a schema: inferred column types and a quarantine of malformed rows (IO-1).

Types form a lattice: whole numbers are numbers, everything is a string, and a
column's type is the least that holds its values. One aggregate over the text of
all rows counts, for every column, how many values fit each type (map-side, one
row a task), so inference is one pass whatever the number of columns and reads
no sample. The mapping is that of ``pandas.read_csv``: a whole-number column with
missing values is a number, a true/false column with missing values a string.

Rows whose number of fields differs from the header's, and rows with a value that
does not fit its column's type, are kept apart with their reason; without a
``tolerance`` inferred types fit all values, and only the former occur.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: what counts as missing in a text file
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE, FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")
WHOLE = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*[+-]?((\d+\.?\d*([eE][+-]?\d+)?)|(\.\d+([eE][+-]?\d+)?)|(?i:inf|infinity))\s*$"
RAW = "_corrupt_record"
TYPES = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}


def _text(spark: SparkSession, path: str, sep: str) -> tuple[DataFrame, list[str]]:
    """All fields as texts, with the raw line of rows whose number of fields is wrong."""
    names = spark.read.option("header", True).option("sep", sep).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, RAW]])
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
    # a reader that parses only some columns would not see that others are missing
    reader = reader.option("columnNameOfCorruptRecord", RAW).option("columnPruning", False).option("enforceSchema", True)
    return reader.csv(path), names


def _value(name: str) -> Column:
    v = F.col(f"`{name}`")
    return F.when(~F.trim(v).isin(*MISSING), v)


def _fits(v: Column, kind: str) -> Column:
    """Can a value that is not missing be read as this type?"""
    if kind == "bigint":
        return v.rlike(WHOLE) & F.trim(v).try_cast("bigint").isNotNull()
    if kind == "double":
        return v.rlike(NUMBER)
    if kind == "boolean":
        return F.trim(v).isin(*TRUE, *FALSE)
    return F.lit(True)


def _read(v: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.trim(v).isin(*TRUE)
    if kind == "double":
        return F.trim(v).try_cast("double")
    return F.trim(v).try_cast("bigint") if kind == "bigint" else v


@dataclass(frozen=True)
class Inferred:
    """``rows`` with types, the ``bad`` rows ``(record, reason)``, and ``types``: ``(column, type, n_missing)``."""

    rows: DataFrame
    bad: DataFrame
    types: DataFrame
    schema: T.StructType


def column_types(text: DataFrame, names: list[str], tolerance: float = 0.0) -> dict[str, tuple[str, int]]:
    """Type and number of missing values of each column, from one aggregate row."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(names):
        v = _value(name)
        aggs.append(F.count(v).alias(f"k{i}"))
        aggs += [F.count_if(_fits(v, kind)).alias(f"{kind}{i}") for kind in ("bigint", "double", "boolean")]
    row = text.where(F.col(RAW).isNull()).agg(*aggs).first()
    out = {}
    for i, name in enumerate(names):
        held = row[f"k{i}"]
        missing = row["n"] - held
        enough = (1 - tolerance) * held
        kind = "string"
        if held and row[f"boolean{i}"] == held:
            kind = "boolean" if not missing else "string"
        elif held == 0 or row[f"double{i}"] >= enough:
            whole = held > 0 and row[f"bigint{i}"] >= enough and not missing
            kind = "bigint" if whole else "double"
        out[name] = (kind, missing)
    return out


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", tolerance: float = 0.0, schema: T.StructType | None = None
) -> Inferred:
    """A CSV file or folder with a header.

    With ``tolerance``, a column is numeric if at most this share of its values is
    not, and their rows are bad. A given ``schema`` (of the four types) is not
    inferred; whatever does not fit it is bad.
    """
    text, names = _text(spark, path, sep)
    found = column_types(text, names, tolerance)
    if schema is not None:
        given = {f.name: f.dataType.simpleString() for f in schema}
        found = {n: (given.get(n, found[n][0]), found[n][1]) for n in names}
    wrong = F.lit(None).cast("string")
    for name, (kind, _) in reversed(found.items()):
        v = _value(name)
        wrong = F.when(v.isNotNull() & ~_fits(v, kind), F.concat(F.lit(f"{name} is no {kind}: "), v)).otherwise(wrong)
    reason = F.when(F.col(RAW).isNotNull(), F.lit("wrong number of fields")).otherwise(wrong)
    judged = text.withColumn("_reason", reason)
    record = F.coalesce(F.col(RAW), F.concat_ws(sep, *[F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names]))
    rows = judged.where(F.col("_reason").isNull()).select(*[_read(_value(n), k).alias(n) for n, (k, _) in found.items()])
    bad = judged.where(F.col("_reason").isNotNull()).select(record.alias("record"), F.col("_reason").alias("reason"))
    types = spark.createDataFrame([(n, k, m) for n, (k, m) in found.items()], "column string, type string, n_missing long")
    return Inferred(rows, bad, types, T.StructType([T.StructField(n, TYPES[k]) for n, (k, _) in found.items()]))
