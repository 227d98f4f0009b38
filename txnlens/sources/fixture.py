"""The ``transactions`` test table derived from the driver's ``events`` and ``embeddings``.

Definition (shared with the DuckDB twin in :mod:`txnlens.oracle`):

* ``txn_id``  = ``event_id``
* ``Time``    = whole seconds since 2024-01-01 modulo two days, as double
* ``V1..V28`` = the first 28 embedding components, rounded to 6 decimals
* ``Amount``  = 0 when ``event_id % 97 = 0`` else ``round(value * 4, 2)``
* ``Class``   = 1 when ``label = 0`` and ``event_type`` is error/click
* rows with ``txn_id % 263 = 0`` appear twice (exact duplicates)

Variants: ``nulls`` (V1 NULL / V2 NaN on some rows), ``rare`` (positives further
restricted by ``event_id % 7 = 0``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_FEATURES = 28
ZERO_MOD = 97
DUP_MOD = 263
NULL_MOD = 101
NAN_MOD = 103
RARE_MOD = 7
EPOCH = "2024-01-01 00:00:00"
TWO_DAYS = 172800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def embeddings_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding side of the fixture join (the whole table)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def modulus(emb: DataFrame) -> int:
    """Events meet embeddings by ``event_id`` modulo this: the greatest id plus one (one aggregate row)."""
    return (emb.agg(F.max("vec_id")).first()[0] or 0) + 1


def build_transactions(ev: DataFrame, emb: DataFrame, variant: str = "base", keep: tuple[str, ...] = ()) -> DataFrame:
    """Events (batch or stream) joined with embeddings -> transaction rows (no duplicates).

    ``emb`` is always a static frame. The planner picks the join: it broadcasts
    only a side whose size in bytes is below its threshold.
    ``keep`` passes extra event columns through (e.g. the event time).
    """
    ev = ev.withColumn("_vk", F.col("event_id") % F.lit(modulus(emb)))
    # rounded before the join: once a vector, not once an event
    first = F.slice("embedding", 1, N_FEATURES)
    emb = emb.withColumn("embedding", F.transform(first, lambda v: F.round(v.cast("double"), 6)))
    j = ev.join(emb, ev["_vk"] == emb["vec_id"])
    positive = (F.col("label") == 0) & F.col("event_type").isin("error", "click")
    if variant == "rare":
        positive = positive & (F.col("event_id") % RARE_MOD == 0)
    feats = []
    for i in range(N_FEATURES):
        v = F.col("embedding")[i]
        name = f"V{i + 1}"
        if variant == "nulls" and name == "V1":
            v = F.when(F.col("event_id") % NULL_MOD != 0, v)
        if variant == "nulls" and name == "V2":
            v = F.when(F.col("event_id") % NAN_MOD == 0, F.lit(float("nan"))).otherwise(v)
        feats.append(v.alias(name))
    epoch = F.lit(EPOCH).cast("timestamp_ntz")
    secs = F.timestamp_diff("SECOND", epoch, F.col("ts").cast("timestamp_ntz"))
    return j.select(
        F.col("event_id").alias("txn_id"),
        (secs % TWO_DAYS).cast("double").alias("Time"),
        *feats,
        F.when(F.col("event_id") % ZERO_MOD == 0, F.lit(0.0))
        .otherwise(F.round(F.col("value") * 4, 2))
        .alias("Amount"),
        F.when(positive, 1).otherwise(0).cast("int").alias("Class"),
        *[F.col(c) for c in keep],
    )


def transactions(spark: SparkSession, sf_dir: str, variant: str = "base") -> DataFrame:
    """Build the labelled transaction table (lazy), exact duplicates included."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    # rows with event_id % 263 = 0 appear twice: one scan, each event emitted 1 or 2 times
    copies = F.when(F.col("event_id") % DUP_MOD == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    ev = ev.select("*", F.explode(copies).alias("_copy")).drop("_copy")
    return build_transactions(ev, embeddings_dim(spark, sf_dir), variant)


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch view of the event stream with a TIMESTAMP event time (watermarks reject NTZ)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
    )


ARRIVAL_SLOTS = 5
LATE_MOD, LATE_HOURS = 20, 26
AGAIN_MOD, AGAIN_MINUTES = 40, 90


def arrivals(spark: SparkSession, sf_dir: str, again: bool = False) -> DataFrame:
    """The events as a feed: all columns, and the ``slot`` of arrival (equal spans of arrival time).

    Ids with ``event_id % 20 = 7`` arrive 26 hours late, those with remainder 11
    40 minutes late, the others at their time. With ``again``, ids with
    ``event_id % 40 = 3`` are delivered a second time 90 minutes later.
    """
    ev = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rest = F.col("event_id") % LATE_MOD
    late = F.when(rest == 7, LATE_HOURS * 60).when(rest == 11, 40).otherwise(0)
    ev = ev.withColumn("_at", at + late.cast("long") * 60_000_000)
    if again:
        copies = F.when(F.col("event_id") % AGAIN_MOD == 3, F.array(F.lit(0), F.lit(AGAIN_MINUTES)))
        ev = ev.withColumn("_more", F.explode(F.coalesce(copies, F.array(F.lit(0)))))
        ev = ev.withColumn("_at", F.col("_at") + F.col("_more").cast("long") * 60_000_000).drop("_more")
    ends = ev.agg(F.min("_at").alias("lo"), F.max("_at").alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    slot = F.expr(f"(_at - {lo}L) * {ARRIVAL_SLOTS}L div {hi - lo + 1}L")
    return ev.withColumn("slot", slot.cast("int")).drop("_at")
