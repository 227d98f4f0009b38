"""Run a streaming job over arrivals, slot by slot, into a file sink.

Every slot's rows are added to the source folder, then the query is started
from its checkpoint with ``availableNow``: it takes the new files as one
micro-batch, moves the watermark, closes what the watermark has passed and
stops. That is how a scheduled incremental job runs, so every slot but the first
also recovers offsets, watermark and state from the checkpoint. Source, sink and
checkpoint lie in the shared folder; the sink's rows are read back through its
commit log, so a retried batch is not read twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.plans.stage import write_table
from txnlens.session import checkpoint_subdir

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_arrivals(
    feed: DataFrame, n_slots: int, job: Callable[[DataFrame], DataFrame], name: str, slot: str = "slot"
) -> tuple[DataFrame, list[dict]]:
    """The rows that ``job`` put into its sink, and the progress of its micro-batches.

    ``feed`` holds the source's rows and the ``slot`` (from 0) each arrives in;
    ``job`` maps the streaming frame of the source to the frame written out.
    """
    spark = feed.sparkSession
    base = checkpoint_subdir(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    held = write_table(feed, f"{name}_feed")
    source_schema = held.drop(slot).schema
    progress: list[dict] = []
    out_schema = None
    for k in range(n_slots):
        held.where(F.col(slot) == k).drop(slot).write.mode("append").parquet(f"{base}/source")
        out = job(spark.readStream.schema(source_schema).parquet(f"{base}/source"))
        out_schema = out.schema
        running = (
            out.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{base}/sink")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        running.awaitTermination()  # raises what the query raised
        progress += [dict(p, slot=k) for p in running.recentProgress]
    if out_schema is None:
        raise ValueError("no slots")
    return spark.read.schema(out_schema).parquet(f"{base}/sink"), progress


def late_rows(progress: list[dict]) -> int:
    """Rows that the state operators dropped behind the watermark."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in progress for s in p["stateOperators"])
