"""Incremental refresh of kept stages and mergeable aggregates (IO-3).

A :class:`KeptStage` follows a folder of Parquet files through a change log: one
row for every file it has read, with size, time and the number of the refresh
that read it. A refresh lists the folder (names and sizes only), reads the files
that the log does not hold, and writes two things for them: their transformed
rows and their partial aggregates. The log's rows are written last, so a refresh
that failed before leaves nothing that counts and is done again under its number.
A file that changed or went makes the log start over with the next generation.

Row-wise stages are read as the union of their refreshes; aggregates are merged
from the partial ones, so that an append costs the appended files alone. Partial
aggregates may hold sketches (:mod:`txnlens.operators.sketches`), which merge too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.session import checkpoint_subdir

LOG_SCHEMA = "path string, length long, modified timestamp, refresh int"


@dataclass
class KeptStage:
    """``transform`` maps new rows to kept rows (row by row); ``partial`` aggregates kept rows; ``merge`` adds partials up."""

    spark: SparkSession
    source: str
    name: str
    transform: Callable[[DataFrame], DataFrame]
    partial: Callable[[DataFrame], DataFrame] | None = None
    merge: Callable[[DataFrame], DataFrame] | None = None
    generation: int = field(default=0)

    def _base(self) -> str:
        return checkpoint_subdir(self.spark, f"kept/{self.name}/{self.generation}")

    def _listing(self) -> DataFrame:
        """The folder's files; their content is not read."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.source)
        return files.select("path", "length", F.col("modificationTime").alias("modified"))

    def _log(self) -> DataFrame:
        if not self._exists(f"{self._base()}/log"):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self._base()}/log")

    def _exists(self, path: str) -> bool:
        try:
            self.spark.read.schema(LOG_SCHEMA).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def refresh(self) -> list[str]:
        """Read the files that are new; their paths. One row a new file comes to the driver, as for any scan."""
        log = self._log()
        listing = self._listing()
        key = ["path", "length", "modified"]
        if not log.join(listing, key, "left_anti").isEmpty():
            self.generation += 1
            while self._exists(self._base()):
                self.generation += 1
            log = self._log()
        new = sorted(r["path"] for r in listing.join(log, key, "left_anti").collect())
        if not new:
            return []
        number = (log.agg(F.max("refresh")).first()[0] or 0) + 1
        rows = self.transform(self.spark.read.parquet(*new))
        rows.write.mode("overwrite").parquet(f"{self._base()}/rows/refresh={number}")
        if self.partial is not None:
            kept = self.spark.read.schema(rows.schema).parquet(f"{self._base()}/rows/refresh={number}")
            self.partial(kept).write.mode("overwrite").parquet(f"{self._base()}/partial/refresh={number}")
        done = listing.where(F.col("path").isin(new)).withColumn("refresh", F.lit(number))
        done.write.mode("append").parquet(f"{self._base()}/log")
        return new

    def _of_log(self, kind: str) -> DataFrame:
        """What the refreshes in the log have written; an unfinished one does not count."""
        numbers = [r["refresh"] for r in self._log().select("refresh").distinct().collect()]
        found = self.spark.read.parquet(f"{self._base()}/{kind}")
        return found.where(F.col("refresh").isin(numbers)).drop("refresh")

    def rows(self) -> DataFrame:
        return self._of_log("rows")

    def result(self) -> DataFrame:
        """The merged aggregates of all files."""
        if self.merge is None:
            raise ValueError("the stage keeps no aggregates")
        return self.merge(self._of_log("partial"))
