"""A stored cube that answers the interactive filter without a rescan (FL-3 with AG-21).

Amounts are cut into ordered cells at sketch quantiles. The cube holds the
measures of every (day, hour, label, cell); the rows are kept beside it, one
folder a cell. A filter on days, hours and a maximum amount takes all cells below
the maximum from the cube; only the one cell that holds the maximum is resolved
from its rows, whose folder the scan is pruned to. Both parts are measures, which
add up to the same scorecard as a scan of the filtered table.

The measures are sums, counts and maxima, so cubes of disjoint row sets merge by
adding them (:func:`merge_cubes`): an append is cubed alone.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.operators.rates import TxnFilter, scorecard_of
from txnlens.session import checkpoint_subdir
from txnlens.spec import TxnSpec

CELLS = 256
KEYS = ("Day_label", "Hour")
CELL = "amount_cell"
NO_CELL = -1  # rows without an amount


@dataclass(frozen=True)
class AmountCube:
    """``measures`` by day, hour, label and cell; ``rows`` by cell; the cells' inner ``edges`` in order."""

    measures: DataFrame
    rows: DataFrame
    edges: tuple[float, ...]
    spec: TxnSpec

    def cell(self, amount: float) -> int:
        return bisect.bisect_left(self.edges, amount)


def cell_edges(df: DataFrame, amount: str, cells: int = CELLS) -> tuple[float, ...]:
    """At most ``cells - 1`` distinct sketch quantiles (one bounded row)."""
    at = F.array(*[F.lit((i + 1) / cells) for i in range(cells - 1)])
    found = df.agg(F.percentile_approx(F.col(amount).cast("double"), at, 10 * cells)).first()[0]
    return tuple(sorted(set(found or [])))


def cell_of(amount: Column, edges: Sequence[float]) -> Column:
    """The number of edges below the amount, by binary search over the literal edges."""
    held = F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>")
    n = len(edges)
    strides = F.array(*[F.lit(1 << j) for j in reversed(range(max(1, n.bit_length())))])

    def step(acc: Column, stride: Column) -> Column:
        upto = acc + stride
        below = (upto <= n) & (F.get(held, upto - 1) < amount)
        return F.when(below, upto).otherwise(acc)

    return F.when(amount.isNull(), F.lit(NO_CELL)).otherwise(F.aggregate(strides, F.lit(0), step)).cast("int")


def measure(rows: DataFrame, keys: Sequence[str], spec: TxnSpec) -> DataFrame:
    """What the scorecard needs of the rows of each group."""
    amount = F.col(spec.amount).cast("double")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(amount).alias("n_amount"),
        F.sum(amount).alias("total"),
        F.max(amount).alias("most"),
        F.count_if(amount == 0).alias("zeros"),
    )


def merge_measures(measures: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("n", "n_amount", "total", "zeros")]
    return measures.groupBy(*keys).agg(*sums, F.max("most").alias("most"))


def build_cube(view: DataFrame, spec: TxnSpec = TxnSpec(), cells: int = CELLS, edges: Sequence[float] | None = None) -> AmountCube:
    """The cube of an analysis view, stored in the shared folder; ``edges`` of another cube make both mergeable."""
    spark = view.sparkSession
    edges = cell_edges(view, spec.amount, cells) if edges is None else tuple(edges)
    base = checkpoint_subdir(spark, f"tables/cube-{uuid.uuid4().hex[:12]}")
    amount = F.col(spec.amount).cast("double")
    kept = view.select(*KEYS, spec.label, spec.amount, cell_of(amount, edges).alias(CELL))
    # rows of a cell in few files, in the order of their amount, so that row groups are skipped inside a cell too
    placed = kept.repartitionByRange(CELL, spec.amount, "Hour").sortWithinPartitions(CELL, spec.amount)
    placed.write.partitionBy(CELL).parquet(f"{base}/rows")
    rows = spark.read.schema(kept.schema).parquet(f"{base}/rows")
    measure(rows, [*KEYS, spec.label, CELL], spec).write.parquet(f"{base}/measures")
    return AmountCube(spark.read.parquet(f"{base}/measures"), rows, edges, spec)


def merge_cubes(cubes: Sequence[AmountCube]) -> AmountCube:
    """One cube of disjoint row sets with equal edges."""
    first = cubes[0]
    if any(c.edges != first.edges for c in cubes):
        raise ValueError("cubes with different edges do not merge")
    measures, rows = first.measures, first.rows
    for c in cubes[1:]:
        measures, rows = measures.unionByName(c.measures), rows.unionByName(c.rows)
    keys = [*KEYS, first.spec.label, CELL]
    return AmountCube(merge_measures(measures, keys), rows, first.edges, first.spec)


def boundary_rows(cube: AmountCube, f: TxnFilter) -> DataFrame:
    """The rows of the one cell that the maximum amount cuts."""
    at = cube.cell(f.max_amount)
    amount = F.col(cube.spec.amount)
    return cube.rows.where((F.col(CELL) == at) & (amount <= F.lit(float(f.max_amount))))


def cube_scorecard(cube: AmountCube, f: TxnFilter) -> DataFrame:
    """AG-21 for any filter, the peak hour from all rows, as the interactive report has it."""
    keys = [*KEYS, cube.spec.label]
    inside = F.col(f.day_col).isin(*f.days) & F.col(f.hour_col).between(*f.hours)
    whole = cube.measures.where(F.col(CELL) >= 0)
    if f.max_amount is not None:
        below = whole.where(F.col(CELL) < cube.cell(f.max_amount))
        whole = below.drop(CELL).unionByName(measure(boundary_rows(cube, f), keys, cube.spec))
    else:
        whole = whole.drop(CELL)
    return scorecard_of(whole.where(inside), cube.measures, cube.spec)
