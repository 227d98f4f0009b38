"""Joins against small sides whose size is checked before broadcasting.

Two kinds of "small" appear in the engine:

* **Fitted parameters** - a global aggregate without grouping keys always has
  exactly one row; it is packed into one struct column and broadcast to every
  task (:func:`with_params`). The join has a one-row build side, so it is
  linear in the big side (every row meets exactly one parameter row).
* **Dimension-like sides** (lookup tables, per-group summaries with a bounded
  key domain) - their rows and bytes are counted before they are broadcast;
  above either limit the plan is an ordinary shuffle join (:func:`join_small`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 1_000_000


MAX_BYTES = 64 << 20


def fits(df: DataFrame, max_rows: int, max_bytes: int = MAX_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows of ``max_bytes`` in all (as JSON text); one aggregate row."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, used = df.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return rows <= max_rows and (used or 0) <= max_bytes


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: str | list[str] | Column,
    how: str = "inner",
    bound: int | None = None,
    max_rows: int = DEFAULT_MAX_ROWS,
    check: bool = False,
) -> DataFrame:
    """Join ``big`` with a side expected to be small, broadcasting it only when safe.

    * ``bound``: a proven upper bound on ``small``'s rows (e.g. #features x
      #buckets). If it is within ``max_rows`` the side is broadcast.
    * ``check=True``: count the rows and bytes of ``small``; only for cheap
      sources such as a stored table, since the count executes the side's plan.
    * otherwise the planner decides at run time: AQE replans the sort-merge
      join as a broadcast join only when the materialised small side is below
      ``spark.sql.adaptive.autoBroadcastJoinThreshold``, and keeps the shuffle
      join beyond it.
    """
    if bound is not None and bound <= max_rows:
        return big.join(F.broadcast(small), on, how)
    if check and fits(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def with_params(df: DataFrame, params: DataFrame, name: str = "_p") -> DataFrame:
    """Attach a one-row parameter frame as a struct column ``name``.

    ``params`` must be an ungrouped aggregate, which Spark guarantees to be
    exactly one row, so the broadcast never grows with the data. (A scalar
    subquery would avoid the join, but Spark rejects subqueries inside
    higher-order functions and mis-resolves them in some self-joins.)
    Fields are read with ``F.col(f"{name}.field")``.
    """
    packed = params.select(F.struct(*[F.col(f"`{c}`") for c in params.columns]).alias(name))
    return df.crossJoin(F.broadcast(packed))
