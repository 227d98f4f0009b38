"""Order-dependent computations without a single-partition window.

A window with ``orderBy`` but no ``partitionBy`` moves every row into one task
(``Exchange SinglePartition``), and Spark's exact ``percentile`` merges the
whole value->count map of a group in one task. Neither survives 100 TB, so the
engine uses two-level plans instead:

* :func:`with_range_buckets` writes the rows range-partitioned by their order
  and keeps the partition number as an ordered bucket. The partitioner takes its
  bounds from a sample, so the buckets stay balanced whatever their number, and
  a salt among the order columns lets one hot value span several buckets.
* :func:`prefix_rank`, :func:`prefix_sums`, :func:`previous_value` compute the
  per-bucket summaries (at most one row per group and bucket), prefix-sum them
  with a window over that small table, and finish with a window partitioned by
  ``(group, bucket)`` over at most about ``TARGET_BUCKET_ROWS`` rows.
* :func:`exact_quantiles` brackets each target rank between two sketch
  quantiles, then ranks only the distinct values inside the bracket (split
  again into value sub-buckets); values outside the brackets are only counted.
  It runs its passes eagerly and writes its small intermediates to the
  checkpoint folder. A bracket that missed its rank is
  tried again with a wider margin, up to the whole range, so results are always
  exact (linear interpolation, as pandas / DuckDB ``quantile_cont``) and there
  is one path at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.plans.small import join_small
from txnlens.plans.stage import write_table

LEAST_BUCKETS = 8
TARGET_BUCKET_ROWS = 1_000_000
LEAST_SALTS = 1024
DEFAULT_ACCURACY = 10_000


def auto_buckets(n_rows: int, n_buckets: int | None = None) -> int:
    """Bucket count of a two-level scan: as given, or about TARGET_BUCKET_ROWS rows a bucket."""
    return n_buckets or max(LEAST_BUCKETS, -(-n_rows // TARGET_BUCKET_ROWS))


def auto_salts(n_rows: int, salts: int | None = None) -> int:
    """Salt count: as given, or so many that rows of one value and salt stay about TARGET_BUCKET_ROWS."""
    return salts or max(LEAST_SALTS, -(-n_rows // TARGET_BUCKET_ROWS))


_G = "_grp0"


def _with_group_key(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Equi-join needs at least one key; use a constant when there are no groups."""
    if by:
        return df, list(by)
    return df.withColumn(_G, F.lit(0)), [_G]


def with_range_buckets(df: DataFrame, order_cols: Sequence[str], out: str, n_buckets: int) -> DataFrame:
    """``df`` written range-partitioned by ``order_cols``; ``out`` is the partition's number.

    Stored, the number is a column like any other: a lost executor cannot change
    it. Buckets follow the order of ``order_cols`` (nulls first).
    """
    order = [F.col(c).asc_nulls_first() for c in order_cols]
    return write_table(df.repartitionByRange(n_buckets, *order).withColumn(out, F.spark_partition_id()), "ranges")


def _salted(df: DataFrame, salts: int) -> DataFrame:
    """Add a row hash ``__row_hash`` (all columns) and a salt ``__salt`` in [0, salts)."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.withColumn("__row_hash", h).withColumn("__salt", F.pmod(F.col("__row_hash"), F.lit(salts)))


def _counted(df: DataFrame, order_col: str, salts: int | None) -> tuple[DataFrame, int, int]:
    """The salted rows with an order value, their number, and the number of salts."""
    x = df.where(F.col(order_col).isNotNull())
    n = x.count()
    salts = auto_salts(n, salts)
    return _salted(x, salts), n, salts


def prefix_rank(
    df: DataFrame,
    order_col: str,
    part_cols: Sequence[str] = (),
    rank_col: str = "_rn",
    total_col: str | None = "_n",
    n_buckets: int | None = None,
    salts: int | None = None,
) -> DataFrame:
    """``row_number()`` over ``part_cols`` ordered by ``order_col``, two-level.

    Ties get consecutive numbers in arbitrary (hash) order, like ``row_number``.
    Rows with a NULL ``order_col`` are dropped. Rows are first collapsed to
    ``(group, value, salt)`` counts, so a value shared by a third of all rows
    becomes at most ``salts`` records; the running offsets are computed over
    that table in range buckets, and rows are numbered only inside their
    ``(group, value, salt)`` group.
    """
    parts = list(part_cols)
    x, n, salts = _counted(df, order_col, salts)
    cv = x.groupBy(*parts, order_col, "__salt").agg(F.count(F.lit(1)).alias("_c"))
    b = "_bkt"
    # records <= rows: sizing the buckets from the input avoids running the aggregation twice
    cvb = with_range_buckets(cv, [*parts, order_col, "__salt"], b, auto_buckets(n, n_buckets))
    bt = cvb.groupBy(*parts, b).agg(F.sum("_c").alias("_bc"))
    wp = (Window.partitionBy(*parts) if parts else Window.partitionBy()).orderBy(b)
    # ``bt`` has at most |groups| x n_buckets rows: the windows over it are small
    offs = bt.select(
        *parts,
        b,
        F.coalesce(F.sum("_bc").over(wp.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_boff"),
        F.sum("_bc").over(Window.partitionBy(*parts) if parts else Window.partitionBy()).alias("_tot"),
    )
    cvb = join_small(cvb, offs, [*parts, b], "inner")
    wv = Window.partitionBy(*parts, b).orderBy(order_col, "__salt").rowsBetween(Window.unboundedPreceding, -1)
    cvb = cvb.withColumn("_off", F.col("_boff") + F.coalesce(F.sum("_c").over(wv), F.lit(0)))
    y = x.join(cvb.select(*parts, order_col, "__salt", "_off", "_tot"), [*parts, order_col, "__salt"], "inner")
    wr = Window.partitionBy(*parts, order_col, "__salt").orderBy("__row_hash")  # rows of one (value, salt)
    y = y.withColumn(rank_col, F.col("_off") + F.row_number().over(wr))
    y = y.withColumnRenamed("_tot", total_col) if total_col else y.drop("_tot")
    return y.drop("_off", "__row_hash", "__salt")


def prefix_sums(
    df: DataFrame,
    order_col: str,
    sum_cols: Sequence[str],
    part_cols: Sequence[str] = (),
    suffix: str = "_cum",
    n_buckets: int | None = None,
) -> DataFrame:
    """Running sums of ``sum_cols`` ordered by ``order_col`` (rows-unbounded-preceding).

    Input rows should already be unique per ``(part_cols, order_col)`` (e.g. a
    value->count table) when a tie-free cumulative distribution is wanted.
    """
    b = "_bkt"
    parts = list(part_cols)
    x = df.where(F.col(order_col).isNotNull())
    x = with_range_buckets(x, [*parts, order_col], b, auto_buckets(x.count(), n_buckets))
    tot = x.groupBy(*parts, b).agg(*[F.sum(c).alias(f"_bt_{c}") for c in sum_cols])
    wp = (Window.partitionBy(*parts) if parts else Window.partitionBy()).orderBy(b).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offs = tot.select(
        *parts, b, *[F.coalesce(F.sum(f"_bt_{c}").over(wp), F.lit(0)).alias(f"_off_{c}") for c in sum_cols]
    )
    x = join_small(x, offs, [*parts, b], "inner")
    w = Window.partitionBy(*parts, b).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    for c in sum_cols:
        x = x.withColumn(f"{c}{suffix}", F.col(f"_off_{c}") + F.sum(c).over(w)).drop(f"_off_{c}")
    return x.drop(b)


def previous_value(
    df: DataFrame,
    order_col: str,
    part_cols: Sequence[str] = (),
    out: str = "_prev",
    n_buckets: int | None = None,
    salts: int | None = None,
) -> DataFrame:
    """``lag(order_col)`` over ``part_cols`` ordered by ``order_col``, two-level.

    Rows are collapsed to ``(group, value, salt)`` records (count, lowest row
    hash); the previous record's value in ``(value, salt)`` order comes from
    per-bucket windows over that table plus the last value of the previous
    non-empty bucket. Back on the rows, the row
    with the lowest hash of its record takes that previous value and every
    other row takes its own value (its predecessor is a tie). Fully identical
    rows share a hash and are numbered among themselves (a window over copies
    of one row).
    """
    parts = list(part_cols)
    x, n, salts = _counted(df, order_col, salts)
    cv = x.groupBy(*parts, order_col, "__salt").agg(F.min("__row_hash").alias("_hmin"))
    b = "_bkt"
    cvb = with_range_buckets(cv, [*parts, order_col, "__salt"], b, auto_buckets(n, n_buckets))  # records <= rows
    last = cvb.groupBy(*parts, b).agg(F.max(order_col).alias("_bmax"))
    wp = (Window.partitionBy(*parts) if parts else Window.partitionBy()).orderBy(b)
    carry = last.select(*parts, b, F.lag("_bmax").over(wp).alias("_carry"))  # small table
    cvb = join_small(cvb, carry, [*parts, b], "inner")
    wv = Window.partitionBy(*parts, b).orderBy(order_col, "__salt")
    cvb = cvb.withColumn("_pp", F.coalesce(F.lag(order_col).over(wv), F.col("_carry")))
    y = x.join(cvb.select(*parts, order_col, "__salt", "_hmin", "_pp"), [*parts, order_col, "__salt"], "inner")
    # fully identical rows share a hash: number them so exactly one is first
    # (a window over identical copies only; distinct rows are singletons)
    wd = Window.partitionBy(*parts, order_col, "__salt", "__row_hash").orderBy("__row_hash")
    first = (F.col("__row_hash") == F.col("_hmin")) & (F.row_number().over(wd) == 1)
    y = y.withColumn(out, F.when(first, F.col("_pp")).otherwise(F.col(order_col)))
    return y.drop("__row_hash", "__salt", "_hmin", "_pp")


def exact_quantiles(
    df: DataFrame,
    value: str | Column,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = DEFAULT_ACCURACY,
    max_groups: int | None = None,
    margin: float | None = None,
    sub_buckets: int = 1024,
) -> DataFrame:
    """Exact quantiles with linear interpolation, per group.

    Returns ``(*by, prob, quantile, n)``; NULL values are ignored; groups
    without values produce no rows.
    """
    vcol = F.col(value) if isinstance(value, str) else value
    x = df.select(*[F.col(c) for c in by], vcol.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    x, keys = _with_group_key(x, by)
    probs = sorted({float(p) for p in probs})
    margin = 4.0 / accuracy if margin is None else margin  # rank margin of the bracket
    out = None
    while True:
        found = _bracket_pass(x, keys, by, probs, accuracy, margin, sub_buckets, max_groups)
        bad = found.where(~F.col("_ok")).select(*keys).distinct()
        done = margin >= 1.0 or bad.isEmpty()
        good = found if done else found.join(bad, keys, "left_anti")
        good = good.select(*keys, "prob", "quantile", "_n")
        out = good if out is None else out.unionByName(good)
        if done:
            break
        # rare: a bracket missed its rank; those groups again with a wider one (at margin 1 it is the whole range)
        x = x.join(bad, keys, "left_semi")
        margin = min(1.0, max(margin, 1.0 / accuracy) * 16)
    out = out.withColumnRenamed("_n", "n")
    return out if by else out.drop(_G)


def _cell_of(v: Column, los: Column, his: Column, k: int, sub_buckets: int) -> tuple[Column, Column]:
    """The ordered cell of a value, and whether it lies in a bracket.

    Cell ``i * (sub_buckets + 1)`` is the gap before bracket ``i``, the next
    ``sub_buckets`` ones divide the bracket; the order of cells follows the
    order of values.
    """
    cell, inside = F.lit(k * (sub_buckets + 1)), F.lit(False)
    for i in reversed(range(k)):
        lo, hi = los[i], his[i]
        span = hi - lo
        sub = F.when(
            (span > 0) & (span < float("inf")),
            F.least(F.greatest(F.floor((v - lo) / span * sub_buckets), F.lit(0)), F.lit(sub_buckets - 1)),
        ).otherwise(F.lit(0))
        own = F.lit(i * (sub_buckets + 1)) + F.when(v < lo, F.lit(0)).otherwise(sub + 1)
        cell = F.when(v <= hi, own).otherwise(cell)
        inside = F.when(v <= hi, v >= lo).otherwise(inside)
    return cell.cast("long"), inside


def _bracket_pass(
    x: DataFrame,
    keys: list[str],
    by: Sequence[str],
    probs: Sequence[float],
    accuracy: int,
    margin: float,
    sub_buckets: int,
    max_groups: int | None,
) -> DataFrame:
    """``(*keys, prob, quantile, _n, _ok)``; not ok where a bracket missed a rank.

    The sketch's brackets are one row a group, so each value is looked at once
    whatever the number of probabilities: it falls into one cell, a part of a
    bracket (kept by distinct value) or a gap between brackets (only counted).
    """
    k = len(probs)
    lo_p = [min(max(p - margin, 0.0), 1.0) for p in probs]
    hi_p = [max(min(p + margin, 1.0), 0.0) for p in probs]
    stats = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_vmin"),
        F.max("_v").alias("_vmax"),
        F.percentile_approx("_v", F.array(*[F.lit(p) for p in lo_p + hi_p]), accuracy).alias("_a"),
    )
    los = F.array(*[F.element_at("_a", i + 1) if lo_p[i] > 0 else F.col("_vmin") for i in range(k)])
    his = F.array(*[F.element_at("_a", k + i + 1) if hi_p[i] < 1 else F.col("_vmax") for i in range(k)])
    # one row a group; read by the value pass and by the ranks, written so that neither scans x for it again
    stats = write_table(stats.select(*keys, "_n", los.alias("_los"), his.alias("_his")), "q-sketch")
    bound = 1 if not by else max_groups
    j = join_small(x, stats.drop("_n"), keys, "inner", bound=bound)
    cell, inside = _cell_of(F.col("_v"), F.col("_los"), F.col("_his"), k, sub_buckets)
    g = j.groupBy(*keys, cell.alias("_cell"), F.when(inside, F.col("_v")).alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    g = write_table(g, "q-bracket")
    # at most k * (sub_buckets + 1) + 1 rows a group
    upto = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = g.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_sc"))
    cells = cells.withColumn("_off", F.coalesce(F.sum("_sc").over(upto), F.lit(0)))
    ranks = stats.select(*keys, "_n", F.explode(F.array(*[F.lit(p) for p in probs])).alias("prob"))
    pos = F.col("prob") * (F.col("_n") - 1).cast("double")
    ranks = ranks.withColumns({"_rlo": F.floor(pos).cast("long"), "_rhi": F.ceil(pos).cast("long"), "_frac": pos - F.floor(pos)})
    held = lambda r: (F.col("_off") <= F.col(r)) & (F.col(r) < F.col("_off") + F.col("_sc"))
    need = ranks.join(cells, keys).where(held("_rlo") | held("_rhi"))
    # the distinct values of the few cells that hold a rank, numbered inside the cell
    hit = g.where(F.col("_k").isNotNull()).join(need.select(*keys, "_cell").distinct(), [*keys, "_cell"], "left_semi")
    before = Window.partitionBy(*keys, "_cell").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    hit = hit.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    at = need.join(hit, [*keys, "_cell"], "left").withColumn("_first", F.col("_off") + F.col("_before"))
    is_at = lambda r: (F.col("_first") <= F.col(r)) & (F.col(r) < F.col("_first") + F.col("_c"))
    found = at.groupBy(*keys, "prob", "_n", "_frac").agg(
        F.max(F.when(is_at("_rlo"), F.col("_k"))).alias("_vlo"), F.max(F.when(is_at("_rhi"), F.col("_k"))).alias("_vhi")
    )
    value = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")
    same = F.col("_vlo") == F.col("_vhi")
    found = found.select(
        *keys, "prob", F.when(same, F.col("_vlo")).otherwise(value).alias("quantile"), "_n",
        (F.col("_vlo").isNotNull() & F.col("_vhi").isNotNull()).alias("_ok"),
    )
    return write_table(found, "q-result")


def quantiles_wide(
    df: DataFrame,
    value: str | Column,
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    accuracy: int = DEFAULT_ACCURACY,
    max_groups: int | None = None,
) -> DataFrame:
    """:func:`exact_quantiles` pivoted to one column per probability (``names``)."""
    q = exact_quantiles(df, value, probs, by, accuracy, max_groups)
    aggs = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(n) for p, n in zip(probs, names)]
    if by:
        return q.groupBy(*by).agg(*aggs)
    return q.agg(*aggs)


def previous_k(
    df: DataFrame,
    order_col: str,
    part_cols: Sequence[str],
    k: int,
    out: str = "_prev_k",
    n_buckets: int | None = None,
    salts: int | None = None,
) -> DataFrame:
    """``lag(order_col, k)`` over ``part_cols`` ordered by ``order_col``, two-level.

    Rows are collapsed to ``(group, value, salt)`` records (a hot entity or a
    hot tie becomes at most ``salts`` records per value). Over the record table,
    ordered by ``(value, salt)`` inside range buckets, each record learns
    its k predecessors' ``(value, count)``: in-bucket ``lag`` for all but the
    first k records of a bucket, which are fixed on a small side table of each
    bucket's first and last k records. From those, "the value j rows before the
    record starts" (j = 1..k) follows from the counts. A row numbered i inside
    its record has ``lag_k`` = its own value when i > k, else the value
    (k - i + 1) rows before the record. Rows are numbered only inside one
    ``(group, value, salt)`` record.
    """
    parts = list(part_cols)
    b = "_bkt"
    x, n, salts = _counted(df, order_col, salts)
    rec = x.groupBy(*parts, order_col, "__salt").agg(F.count(F.lit(1)).alias("_c"))
    rec = with_range_buckets(rec, [*parts, order_col, "__salt"], b, auto_buckets(n, n_buckets))  # records <= rows
    vc = F.struct(F.col(order_col).alias("v"), F.col("_c").alias("c"))
    wg = Window.partitionBy(*parts, b).orderBy(order_col, "__salt")
    rec = rec.withColumn("_ra", F.row_number().over(wg)).withColumn(
        "_nb", F.count(F.lit(1)).over(Window.partitionBy(*parts, b))
    )
    for d in range(1, k + 1):
        rec = rec.withColumn(f"_l{d}", F.lag(vc, d).over(wg))
    # first and last k records of every bucket: at most 2k rows per bucket
    edge = rec.where((F.col("_ra") <= k) | (F.col("_ra") > F.col("_nb") - k)).select(*parts, b, "_ra", vc.alias("_vc"))
    we = Window.partitionBy(*parts).orderBy(b, "_ra")
    heads = edge
    for d in range(1, k + 1):
        heads = heads.withColumn(f"_e{d}", F.lag("_vc", d).over(we))
    heads = heads.where(F.col("_ra") <= k).drop("_vc")
    rec = rec.join(heads, [*parts, b, "_ra"], "left")
    lags = [F.when(F.col("_ra") <= k, F.col(f"_e{d}")).otherwise(F.col(f"_l{d}")) for d in range(1, k + 1)]
    # value j rows before the record starts: walk back over the k previous records
    before = []
    for j in range(1, k + 1):
        expr = None
        cum = F.lit(0)
        for d in range(k):
            cum = cum + F.coalesce(lags[d]["c"], F.lit(0))
            cond = lags[d].isNotNull() & (cum >= j)
            expr = F.when(cond, lags[d]["v"]) if expr is None else expr.when(cond, lags[d]["v"])
        before.append(expr)
    rec = rec.select(*parts, order_col, "__salt", F.array(*before).alias("_before"))
    y = x.join(rec, [*parts, order_col, "__salt"], "inner")
    wi = Window.partitionBy(*parts, order_col, "__salt").orderBy("__row_hash")  # rows of one record
    i = F.row_number().over(wi)
    y = y.withColumn(
        out, F.when(i > k, F.col(order_col)).otherwise(F.element_at(F.col("_before"), F.lit(k + 1) - i))
    )
    return y.drop("__row_hash", "__salt", "_before")
