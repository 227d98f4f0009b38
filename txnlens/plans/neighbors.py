"""Exact k nearest neighbours inside one (minority) class by boxes of near rows.

1. Rows of one vector are one point, which keeps the ``k + 1`` smallest ids: no other
   id of that vector can be among the k nearest of any row.
2. A k-d tree over a bounded sample (``SAMPLE_PER_GROUP`` points a group) deals the points
   into groups of about ``tile_blocks`` x ``bucket_rows``. It splits the widest direction
   first, so clusters are parted from each other before they are cut.
3. Inside a group (``applyInArrow``) the points are cut further into blocks of at most
   ``bucket_rows``, each with the least and greatest value of every column. A point
   is searched in its own block, then in those of its group whose box is nearer than
   the k-th found so far.
4. A point is sent only to the other groups whose box is nearer than its k-th neighbour,
   and there compared only with the blocks whose box is. Where more than a group's number
   of points come, they are dealt over several tasks.
5. A matrix product bounds the distances, and those that may count are computed exactly.
   No pair is a Spark row, and only the groups' boxes are broadcast (two vectors a group).

There is no cap on candidates: the result is the exact k-NN, ties by distance,
then id. :func:`knn_with_stats` also reports the distances computed, which on
clustered rows are a small part of all pairs; without any structure the boxes
prune nothing and the work is all pairs of the class, in the same blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnlens.plans.stage import write_table

SAMPLE_PER_GROUP = 256
TILE_BLOCKS = 32
LEAST_TILES = 48  # smaller tiles for few blocks, so that their groups keep many tasks busy
AT_ONCE = 1 << 21  # distances bounded at once
MANY = 16  # candidates a row and neighbour, beyond which the bounds are cut first
SLACK = 1e-9  # bounds are widened by it, so that rounding never prunes a tie

_CANDIDATE_SCHEMA = pa.schema([("a_id", pa.int64()), ("b_id", pa.int64()), ("_d", pa.float64())])
_NEAR = "_near array<struct<_d: double, b_id: long>>, _work long"
_OWN = f"_id long, _v array<double>, _group int, _block int, _r double, _to array<int>, {_NEAR}"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), dtype="float64").reshape(len(flat), -1)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """Lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _widest(v: np.ndarray) -> np.ndarray:
    """The columns that have more than one value, the widest first (by the mean deviation, which few far rows hardly move)."""
    with np.errstate(all="ignore"):
        spread = np.abs(v - v.mean(axis=0)).mean(axis=0)
    spread[~np.isfinite(spread)] = np.finfo(float).max
    return [c for c in np.argsort(-spread, kind="stable") if v[:, c].min() < v[:, c].max()]


def _cut(v: np.ndarray) -> tuple[int, float] | None:
    """A column and a value of it, such that about half of the rows do not exceed it; None if all rows are equal."""
    for c in _widest(v):
        x = np.sort(v[:, c])
        ends = np.flatnonzero(x[:-1] < x[1:])  # last places of all values but the greatest
        return int(c), float(x[ends[np.abs(ends + 1 - len(x) / 2).argmin()]])
    return None


def _tree(sample: np.ndarray, leaves: int) -> dict[str, np.ndarray]:
    """A k-d tree: ``column`` (-1 in a leaf), ``value``, and the children, or the leaf's number as ``low``."""
    column, value, low, high = [-1], [0.0], [0], [0]
    heap = [(-len(sample), 0)]
    rows = {0: np.arange(len(sample))}
    while heap and len(rows) < leaves:
        _, node = heapq.heappop(heap)
        cut = _cut(sample[rows[node]])
        if cut is None:
            continue
        inside = rows.pop(node)
        under = sample[inside, cut[0]] <= cut[1]
        column[node], value[node], low[node], high[node] = *cut, len(column), len(column) + 1
        for child in (inside[under], inside[~under]):
            rows[len(column)] = child
            heapq.heappush(heap, (-len(child), len(column)))
            column.append(-1), value.append(0.0), low.append(0), high.append(0)
    for number, leaf in enumerate(rows):
        low[leaf] = number
    return {"column": np.array(column), "value": np.array(value), "low": np.array(low), "high": np.array(high)}


def _leaf_of(tree: dict[str, np.ndarray], v: np.ndarray) -> np.ndarray:
    at = np.zeros(len(v), dtype=np.int64)
    while True:
        inner = np.flatnonzero(tree["column"][at] >= 0)
        if not len(inner):
            return tree["low"][at]
        node = at[inner]
        under = v[inner, tree["column"][node]] <= tree["value"][node]
        at[inner] = np.where(under, tree["low"][node], tree["high"][node])


def _locate(tree):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(pa.chunked_array([batch.column("_v")]))
                group = pa.array(_leaf_of(tree.value, v), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_v"), group], names=["_id", "_v", "_group"])

    return run


def _halved(v: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows' places in parts of at most ``most`` rows, halved along the widest column."""
    done, todo = [], [np.arange(len(v))]
    while todo:
        part = todo.pop()
        if len(part) <= most:
            done.append(part)
            continue
        wide = _widest(v[part])
        half = len(part) // 2
        order = np.argpartition(v[part, wide[0]], half) if wide else np.arange(len(part))
        todo += [part[order[half:]], part[order[:half]]]
    return done


def _may_reach(av, bv, a_sq, b_sq, k: int, radius, apart) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``a``, row of ``b``) with every one that can be among the k nearest within the radius.

    ``|a - b|^2 = |a|^2 + |b|^2 - 2ab`` up to the rounding error ``err`` of the sums.
    """
    err = 8 * (av.shape[1] + 4) * np.finfo(float).eps * (a_sq + b_sq.max())
    d = av @ (-2 * bv.T)
    d += b_sq[None, :]
    if apart is not None:
        d[~apart] = np.inf
    limit = np.full(len(av), np.inf) if radius is None else radius * radius * (1 + SLACK) + err
    limit = limit - a_sq  # |a|^2 is left out of d
    near = d <= limit[:, None]
    if np.count_nonzero(near) > MANY * k * len(av) and d.shape[1] > k:
        kth = np.partition(d, k - 1, axis=1)[:, k - 1]
        near = d <= np.minimum(limit, kth + 2 * err)[:, None]
    near &= np.isfinite(d)
    return np.nonzero(near)


def _nearest(av, aid, bv, bid, k: int, radius=None) -> pa.Table:
    """The k nearest of ``b`` for each row of ``a`` (within its radius), ties by id; never the row itself."""
    out_a, out_b, out_d = [], [], []
    meet = len(np.intersect1d(aid, bid)) > 0
    with np.errstate(over="ignore", invalid="ignore"):
        a_sq, b_sq = (av * av).sum(-1), (bv * bv).sum(-1)
    bounded = bool(np.isfinite(a_sq).all() and np.isfinite(b_sq).all())  # else every distance is computed
    many = max(1, AT_ONCE // max(1, len(bid)))
    for s in range(0, len(aid), many):
        e = min(s + many, len(aid))
        apart = aid[s:e, None] != bid[None, :] if meet else None
        r_s = None if radius is None else radius[s:e]
        if bounded:
            r, c = _may_reach(av[s:e], bv, a_sq[s:e], b_sq, k, r_s, apart)
        else:
            r, c = np.nonzero(np.ones((e - s, len(bid)), dtype=bool) if apart is None else apart)
        d = np.concatenate(
            [np.zeros(0)] + [np.sqrt(((av[s + r[i : i + many]] - bv[c[i : i + many]]) ** 2).sum(-1)) for i in range(0, len(r), many)]
        )
        held = np.isfinite(d) if r_s is None else np.isfinite(d) & (d <= r_s[r])
        r, c, d = r[held], c[held], d[held]
        # the k first by (distance, id)
        order = np.lexsort((bid[c], d, r))
        r, c, d = r[order], c[order], d[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        out_a.append(aid[s + r[first]])
        out_b.append(bid[c[first]])
        out_d.append(d[first])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.table(
        {"a_id": join(out_a, "int64"), "b_id": join(out_b, "int64"), "_d": join(out_d, "float64")}, schema=_CANDIDATE_SCHEMA
    )


def _best(found: list[pa.Table], ids: np.ndarray, k: int) -> tuple[pa.ListArray, np.ndarray]:
    """The k first candidates of each of ``ids`` by (distance, id), and the k-th distance (infinite if there is none)."""
    table = pa.concat_tables([_CANDIDATE_SCHEMA.empty_table(), *found])
    a, b, d = (table.column(c).to_numpy() for c in ("a_id", "b_id", "_d"))
    by_id = np.argsort(ids)
    at = by_id[np.searchsorted(ids[by_id], a)]
    order = np.lexsort((b, d, at))
    order = order[np.arange(len(order)) - np.searchsorted(at[order], at[order]) < k]
    sizes = np.bincount(at[order], minlength=len(ids))
    kth = np.full(len(ids), np.inf)
    kth[sizes >= k] = d[order][np.cumsum(sizes)[sizes >= k] - 1]
    near = pa.StructArray.from_arrays([pa.array(d[order], pa.float64()), pa.array(b[order], pa.int64())], names=["_d", "b_id"])
    return _lists(near, sizes), kth


def _box(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return v.min(axis=0), v.max(axis=0)


def _gap(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
    """Lower bound on the distance of boxes; a row is the box of its own values."""
    with np.errstate(over="ignore"):
        apart = np.maximum(np.maximum(lo_a - hi_b, lo_b - hi_a), 0.0)
        return np.sqrt((apart * apart).sum(-1))


def _widened(d: np.ndarray) -> np.ndarray:
    return d * (1 + SLACK) + SLACK


def _search(v, ids, reach, parts, others, k: int, same: bool) -> tuple[list[pa.Table], np.ndarray]:
    """What the rows of ``parts`` find within their reach in the blocks ``others`` (their own excepted if ``same``).

    ``others`` are (values, ids). Also returns the distances bounded, by row.
    """
    found, work = [], np.zeros(len(v), dtype=np.int64)
    boxes = [_box(v[p]) for p in parts]
    lows, highs = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
    far = np.array([reach[p].max() for p in parts])
    for j, (bv, bid) in enumerate(others):
        lo, hi = _box(bv)
        meet = _gap(lows, highs, lo, hi) <= far
        if same:
            meet[j] = False
        rows = [parts[i][_gap(v[parts[i]], v[parts[i]], lo, hi) <= reach[parts[i]]] for i in np.flatnonzero(meet)]
        rows = np.concatenate([np.zeros(0, dtype=np.int64), *rows])
        if len(rows):
            work[rows] += len(bid)
            found.append(_nearest(v[rows], ids[rows], bv, bid, k, reach[rows]))
    return found, work


def _own(k: int, bucket_rows: int, boxes):
    def run(table: pa.Table) -> pa.Table:
        ids, v = table.column("_id").to_numpy(), _matrix(table.column("_v"))
        groups, lows, highs = boxes.value
        parts = _halved(v, bucket_rows)
        block = np.zeros(len(ids), dtype=np.int32)
        found, work = [], np.full(len(ids), len(groups), dtype=np.int64)  # boxes of groups count as distances too
        for i, p in enumerate(parts):
            block[p] = i
            work[p] += len(p)
            found.append(_nearest(v[p], ids[p], v[p], ids[p], k))
        _, kth = _best(found, ids, k)
        more, steps = _search(v, ids, _widened(kth), parts, [(v[p], ids[p]) for p in parts], k, same=True)
        near, kth = _best(found + more, ids, k)
        reach = _widened(kth)

        # the other groups that may hold nearer points
        at, to = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        others = groups != table.column("_group")[0].as_py()
        for p in parts:
            for g in np.flatnonzero(others & (_gap(*_box(v[p]), lows, highs) <= reach[p].max())):
                rows = p[_gap(v[p], v[p], lows[g], highs[g]) <= reach[p]]
                at.append(rows)
                to.append(np.full(len(rows), groups[g], dtype=np.int32))
        at, to = np.concatenate(at), np.concatenate(to)
        sent = _lists(pa.array(to[np.argsort(at, kind="stable")], pa.int32()), np.bincount(at, minlength=len(ids)))
        own = [table.column("_id"), table.column("_v"), table.column("_group"), pa.array(block), pa.array(reach), sent]
        return pa.table([*own, near, pa.array(work + steps)], names=["_id", "_v", "_group", "_block", "_r", "_to", "_near", "_work"])

    return run


def _across(k: int, bucket_rows: int):
    def run(table: pa.Table) -> pa.Table:
        held = table.column("_block").is_valid().to_numpy()
        here, come = table.filter(pa.array(held)), table.filter(pa.array(~held))
        ids, v = come.column("_id").to_numpy(), _matrix(come.column("_v"))
        bid, bv, block = here.column("_id").to_numpy(), _matrix(here.column("_v")), here.column("_block").to_numpy()
        parts = _halved(v, bucket_rows)
        blocks = [block == b for b in np.unique(block)]
        found, work = _search(v, ids, come.column("_r").to_numpy(), parts, [(bv[b], bid[b]) for b in blocks], k, same=False)
        near, _ = _best(found, ids, k)
        return pa.table([come.column("_id"), near, pa.array(work)], names=["_id", "_near", "_work"])

    return run


def _points(x: DataFrame, k: int) -> DataFrame:
    """One row a vector: ``_id`` (the smallest), the vector, and the ``k + 1`` smallest ids.

    Rows with an infinite or NaN value are at no finite distance from any row and are left out.
    """
    finite = F.forall("_v", lambda e: (e < F.lit(float("inf"))) & (e > F.lit(float("-inf"))))
    w = Window.partitionBy("_h", "_v").orderBy("_id")
    low = x.where(finite).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1)
    p = low.groupBy("_h", "_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids"))
    return p.select(F.col("_ids")[0].alias("_id"), "_h", "_v", "_ids")


def _near_points(points: DataFrame, k: int, seed: int, bucket_rows: int, tile_blocks: int) -> tuple[DataFrame, DataFrame]:
    """``(_id, _d, b_id)``, the k nearest other points of each, and one row with the distances computed."""
    spark, n = points.sparkSession, points.count()
    per_tile = max(1, min(tile_blocks, -(-n // bucket_rows) // LEAST_TILES))
    group_rows = per_tile * bucket_rows
    n_groups = -(-n // group_rows)
    share = n_groups * SAMPLE_PER_GROUP / n
    lot = F.pmod(F.xxhash64(F.lit(seed), F.col("_id")), F.lit(1 << 30))
    sample = _matrix(points.where(lot < F.lit(share * (1 << 30))).select("_v").toArrow().column("_v"))
    tree = spark.sparkContext.broadcast(_tree(sample, n_groups))
    located = points.select("_id", "_v").mapInArrow(_locate(tree), "_id long, _v array<double>, _group int")
    located = write_table(located, "knn-located")

    at = [F.col("_v")[i] for i in range(sample.shape[1])]
    boxes = located.groupBy("_group").agg(F.array(*map(F.min, at)).alias("lo"), F.array(*map(F.max, at)).alias("hi"))
    boxes = boxes.toArrow()  # one row a group
    boxes = (boxes.column("_group").to_numpy(), _matrix(boxes.column("lo")), _matrix(boxes.column("hi")))
    boxes = spark.sparkContext.broadcast(boxes)
    own = write_table(located.groupBy("_group").applyInArrow(_own(k, bucket_rows, boxes), _OWN), "knn-own")

    # points meet the groups they are sent to, up to about ``group_rows`` of them a task
    sent = own.select("_id", "_v", "_r", F.explode("_to").alias("_group"))
    loads = sent.groupBy("_group").agg(F.ceil(F.count(F.lit(1)) / F.lit(group_rows)).cast("int").alias("_n"))
    loads = write_table(loads, "knn-loads")
    task = F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int").alias("_task")
    come = sent.join(loads, "_group").select("_group", task, "_id", "_v", F.lit(None).cast("int").alias("_block"), "_r")
    tasks = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_task")
    here = own.select("_group", "_id", "_v", "_block", "_r").join(loads, "_group").select("_group", tasks, "_id", "_v", "_block", "_r")
    met = here.unionByName(come).groupBy("_group", "_task").applyInArrow(_across(k, bucket_rows), f"_id long, {_NEAR}")
    both = own.select("_id", "_near", "_work").unionByName(write_table(met, "knn-across"))
    near = both.select("_id", F.explode("_near").alias("_c")).select("_id", "_c._d", "_c.b_id")
    w = Window.partitionBy("_id").orderBy("_d", "b_id")  # at most k candidates a group met
    near = near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
    return near, both.agg(F.coalesce(F.sum("_work"), F.lit(0)).alias("_work"))


def knn_with_stats(
    df: DataFrame, id_col: str, cols: Sequence[str], k: int = 5, seed: int = 42, bucket_rows: int = 1024, tile_blocks: int = TILE_BLOCKS
) -> tuple[DataFrame, DataFrame]:
    """:func:`exact_knn` and one row ``(rows, pairs, computed)``: all ordered pairs, and the distances computed."""
    # adding 0.0 makes -0.0 the same value as 0.0
    vec = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) + F.lit(0.0) for c in cols])
    x = df.select(F.col(id_col).cast("long").alias("_id"), vec.alias("_v")).withColumn("_h", F.xxhash64("_v"))
    x = write_table(x, "knn-vectors")
    m = x.count()
    spark = df.sparkSession
    points = write_table(_points(x, k), "knn-points")
    if points.isEmpty():
        none = spark.createDataFrame([], f"{id_col} long, nn_rank int, nn_{id_col} long, dist double")
        return none, spark.createDataFrame([(m, m * (m - 1), 0)], "rows long, pairs long, computed long")
    near, work = _near_points(points, k, seed, bucket_rows, tile_blocks)

    # the first k + 1 ids of a point's list, its own among them: a row takes the first k beside itself
    ids = points.select(F.col("_id").alias("b_id"), F.explode("_ids").alias("id"))
    listed = near.join(ids, "b_id").select("_id", "_d", "id")
    listed = listed.unionByName(ids.select(F.col("b_id").alias("_id"), F.lit(0.0).alias("_d"), "id"))
    lists = listed.groupBy("_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("_d", "id"))), 1, k + 1).alias("_l"))
    # merged: the planner takes an array for one element, so it would broadcast too many vectors
    rows = x.join(points.select("_h", "_v", F.col("_id").alias("_p")).hint("merge"), ["_h", "_v"]).select("_id", "_p")
    rows = rows.join(lists.withColumnRenamed("_id", "_p"), "_p")
    rest = F.slice(F.filter("_l", lambda c: c["id"] != F.col("_id")), 1, k)
    top = rows.select(F.col("_id").alias(id_col), F.posexplode(rest).alias("_n", "_c"))
    top = top.select(id_col, (F.col("_n") + 1).alias("nn_rank"), F.col("_c.id").alias(f"nn_{id_col}"), F.col("_c._d").alias("dist"))
    stats = work.select(
        F.lit(m).cast("long").alias("rows"), F.lit(m * (m - 1)).cast("long").alias("pairs"), F.col("_work").cast("long").alias("computed")
    )
    return top, stats


def exact_knn(
    df: DataFrame, id_col: str, cols: Sequence[str], k: int = 5, seed: int = 42, bucket_rows: int = 1024, tile_blocks: int = TILE_BLOCKS
) -> DataFrame:
    """``(id, nn_rank, nn_id, dist)`` for the k nearest other rows of each row.

    ``id_col`` must be unique and a whole number. Features are cast to double;
    NULL features are treated as 0.
    """
    return knn_with_stats(df, id_col, cols, k, seed, bucket_rows, tile_blocks)[0]


__all__ = ["exact_knn", "knn_with_stats"]
