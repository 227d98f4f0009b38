"""Nearest neighbours by inner product: a block matrix join on int8 tiles.

Queries and candidates are dealt into blocks by a hash; each (query block,
candidate block) pair is one tile and one task. In a tile the rows are
quantised to int8 with one scale each, and the int8 product gives every inner
product together with a proven error bound

    |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|.

A candidate survives if its upper bound reaches the k-th greatest lower bound
of its query; survivors are recomputed in double precision on the original
values (added in component order, so equal vectors score exactly alike). The
best k of every tile are merged by one bounded heap per query. Nothing is
dropped that could be among the best k: the result is exact.

Defined results
    null ids and vectors that are null, empty, zero, or hold null or non-finite
    components take no part. Vectors of different lengths never meet. Repeated
    rows are candidates each; a query id that occurs with several vectors uses
    the smallest. Ties go to the smaller id. Empty table: no rows. Only
    ``vec_id`` and the vector column are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 16384
CHUNK_CELLS = 2_000_000
CHUNK_PAIRS = 400_000
TOP_SCHEMA = "query_id long, vec_id long, score double"
RESULT_SCHEMA = "query_id long, rank int, vec_id long, score double"


def valid_vector(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


class Int8Rows:
    """Rows quantised to int8: codes (held as floats that are whole numbers), scales, norms, error norms."""

    def __init__(self, rows: np.ndarray):
        peak = np.abs(rows).max(axis=1)
        self.scale = peak / 127.0
        scaled = np.divide(rows, self.scale[:, None], out=np.zeros_like(rows), where=self.scale[:, None] > 0)
        codes = np.rint(scaled)
        # products of int8 codes stay whole in float32 up to 2**24: the matrix product is exact
        self.codes = codes.astype(np.float32 if rows.shape[1] * 127 * 127 < 1 << 24 else np.float64)
        back = codes * self.scale[:, None]
        self.error = np.linalg.norm(rows - back, axis=1)
        self.norm = np.linalg.norm(rows, axis=1)
        self.norm8 = np.linalg.norm(back, axis=1)


def _scores(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Inner products of the pairs, added in component order."""
    out = np.zeros(len(qi))
    for d in range(q.shape[1]):
        out += q[qi, d] * c[ci, d]
    return out


def tile_top(q_ids, q, c_ids, c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query_id, vec_id, score)`` of the k best candidates of each query in one tile."""
    q8, c8 = Int8Rows(q), Int8Rows(c)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, CHUNK_CELLS // len(c))
    for a in range(0, len(q), step):
        part = slice(a, a + step)
        near = (q8.codes[part] @ c8.codes.T).astype(np.float64)
        near *= q8.scale[part, None] * c8.scale[None, :]
        slack = q8.error[part, None] * c8.norm + q8.norm8[part, None] * c8.error
        slack += 1e-12 * (q8.norm[part, None] * c8.norm)
        own = q_ids[part, None] == c_ids[None, :]
        with np.errstate(invalid="ignore", over="ignore"):
            low, high = near - slack, near + slack
        # a bound beyond double precision proves nothing: such pairs are recomputed
        low = np.where(own | np.isnan(low), -np.inf, low)
        high = np.where(np.isnan(high), np.inf, high)
        if len(c) > k:
            limit = np.partition(low, len(c) - k, axis=1)[:, len(c) - k]
        else:
            limit = np.full(len(low), -np.inf)
        qi, ci = np.nonzero((high >= limit[:, None]) & ~own)
        for b in range(0, len(qi), CHUNK_PAIRS):
            x, y = qi[b : b + CHUNK_PAIRS] + a, ci[b : b + CHUNK_PAIRS]
            score = _scores(q, c, x, y)
            order = np.lexsort((c_ids[y], -score, x))
            x, y, score = x[order], y[order], score[order]
            place = np.arange(len(x)) - np.searchsorted(x, x, side="left")
            best = place < k
            found.append((q_ids[x[best]], c_ids[y[best]], score[best]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def tiles(queries: DataFrame, candidates: DataFrame, n_queries: int, n_candidates: int, k: int) -> DataFrame:
    """The best k of every tile."""
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    blocks = max(1, -(-n_candidates // CANDIDATE_BLOCK))
    number = F.monotonically_increasing_id()
    q = queries.select(
        "vec_id",
        "vec",
        F.size("vec").alias("dim"),
        F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1))).alias("cb"),
    )
    c = candidates.select(
        "vec_id",
        "vec",
        F.size("vec").alias("dim"),
        # the row's number spreads repeated ids as well
        F.pmod(F.xxhash64("vec_id", number), F.lit(blocks)).alias("cb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1))).alias("qb"),
    )

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        stack = lambda rows: np.stack(rows["vec"].to_list()).astype(np.float64)
        found = tile_top(left["vec_id"].to_numpy(), stack(left), right["vec_id"].to_numpy(), stack(right), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    keys = ["qb", "cb", "dim"]
    return q.groupBy(keys).cogroup(c.groupBy(keys)).applyInPandas(tile, TOP_SCHEMA)


def merge(tops: DataFrame, k: int) -> DataFrame:
    """One heap of k entries per query over the stream of tile results."""

    def heaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for query, vec, score in zip(batch["query_id"], batch["vec_id"], batch["score"], strict=True):
                heap = best.setdefault(query, [])
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                else:
                    heapq.heappushpop(heap, (score, -vec))
        rows = [
            (query, rank, -vec, score)
            for query, heap in best.items()
            for rank, (score, vec) in enumerate(sorted(heap, reverse=True), 1)
        ]
        yield pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])

    return tops.repartition("query_id").mapInPandas(heaps, RESULT_SCHEMA)


def nearest(embeddings: DataFrame, is_query: Column, k: int, vector: str = "embedding") -> DataFrame:
    """The k nearest other rows of every row that ``is_query`` selects."""
    rows = embeddings.select("vec_id", F.col(vector).alias("vec")).where(
        F.col("vec_id").isNotNull() & valid_vector(F.col("vec"))
    )
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    n = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    return merge(tiles(queries, rows, n[1], n[0], k), k)
