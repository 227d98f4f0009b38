"""Substring dedup: a count-min prefilter in front of an exact grouping of word windows.

A word is removed when a window of ``WINDOW`` words that covers it also starts
in a document with a smaller id.

The documents are dealt into blocks of about ``BLOCK_BYTES`` and written once,
bucketed by block, so that no later pass shuffles text again.

Pass 1, prefilter. Every block sketches its windows: ``DEPTH`` rows of cells,
each cell holding 1 or 2 (two documents or more). The cell space is cut into
shards; the sketch of a block travels as one compressed list of cells per row
and shard, about 1.5 bytes a cell. A shard adds up the blocks' sketches, which
is the merged count-min sketch, and answers each block with one bit per cell.
So the sketch grows with the corpus (``CELLS_PER_WINDOW``) without being
broadcast or held whole anywhere.

Pass 2, exact. A window whose cells all reached 2 is estimated repeated; none
that really repeats is lost, since counts are only ever overestimated. Each
block sends the distinct 128-bit hashes of its estimated windows with its
smallest document id; the hash's shard groups them exactly and answers the
smallest id of the corpus. A very frequent window is one entry per block, so no
key is hot.

With its hashes the block stores where its estimated windows start. Pass 3 reads
these places back, splits the words again and marks the covered ones; it hashes
nothing.

Windows are told apart by two 64-bit hashes, both linear forms of 64-bit word
hashes.

Defined results
    null or empty text: no words, nothing removed. Documents shorter than a
    window lose nothing. Rows with equal ids do not remove each other's words;
    a null id is neither smaller nor greater than another. Empty table: no
    rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import small_batches, stored
from txnlens.llm.words import mix, shared_hasher, split_words, window_hashes
from txnlens.session import checkpoint_subdir

WINDOW = 13
DEPTH = 2
CELLS_PER_WINDOW = 8
BLOCK_BYTES = 8_000_000
SHARD_BITS = 25  # cells of a sketch shard, one byte each while it is merged
EXACT_SHARD_WINDOWS = 1 << 22
MAX_BUCKETS = 50_000
_SEEDS = [0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]
PIECE_SCHEMA = "kind int, shard long, block long, n long, payload binary"
_PIECE = pa.schema(
    [("kind", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())]
)
EXACT, PLACES = -1, -2  # the kinds of pass 2; kinds 0 .. DEPTH - 1 are the sketch's rows
RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, text string"
_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())]
)


def squeeze(values: np.ndarray) -> bytes:
    """Compressed whole numbers: byte planes, since the high bytes are mostly equal."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zlib.compress(planes.tobytes(), 1)


def expand(payload: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(payload), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=np.uint64(0))


class BlockWindows:
    """All windows of one block: hashes, and the row each starts in."""

    def __init__(self, table: pa.Table, window: int):
        self.ids = table.column("doc_id").to_pylist()
        self.words = [split_words(t) for t in table.column("text").to_pylist()]
        self.window = window
        hasher = shared_hasher()
        first, second, rows = [], [], []
        for row, words in enumerate(self.words):
            if len(words) >= window and self.ids[row] is not None:
                coded = hasher(words)
                first.append(window_hashes(coded, window))
                second.append(window_hashes(coded, window, seed=1))
                rows.append(np.full(len(first[-1]), row, dtype=np.int32))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        self.h1, self.h2, self.row = join(first, np.uint64), join(second, np.uint64), join(rows, np.int32)
        self.distinct, self.place = np.unique(self.h1, return_inverse=True)

    def several(self) -> np.ndarray:
        """For each distinct window: does it start in two rows or more?"""
        low = np.full(len(self.distinct), np.iinfo(np.int32).max, dtype=np.int32)
        high = np.full(len(self.distinct), -1, dtype=np.int32)
        np.minimum.at(low, self.place, self.row)
        np.maximum.at(high, self.place, self.row)
        return low != high

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct cells of one sketch row, in order, and each distinct window's place among them."""
        cell = mix(self.distinct ^ np.uint64(_SEEDS[row])) >> np.uint64(64 - bits)
        return np.unique(cell, return_inverse=True)

    def estimated(self, answers: list[dict], bits: int) -> np.ndarray:
        """The places of the windows whose cells all reached 2."""
        repeated = np.ones(len(self.distinct), dtype=bool)
        for row in range(DEPTH):
            cells, place = self.cells(row, bits)
            own = sorted((a for a in answers if a["kind"] == row), key=lambda a: a["shard"])
            bit = [np.unpackbits(np.frombuffer(a["payload"], dtype=np.uint8), count=a["n"]) for a in own]
            flags = np.concatenate(bit).astype(bool) if bit else np.zeros(len(cells), dtype=bool)
            repeated &= flags[place]
        return np.flatnonzero(repeated[self.place])

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct 128-bit windows at ``at``: both hashes, the smallest id here, and each position's entry."""
        order = at[np.lexsort((self.h2[at], self.h1[at]))]
        a, b = self.h1[order], self.h2[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        ids = np.array([0 if i is None else i for i in self.ids], dtype=np.int64)[self.row[order]]
        starts = np.flatnonzero(new)
        least = np.minimum.reduceat(ids, starts) if len(starts) else ids
        entry = np.zeros(len(self.h1), dtype=np.int64)
        entry[order] = np.cumsum(new) - 1
        return a[starts], b[starts], least, entry


def _pieces(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _PIECE]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _PIECE, strict=True)], schema=_PIECE)


def _cut(sorted_values: np.ndarray, shift: int) -> Iterator[tuple[int, slice]]:
    """The runs of sorted values by their high part."""
    high = sorted_values >> np.uint64(shift) if shift < 64 else np.zeros_like(sorted_values)
    starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]).tolist() if len(high) else []
    for a, b in pairwise([*starts, len(high)]):
        yield int(high[a]), slice(a, b)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64).view(np.uint64)


def sketch_blocks(blocks: DataFrame, window: int, bits: int) -> DataFrame:
    """Pass 1, from the blocks: each block's cells by sketch row and shard."""

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        own = BlockWindows(table, window)
        weight = 1 + own.several()
        rows = []
        for row in range(DEPTH):
            cells, place = own.cells(row, bits)
            twice = np.bincount(place, weights=weight, minlength=len(cells)) > 1
            for shard, part in _cut(cells, SHARD_BITS):
                packed = zlib.compress(np.packbits(twice[part]).tobytes(), 1)
                coded = squeeze(deltas(cells[part]))
                payload = len(packed).to_bytes(8, "little") + packed + coded
                rows.append((row, shard, key[0].as_py(), part.stop - part.start, payload))
        return _pieces(rows)

    return blocks.groupBy("block").applyInArrow(sketch, PIECE_SCHEMA)


def merge_sketches(pieces: DataFrame) -> DataFrame:
    """Pass 1, from the shards: one bit for every cell that a block sent."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        base = np.uint64(key[1].as_py()) << np.uint64(SHARD_BITS)
        count = np.zeros(1 << SHARD_BITS, dtype=np.uint8)
        sent = []
        for piece in table.select(["block", "n", "payload"]).to_pylist():
            payload = piece["payload"]
            size = int.from_bytes(payload[:8], "little")
            twice = np.unpackbits(
                np.frombuffer(zlib.decompress(payload[8 : 8 + size]), dtype=np.uint8), count=piece["n"]
            )
            cells = (np.cumsum(expand(payload[8 + size :]), dtype=np.uint64) - base).astype(np.uint32)
            count[cells] = np.minimum(count[cells] + 1 + twice, 2)
            sent.append((piece["block"], cells))
        rows = [
            (key[0].as_py(), key[1].as_py(), block, len(cells), np.packbits(count[cells] > 1).tobytes())
            for block, cells in sent
        ]
        return _pieces(rows)

    return pieces.groupBy("kind", "shard").applyInArrow(merge, PIECE_SCHEMA)


def exact_blocks(blocks: DataFrame, answers: DataFrame, window: int, bits: int, exact_bits: int) -> DataFrame:
    """Pass 2, from the blocks: the distinct windows estimated repeated, by shard of their hash."""

    def send(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _pieces([])
        own = BlockWindows(table, window)
        at = own.estimated(got.to_pylist(), bits)
        h1, h2, least, entry = own.entries(at)
        where = squeeze(deltas(at.astype(np.uint64)))
        places = len(where).to_bytes(8, "little") + where + entry[at].astype(np.uint32).tobytes()
        rows = [(PLACES, 0, key[0].as_py(), len(at), places)]
        for shard, part in _cut(h1, 64 - exact_bits):
            first = squeeze(deltas(h1[part]))
            ids = squeeze(_signed(least[part]))
            payload = len(first).to_bytes(8, "little") + len(ids).to_bytes(8, "little") + first + ids + h2[part].tobytes()
            rows.append((EXACT, shard, key[0].as_py(), part.stop - part.start, payload))
        return _pieces(rows)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send, PIECE_SCHEMA)


def merge_exact(pieces: DataFrame) -> DataFrame:
    """Pass 2, from the shards: the smallest document id of every window that a block sent."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        blocks, sizes, h1, h2, ids = [], [], [], [], []
        for piece in table.select(["block", "n", "payload"]).to_pylist():
            payload = piece["payload"]
            a, b = int.from_bytes(payload[:8], "little"), int.from_bytes(payload[8:16], "little")
            blocks.append(piece["block"])
            sizes.append(piece["n"])
            h1.append(np.cumsum(expand(payload[16 : 16 + a]), dtype=np.uint64))
            ids.append(expand(payload[16 + a : 16 + a + b]).view(np.int64))
            h2.append(np.frombuffer(payload[16 + a + b :], dtype=np.uint64))
        x, y, z = np.concatenate(h1), np.concatenate(h2), np.concatenate(ids)
        order = np.lexsort((y, x))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
        least = np.minimum.reduceat(z[order], np.flatnonzero(new))
        answer = np.empty(len(order), dtype=np.int64)
        answer[order] = least[np.cumsum(new) - 1]
        ends = np.cumsum(sizes)
        rows = [
            (EXACT, key[0].as_py(), block, n, squeeze(_signed(answer[e - n : e])))
            for block, n, e in zip(blocks, sizes, ends.tolist(), strict=True)
        ]
        return _pieces(rows)

    return pieces.groupBy("shard").applyInArrow(merge, PIECE_SCHEMA)


def mark(blocks: DataFrame, answers: DataFrame, window: int) -> DataFrame:
    """Pass 3: the words that are left in every document, from the places and least ids of the block's windows."""

    def keep(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _RESULT.empty_table()
        all_ids = table.column("doc_id").to_pylist()
        split = [split_words(t) for t in table.column("text").to_pylist()]
        answers = got.to_pylist()
        at, entry = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        for a in answers:
            if a["kind"] == PLACES and a["n"]:
                size = int.from_bytes(a["payload"][:8], "little")
                at = np.cumsum(expand(a["payload"][8 : 8 + size]), dtype=np.uint64).astype(np.int64)
                entry = np.frombuffer(a["payload"][8 + size :], dtype=np.uint32)
        exact = sorted((a for a in answers if a["kind"] == EXACT), key=lambda a: a["shard"])
        least = np.concatenate([expand(a["payload"]).view(np.int64) for a in exact]) if exact else np.zeros(0, np.int64)
        ids = np.array([0 if i is None else i for i in all_ids], dtype=np.int64)
        windows = [0 if i is None else max(0, len(w) - window + 1) for i, w in zip(all_ids, split, strict=True)]
        begins = np.concatenate([[0], np.cumsum(windows, dtype=np.int64)])  # the first window of each row
        row_of = np.searchsorted(begins, at, side="right") - 1
        bad = at[least[entry] < ids[row_of]] if len(at) else at
        by_row = np.searchsorted(bad, begins)
        removed, texts = [], []
        for row, words in enumerate(split):
            starts = bad[by_row[row] : by_row[row + 1]] - begins[row]
            if len(starts):
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + window, -1)
                stay = np.cumsum(change[:-1]) == 0
                removed.append(int(len(words) - stay.sum()))
                words = [words[k] for k in np.flatnonzero(stay).tolist()]
            else:
                removed.append(0)
            texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        columns = [all_ids, [len(w) for w in split], removed, texts]
        return pa.Table.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, _RESULT, strict=True)], schema=_RESULT
        )

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(keep, RESULT_SCHEMA)


def deal(documents: DataFrame, n_blocks: int) -> DataFrame:
    """``(doc_id, text, block)`` written once to the shared folder, bucketed by block.

    Rows are dealt by a hash of their place in the scan, so repeated ids or
    texts spread like any others. The catalog's entry is only needed to plan
    the bucketed read and goes at once; the files stay.
    """
    spark = documents.sparkSession
    number = F.xxhash64(F.monotonically_increasing_id())
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.withColumn("block", F.pmod(number, F.lit(n_blocks)))
    buckets = min(n_blocks, MAX_BUCKETS)
    name = f"substring_{uuid.uuid4().hex[:12]}"
    writer = dealt.repartition(buckets, "block").write.format("parquet").bucketBy(buckets, "block")
    writer.option("compression", "zstd").option("path", checkpoint_subdir(spark, f"tables/{name}")).saveAsTable(name)
    read = spark.table(name)
    read.schema  # noqa: B018 - resolved before the entry goes
    spark.sql(f"DROP TABLE {name}")
    return read


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, text)``: the words left, joined by one space."""
    spark = documents.sparkSession
    small_batches(spark)
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = deal(documents, max(1, -(-total // BLOCK_BYTES)))
    # a word and its separator take two bytes at least, but six in most text; an
    # underestimate only makes the sketch denser
    windows = max(1024, total // 6)
    bits = max(SHARD_BITS - 5, (windows * CELLS_PER_WINDOW - 1).bit_length())
    exact_bits = max(0, (windows // EXACT_SHARD_WINDOWS).bit_length())
    answers = stored(merge_sketches(sketch_blocks(blocks, window, bits)), "cells")
    sent = stored(exact_blocks(blocks, answers, window, bits, exact_bits), "estimated")
    found = stored(merge_exact(sent.where(F.col("kind") == EXACT)), "windows")
    return mark(blocks, sent.where(F.col("kind") == PLACES).unionByName(found), window)
