"""Line dedup: documents probe a sharded minimal perfect hash instead of joining lines.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at its ends
and with A-Z lower-cased. Keys of ``LEAST_CHARS`` code points or more that
several documents hold lose their lines in all of them but the one with the
smallest id.

1. The documents are dealt evenly, row by row, into blocks of about
   ``BLOCK_BYTES`` and written once, bucketed by block: no later pass shuffles
   text. A block hashes its lines (96 bits) and sends each shard of the hash
   space one message: its distinct keys with their row count and smallest id.
   A line that a third of all documents hold is one entry per block.
2. A shard merges its messages and builds its part of the index
   (:mod:`txnlens.llm.mph`): a minimal perfect hash over the distinct keys that
   addresses an array of 32-bit fingerprints, an array of counts and, for
   repeated lines only, an array of first ids. The index is a stored table of
   one row per shard, and :func:`drop_known_lines` answers any documents from it.
3. The blocks' messages probe the arrays and get one bit a key back: does a
   document with a smaller id than any of the block hold the line? That and
   the block's own smallest id decide every line.

Keys are distinct by 96 bits (some 1e-5 expected collisions among 1e12 lines),
and each shard holds all its own keys, so the fingerprint cannot mistake one
line of the corpus for another; among foreign lines it lets 2**-32 through.

Defined results
    null or empty text: one empty line, kept. Keys that are too short stay.
    Rows with equal ids are one document: their lines never remove each other.
    A row with a null id neither removes nor loses lines. Counts are rows that
    hold a line. Equal lines of the keeping document all stay. Empty table: no
    rows. Only ``doc_id`` and ``text`` are read; other columns may have any name.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import stored
from txnlens.llm.mph import LineIndex
from txnlens.session import checkpoint_subdir

LEAST_CHARS = 10
BLOCK_BYTES = 16_000_000
SHARD_LINES = 1 << 20
MAX_BUCKETS = 50_000
MESSAGE_SCHEMA = "shard long, block long, n long, payload binary"
_MESSAGE = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])
INDEX_SCHEMA = "shard long, n long, sizes array<long>, bits binary, fingerprints binary, counts binary, firsts binary"
_INDEX = pa.schema(
    [("shard", pa.int64()), ("n", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()),
     ("fingerprints", pa.binary()), ("counts", pa.binary()), ("firsts", pa.binary())]
)
RESULT_SCHEMA = "doc_id long, n_lines long, n_dropped long, text string"
_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())]
)


def line_key(line: bytes) -> bytes:
    """``bytes.strip`` takes exactly the six characters, ``bytes.lower`` changes exactly A-Z."""
    return line.strip().lower()


def long_enough(key: bytes, least: int) -> bool:
    if len(key) < least:
        return False
    # four bytes a code point at most
    return len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least


class BlockLines:
    """The lines of one block and its distinct keys, in the order of their hashes."""

    def __init__(self, table: pa.Table, least: int):
        self.ids = table.column("doc_id").to_pylist()
        self.lines = [(t or "").encode("utf-8", "surrogatepass").split(b"\n") for t in table.column("text").to_pylist()]
        digest = xxhash.xxh3_128_digest
        hashes, rows, places = [], [], []
        at = 0
        for row, lines in enumerate(self.lines):
            if self.ids[row] is not None:
                for place, line in enumerate(lines, at):
                    key = line_key(line)
                    if long_enough(key, least):
                        hashes.append(digest(key))
                        rows.append(row)
                        places.append(place)
            at += len(lines)
        self.n_lines = at
        self.places = np.array(places, dtype=np.int64)  # of the lines that have a key
        pairs = np.frombuffer(b"".join(hashes), dtype=">u8").reshape(-1, 2)
        h, fp = pairs[:, 0].astype(np.uint64), (pairs[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        row_of = np.array(rows, dtype=np.int64)
        self.id_of = np.array([0 if i is None else i for i in self.ids], dtype=np.int64)[row_of]
        order = np.lexsort((row_of, fp, h))
        a, b, r = h[order], fp[order], row_of[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        other_row = new.copy()
        other_row[1:] |= r[1:] != r[:-1]
        starts = np.flatnonzero(new)
        self.h, self.fp = a[starts], b[starts]
        self.entry = np.empty(len(order), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(self.id_of[order], starts) if len(starts) else self.id_of
        self.count = np.add.reduceat(other_row.astype(np.int64), starts) if len(starts) else self.least

    def shards(self, bits: int) -> list[tuple[int, slice]]:
        """The shards that the block has keys of, with their slices."""
        high = (self.h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.h), dtype=np.int64)
        starts = np.flatnonzero(np.diff(high, prepend=-1)).tolist()
        return [(int(high[a]), slice(a, b)) for a, b in zip(starts, starts[1:] + [len(high)])]  # noqa: B905


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers as their least value and differences of as few bytes as hold them."""
    least = int(values.min()) if len(values) else 0
    over = (values - np.int64(least)).view(np.uint64)
    width = max(1, (int(over.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = over.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return np.int64(least).tobytes() + bytes([width]) + np.ascontiguousarray(planes).tobytes()


def _widen(data: memoryview, n: int) -> tuple[np.ndarray, int]:
    """The numbers of :func:`_narrow`, and the bytes they took."""
    width = data[8]
    full = np.zeros((n, 8), dtype=np.uint8)
    full[:, :width] = np.frombuffer(data[9 : 9 + n * width], dtype=np.uint8).reshape(n, width)
    least = np.frombuffer(data[:8], dtype=np.int64)[0]
    return full.view("<u8").reshape(-1).view(np.int64) + least, 9 + n * width


def pack_message(h: np.ndarray, fp: np.ndarray, count: np.ndarray, least: np.ndarray) -> bytes:
    return h.tobytes() + fp.tobytes() + _narrow(count) + _narrow(least)


def unpack_message(payload: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = memoryview(payload)
    h, fp = np.frombuffer(data[: 8 * n], dtype=np.uint64), np.frombuffer(data[8 * n : 12 * n], dtype=np.uint32)
    count, used = _widen(data[12 * n :], n)
    least, _ = _widen(data[12 * n + used :], n)
    return h, fp, count, least


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def deal(documents: DataFrame, n_blocks: int) -> DataFrame:
    """``(doc_id, text, block)`` written once to the shared folder, bucketed by block.

    Rows are dealt by a hash of their place in the scan, so repeated ids or
    texts spread like any others. The catalog's entry is only needed to plan
    the bucketed read and goes at once; the files stay.
    """
    spark = documents.sparkSession
    number = F.xxhash64(F.monotonically_increasing_id())
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.withColumn("block", F.pmod(number, F.lit(n_blocks)))
    buckets = min(n_blocks, MAX_BUCKETS)
    name = f"lines_{uuid.uuid4().hex[:12]}"
    writer = dealt.repartition(buckets, "block").write.format("parquet").bucketBy(buckets, "block")
    writer.option("compression", "zstd").option("path", checkpoint_subdir(spark, f"tables/{name}")).saveAsTable(name)
    read = spark.table(name)
    read.schema  # noqa: B018 - resolved before the entry goes
    spark.sql(f"DROP TABLE {name}")
    return read


def messages(blocks: DataFrame, bits: int, least: int = LEAST_CHARS) -> DataFrame:
    """Each block's distinct keys, one message a shard."""

    def send(key: tuple, table: pa.Table) -> pa.Table:
        own = BlockLines(table, least)
        rows = [
            (shard, key[0].as_py(), p.stop - p.start, pack_message(own.h[p], own.fp[p], own.count[p], own.least[p]))
            for shard, p in own.shards(bits)
        ]
        return _table(rows, _MESSAGE)

    return blocks.groupBy("block").applyInArrow(send, MESSAGE_SCHEMA)


def build_index(sent: DataFrame) -> DataFrame:
    """The index, one row a shard, from all blocks' messages."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpack_message(p, n) for n, p in zip(*(table.column(c).to_pylist() for c in ("n", "payload")), strict=True)]
        h, fp, count, first = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((fp, h))
        h, fp = h[order], fp[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])
        starts = np.flatnonzero(new)
        count, first = np.add.reduceat(count[order], starts), np.minimum.reduceat(first[order], starts)
        made = LineIndex.build(h[starts], fp[starts], count, first)
        row = (
            key[0].as_py(), len(starts), [len(x) for x in made.levels], np.concatenate(made.levels).tobytes(),
            made.fingerprints.tobytes(), _narrow(made.counts), made.firsts.tobytes(),
        )
        return _table([row], _INDEX)

    return sent.groupBy("shard").applyInArrow(build, INDEX_SCHEMA)


def load_index(row: dict) -> LineIndex:
    bits = np.frombuffer(row["bits"], dtype=np.uint64)
    levels = np.split(bits, np.cumsum(row["sizes"])[:-1])
    counts, _ = _widen(memoryview(row["counts"]), row["n"])
    return LineIndex(
        levels, np.frombuffer(row["fingerprints"], np.uint32), counts, np.frombuffer(row["firsts"], np.int64)
    )


def probe_index(sent: DataFrame, index: DataFrame, foreign: bool = False) -> DataFrame:
    """One bit for every key of a message: is it to go from all documents of the block?

    Of the corpus's own documents a line goes where an earlier document holds
    it; of foreign documents every line that the corpus holds goes.
    """

    def answer(key: tuple, asked: pa.Table, shards: pa.Table) -> pa.Table:
        made = load_index(shards.to_pylist()[0]) if shards.num_rows else None
        rows = []
        for piece in asked.to_pylist():
            h, fp, _, least = unpack_message(piece["payload"], piece["n"])
            if made is None:
                gone = np.zeros(len(h), dtype=bool)
            else:
                count, first = made.probe(h, fp)
                gone = count > 0 if foreign else (count > 1) & (first < least)
            rows.append((piece["shard"], piece["block"], piece["n"], np.packbits(gone).tobytes()))
        return _table(rows, _MESSAGE)

    return sent.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(answer, MESSAGE_SCHEMA)


def keep_lines(blocks: DataFrame, answers: DataFrame, least: int = LEAST_CHARS, foreign: bool = False) -> DataFrame:
    """The documents without the lines that the answers and the block's own first holders rule out."""

    def keep(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _RESULT.empty_table()
        own = BlockLines(table, least)
        pieces = sorted(got.to_pylist(), key=lambda a: a["shard"])
        bits = [np.unpackbits(np.frombuffer(a["payload"], dtype=np.uint8), count=a["n"]) for a in pieces]
        elsewhere = np.concatenate(bits).astype(bool) if bits else np.zeros(0, dtype=bool)
        gone = np.zeros(own.n_lines, dtype=bool)
        drop = elsewhere[own.entry]
        if not foreign:
            drop |= own.id_of > own.least[own.entry]
        gone[own.places[drop]] = True
        ends = np.cumsum([len(x) for x in own.lines])
        dropped, texts = [], []
        for lines, end in zip(own.lines, ends.tolist(), strict=True):
            flags = gone[end - len(lines) : end]
            n = int(flags.sum())
            dropped.append(n)
            if n:
                lines = [x for x, f in zip(lines, flags.tolist(), strict=True) if not f]
            texts.append(b"\n".join(lines).decode("utf-8", "surrogatepass"))
        columns = [own.ids, [len(x) for x in own.lines], dropped, texts]
        return pa.Table.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, _RESULT, strict=True)], schema=_RESULT
        )

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(keep, RESULT_SCHEMA)


def _sizes(documents: DataFrame) -> tuple[int, int]:
    """Text bytes and lines of all documents."""
    lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"))) + 1
    row = documents.agg(F.sum(F.octet_length("text").cast("long")), F.sum(lines.cast("long"))).first()
    return row[0] or 0, row[1] or 0


def shard_bits(n_lines: int) -> int:
    return max(0, (-(-n_lines // SHARD_LINES) - 1).bit_length())


def drop_repeated_lines(documents: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text)``: every document without lines that an earlier one holds."""
    size, n_lines = _sizes(documents)
    blocks = deal(documents, max(1, -(-size // BLOCK_BYTES)))
    sent = stored(messages(blocks, shard_bits(n_lines), least), "line_messages")
    index = stored(build_index(sent), "line_index")
    return keep_lines(blocks, stored(probe_index(sent, index), "line_answers"), least)


def line_index(documents: DataFrame, bits: int, least: int = LEAST_CHARS) -> DataFrame:
    """The stored index of a corpus in ``2**bits`` shards, for :func:`drop_known_lines`."""
    size, _ = _sizes(documents)
    blocks = deal(documents, max(1, -(-size // BLOCK_BYTES)))
    return stored(build_index(messages(blocks, bits, least)), "line_index")


def drop_known_lines(documents: DataFrame, index: DataFrame, bits: int, least: int = LEAST_CHARS) -> DataFrame:
    """New documents without the lines that an indexed corpus holds (among themselves they keep theirs)."""
    size, _ = _sizes(documents)
    blocks = deal(documents, max(1, -(-size // BLOCK_BYTES)))
    answers = probe_index(messages(blocks, bits, least), index, foreign=True)
    return keep_lines(blocks, answers, least, foreign=True)
