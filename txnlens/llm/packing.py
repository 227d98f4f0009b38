"""Best-two-fit packing of tokenised documents into fixed-length sequences.

1. Tokenise in the scan. Only (doc, piece, start, length, checksum) leaves the
   tokeniser.
2. Deal the pieces into packing blocks by a hash, so that each block has the
   length distribution of the whole and at most about ``BLOCK_PIECES`` pieces.
3. In every block, pack with lengths as classes: fill each bin greedily with
   the longest piece that fits, then try to replace its smallest piece by two
   unpacked pieces that fill the widened gap more tightly. A block leaves at
   most one badly filled bin, so the loss is one bin per ``BLOCK_PIECES``.

Defined results
    null text: empty, that is one piece of the end token alone. Repeated rows
    are packed each; a null ``doc_id`` stays null. Very long texts are cut into
    pieces of ``capacity`` tokens, the first piece taking the remainder. Empty
    table: no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import bisect
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import small_batches, stored

CAPACITY = 2048
END_ID = 0
BLOCK_PIECES = 60_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: fixed value: the pre-token pattern of the ``ByteLevel`` pre-tokeniser
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's characters stand for.

    Printable bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes with their ids, if these ids order the merges of a plain byte-level BPE; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type", "BPE") == "BPE"
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and before.get("use_regex", True)
        and not spec.get("normalizer")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    )
    if not plain:
        return None
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab["".join(m)] for m in pairs]
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in t): k for t, k in vocab.items() if all(c in byte_of for c in t)}
    ordered = all(a < b for a, b in zip(made, made[1:], strict=False)) and min(made, default=256) >= 256
    if not ordered or any(bytes([b]) not in ranks for b in range(256)):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {t: k for t, k in ranks.items() if t.decode("utf-8", "replace") not in special}


class TextTokenizer:
    """Token ids of whole texts.

    A plain byte-level BPE whose ids follow its merges is applied by ``tiktoken``
    with ranks read from the same file, which gives the same ids several times
    faster (the tests hold both against each other). Other vocabularies, and
    texts with the string of a special token, go through ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = merge_ranks(path)
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding(path, pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        if self.fast is None or any(s in text for s in self.special):
            return self.whole(text)
        return array("I", self.fast.encode_ordinary(text)).tobytes()


_CODERS: dict[str, TextTokenizer] = {}


def coder_for(path: str) -> TextTokenizer:
    """One tokeniser per worker process, whatever the number of its tasks."""
    if path not in _CODERS:
        _CODERS[path] = TextTokenizer(path)
    return _CODERS[path]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """``(start, length, crc32)`` of the pieces of one document, end token included."""
    ids += END_ID.to_bytes(4, "little")
    n = len(ids) // 4
    first = n % capacity or capacity
    bounds = [0, *range(first, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(bounds, bounds[1:], strict=False)]


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document."""

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = coder_for(tokenizer_path)
        for batch in batches:
            rows = [
                (doc, k, *p)
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True)
                for k, p in enumerate(cut(coder.encode(text or ""), capacity))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype(
                {"doc_id": "Int64"}
            )

    return documents.select("doc_id", "text").mapInPandas(tokenise, PIECE_SCHEMA)


class _Lengths:
    """The unpacked pieces of a block by length: counts, and the lengths still present in order."""

    def __init__(self, lengths: list[int]):
        self.count: dict[int, int] = {}
        for n in lengths:
            self.count[n] = self.count.get(n, 0) + 1
        self.order = sorted(self.count)

    def longest(self, limit: int) -> int:
        """The greatest length present up to ``limit``; 0 if there is none."""
        k = bisect.bisect_right(self.order, limit)
        return self.order[k - 1] if k else 0

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.order.pop(bisect.bisect_left(self.order, n))

    def put(self, n: int) -> None:
        if not self.count.get(n):
            bisect.insort(self.order, n)
            self.count[n] = 0
        self.count[n] += 1

    def best_pair(self, gap: int) -> tuple[int, int]:
        """Two pieces whose sum is greatest without passing ``gap``; (0, 0) if there are none."""
        best, found = 0, (0, 0)
        order = self.order
        low, high = 0, bisect.bisect_right(order, gap) - 1
        while low <= high:
            a, b = order[low], order[high]
            if a + b > gap or (low == high and self.count[a] < 2):
                high -= 1
                continue
            if a + b > best:
                best, found = a + b, (b, a)
                if best == gap:
                    break
            low += 1
        return found


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of lengths) for all lengths, each of at most ``capacity``."""
    left = _Lengths(lengths)
    bins = []
    while left.order:
        room, bin_ = capacity, []
        while n := left.longest(room):
            left.take(n)
            bin_.append(n)
            room -= n
        if room and len(bin_) > 1:
            least = bin_[-1]  # greedy filling takes lengths in falling order
            pair = left.best_pair(room + least)
            if sum(pair) > least:
                bin_.pop()
                for n in pair:
                    left.take(n)
                    bin_.append(n)
                left.put(least)
        bins.append(bin_)
    return bins


def pack(piece_rows: DataFrame, n_pieces: int, capacity: int = CAPACITY) -> DataFrame:
    """The piece rows with ``sequence_id`` and ``offset``."""
    blocks = max(1, -(-n_pieces // BLOCK_PIECES))
    # repeated rows differ by their number, so that they too are spread evenly
    dealt = piece_rows.withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(blocks))
    )

    def pack_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        bins = best_two_fit(lengths, capacity)
        # the k-th piece of a length goes to the k-th place that the packing gave to this length
        places: dict[int, list[tuple[int, int]]] = {}
        for number, bin_ in enumerate(bins):
            at = 0
            for n in bin_:
                places.setdefault(n, []).append((number, at))
                at += n
        handed = {n: iter(p) for n, p in places.items()}
        given = [next(handed[n]) for n in lengths]
        rows["sequence_id"] = [(int(key[0]) << 32) + g[0] for g in given]
        rows["offset"] = [g[1] for g in given]
        return rows.drop(columns="block")

    schema = PIECE_SCHEMA + ", sequence_id long, offset long"
    return dealt.groupBy("block").applyInPandas(pack_block, schema)


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its place.

    The piece rows (no text) are written once to the shared folder: a lost
    executor then never tokenises again, and their number is known for dealing.
    """
    small_batches(documents.sparkSession)
    rows = stored(pieces(documents, tokenizer_path, capacity), "pieces")
    return pack(rows, rows.count(), capacity)
