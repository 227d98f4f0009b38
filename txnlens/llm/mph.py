"""A minimal perfect hash over distinct line hashes, with its fingerprint and count arrays (numpy).

A key is a 96-bit line hash: 64 bits that choose the slot and a 32-bit
fingerprint. The function is a cascade of bit arrays: on each level the keys
left over hash into twice as many cells, those alone in their cell claim it and
the others go on to the next level. The rank of a key's claimed cell among all
claimed cells is its slot, so ``n`` keys fill exactly the slots ``0 .. n - 1``
in about four bits a key, without storing the keys.
"""

from __future__ import annotations

import numpy as np

from txnlens.llm.words import mix

SPARE = 2  # cells a level gives each key that reaches it
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _cells(h: np.ndarray, fp: np.ndarray, level: int, size: int) -> np.ndarray:
    """Each key's cell on a level; both parts of the key count, so distinct keys part sooner or later."""
    seed = np.uint64(((level + 1) * int(_STEP)) & 0xFFFFFFFFFFFFFFFF)
    mixed = mix((h ^ seed) + (fp.astype(np.uint64) + np.uint64(1)) * _STEP)
    # the high 32 bits scaled to the size: a shard has far fewer than 2**32 keys
    return ((mixed >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def build_levels(h: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
    """Bit arrays (64-bit words) of the cascade over distinct keys ``(h, fp)``."""
    levels = []
    while len(h):
        words = -(-len(h) * SPARE // 64)
        cell = _cells(h, fp, len(levels), words * 64)
        alone = np.bincount(cell.astype(np.int64), minlength=words * 64) == 1
        levels.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = ~alone[cell.astype(np.int64)]
        h, fp = h[left], fp[left]
    return levels


class PerfectHash:
    """Slots of keys; a foreign key gets any slot, or -1 if no level claims it."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        words = np.concatenate(levels) if levels else np.zeros(0, dtype=np.uint64)
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    def slots(self, h: np.ndarray, fp: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, dtype=np.int64)
        left = np.arange(len(h))
        first = 0
        for k, level in enumerate(self.levels):
            if not len(left):
                break
            cell = _cells(h[left], fp[left], k, len(level) * 64)
            word = first + (cell >> np.uint64(6)).astype(np.int64)
            bit = cell & np.uint64(63)
            held = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.before[word] + np.bitwise_count(below).astype(np.int64)
            out[left[held]] = rank[held]
            left = left[~held]
            first += len(level)
        return out


class LineIndex:
    """One shard: the perfect hash, and by slot a fingerprint, a row count and, for repeated lines, the first id."""

    def __init__(self, levels: list[np.ndarray], fingerprints: np.ndarray, counts: np.ndarray, firsts: np.ndarray):
        self.levels, self.fingerprints, self.counts, self.firsts = levels, fingerprints, counts, firsts
        self.hash = PerfectHash(levels)
        # ids are kept for repeated lines only, in slot order
        self.place = np.cumsum(counts > 1) - 1

    @classmethod
    def build(cls, h: np.ndarray, fp: np.ndarray, count: np.ndarray, first: np.ndarray) -> LineIndex:
        """From distinct keys with their row counts and smallest ids."""
        levels = build_levels(h, fp)
        slot = PerfectHash(levels).slots(h, fp)
        n = len(h)
        fingerprints, counts, ids = np.zeros(n, np.uint32), np.zeros(n, np.int64), np.zeros(n, np.int64)
        fingerprints[slot], counts[slot], ids[slot] = fp, count, first
        return cls(levels, fingerprints, counts, ids[counts > 1])

    def probe(self, h: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row count of each key (0: not a line of the corpus), and the smallest id of the repeated ones."""
        slot = self.hash.slots(h, fp)
        known = slot >= 0
        known[known] = self.fingerprints[slot[known]] == fp[known]
        count = np.zeros(len(h), dtype=np.int64)
        count[known] = self.counts[slot[known]]
        first = np.zeros(len(h), dtype=np.int64)
        several = count > 1
        first[several] = self.firsts[self.place[slot[several]]]
        return count, first
