"""Word hashing for the operators that work on white-space words (numpy, inside tasks)."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

MEMO_WORDS = 200_000


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``lower`` changes A-Z only.

    ``bytes.split`` divides at exactly these six characters, ``bytes.lower``
    changes exactly these 26.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class WordHasher:
    """64-bit word hashes, memoised up to ``MEMO_WORDS`` words (more only within one text)."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        digest = xxhash.xxh3_64_intdigest
        for w in set(words).difference(memo):
            memo[w] = digest(w)
        return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


_HASHER = WordHasher()


def shared_hasher() -> WordHasher:
    """One memo per worker process, whatever the number of its tasks and groups."""
    return _HASHER


@cache
def _odd_constants(n: int, seed: int) -> np.ndarray:
    return np.array(
        [xxhash.xxh3_64_intdigest(f"{seed}:{k}".encode()) | 1 for k in range(n)], dtype=np.uint64
    )


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(word_hashes: np.ndarray, window: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of each window of consecutive words (a random linear form, then mixed)."""
    n = len(word_hashes) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k, c in enumerate(_odd_constants(window, seed + 17 * window)):
        out += word_hashes[k : k + n] * c
    return mix(out)
