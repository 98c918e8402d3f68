"""Word shingles as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from weblens.llm.common import keep_cache

SHINGLE_WORDS = 5
#: Hashed words that a task keeps at most; then it starts again.
KEPT_WORDS = 300_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS or not self:
            self.clear()
            keep_cache("weblens.llm.near_dedup", self.clear)
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = _Words()


def mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * _TURN
    return values ^ (values >> np.uint64(29))


def contract_words(text: str) -> list[bytes]:
    """Words between blanks (bytes 20 and 09 to 0D), with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "replace").lower().split()


def hashes_of(words: list) -> np.ndarray:
    return np.array([_WORDS[w] for w in words], dtype=np.uint64)


def _rolled(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = mixed(out * _STEP + words[k : k + n])
    return out


def sequences(lists: list[list], width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each list of words, the hashes of its shingles in text order.

    A list with fewer words than a shingle has one: the whole list. An empty list has none.
    """
    sizes = [len(x) for x in lists]
    flat = hashes_of([w for x in lists for w in x])
    rolled = _rolled(flat, width) if len(flat) >= width else np.zeros(0, dtype=np.uint64)
    out, at = [], 0
    for n in sizes:
        if n >= width:
            out.append(rolled[at : at + n - width + 1])
        else:
            out.append(_rolled(flat[at : at + n], n) if n else np.zeros(0, dtype=np.uint64))
        at += n
    return out


def minima(sets: list[np.ndarray], hashes: int, seed: int) -> np.ndarray:
    """(sets, hashes) MinHash values; an empty set has the largest value everywhere."""
    rng = np.random.default_rng(seed)
    turns = rng.integers(0, 2**64, size=hashes, dtype=np.uint64)
    factors = rng.integers(0, 2**64, size=hashes, dtype=np.uint64) | np.uint64(1)
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), hashes), np.iinfo(np.uint64).max, dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        at = np.cumsum(sizes[full]) - sizes[full]
        for k in range(hashes):
            out[full, k] = np.minimum.reduceat((flat ^ turns[k]) * factors[k], at)
    return out
