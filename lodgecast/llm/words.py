"""Words of a text and rolling hashes over them, shared by the operators that compare word sequences.

A word is a run of bytes outside space and the controls 09 to 0D, which is what ``bytes.split`` cuts at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words whose hash a worker remembers; beyond it the memory starts anew.
REMEMBERED_WORDS = 400_000
BASE = 0x9E3779B97F4A7C15
SECOND_BASE = 0xD6E8FEB86659FD93


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()
_POWERS: dict[int, np.ndarray] = {}


def split_words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    found = _POWERS.get(base)
    if found is None or len(found) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        found = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return found[:n]


def rolling(values: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``width`` values, modulo 2 ** 64, then mixed.

    The prefix sums of ``value[i] * base ** -i`` give each run by one difference; base is odd, so it has an inverse.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(inverse, len(values)), dtype=np.uint64, out=sums[1:])
    return mixed((sums[width:] - sums[:n]) * _powers(base, n))


def first_minima(hashes: np.ndarray, span: int) -> np.ndarray:
    """Place of the first smallest hash in every run of ``span`` hashes, by doubling the run's length."""
    best, reach = np.arange(len(hashes)), 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(hashes[right] < hashes[left], right, left)
        reach += step
    return best


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Tuples of Python values, a few hundred rows at a time so that long texts do not pile up."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(column.to_pylist() for column in part.columns), strict=True)
