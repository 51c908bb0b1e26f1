"""Words of a text as 64-bit hashes, and polynomial hashes of word windows."""

from __future__ import annotations

import numpy as np
import xxhash

from quarry.llm._shared import only

#: Words whose hash a worker process keeps, and the longest of them.
CACHED_WORDS, CACHED_BYTES = 300_000, 64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_known: dict[bytes, int] = {}
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    only("wordhash", _known.clear)
    found = list(map(_known.get, words))
    if None in found:
        if len(_known) > CACHED_WORDS:
            _known.clear()
        digest = xxhash.xxh64_intdigest
        for at, value in enumerate(found):
            if value is None:
                word = words[at]
                found[at] = digest(word)
                if len(word) <= CACHED_BYTES:
                    _known[word] = found[at]
    return np.array(found, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if _powers[0].size < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for at, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            _powers[at] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x7FB5D329728EA185)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


class Prefix:
    """Hashes of any span of a sequence of 64-bit values in constant time."""

    def __init__(self, values: np.ndarray):
        up, self._down = powers(values.size + 1)
        self._sums = np.zeros(values.size + 1, dtype=np.uint64)
        np.cumsum(values * up[:-1], out=self._sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._down[starts])

    def windows(self, width: int) -> np.ndarray:
        n = self._sums.size - width
        return mixed((self._sums[width:] - self._sums[:n]) * self._down[:n]) if n > 0 else np.zeros(0, np.uint64)
