"""Hashes of words and of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

MASK = (1 << 64) - 1
#: An odd factor of the polynomial over words, and how many words a worker remembers, if they are no longer than so many bytes.
BASE = np.uint64(0x9E3779B97F4A7C15)
MEMO, LONGEST = 100_000, 64
_memo: dict[bytes, int] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    get, out = _memo.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(w) <= LONGEST:
                if len(_memo) >= MEMO:
                    _memo.clear()
                _memo[w] = h
        out.append(h)
    return np.array(out, dtype=np.uint64)


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive words."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        if n <= 8:
            out = hashes[:k].copy()
            for i in range(1, n):
                out = out * BASE + hashes[i : i + k]
            return mixed(out)
        up, down = _powers(len(hashes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up)])
        return mixed((sums[n:] - sums[:k]) * down[:k])


_up = _down = np.empty(0, np.uint64)


def forget() -> None:
    """Release what a worker remembers; called at the end of a partition, as workers are used again."""
    global _up, _down
    _memo.clear()
    _up = _down = np.empty(0, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE, and of its inverse; kept for the longest text so far."""
    global _up, _down
    if len(_up) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _up = np.cumprod(np.full(n, BASE, np.uint64))
        _down = np.cumprod(np.full(n, inverse, np.uint64))
    return _up[:n], _down[:n]


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values, by block-wise running minima."""
    k = len(values) - width + 1
    if k <= 0:
        return np.empty(0, values.dtype)
    pad = -len(values) % width
    full = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:k], left[width - 1 : width - 1 + k])
