"""Words of whole batches of texts as numpy arrays: places, 64-bit hashes, hashes of word runs."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

#: Blank and U+0009 to U+000D end a word; all are single bytes in UTF-8.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Words of more bytes are hashed one by one.
_LONG = 64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """All words of some texts, one text after another."""

    buf: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    #: Text i has the words bounds[i] to bounds[i + 1].
    bounds: np.ndarray
    hashes: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.bounds.size - 1), np.diff(self.bounds))


def split(texts: list[bytes | str | None], lower: bool = False, hashed: bool = True) -> Words:
    """Texts cut into words; null has none.  ``lower`` lower-cases A-Z."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
    buf = np.frombuffer(b" ".join([*raw, b" " * 8]), np.uint8)
    if lower:
        buf = _LOWER[buf]
    blank = _BLANK[buf]
    edge = np.empty(buf.size, bool)
    edge[0] = not blank[0]
    np.not_equal(blank[1:], blank[:-1], out=edge[1:])
    places = np.nonzero(edge)[0]
    starts, ends = places[::2], places[1::2]
    text_ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    bounds = np.append(0, np.searchsorted(starts, text_ends))
    sizes = ends - starts
    return Words(buf, starts, sizes, bounds, hash_words(buf, starts, sizes) if hashed else np.zeros(0, np.uint64))


def hash_words(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; the buffer goes on for eight bytes after the last word."""
    view = np.ndarray((buf.size - 7,), "<u8", np.ascontiguousarray(buf), strides=(1,))
    h = mix(sizes.astype(np.uint64) + np.uint64(_MULTIPLIER))
    most = int(sizes.max()) if sizes.size else 0
    for k in range(0, min(most, _LONG), 8):
        own = slice(None) if k == 0 else np.nonzero(sizes > k)[0]
        gone = np.maximum(8 + k - sizes[own], 0).astype(np.uint64) * np.uint64(8)
        lane = view[starts[own] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> gone)
        h[own] = mix((h[own] ^ lane) * np.uint64(_MULTIPLIER))
    for i in np.nonzero(sizes > _LONG)[0].tolist():
        word = buf[starts[i] : starts[i] + sizes[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return h


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words that stand in a row (also across texts: mask those)."""
    n = hashes.size - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_MULTIPLIER) + hashes[j : j + n]
    return mix(out)


def run_hashes(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words from first to before end, for any runs, from one prefix sum."""
    n = hashes.size
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(_MULTIPLIER, n), out=prefix[1:])
    back = _powers(_INVERSE, n + 1)
    return mix((prefix[end] - prefix[first]) * back[first] + (end - first).astype(np.uint64))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value of each window, by doubling."""
    n = values.size - width + 1
    if n < 1:
        return np.zeros(0, np.int64)
    low, at, size = values, np.arange(values.size), 1
    while size < width:
        step = min(size, width - size)
        left = low[:-step] <= low[step:]
        low = np.where(left, low[:-step], low[step:])
        at = np.where(left, at[:-step], at[step:])
        size += step
    return at[:n]
