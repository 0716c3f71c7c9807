"""Words of UTF-8 text found and hashed in numpy, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Most bytes handled at once.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
_BLANKS = (32, 9, 10, 11, 12, 13)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64 and of its inverse."""

    def powers(base: int) -> np.ndarray:
        out = np.full(CHUNK + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return powers(BASE), powers(pow(BASE, -1, 1 << 64))


def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit value for every byte."""
    return np.random.default_rng(seed).integers(0, (1 << 64) - 1, 256, dtype=np.uint64, endpoint=True)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of other bytes than ASCII white space."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def without_tails(
    raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, tail: bytes
) -> tuple[np.ndarray, np.ndarray]:
    """Spans of lower-case text with the tail of some bytes after a letter cut off.

    Only a-z and the lower letters of Latin-1 count as letters here; other words stay
    whole. A cut word gives two spans.
    """
    is_tail = np.isin(np.arange(256), np.frombuffer(tail, np.uint8))[raw]
    kept = np.maximum.accumulate(np.where(is_tail, -1, np.arange(len(raw))))
    cut = kept[ends - 1] + 1
    last, before = raw[cut - 1], raw[np.maximum(cut - 2, 0)]
    letter = ((last >= 97) & (last <= 122)) | ((before == 0xC3) & (last >= 0xA0) & (last <= 0xBF) & (last != 0xB7))
    cut = cut[(cut > starts) & (cut < ends) & letter]
    return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of each span of at most CHUNK bytes: a polynomial in the bytes' values.

    Prefix sums give the value of any run; the inverse power takes out where it began.
    """
    powers, inverses = _powers()
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values[raw] * powers[:len(raw)])])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def parts(data: bytes) -> Iterator[bytes]:
    """A text in parts of at most CHUNK bytes cut at white space; a longer word is a part."""
    low = 0
    while len(data) - low > CHUNK:
        cut = max(data.rfind(bytes([c]), low, low + CHUNK) for c in _BLANKS)
        if cut <= low:
            ends = [e for c in _BLANKS if (e := data.find(bytes([c]), low + CHUNK)) >= 0]
            cut = min(ends, default=len(data))
        yield data[low:cut]
        low = cut
    yield data[low:]


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one of each value, number of its value for each item)."""
    order = hashes.argsort()
    ranked = hashes[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(ranked), np.int64)
    number[order] = np.cumsum(first) - 1
    return order[first], number
