"""Words of many texts at once, as 64-bit hashes.

Words are the runs of bytes other than space and 0x09 to 0x0D of the UTF-8 text, usually with A-Z in lower
case. A word's hash sums a random number for each byte times a power of an odd multiplier for its
place, modulo 2**64, and is then mixed; the numbers come from a fixed seed, so all workers agree.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = _AS_IS.copy()
_LOWER[65:91] += 32
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 64, 256, dtype=np.uint64)
_FACTOR = 0x9E3779B97F4A7C15
#: Bytes hashed at a time; a longer word is still hashed whole.
SLICE = 1 << 21


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _FACTOR, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers, so that any of their bits can pick a bucket."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slice_words(raw: np.ndarray, case: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a stretch of bytes."""
    solid = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    top = 1 << int(lengths.max()).bit_length()
    return starts, mixed(np.add.reduceat(_BYTES[case[raw[solid]]] * _powers(top)[place], first))


def byte_hashes(data: np.ndarray, first: np.ndarray, at_once: int) -> np.ndarray:
    """The hash of each part of ``data``, which are cut at ``first`` and go to the next cut or the end. About
    ``at_once`` bytes are hashed together; a longer part is still hashed whole."""
    sizes = np.diff(np.append(first, len(data)))
    out, at = np.empty(len(first), np.uint64), 0
    while at < len(first):
        stop = max(int(np.searchsorted(first, first[at] + at_once)), at + 1)
        own = sizes[at:stop]
        begin = first[at:stop] - first[at]
        place = np.arange(own.sum()) - np.repeat(begin, own)
        part = data[first[at] : first[at] + len(place)]
        out[at:stop] = np.add.reduceat(_BYTES[part] * _powers(1 << int(own.max()).bit_length())[place], begin)
        at = stop
    return mixed(out)


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text begins and ends, in bytes."""
    edges = np.flatnonzero(np.diff(~_SPACE[np.frombuffer(raw, np.uint8)], prepend=False, append=False))
    return edges[::2], edges[1::2]


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets at which each text's words begin (one more than texts).
    Without ``lower`` the words are taken as they are."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.empty(0, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(data):
        stop = min(at + SLICE, len(data))
        while stop < len(data) and not _SPACE[data[stop - 1]]:
            gap = np.flatnonzero(_SPACE[data[stop : stop + SLICE]])
            stop = stop + int(gap[0]) + 1 if len(gap) else min(stop + SLICE, len(data))
        s, h = _slice_words(data[at:stop], _LOWER if lower else _AS_IS)
        starts.append(s + at)
        hashes.append(h)
        at = stop
    where = np.concatenate(starts) if starts else np.empty(0, np.int64)
    offsets = np.searchsorted(where, np.concatenate([[0], ends]))
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), offsets
