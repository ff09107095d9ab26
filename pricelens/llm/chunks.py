"""Encoding whole texts through a cache of their chunks.

The pattern of byte-level BPE always starts a new match at a space before a non-space, and at a line
feed between non-spaces. A text whose white space is single spaces and line feeds can therefore be
cut there, and each chunk encoded by itself; any other text is encoded as a whole. Words repeat, so
most chunks are found in the cache. Chunks are cut, hashed (64 bits), looked up and put together many at
a time in numpy; the cache is a sorted array of hashes beside one array of all their ids. A full cache
gives up the half of its chunks that was not used for longest, which bounds a worker's memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from pricelens.llm.words import byte_hashes

#: Chunks held, characters of texts taken together (a longer text is taken alone), and bytes hashed at a time.
CACHED, TEXT_AT_ONCE, SLICE = 1_000_000, 4 << 20, 1 << 20
#: Chunks encoded as one text.
JOINED = 64
_UNEVEN = re.compile(r"[ \n]\s|[^\S \n]")
_SPACE, _FEED = 0x20, 0x0A


def _table(values: list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[values] = True
    return out


#: White space of one byte, and how white space of more bytes may begin and go on.
_WHITE, _LEAD, _NEXT = _table([*range(9, 14), *range(28, 33)]), _table([0xC2, 0xE1, 0xE2, 0xE3]), _table([0x80, 0x81, 0x85, 0x9A, 0xA0])


def _uneven(texts: list[str], raw: list[bytes]) -> list[bool]:
    """Which texts have other white space than single spaces and line feeds. The bytes tell which texts may."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    white = _WHITE[data]
    maybe = white & (data != _SPACE) & (data != _FEED)
    maybe[1:] |= (white[1:] & white[:-1]) | (_LEAD[data[:-1]] & _NEXT[data[1:]])
    ends = np.cumsum([len(r) for r in raw])
    out = [False] * len(texts)
    for k in np.unique(np.searchsorted(ends, np.flatnonzero(maybe), side="right")).tolist():
        out[k] = bool(_UNEVEN.search(texts[k]))
    return out


class ChunkEncoder:
    """``encode_all`` takes texts and returns each one's ids as little-endian unsigned 32-bit bytes.

    ``opens`` says of every id whether its token begins with a space or a line feed. Only a chunk's first
    token does, so with it chunks can be encoded many at a time and told apart afterwards.
    """

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]], opens: np.ndarray | None = None):
        self.encode_all, self.opens = encode_all, opens
        self.forget()

    def forget(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.starts, self.counts, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, "<u4")
        self.calls = 0

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        if self.opens is None:
            return self.encode_all(chunks)
        opening = [x for x in chunks if x[0] in " \n"]
        out: dict[str, bytes] = {}
        for k, raw in enumerate(self.encode_all(["".join(opening[at : at + JOINED]) for at in range(0, len(opening), JOINED)])):
            part = opening[k * JOINED : (k + 1) * JOINED]
            first = np.flatnonzero(self.opens[ids_of(raw)]).tolist()
            ends = [4 * n for n in first[1:]] + [len(raw)]
            told = len(first) == len(part) and min(map(len, part)) > 1  # white space alone merges with what follows
            own = [raw[4 * a : b] for a, b in zip(first, ends, strict=True)] if told else self.encode_all(part)
            out.update(zip(part, own, strict=True))
        alone = [x for x in chunks if x[0] not in " \n"]
        out.update(zip(alone, self.encode_all(alone), strict=True))
        return [out[x] for x in chunks]

    def _shrink(self) -> None:
        """Half of the chunks, the ones used last, with their ids moved together."""
        keep = np.sort(np.argsort(self.used, kind="stable")[len(self.used) - CACHED // 2 :])
        self.hashes, starts, self.counts, self.used = self.hashes[keep], self.starts[keep], self.counts[keep], self.used[keep]
        ends = np.cumsum(self.counts)
        self.ids = self.ids[_places(starts, self.counts)]
        self.starts = ends - self.counts

    def _slots(self, hashes: np.ndarray, chunk: Callable[[int], str]) -> np.ndarray:
        """Where the distinct, sorted hashes are in the cache; ``chunk`` gives the text of the nth."""
        if len(self.hashes) > CACHED:
            self._shrink()
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            encoded = self._encode_chunks([chunk(n) for n in new.tolist()])
            counts = np.array([len(e) // 4 for e in encoded], np.int64)
            starts = len(self.ids) + np.cumsum(counts) - counts
            self.ids = np.concatenate([self.ids, ids_of(b"".join(encoded))])
            place = at[new]
            self.hashes = np.insert(self.hashes, place, hashes[new])
            self.starts, self.counts = np.insert(self.starts, place, starts), np.insert(self.counts, place, counts)
            self.used = np.insert(self.used, place, 0)
            at = np.searchsorted(self.hashes, hashes)
        self.used[at] = self.calls
        return at

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin (one more than texts)."""
        if len(texts) > 1 and sum(map(len, texts)) > TEXT_AT_ONCE:
            half = len(texts) // 2
            (a, to), (b, more) = self.flat(texts[:half]), self.flat(texts[half:])
            return np.concatenate([a, b]), np.concatenate([to, more[1:] + to[-1]])
        self.calls += 1
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        whole = _uneven(texts, raw)
        raw = [b"" if w else r for r, w in zip(raw, whole, strict=True)]
        sizes = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(sizes)
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        cut = (data == _SPACE) | (data == _FEED)
        cut[(ends - sizes)[sizes > 0]] = True
        first = np.flatnonzero(cut)
        stop = np.append(first[1:], len(data))
        hashes, at, back = np.unique(byte_hashes(data, first, SLICE), return_index=True, return_inverse=True)
        slots = self._slots(hashes, lambda n: joined[first[at[n]] : stop[at[n]]].decode("utf-8", "surrogatepass"))
        counts = self.counts[slots][back]
        ids = self.ids[_places(self.starts[slots][back], counts)]
        bounds = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(first, np.concatenate([[0], ends]))]
        if not any(whole):
            return ids, bounds
        others = iter(self.encode_all([t for t, w in zip(texts, whole, strict=True) if w]))
        parts = [ids_of(next(others)) if w else ids[bounds[k] : bounds[k + 1]] for k, w in enumerate(whole)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, bounds = self.flat(texts)
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of stretches of an array, one stretch after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def ids_of(encoded: bytes) -> np.ndarray:
    return np.frombuffer(encoded, dtype="<u4")
