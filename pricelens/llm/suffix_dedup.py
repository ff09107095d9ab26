"""Exact removal of repeated byte strings with a hash-compared suffix sort.

A byte is removed if a string of ``LENGTH`` bytes covers it that also starts elsewhere, in the same text
or another. Sorting all suffixes of a corpus would move each byte hundreds of times, so suffixes are
first brought together where they can match at all:

* Every window of ``LENGTH`` bytes names its least ``GRAM``-byte string by hash, the leftmost of equals.
  Equal windows name the same string at the same place, so windows that share an anchor form a
  segment, and only segments with the same anchor string can hold equal windows.
* Anchor hashes are counted over the corpus, one entry for each hash and block of texts. Texts in
  which no anchor repeats are done.
* Segments whose anchor repeats go to that anchor's bucket with their bytes; equal segments of a
  block go once. Texts are ordered by the least of their repeated anchors before, on which near copies
  mostly agree, so that a block holds the near copies of a text and not any texts. There the suffixes that start at the anchors are sorted, and so are the strings
  before them, read backwards. Sorting is a merge sort in which two suffixes are compared by a binary
  search for their common extension on prefix polynomial hashes, so a comparison costs a logarithm of
  the length; each merge places all elements of its runs at once by binary search. Then the bytes of
  neighbours are compared for their whole extension, which proves order and extensions free of hash
  collisions (else the sort is done again with other numbers).
* A window reaching ``x`` bytes before its anchor is repeated if some other segment agrees in ``x`` bytes
  before the anchor and in ``LENGTH - x`` from it: the same class in both sorted orders, whose classes for
  any length are the stretches between shorter extensions of neighbours. Large groups therefore cost no
  pairs of segments.

Equal texts are one text that occurs several times; all of it is repeated.

With ``words`` a run of ``WORDS`` words that also starts elsewhere is repeated too, however few bytes it has.
A text then goes through the same sort a second time as the string of its words' 64-bit hashes, of which
``LENGTH`` bytes are ``WORDS`` words. Runs found there are rounded to whole words: a window between words holds
eight bytes of two further hashes, so it agrees by a collision only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.tables import buckets_for, stored
from pricelens.llm.words import mixed, word_hashes, word_places

LENGTH, GRAM = 400, 200
#: Words of 8 bytes of hash in a window.
WORDS = LENGTH // 8
#: Bytes taken together, bytes of segments in a block, and texts of a block.
STRETCH, BLOCK, TEXTS = 1 << 20, 8 << 20, 30_000
ROWS_AT_ONCE = 256
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
#: Powers are kept for so many places; those of a further place are a product of two.
_NEAR = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSES = _powers(_FACTOR, _NEAR), _powers(_INVERSE, _NEAR)


def _numbers(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 64, 256, dtype=np.uint64)


class Hashed:
    """Prefix polynomial hashes of a byte array: the hash of any part in constant time."""

    def __init__(self, data: np.ndarray, seed: int = 11):
        steps = len(data) // _NEAR + 1
        far = _powers(pow(_FACTOR, _NEAR, 1 << 64), steps)
        self.inverses = _powers(pow(_INVERSE, _NEAR, 1 << 64), steps)
        numbers = _numbers(seed)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        for k in range(steps):
            own = data[k * _NEAR : (k + 1) * _NEAR]
            out = self.sums[k * _NEAR + 1 : k * _NEAR + 1 + len(own)]
            np.cumsum(numbers[own] * _POWERS[: len(own)], out=out)
            out *= far[k]
            out += self.sums[k * _NEAR]

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverses[start // _NEAR] * _INVERSES[start % _NEAR]


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Segments of the texts at ``starts`` to ``ends`` of ``data``: the text's number, first and last window,
    anchor, anchor hash, and a hash of the segment's bytes."""
    n = len(data) - gram + 1
    long_enough = np.flatnonzero(ends - starts >= length)
    if n < 1 or not len(long_enough):
        empty = np.empty(0, np.int64)
        return {k: empty for k in ("text", "first", "last", "anchor")} | {k: np.empty(0, np.uint64) for k in ("key", "content")}
    hashed = Hashed(data)
    keys = mixed(hashed.part(np.arange(n), np.arange(gram, n + gram)))
    least = (keys >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
    span, wide = length - gram + 1, 1
    while 2 * wide <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < span:
        least = np.minimum(least[: len(least) - (span - wide)], least[span - wide :])
    sizes = ends[long_enough] - starts[long_enough] - length + 1
    windows = np.repeat(starts[long_enough] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    text = np.repeat(long_enough, sizes)
    anchor = (least[windows] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = windows[np.concatenate([new[1:], [len(windows)]]) - 1]
    first, anchor = windows[new], anchor[new]
    content = mixed(hashed.part(first, last + length) + keys[anchor] * np.uint64(3) + (anchor - first).astype(np.uint64) * np.uint64(1 << 32))
    return {"text": text[new], "first": first, "last": last, "anchor": anchor, "key": keys[anchor], "content": content}


def text_segments(raw: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Segments of texts in stretches of bounded size, with the bytes they refer to; ``text`` counts through
    all texts and ``shift`` is what a place in the bytes is less than its place in the text. The windows of
    a long text are dealt to overlapping stretches."""
    parts = [(k, at) for k, r in enumerate(raw) for at in range(0, max(len(r) - length + 1, 1), STRETCH)]
    held, size = [], 0
    for number, (k, at) in enumerate(parts):
        held.append((k, at, raw[k][at : at + STRETCH + length - 1]))
        size += len(held[-1][2])
        if size >= STRETCH or number == len(parts) - 1:
            ends = np.cumsum([len(p) for _, _, p in held])
            starts = ends - [len(p) for _, _, p in held]
            data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
            found = segments(data, starts, ends, length, gram)
            own = found["text"]
            found["shift"] = starts[own] - np.array([at for _, at, _ in held])[own] if len(own) else own
            found["text"] = np.array([k for k, _, _ in held])[own] if len(own) else own
            yield data, found
            held, size = [], 0


class Suffixes:
    """Strings that leave points of a byte array, forwards or backwards, each of its own length."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lengths: np.ndarray, backwards: bool, seed: int):
        self.data, self.at, self.lengths, self.backwards = data, at, lengths, backwards
        self.hashed = Hashed(data, seed)

    def _hash(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = self.at[x]
        return self.hashed.part(at - n, at) if self.backwards else self.hashed.part(at, at + n)

    def byte(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The byte at place ``n``, -1 behind the end."""
        inside = n < self.lengths[x]
        place = np.where(inside, self.at[x] - 1 - n if self.backwards else self.at[x] + n, 0)
        return np.where(inside, self.data[place].astype(np.int16), -1) if len(self.data) else np.full(len(x), -1, np.int16)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common extension of each pair, by binary search on hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.lengths[x], self.lengths[y])
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) >> 1
            same = self._hash(x[open_], middle) == self._hash(y[open_], middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1
        return low

    def before(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether x sorts before y; ``ties`` decides between equals."""
        n = self.common(x, y)
        a, b = self.byte(x, n), self.byte(y, n)
        return np.where(a == b, ties, a < b)


def sorted_suffixes(suffixes: Suffixes, group: np.ndarray) -> np.ndarray:
    """An order of the strings by group and then by content: a merge sort of all groups at once."""
    order = np.argsort(group, kind="stable")
    of = group[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
    sizes = np.diff(np.concatenate([first, [len(of)]]))
    start, end = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
    width = 1
    while sizes.size and width < sizes.max():
        place = np.flatnonzero(end - start > width)
        q = place - start[place]
        run = q // width
        low = np.minimum(start[place] + (run ^ 1) * width, end[place])
        partner = low.copy()
        high = np.minimum(low + width, end[place])
        mine, later = order[place], (run & 1) == 1
        while (open_ := np.flatnonzero(low < high)).size:  # how many of the partner run come before each
            middle = (low[open_] + high[open_]) >> 1
            ahead = suffixes.before(order[middle], mine[open_], later[open_])
            low[open_[ahead]] = middle[ahead] + 1
            high[open_[~ahead]] = middle[~ahead]
        target = start[place] + (run >> 1) * 2 * width + q % width + (low - partner)
        order = order.copy()
        order[target] = mine
        width *= 2
    return order


def _proved(suffixes: Suffixes, order: np.ndarray, common: np.ndarray) -> bool:
    """Whether neighbours agree in the bytes of their extension and sort by the byte after it."""
    x, y = order[:-1], order[1:]
    inner = common[1:] >= 0
    x, y, n = x[inner], y[inner], common[1:][inner]
    for start in range(0, len(x), 8192):
        a, b, m = x[start : start + 8192], y[start : start + 8192], n[start : start + 8192]
        if not (suffixes.byte(a, m) <= suffixes.byte(b, m)).all() or ((suffixes.byte(a, m) == suffixes.byte(b, m)) & (suffixes.lengths[a] > m)).any():
            return False
        pair, step = np.repeat(np.arange(len(a)), m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        if (suffixes.byte(a[pair], step) != suffixes.byte(b[pair], step)).any():
            return False
    return True


def order_with_extensions(data: np.ndarray, at: np.ndarray, lengths: np.ndarray, group: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order and each one's common extension with the one before it, -1 at the start of a group."""
    for seed in range(11, 19):
        suffixes = Suffixes(data, at, lengths, backwards, seed)
        order = sorted_suffixes(suffixes, group)
        common = np.full(len(order), -1, np.int64)
        inner = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
        common[inner] = suffixes.common(order[inner - 1], order[inner])
        if _proved(suffixes, order, common):
            return order, common
    raise RuntimeError("eight hashes collided")


def repeated_windows(data: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray, group: np.ndarray, weight: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(segment, x) of every window that occurs more than once: it starts ``x`` bytes before the anchor.

    A segment has ``before`` bytes in front of its anchor (at ``at`` of ``data``) and ``after`` from it on;
    its windows are those inside. ``weight`` says how often it occurs itself.
    """
    orders = [order_with_extensions(data, at, n, group, back) for n, back in ((before, True), (after, False))]
    members, found = [], []
    for x in range(int(before.max(initial=-1)) + 1):
        own = np.flatnonzero((before >= x) & (after >= length - x))
        if not len(own):
            continue
        classes = []
        for (order, common), n in zip(orders, (x, length - x), strict=True):
            name = np.empty(len(order), np.int64)
            name[order] = np.cumsum(common < n)
            classes.append(name[own])
        _, which = np.unique(classes[0] * (len(at) + 1) + classes[1], return_inverse=True)
        often = np.bincount(which, weights=weight[own])[which] > 1
        members.append(own[often])
        found.append(np.full(int(often.sum()), x))
    if not members:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(members), np.concatenate(found)


def merged_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[new], reach[np.concatenate([new[1:], [len(start)]]) - 1]


def _word_runs(spans: np.ndarray) -> np.ndarray:
    """Spans of a string of word hashes as runs of whole words, coded under 0."""
    runs = np.stack([-(-spans[:, 0] // 8), spans[:, 1] // 8], axis=1)
    return -1 - runs[runs[:, 1] - runs[:, 0] >= WORDS]


def resolved(raw: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans with the runs of words of ``raw`` turned into bytes, as maximal runs."""
    coded = spans[:, 0] < 0
    if not coded.any():
        return spans
    (starts, ends), runs = word_places(raw), -1 - spans[coded]
    start, end = np.concatenate([spans[~coded, 0], starts[runs[:, 0]]]), np.concatenate([spans[~coded, 1], ends[runs[:, 1] - 1]])
    return np.stack(merged_spans(start, end), axis=1)


_TEXT = np.dtype([("key", "<i8"), ("t1", "<i8"), ("t2", "<i8"), ("segments", "<i8")])


def _raw(part: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]


def _units(part: pa.RecordBatch, words: bool) -> list[bytes]:
    """The strings to sort: each text, and with ``words`` each text followed by the hashes of its words."""
    raw = _raw(part)
    if not words:
        return raw
    hashes, offsets = word_hashes([t or "" for t in part.column("text").to_pylist()])
    return [unit for k, r in enumerate(raw) for unit in (r, hashes[offsets[k] : offsets[k + 1]].tobytes())]


def repeated_anchors(docs: DataFrame, buckets: int, words: bool = False) -> DataFrame:
    """``key``, ``t1``, ``t2``, ``marks`` (packed bits, one for each segment of the text) and ``near`` (the least
    repeated hash) of the documents in which some anchor's hash occurs elsewhere too."""
    per = 2 if words else 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32

        def rows(about: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
            own, which, times = np.unique(keys, return_inverse=True, return_counts=True)
            bucket = (own % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            own, often = own[order], (times[order] > 1).astype(np.uint8)
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            home = block % buckets
            used = [b for b in range(buckets) if ends[b] < ends[b + 1] or b == home]
            return pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(used, pa.int32()),
                    "block": pa.array([block] * len(used), pa.int64()),
                    "keys": pa.array([own[ends[b] : ends[b + 1]].tobytes() for b in used], pa.binary()),
                    "often": pa.array([often[ends[b] : ends[b + 1]].tobytes() for b in used], pa.binary()),
                    "about": pa.array([about.tobytes() if b == home else None for b in used], pa.binary()),
                    "which": pa.array([rank[which].tobytes() if b == home else None for b in used], pa.binary()),
                }
            )

        about, keys, size = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                raw = _units(part, words)
                counts = np.zeros(part.num_rows, np.int64)
                for _, found in text_segments(raw):
                    counts += np.bincount(found["text"] // per, minlength=len(counts))
                    keys.append(found["key"])
                ids = zip(*(part.column(c).to_pylist() for c in ("key", "t1", "t2")), counts.tolist(), strict=True)
                about += list(ids)
                size += sum(map(len, raw))
                if size >= BLOCK // per or len(about) >= TEXTS:
                    yield rows(np.array(about, _TEXT), np.concatenate(keys))
                    about, keys, size, block = [], [], 0, block + 1
        if about:
            yield rows(np.array(about, _TEXT), np.concatenate(keys))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(k, np.uint64) for k in rows["keys"]]
        often = np.frombuffer(b"".join(rows["often"]), np.uint8)
        names, at, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        again = (times + np.bincount(at, weights=often, minlength=len(names)) > 1)[at]
        ends = np.cumsum([len(k) for k in own])
        back = [k[again[e - len(k) : e]].tobytes() for k, e in zip(own, ends, strict=True)]
        bits = [np.packbits(again[e - len(k) : e]).tobytes() for k, e in zip(own, ends, strict=True)]
        found = {"block": rows["block"], "bucket": rows["bucket"], "n": [len(k) for k in own], "bits": bits, "keys": back}
        return pd.DataFrame({**found, "about": rows["about"], "which": rows["which"]})

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        home = rows[rows["about"].notna()].iloc[0]
        about = np.frombuffer(home["about"], _TEXT)
        again = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(rows["bits"], rows["n"], strict=True)]).astype(bool)
        names = np.zeros(len(again), np.uint64)
        names[again] = np.frombuffer(b"".join(rows["keys"]), np.uint64)
        which = np.frombuffer(home["which"], "<u4")
        repeated, names = again[which], names[which]
        ends = np.cumsum(about["segments"])
        own = [repeated[e - n : e] for e, n in zip(ends, about["segments"], strict=True)]
        keep = np.array([m.any() for m in own], bool)
        marks = [np.packbits(m).tobytes() for m, k in zip(own, keep, strict=True) if k]
        near = [names[e - n : e][m].min() for e, n, m, k in zip(ends, about["segments"], own, keep, strict=True) if k]
        near = np.array(near, np.uint64).view(np.int64)
        return pd.DataFrame({"key": about["key"][keep], "t1": about["t1"][keep], "t2": about["t2"][keep], "marks": marks, "near": near})

    sent = docs.mapInArrow(send, "bucket int, block long, keys binary, often binary, about binary, which binary")
    counted = sent.groupBy("bucket").applyInPandas(count, "block long, bucket int, n long, bits binary, keys binary, about binary, which binary")
    return counted.groupBy("block").applyInPandas(mark, "key long, t1 long, t2 long, marks binary, near long")


def packed(parts: list[bytes]) -> bytes:
    """The parts as one compressed string. Segments overlap by all but a byte and near copies by most of theirs, which a
    shuffle's own compression does not see, as it looks at 32 KB at a time."""
    return pa.compress(b"".join(parts), codec="zstd", asbytes=True) if parts else b""


def unpacked(data: bytes, size: int) -> bytes:
    """The ``size`` bytes of ``packed``."""
    return pa.decompress(data, size, codec="zstd", asbytes=True) if size else b""


_SENT = (
    "bucket int, block long, groups binary, before binary, after binary, weight binary, bytes binary, "
    "texts binary, owners binary"
)
_OWNER = np.dtype([("member", "<i8"), ("text", "<i4"), ("anchor", "<i8")])


def repeated_spans(texts: DataFrame, buckets: int, words: bool = False) -> DataFrame:
    """``t1``, ``t2`` and ``spans`` (pairs of 64-bit places) of the marked texts. ``texts`` has ``t1``, ``t2``, ``copies``,
    ``marks`` and ``text``; equal texts are in one partition and only the first counts. Pairs under 0 are runs of
    words, -1 minus the number of the first and of the one after the last."""
    per = 2 if words else 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        seen: set[tuple[int, int]] = set()

        def rows(about: list, cut: dict[str, list]) -> pa.RecordBatch:
            names = {n: np.concatenate(cut[n]) for n in ("content", "key", "before", "after", "text", "anchor", "weight")}
            _, member, which = np.unique(names["content"], return_index=True, return_inverse=True)
            weight = np.minimum(np.bincount(which, weights=names["weight"]), 2).astype(np.uint8)
            bucket = (names["key"][member] % np.uint64(buckets)).astype(np.int64)
            # By anchor within a bucket, so that near copies follow each other and compress well.
            order = np.lexsort((names["key"][member], bucket))
            bucket = bucket[order]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            owners = np.zeros(len(which), _OWNER)
            owners["member"], owners["text"], owners["anchor"] = rank[which], names["text"], names["anchor"]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            member, weight = member[order], weight[order]
            home = block % buckets
            used = [b for b in range(buckets) if ends[b] < ends[b + 1] or b == home]
            part = lambda n, kind: pa.array([names[n][member[ends[b] : ends[b + 1]]].astype(kind).tobytes() for b in used], pa.binary())
            return pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(used, pa.int32()),
                    "block": pa.array([block] * len(used), pa.int64()),
                    "groups": part("key", "<u8"),
                    "before": part("before", "<u2"),
                    "after": part("after", "<u2"),
                    "weight": pa.array([weight[ends[b] : ends[b + 1]].tobytes() for b in used], pa.binary()),
                    "bytes": pa.array([packed([cut["bytes"][m] for m in member[ends[b] : ends[b + 1]]]) for b in used], pa.binary()),
                    "texts": pa.array([np.array(about, "<i8").tobytes() if b == home else None for b in used], pa.binary()),
                    "owners": pa.array([owners.tobytes() if b == home else None for b in used], pa.binary()),
                }
            )

        def fresh() -> dict[str, list]:
            return {n: [] for n in ("content", "key", "before", "after", "text", "anchor", "weight", "bytes")}

        about, cut, size = [], fresh(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                ids = list(zip(*(part.column(c).to_pylist() for c in ("t1", "t2", "copies", "marks")), strict=True))
                raw = _units(part, words)
                new = [k for k, x in enumerate(ids) if x[:2] not in seen and not seen.add(x[:2])]
                raw, ids = [raw[k * per + u] for k in new for u in range(per)], [ids[k] for k in new]
                passed = np.zeros(len(ids), np.int64)
                for data, found in text_segments(raw):
                    text = found["text"] // per
                    nth = np.arange(len(text)) - np.searchsorted(text, text) + passed[text]
                    passed += np.bincount(text, minlength=len(ids))
                    marks = [np.unpackbits(np.frombuffer(x[3], np.uint8)).astype(bool) for x in ids]
                    keep = np.array([marks[t][m] for t, m in zip(text, nth, strict=True)], bool)
                    own = {n: v[keep] for n, v in found.items()}
                    cut["content"].append(own["content"])
                    cut["key"].append(own["key"])
                    cut["before"].append(own["anchor"] - own["first"])
                    cut["after"].append(own["last"] + LENGTH - own["anchor"])
                    cut["text"].append(own["text"] + len(about) * per)
                    cut["anchor"].append(own["anchor"] - own["shift"])
                    cut["weight"].append(np.array([min(ids[t // per][2], 2) for t in own["text"]], np.int64))
                    cut["bytes"] += [data[a:b].tobytes() for a, b in zip(own["first"], own["last"] + LENGTH, strict=True)]
                    size += int((own["last"] + LENGTH - own["first"]).sum())
                about += [x[:2] for x in ids]
                if size >= BLOCK or len(about) >= TEXTS:
                    yield rows(about, cut)
                    about, cut, size, block = [], fresh(), 0, block + 1
        if about:
            yield rows(about, cut)

    def sort(rows: pd.DataFrame) -> pd.DataFrame:
        join = lambda name, kind: np.frombuffer(b"".join(rows[name]), kind)
        before, after = join("before", "<u2").astype(np.int64), join("after", "<u2").astype(np.int64)
        at = np.cumsum(before + after) - after
        sizes = [int(np.frombuffer(b, "<u2").sum(dtype=np.int64) + np.frombuffer(a, "<u2").sum(dtype=np.int64)) for b, a in zip(rows["before"], rows["after"], strict=True)]
        data = np.frombuffer(b"".join(unpacked(p, n) for p, n in zip(rows["bytes"], sizes, strict=True)), np.uint8)
        member, x = repeated_windows(data, at, before, after, join("groups", "<u8"), join("weight", np.uint8))
        order = np.lexsort((x, member))
        member, x = member[order], x[order]
        new = np.flatnonzero(np.concatenate([[True], (member[1:] != member[:-1]) | (x[1:] != x[:-1] + 1)])) if len(member) else np.empty(0, np.int64)
        stop = np.concatenate([new[1:], [len(member)]]) - 1 if len(member) else new
        ends = np.cumsum([len(g) // 8 for g in rows["groups"]])
        sizes = np.array([len(g) // 8 for g in rows["groups"]])
        cut = np.searchsorted(member[new], np.concatenate([[0], ends]))
        runs = [np.stack([member[new[a:b]] - (e - n), x[new[a:b]], x[stop[a:b]]], axis=1).astype("<i8").tobytes() for a, b, e, n in zip(cut[:-1], cut[1:], ends, sizes, strict=True)]
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "n": sizes, "runs": runs, "texts": rows["texts"], "owners": rows["owners"]})

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        home = rows[rows["owners"].notna()].iloc[0]
        about, owners = np.frombuffer(home["texts"], "<i8").reshape(-1, 2), np.frombuffer(home["owners"], _OWNER)
        runs = [np.frombuffer(r, "<i8").reshape(-1, 3) + [shift, 0, 0] for r, shift in zip(rows["runs"], np.cumsum(rows["n"]) - rows["n"], strict=True)]
        runs = np.concatenate(runs)
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        low, high = np.searchsorted(runs[:, 0], owners["member"]), np.searchsorted(runs[:, 0], owners["member"], "right")
        n = high - low
        which = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        anchor, text = np.repeat(owners["anchor"], n), np.repeat(owners["text"], n)
        start, end = anchor - runs[which, 2], anchor - runs[which, 1] + LENGTH
        order = np.argsort(text, kind="stable")
        text, start, end = text[order], start[order], end[order]
        bounds = np.searchsorted(text, np.arange(len(about) * per + 1))
        out: dict[int, list[np.ndarray]] = {}
        for unit in np.flatnonzero(np.diff(bounds)).tolist():
            spans = np.stack(merged_spans(start[bounds[unit] : bounds[unit + 1]], end[bounds[unit] : bounds[unit + 1]]), axis=1)
            out.setdefault(unit // per, []).append(_word_runs(spans) if unit % per else spans)
        spans = [(int(about[k, 0]), int(about[k, 1]), np.concatenate(v).astype("<i8").tobytes()) for k, v in out.items()]
        return pd.DataFrame(spans, columns=["t1", "t2", "spans"])

    sent = texts.mapInArrow(send, _SENT)
    sorted_ = sent.groupBy("bucket").applyInPandas(sort, "block long, bucket int, n long, runs binary, texts binary, owners binary")
    return sorted_.groupBy("block").applyInPandas(gather, "t1 long, t2 long, spans binary")


def with_spans(docs: DataFrame, words: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``spans``: the maximal runs of repeated bytes of its ``text``, as pairs of
    64-bit places, null without one. A text under ``LENGTH`` bytes, empty or null has none. Rows that repeat
    a ``doc_id`` are documents of their own, so a text of two equal rows is repeated. Texts are told
    apart by 128 bits of hash. A column named ``spans`` is replaced. No row for an empty table. With ``words``
    repeated runs of ``WORDS`` words are among the spans, coded for ``resolved``."""
    columns = [c for c in docs.columns if c.lower() != "spans"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), text.alias("text"))
    named = named.select("row", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    doc_id = F.col("doc_id").cast("long")
    plain = docs.select(F.coalesce(doc_id, F.xxhash64(text)).alias("key"), text.alias("text"))
    plain = plain.select("key", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    buckets = buckets_for(docs, 2 if words else 12)
    marked = stored(repeated_anchors(plain, buckets, words), "marked")
    once = marked.groupBy("t1", "t2").agg(F.min("key").alias("key"), F.count("*").alias("copies"), F.first("marks").alias("marks"), F.first("near").alias("near"))
    # Both joins have a side that grows with the texts, so neither is broadcast, whatever its size today.
    again = plain.join(once.hint("merge"), ["key", "t1", "t2"]).select("near", "t1", "t2", "copies", "marks", "text")
    # Ranges, so that near copies are side by side and yet very many of them are several tasks; equal texts are in one.
    side_by_side = again.repartitionByRange(buckets, "near", "t1").sortWithinPartitions("near", "t1")
    spans = stored(repeated_spans(side_by_side, buckets, words), "spans")
    return named.join(spans.hint("merge"), ["t1", "t2"], "left").select("row.*", "spans")


def kept(raw: bytes, spans: np.ndarray) -> bytes:
    """The bytes outside the spans."""
    out, at = [], 0
    for start, end in spans.tolist():
        out.append(raw[at:start])
        at = end
    return b"".join(out) + raw[at:]


def spans_of(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", "<i8").reshape(-1, 2)


def without_repeats(docs: DataFrame, words: bool = False) -> DataFrame:
    """Every row of ``docs`` with the repeated bytes, and with ``words`` the repeated runs of ``WORDS`` words, cut
    out of ``text``. A character that is cut through goes as a whole. Other columns pass through; a null text
    stays null."""

    def shortened(raw: bytes, spans: bytes) -> str:
        return kept(raw, resolved(raw, spans_of(spans))).decode("utf-8", "ignore")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series(
                [t if t is None or s is None else shortened(t.encode("utf-8", "surrogatepass"), s) for t, s in zip(texts, spans, strict=True)],
                dtype=object,
            )

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    found = with_spans(docs.select(row.alias("row"), "doc_id", F.col("text").cast("string").alias("text")), words)
    shorter = F.pandas_udf(cut, "string")(F.col("text"), F.col("spans"))
    return found.select(F.col("row").withField("text", shorter).alias("row")).select("row.*")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` by the strings of ``LENGTH``
    bytes alone, and as ``n_word_runs`` and ``n_repeated_words`` the maximal runs of ``WORDS`` words or more that
    also start elsewhere, of which nothing is removed here."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _raw(batch)
            both = [spans_of(s) for s in batch.column("spans").to_pylist()]
            spans, runs = [s[s[:, 0] >= 0] for s in both], [-1 - s[s[:, 0] < 0] for s in both]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array([len(r) for r in raw], pa.int64()),
                    "n_removed": pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()),
                    "n_spans": pa.array([len(s) for s in spans], pa.int64()),
                    "kept_sha256": [hashlib.sha256(kept(r, s)).hexdigest() for r, s in zip(raw, spans, strict=True)],
                    "n_word_runs": pa.array([len(r) for r in runs], pa.int64()),
                    "n_repeated_words": pa.array([int((r[:, 1] - r[:, 0]).sum()) for r in runs], pa.int64()),
                }
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_word_runs long, n_repeated_words long"
    return with_spans(plain, words=True).mapInArrow(digest, schema)
