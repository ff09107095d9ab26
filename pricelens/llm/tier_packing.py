"""Hierarchical packing of documents into sequences of several lengths.

Documents are routed to tiers of context sizes (256, 512, 1024 and 2048 tokens). A document longer
than the longest tier first fills windows of its own; what remains of it goes to the shortest tier
that holds it. Tiers are packed from the longest down: a window takes its longest waiting document,
its gap is filled with the documents of the shorter tiers that fit best, and what still gapes is
filled exactly by cutting a document, whose rest returns to the tier it now fits. So a window is
full, and as every tier is a power of two, it needs no padding.

Windows of a tier are dealt to step groups of equal token count: ordered by attention cost (the sum
of squared piece lengths) and dealt back and forth, so that the steps cost about the same.

Every task packs the documents it reads, ``BLOCK`` waiting tokens at a time; what cannot fill a window
waits for the next block, and at the end of the task it is cut at powers of two. Nothing is shuffled,
memory is bounded by the block and the longest document, and a repeated task packs the same again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pricelens.llm.tables import documents
from pricelens.llm.tokens import token_rows, vocabulary_path

TIERS = (256, 512, 1024, 2048)
#: Waiting tokens that are packed together, and the tokens of a training step.
BLOCK, STEP_TOKENS = 1 << 20, 1 << 16
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)

#: A piece is (document number, start, length).
Piece = tuple[int, int, int]


class Pool:
    """Waiting pieces by length, with the longest one up to a given length at hand."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[Piece]] = {}
        self.lengths = 0  # bit n: a piece of length n waits

    def add(self, piece: Piece) -> None:
        self.by_length.setdefault(piece[2], []).append(piece)
        self.lengths |= 1 << piece[2]

    def longest(self, limit: int) -> int:
        """The greatest waiting length up to ``limit``, 0 if there is none."""
        return max((self.lengths & ((2 << limit) - 1)).bit_length() - 1, 0)

    def shortest_over(self, limit: int) -> int:
        above = self.lengths >> (limit + 1) << (limit + 1)
        return (above & -above).bit_length() - 1 if above else 0

    def take(self, length: int) -> Piece:
        found = self.by_length[length]
        piece = found.pop()
        if not found:
            self.lengths &= ~(1 << length)
        return piece

    def pieces(self) -> list[Piece]:
        return [p for n in sorted(self.by_length, reverse=True) for p in self.by_length[n]]


def fill_windows(pool: Pool, tiers: tuple[int, ...] = TIERS) -> Iterator[tuple[int, list[Piece]]]:
    """Full windows as (tier, pieces). What cannot fill a window stays in the pool."""
    for k in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[k], tiers[k - 1] if k else 0
        while (length := pool.longest(tier)) > below:
            window, gap = [pool.take(length)], tier - length
            while gap and (length := pool.longest(gap)):
                window.append(pool.take(length))
                gap -= length
            if gap and (length := pool.shortest_over(gap)):
                doc, start, _ = pool.take(length)
                window.append((doc, start, gap))
                pool.add((doc, start + gap, length - gap))
                gap = 0
            if gap:  # everything that waited is in this window: it waits on
                for piece in window:
                    pool.add(piece)
                return
            yield tier, window


def powers_of_two(pieces: list[Piece]) -> Iterator[tuple[int, list[Piece]]]:
    """The pieces in sequences whose lengths are the powers of two of their sum."""
    rest = sum(p[2] for p in pieces)
    waiting = list(reversed(pieces))
    while rest:
        size = 1 << (rest.bit_length() - 1)
        window, gap = [], size
        while gap:
            doc, start, length = waiting.pop()
            if length > gap:
                waiting.append((doc, start + gap, length - gap))
            window.append((doc, start, min(gap, length)))
            gap -= min(gap, length)
        yield size, window
        rest -= size


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step for each window: equal tokens, one tier, attention cost balanced by dealing back and forth."""
    out, first = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}, reverse=True):
        own = [k for k, (t, _) in enumerate(windows) if t == tier]
        steps = -(-len(own) * tier // step_tokens)
        own.sort(key=lambda k: (-sum(n * n for _, _, n in windows[k][1]), k))
        for place, k in enumerate(own):
            turn, at = divmod(place, steps)
            out[k] = first + (steps - 1 - at if turn % 2 else at)
        first += steps
    return out


def packed(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: where it lies in the document and in which sequence.

    ``docs`` has ``doc_id`` and ``text``; a null or empty text is the end token alone. Rows that repeat
    a ``doc_id`` are documents of their own. ``with_ids`` adds the ids themselves (``ids``, binary).
    An empty table gives no row. Sequences of one task share a number range of their own.
    """
    path = path or vocabulary_path()
    top = tiers[-1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        sequences = steps = 0
        waiting: dict[int, tuple[int | None, np.ndarray]] = {}
        pool, windows, held = Pool(), [], 0

        def written(windows: list[tuple[int, list[Piece]]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, steps
            groups = step_groups(windows)
            rows = []
            for k, (tier, window) in enumerate(windows):
                offset = 0
                for doc, start, length in window:
                    doc_id, ids = waiting[doc]
                    raw = ids[start : start + length].tobytes()
                    rows.append((doc_id, start, length, zlib.crc32(raw), len(ids), first + sequences + k, offset, tier, first + steps + groups[k], raw))
                    offset += length
            sequences, steps = sequences + len(windows), steps + max(groups, default=-1) + 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else []
            names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"]
            n = len(names) if with_ids else len(names) - 1
            if rows:
                yield pa.RecordBatch.from_arrays(columns[:n], names[:n])

        number = 0
        for doc_id, ids in token_rows(batches, path):
            waiting[number] = (doc_id, ids)
            whole = len(ids) // top * top
            windows += [(top, [(number, start, top)]) for start in range(0, whole, top)]
            if whole < len(ids):
                pool.add((number, whole, len(ids) - whole))
            held += len(ids)
            number += 1
            if held >= BLOCK:
                windows += fill_windows(pool, tiers)
                yield from written(windows)
                kept = {p[0] for p in pool.pieces()}
                waiting = {k: v for k, v in waiting.items() if k in kept}
                windows, held = [], 0
        windows += fill_windows(pool, tiers)
        yield from written(windows + list(powers_of_two(pool.pieces())))

    return documents(docs).mapInArrow(pack, SCHEMA + ", ids binary" if with_ids else SCHEMA)
