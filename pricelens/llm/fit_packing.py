"""Best-fit-decreasing packing into id matrices.

A document longer than a row is split without loss: full rows first, then its remainder. Pieces are
taken from long to short, and each goes to the open row with the least room that still holds it. A
segment tree over the possible rooms finds that row in logarithmic time; ties go to the row opened
last. A row is one line of the id matrix, padded at its end; beside it stand the cumulative segment
lengths, and the positions, which restart at zero with every segment.

Every task packs what it reads, ``BLOCK`` tokens at a time, so memory is bounded and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pricelens.llm.tables import documents
from pricelens.llm.tokens import token_rows, vocabulary_path

#: Tokens of a row, tokens packed together, and the id that fills a row up.
ROW, BLOCK, PAD = 2048, 4 << 20, 0
ROWS_AT_ONCE = 512
SCHEMA = (
    "row_id long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, "
    "doc_ids array<bigint>, starts array<bigint>"
)


class Rooms:
    """Open rows by the room left, in a segment tree whose nodes count the rows below them."""

    def __init__(self, row: int):
        self.size = 1 << row.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the least room from ``least`` up, and that room."""
        node = least + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up until a right sibling has rows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:  # down to its leftmost row
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._change(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: Sequence[int], row: int = ROW) -> list[list[int]]:
    """Which pieces each row holds, in the order they were put there."""
    lengths = np.asarray(lengths, np.int64)
    rooms, rows = Rooms(row), []
    order = np.argsort(-lengths, kind="stable")
    for k, length in zip(order.tolist(), lengths[order].tolist()):
        found = rooms.take(length) if length < row else None
        if found is None:
            found = len(rows), row
            rows.append([])
        at, room = found
        rows[at].append(k)
        if room > length:
            rooms.put(room - length, at)
    return rows


def _cells(values: np.ndarray, row: int) -> pa.Array:
    """One binary value for each ``row`` values."""
    offsets = np.arange(0, values.nbytes + 1, row * values.itemsize, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def matrices(docs: DataFrame, path: str | None = None, row: int = ROW, pad: int = PAD) -> DataFrame:
    """One line for each row of the matrix.

    ``ids`` holds ``row`` little-endian unsigned 32-bit ids, ``positions`` as many unsigned 16-bit places.
    ``cu_seqlens`` runs from 0 to ``n_tokens``; segment k is that of ``doc_ids[k]`` from token ``starts[k]``.
    A null or empty text is the end token alone; repeated rows are packed one by one, pieces of equal length in
    the order of the rows; an empty table gives no row.
    """
    path = path or vocabulary_path()
    if row > 1 << 16:
        raise ValueError("a row has at most 65,536 places")

    def lines(held: list[tuple[int | None, np.ndarray]], first: int) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([ids for _, ids in held]) if held else np.empty(0, "<u4")
        sizes = np.array([len(ids) for _, ids in held], np.int64)
        count = -(-sizes // row)  # pieces of each document
        doc = np.repeat(np.arange(len(held)), count)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * row
        length = np.minimum(sizes[doc] - start, row)
        source = (np.cumsum(sizes) - sizes)[doc] + start
        names = pa.array([doc_id for doc_id, _ in held], pa.int64())
        rows = best_fit(length, row)
        for begin in range(0, len(rows), ROWS_AT_ONCE):
            part = rows[begin : begin + ROWS_AT_ONCE]
            piece = np.concatenate([np.asarray(r, np.int64) for r in part])
            held_by = np.repeat(np.arange(len(part)), [len(r) for r in part])
            own = length[piece]
            ends = np.cumsum(own)
            opens = np.searchsorted(held_by, np.arange(len(part)))  # each row's first piece
            before = ends - own
            offset = before - before[opens][held_by]
            inside = np.arange(ends[-1]) - np.repeat(before, own)  # each token's place in its piece
            target = np.repeat(held_by * row + offset, own) + inside
            ids, positions = np.full(len(part) * row, pad, "<u4"), np.zeros(len(part) * row, "<u2")
            ids[target] = tokens[np.repeat(source[piece], own) + inside]
            positions[target] = inside
            cu = np.zeros(len(piece) + len(part), np.int32)
            cu[np.arange(len(piece)) + held_by + 1] = offset + own
            pieces_of = np.append(opens, len(piece)).astype(np.int32)
            cu_of = pieces_of + np.arange(len(part) + 1, dtype=np.int32)
            columns = [
                pa.array(np.arange(first + begin, first + begin + len(part))),
                pa.array(np.add.reduceat(own, opens).astype(np.int32)),
                _cells(ids, row),
                pa.ListArray.from_arrays(pa.array(cu_of), pa.array(cu)),
                _cells(positions, row),
                pa.ListArray.from_arrays(pa.array(pieces_of), names.take(pa.array(doc[piece]))),
                pa.ListArray.from_arrays(pa.array(pieces_of), pa.array(start[piece])),
            ]
            yield pa.RecordBatch.from_arrays(columns, [column.split()[0] for column in SCHEMA.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        held, tokens = [], 0
        for doc_id, ids in token_rows(batches, path):
            held.append((doc_id, ids))
            tokens += len(ids)
            if tokens >= BLOCK:
                for out in lines(held, first):
                    first += out.num_rows
                    yield out
                held, tokens = [], 0
        yield from lines(held, first)

    return documents(docs).mapInArrow(pack, SCHEMA)


def unpacked(matrix: DataFrame) -> DataFrame:
    """The pieces of the matrix again: ``doc_id``, ``start``, ``ids``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                for k, (doc_id, start) in enumerate(zip(x["doc_ids"], x["starts"], strict=True)):
                    rows.append((doc_id, start, x["ids"][4 * x["cu_seqlens"][k] : 4 * x["cu_seqlens"][k + 1]]))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
                ["doc_id", "start", "ids"],
            )

    return matrix.select("ids", "cu_seqlens", "doc_ids", "starts").mapInArrow(cut, "doc_id long, start long, ids binary")
