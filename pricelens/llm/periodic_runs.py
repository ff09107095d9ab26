"""Periodic runs of words, by a dictionary of basic factors.

The dictionary names, for each power of two, the stretches of that many words: equal stretches of a
document get equal names, and a name of twice the length is the pair of the names of its halves. Where an
occurrence and its successor lie within twice the stretch's length (they touch or overlap), they and those
after them form an arithmetic progression, whose difference is a period. Progressions of neighbouring
places with the same difference join, which extends a proposed period over its whole run, to the word on
either side that breaks it: a run [s, e) of period q has such successors at s, s + 1, ..., e - q - length,
and at no place beside them. A period belongs to the shortest power of two that holds it, so no run comes
out twice. It is the smallest one, because in a run of a smaller period the successor would be nearer.

A stretch that occurs once in its document has no successor, and neither has any longer one that holds it.
Only places that still repeat go on to the next length, which in plain prose is few. Documents are handled
many at a time in numpy, nothing is shuffled, and memory follows the block of texts and the longest text.
Words are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pricelens.llm.tables import documents
from pricelens.llm.words import mixed, word_hashes, word_places

#: A run has at least so many periods and words.
PERIODS, LEAST_WORDS = 4, 6
#: Characters of texts handled together (a longer text is handled alone), and words written out at a time.
BLOCK, WORDS_AT_ONCE = 1 << 21, 1 << 16
SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


class Runs(NamedTuple):
    """Runs in order of start and period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and a number from 0 for each of those keys, in the order of the places kept."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    repeats = np.zeros(len(keys), bool)
    repeats[1:] = same
    repeats[:-1] |= same
    opens = np.append(True, ~same) if len(keys) else np.empty(0, bool)
    # A key that occurs once opens a group but is not counted.
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(opens & repeats) - 1
    kept = np.empty(len(keys), bool)
    kept[order] = repeats
    return kept, names[kept]


def _successors(places: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Distance to the next place with the same name, 0 where there is none. Places rise."""
    order = np.argsort(names, kind="stable")
    out = np.zeros(len(places), np.int64)
    same = names[order][1:] == names[order][:-1]
    out[order[:-1][same]] = (places[order][1:] - places[order][:-1])[same]
    return out


def runs_of(words: np.ndarray, offsets: np.ndarray, periods: int = PERIODS, least: int = LEAST_WORDS) -> Runs:
    """All runs of at least ``periods`` periods and ``least`` words in the documents whose words, as 64-bit numbers,
    stand one after the other; document ``d`` holds ``words[offsets[d]:offsets[d + 1]]``. ``start`` counts over all
    documents. ``periods`` is 3 or more."""
    sizes = np.diff(offsets)
    document = np.repeat(np.arange(len(sizes)), sizes)
    # The document is part of a word's name, so nothing repeats across documents.
    kept, names = _named(words ^ mixed(document.astype(np.uint64) + np.uint64(1)))
    places = np.flatnonzero(kept)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    length = 1
    while len(places):
        apart = _successors(places, names)
        apart[(apart > length) | (apart <= length // 2)] = 0  # this length's periods
        joins = (apart[1:] == apart[:-1]) & (places[1:] == places[:-1] + 1)
        first = np.flatnonzero(np.append(True, ~joins) & (apart > 0))
        if len(first):
            ends = np.append(np.flatnonzero(~joins), len(places) - 1)
            last = ends[np.searchsorted(ends, first)]
            period = apart[first]
            whole = places[last] - places[first] + period + length
            long = whole >= np.maximum(least, periods * period)
            found.append((places[first][long], whole[long], period[long]))
        # Periods above this length need documents of more than `periods` times as many words.
        at = np.searchsorted(places, places + length)
        second = np.minimum(at, len(places) - 1)
        both = (places[second] == places + length) & (sizes[document[places]] > periods * length)
        both &= document[places] == document[places[second]]
        first_half, places = names[both], places[both]
        kept, names = _named(first_half * (int(names.max()) + 1) + names[second[both]])
        places = places[kept]
        length *= 2
    if not found:
        return Runs(*[np.empty(0, np.int64)] * 3)
    start, whole, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return Runs(start[order], whole[order], period[order])


def repeated_words(runs: Runs, n_words: int) -> np.ndarray:
    """Which words lie in a run after its first period."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, runs.start + runs.period, 1)
    np.add.at(change, runs.start + runs.length, -1)
    return np.cumsum(change[:-1]) > 0


def recurring_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the documents, by their id's crc32: which original word stands at each place once the words
    from some place on recur with some period. None where the text stays as it is (also without an id)."""
    if doc_id is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def _joined(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
    """The given words of a text, joined by one space, some thousand at a time."""
    for at in range(0, len(starts), WORDS_AT_ONCE):
        s, z = starts[at : at + WORDS_AT_ONCE], sizes[at : at + WORDS_AT_ONCE] + 1  # each word with a space before it
        ends = np.cumsum(z)
        out = raw[np.repeat(s - 1 - (ends - z), z) + np.arange(ends[-1])]
        out[ends - z] = 0x20
        yield out.tobytes() if at else out[1:].tobytes()


def _analysed(ids: list, texts: list[str]) -> list[tuple]:
    words, offsets = word_hashes(texts, lower=False)
    raw = np.frombuffer(b"\n" + b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts) + b"\n", np.uint8)
    starts, ends = word_places(raw.tobytes())
    orders = [recurring_order(d, int(n)) for d, n in zip(ids, np.diff(offsets), strict=True)]
    for first, order in zip(offsets, orders):
        if order is not None:
            order += first
            for x in (words, starts, ends):
                x[first : first + len(order)] = x[order]
    runs = runs_of(words, offsets)
    kept = ~repeated_words(runs, len(words))
    bounds = np.searchsorted(runs.start, offsets)
    rows = []
    for k, doc_id in enumerate(ids):
        first, stop = offsets[k], offsets[k + 1]
        start, length, period = (x[bounds[k] : bounds[k + 1]] for x in runs)
        start = start - first
        listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist())).encode())
        collapsed = hashlib.sha256()
        own = np.flatnonzero(kept[first:stop]) + first
        for piece in _joined(raw, starts[own], ends[own] - starts[own]):
            collapsed.update(piece)
        best: tuple = (None,) * 4
        if len(start):
            i = int(np.argmax(length))  # the first of the longest, in order of start and period
            best = (int(start[i]), int(length[i]), int(period[i]), 1000 * int(length[i]) // int(period[i]))
        rows.append((doc_id, len(start), *best, listed.hexdigest(), collapsed.hexdigest()))
    return rows


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            text = text.as_py() or ""
            if texts and size + len(text) > BLOCK:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id.as_py())
            texts.append(text)
            size += len(text)
    if texts:
        yield ids, texts


def with_runs(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id`` and ``runs``, all its runs as (start, length, period) in words, by start and period.

    Words are the text's runs of characters other than space and 0x09 to 0x0D, numbered from 0 and compared as they
    are. A null or empty text has none. Every row is answered by itself, so repeated rows give repeated answers;
    an empty table gives none. A text of any length is handled whole, in memory of some hundred bytes a word.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            words, offsets = word_hashes(texts, lower=False)
            runs = runs_of(words, offsets)
            bounds = np.searchsorted(runs.start, offsets)
            inside = runs.start - np.repeat(offsets[:-1], np.diff(bounds))
            fields = [pa.array(x, pa.int64()) for x in (inside, runs.length, runs.period)]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["doc_id", "runs"])

    return documents(docs).mapInArrow(find, "doc_id long, runs array<struct<start: long, length: long, period: long>>")


def without_runs(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id`` and ``text``, where of each run only the first period is left and words are joined by
    one space. Cases as in ``with_runs``; a null text becomes empty."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            words, offsets = word_hashes(texts, lower=False)
            kept = ~repeated_words(runs_of(words, offsets), len(words))
            raw = np.frombuffer(b"\n" + b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts) + b"\n", np.uint8)
            starts, ends = word_places(raw.tobytes())
            own = [np.flatnonzero(kept[a:b]) + a for a, b in zip(offsets, offsets[1:])]
            out = [b"".join(_joined(raw, starts[x], ends[x] - starts[x])).decode("utf-8", "surrogatepass") for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["doc_id", "text"])

    return documents(docs).mapInArrow(collapse, "doc_id long, text string")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: the runs of each document once a tenth of the documents has been made to recur (see
    ``recurring_order``), its longest run, and digests of the list of runs and of the words left. Of equally long
    runs the first one counts, then the one of the smaller period. Other cases as in ``with_runs``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [column.split()[0] for column in SCHEMA.split(", ")]
        types = [pa.string() if "string" in column else pa.int64() for column in SCHEMA.split(", ")]
        for ids, texts in _blocks(batches):
            columns = zip(*_analysed(ids, texts), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return documents(docs).mapInArrow(digest, SCHEMA)
