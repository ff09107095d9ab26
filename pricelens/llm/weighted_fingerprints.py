"""Document fingerprints by consistent weighted sampling.

A text is a bag of words, each weighing as often as it occurs. For each of the fingerprint's lanes,
every term derives from its hash two gamma variables and a uniform one; they quantise the logarithm
of its weight to a step and give a race value, and the term with the least value is the lane's
sample, together with its step. Two bags have the same sample in a lane with a probability equal to
their generalised Jaccard similarity, the sum of the lesser weights over the sum of the greater ones.
So the share of equal lanes estimates it, with a standard error of at most 1 / (2 * sqrt(lanes)).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.tables import documents, buckets_for, stored
from pricelens.llm.words import mixed, word_hashes

LANES = 64
#: Texts sampled at a time, terms whose variables are made at a time.
TEXTS_AT_ONCE, TERMS_AT_ONCE = 256, 4096
_KEYS = mixed(np.arange(1, 2 * LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, LANES)


def _scattered(terms: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A number for each term and lane; the terms are mixed already, so one round more is enough."""
    x = (terms[:, None] ^ keys) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x


def _uniform(x: np.ndarray, shift: int) -> np.ndarray:
    """21 bits from ``shift`` on, as a number between 0 and 1."""
    bits = ((x >> np.uint64(shift)) & np.uint64(0x1FFFFF)).astype(np.float32)
    bits += np.float32(0.5)
    bits *= np.float32(2.0**-21)
    return bits


def _variables(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each term and lane: a gamma(2, 1), the logarithm of another, and a uniform number."""
    x, y = _scattered(terms, _KEYS[0]), _scattered(terms, _KEYS[1])
    return -np.log(_uniform(x, 43) * _uniform(x, 22)), np.log(-np.log(_uniform(y, 43) * _uniform(y, 22))), _uniform(x, 1)


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Sixteen bits for each lane; empty for a text without a word. Equal bags have equal fingerprints."""
    words, offsets = word_hashes(texts)
    terms, at = np.unique(words, return_inverse=True)
    out = []
    r, logc, beta = (
        [np.concatenate(x) for x in zip(*(_variables(terms[k : k + TERMS_AT_ONCE]) for k in range(0, len(terms), TERMS_AT_ONCE)), strict=True)]
        if len(terms)
        else (None, None, None)
    )
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        if low == high:
            out.append(np.empty(0, np.uint16))
            continue
        own, weights = np.unique(at[low:high], return_counts=True)
        least, sample = None, None
        for k in range(0, len(own), TERMS_AT_ONCE):
            part, logw = own[k : k + TERMS_AT_ONCE], np.log(weights[k : k + TERMS_AT_ONCE].astype(np.float32))[:, None]
            rp, bp = r[part], beta[part]
            step = np.floor(logw / rp + bp)
            race = logc[part] - rp * (step - bp + 1)
            best = race.argmin(axis=0)
            lanes = np.arange(race.shape[1])
            value, found = race[best, lanes], mixed(terms[part][best] + step[best, lanes].astype(np.int64).astype(np.uint64))
            if least is None:
                least, sample = value, found
            else:
                better = value < least
                least, sample = np.where(better, value, least), np.where(better, found, sample)
        out.append((sample >> np.uint64(48)).astype(np.uint16))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal lanes; two texts without a word are alike, one of them and another are not."""
    if len(a) != len(b):
        return 0.0
    return float((a == b).mean()) if len(a) else 1.0


def as_bytes(fingerprint: np.ndarray) -> bytes:
    return fingerprint.astype(">u2").tobytes()


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every document; a null text counts as empty."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                found = fingerprints([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fingerprint": [as_bytes(f).hex() for f in found]})

    return documents(docs).mapInArrow(sample, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Digests and fingerprints are bytes until the end, which halves what is written between the steps.
_RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _compared(ids: list, texts: list[str]) -> list[tuple]:
    """The result for every text but the last, each with the one after it."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    found = fingerprints(texts + changed)
    own, after = found[: len(texts)], found[len(texts) :]
    return [
        (
            ids[k],
            len(texts[k]),
            hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest(),
            as_bytes(own[k]),
            as_bytes(after[k]),
            likeness(own[k], after[k]),
            likeness(own[k], own[k + 1]),
        )
        for k, t in enumerate(changed)
    ]


def compared_with_edits(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next one, by descending ``doc_id``.

    Documents are range-partitioned and sorted by id, so a task finds every next document but that of
    its last row. The first and the last row of each task are kept and joined afterwards: two texts
    for each partition. Rows that repeat an id follow one another by their text's hash (the bounds of
    the ranges are sampled on the driver, where texts have no place), null ids come last,
    a null text counts as empty, a single document follows itself, an empty table gives no row.
    """
    plain = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    session = docs.sparkSession
    parts = buckets_for(docs, 64)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None

        def rows(kind: str, found: list[tuple], texts: list[str | None]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            arrays = [pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)]
            arrays += [pa.array([part] * len(found), pa.int64()), pa.array([kind] * len(found)), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, [*_NAMES, "part", "kind", "text"])

        edge = lambda kind, row: rows(kind, [(row[0], *[None] * 6)], [row[1]])
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                piece = batch.slice(start, TEXTS_AT_ONCE)
                pairs = list(zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True))
                if held is None:
                    yield edge("first", pairs[0])
                else:
                    pairs.insert(0, held)
                if found := _compared([p[0] for p in pairs], [p[1] for p in pairs]):
                    yield rows("row", found, [None] * len(found))
                held = pairs[-1]
        if held is not None:
            yield edge("last", held)

    spread = plain.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    done = stored(spread.mapInArrow(compare, f"{_RESULT}, part long, kind string, text string"), "fingerprints")
    firsts = done.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    here = sorted(r.next_part for r in firsts.select("next_part").collect())  # one number for each partition
    follows = session.createDataFrame([(a, b) for a, b in zip(here, here[1:] + here[:1], strict=True)], "part long, next_part long")
    lasts = done.where("kind = 'last'").select("doc_id", "text", "part").join(follows, "part").join(firsts, "next_part")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = _compared([row["doc_id"]], [row["text"], row["next_text"]])
                arrays = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), _KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, _NAMES)

    ends = lasts.select("doc_id", "text", "next_text").mapInArrow(finish, _RESULT)
    both = done.where("kind = 'row'").select(*_NAMES).union(ends)
    in_hex = ("edited_sha256", "fingerprint", "edited_fingerprint")
    return both.select(*(F.lower(F.hex(n)).alias(n) if n in in_hex else n for n in _NAMES))
