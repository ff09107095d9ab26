"""Scoring texts with a language model kept in a log-frequency Bloom filter.

Counts of words and word pairs are quantised to levels, ``1 + floor(log_b(count))``, and each level up
to a gram's own is entered in the filter. A gram's level is then read by probing level after level
until one is missing; the filter never misses what was entered, so a level is never read too low, and
too high only with the filter's error rate for each step. The probability of a word is smoothed:

    p(w | u) = share * c(u, w) / c(u) + (1 - share) * (c(w) + 1) / (N + V + 1)

with the middle of the level's counts for ``c``. Every text is followed by one end, which is a token
and also stands before the first word.

How the work is spread. The filter is cut into segments, one for each bucket of the grams' hashes, and their
number follows the input, so a segment stays small, the filter grows with the grams and no level is left out.
Learning sends the distinct grams of each block of texts to their buckets, with their counts, so a word costs a
bucket one entry for each block, however frequent; a bucket sums the counts, enters its grams in its segment and
stores it. Beside it stand the words' exact counts, which the base score is defined by. Scoring reads
nothing else: blocks of any texts send the hashes of their distinct words and pairs to the buckets, where each
segment is probed for them, and the levels go back to the block. A pair's count never gets there, and no
task is sent more of the filter than a segment. A block's own tokens travel with it, by way of one of the
buckets, as numbers of its distinct words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.tables import documents, fold, buckets_for, stored
from pricelens.llm.words import mixed, word_hashes

#: Base of the levels, bits and probes for each entry, weight of the pairs.
BASE, BITS, PROBES, SHARE = 1.5, 10, 7, 0.1
#: The tokens of a block, and grams probed at a time.
BLOCK, GRAMS_AT_ONCE = 1 << 20, 1 << 19
TEXTS_AT_ONCE = 256
END = np.uint64(0xE0F0_0D0C_0B0A_0908)
_PAIR, _LEVEL = np.uint64(0xD6E8FEB86659FD93), 0xA0761D6478BD642F
MAX_LEVEL = 128


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end after each, and the offsets of the texts."""
    words, offsets = word_hashes(texts)
    return np.insert(words, offsets[1:], END), offsets + np.arange(len(offsets))


def pairs_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Each token with the one before it: the bucket, and 32 bits of hash below it. An end comes before the first token.
    In a bucket few pairs share the 32 bits beside those the filter takes for each other anyway."""
    before = np.concatenate([[END], tokens[:-1]])
    hashed = mixed(before * _PAIR ^ tokens)
    return (hashed >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | hashed & np.uint64(0xFFFFFFFF)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def count_at(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level, 0 for level 0."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    high = np.maximum(np.ceil(BASE ** np.asarray(level, float) - 1e-9) - 1, low)
    return np.where(level > 0, (low + high) / 2, 0.0)


def _places(keys: np.ndarray, level: int, probe: int, sizes: np.ndarray) -> np.ndarray:
    first = mixed(keys + np.uint64(level * _LEVEL % (1 << 64)))
    step = mixed(first) | np.uint64(1)
    return (first + np.uint64(probe) * step) % sizes


def segment(keys: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The bits of one bucket's grams, packed: every level up to each gram's own."""
    size = max(64, int(level.sum()) * BITS)
    bits = np.zeros(size, bool)
    for n in range(1, int(level.max(initial=0)) + 1):
        own = keys[level >= n]
        for probe in range(PROBES):
            bits[_places(own, n, probe, np.uint64(size)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def probed(bits: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    """Levels of the keys in a segment: probe level after level until one is missing."""
    out = np.zeros(len(keys), np.int64)
    at = np.arange(len(keys) if size else 0)
    for n in range(1, MAX_LEVEL + 1):
        for probe in range(PROBES):
            place = _places(keys[at], n, probe, np.uint64(size)).astype(np.int64)
            at = at[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
        if not len(at):
            break
        out[at] = n
    return out


def _gram(pairs: np.ndarray) -> np.ndarray:
    """What a pair is entered as, apart from the words."""
    return mixed(pairs ^ _PAIR)


def log10_probabilities(single: np.ndarray, double: np.ndarray, at: np.ndarray, before: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    """For each token: ``single`` is the count of each word, ``at`` and ``before`` are the words of the token and of the
    one before it, and ``double`` is the count of each token's pair."""
    alone = (single[at] + 1) / (tokens + distinct + 1)
    after = np.minimum(double / np.maximum(single[before], 1), 1)
    return np.log10(SHARE * after + (1 - SHARE) * alone)


def _packed(pairs: np.ndarray) -> bytes:
    """Sorted pairs of one bucket, as steps: 16 low bits each, then the high bits, which are mostly small."""
    steps = np.diff((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), prepend=0)
    return len(steps).to_bytes(4, "little") + (steps & 0xFFFF).astype("<u2").tobytes() + _shrunk((steps >> 16).astype("<u2"))


def _unpacked(raw: bytes, bucket: int) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    low, high = np.frombuffer(raw, "<u2", n, 4), _grown(raw[4 + 2 * n :], "<u2")
    return np.cumsum(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(16), dtype=np.uint64) | np.uint64(bucket << 32)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
    return every[first], np.add.reduceat(np.concatenate(counts)[order], first) if len(every) else np.empty(0, np.int64)


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of sorted keys by bucket, and where each bucket begins."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Documents together until they have a block's tokens: ids, tokens, offsets."""
    ids, tokens, sizes = [], [], []
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(start, TEXTS_AT_ONCE)
            found, offsets = tokens_of([t or "" for t in part.column("text").to_pylist()])
            ids += part.column("doc_id").to_pylist()
            tokens.append(found)
            sizes.append(np.diff(offsets))
            if sum(map(len, tokens)) >= BLOCK:
                yield ids, np.concatenate(tokens), np.concatenate([[0], *sizes]).cumsum()
                ids, tokens, sizes = [], [], []
    if ids:
        yield ids, np.concatenate(tokens), np.concatenate([[0], *sizes]).cumsum()


def _shrunk(a: np.ndarray) -> bytes:
    """An array of mostly small or recurring numbers, for the shuffle."""
    return zlib.compress(a.tobytes(), 1)


def _grown(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), kind)


@dataclass
class Model:
    """The stored segments (``bucket``, ``size`` in bits, ``bits``, and the ``words`` with their ``counts``), how many there
    may be, and the tokens and distinct words learned from."""

    segments: DataFrame
    buckets: int
    tokens: int
    distinct: int


def _learned_words(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray) -> tuple[bytes, int]:
    """A bucket's segment and its size in bits."""
    level = levels(np.concatenate([counts, pair_counts]))
    return segment(np.concatenate([keys, _gram(pairs)]), level).tobytes(), max(64, int(level.sum()) * BITS)


def learned(training: DataFrame, buckets: int) -> Model:
    """The model of all texts of ``training`` (``doc_id``, ``text``), stored. Without a text nothing is known."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, _ in _blocks(batches):
            keys, counts = np.unique(tokens, return_counts=True)
            order, ends = _by_bucket(keys, buckets)
            keys, counts = keys[order], counts[order].astype("<u4")
            pairs, pair_counts = np.unique(pairs_of(tokens, buckets), return_counts=True)
            pair_ends = np.searchsorted(pairs >> np.uint64(32), np.arange(buckets + 1))
            words, both = ([slice(x, y) for x, y in zip(e[:-1], e[1:], strict=True)] for e in (ends, pair_ends))
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(range(buckets), pa.int32()),
                    "keys": pa.array([keys[p].tobytes() for p in words], pa.binary()),
                    "counts": pa.array([_shrunk(counts[p]) for p in words], pa.binary()),
                    "pairs": pa.array([_packed(pairs[p]) for p in both], pa.binary()),
                    "pair_counts": pa.array([_shrunk(pair_counts[p].astype("<u4")) for p in both], pa.binary()),
                }
            )

    def enter(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        grown = lambda name: [_grown(c, "<u4").astype(np.int64) for c in rows[name]]
        keys, counts = _summed([np.frombuffer(k, np.uint64) for k in rows["keys"]], grown("counts"))
        bits, size = _learned_words(keys, counts, *_summed([_unpacked(p, bucket) for p in rows["pairs"]], grown("pair_counts")))
        return pd.DataFrame(
            {"bucket": [bucket], "size": [size], "bits": [bits], "words": [keys.tobytes()], "counts": [_shrunk(counts)], "tokens": [int(counts.sum())], "distinct": [len(keys)]}
        )

    sent = training.mapInArrow(count, "bucket int, keys binary, counts binary, pairs binary, pair_counts binary")
    schema = "bucket int, size long, bits binary, words binary, counts binary, tokens long, distinct long"
    segments = stored(sent.groupBy("bucket").applyInPandas(enter, schema), "segments")
    total = segments.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    return Model(segments.drop("tokens", "distinct"), buckets, total.tokens or 0, total.distinct or 0)


_DOCS = "docs binary, low binary, high binary"
_BLOCK = f"block long, bucket int, keys binary, pairs binary, {_DOCS}"
_ABOUT = np.dtype([("id", "<i8"), ("known", "?"), ("tokens", "<i8")])


def _asked(parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct numbers of all parts, and where each part's are among them."""
    every, at = np.unique(np.concatenate(parts), return_inverse=True)
    return every, np.split(at, np.cumsum([len(p) for p in parts])[:-1])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.
    The texts need not be those that the model has learned from. Cases as in ``scored``."""
    buckets, n_train, n_distinct = model.buckets, model.tokens, model.distinct

    def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        names = [x.split()[0] for x in _BLOCK.split(", ")]
        for ids, tokens, offsets in _blocks(batches):
            keys, at = np.unique(tokens, return_inverse=True)
            order, ends = _by_bucket(keys, buckets)
            rank = np.empty(len(keys), np.int64)
            rank[order] = np.arange(len(keys))
            at, keys = rank[at], keys[order]
            pairs = np.unique(pairs_of(tokens, buckets))
            pair_ends = np.searchsorted(pairs >> np.uint64(32), np.arange(buckets + 1))
            about = np.zeros(len(ids), _ABOUT)
            about["id"], about["known"] = [i or 0 for i in ids], [i is not None for i in ids]
            about["tokens"] = np.diff(offsets)
            own = (about.tobytes(), _shrunk(at.astype("<u2")), _shrunk((at >> 16).astype("<u2")))
            rows, home = [], int(mixed(np.array([block], np.uint64))[0] % np.uint64(buckets))
            for b in range(buckets):
                part, both = slice(ends[b], ends[b + 1]), slice(pair_ends[b], pair_ends[b + 1])
                if b == home or part.start < part.stop or both.start < both.stop:
                    rows.append((block, b, keys[part].tobytes(), _packed(pairs[both]), *(own if b == home else [None] * 3)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            block += 1

    def answer(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({name.split()[0]: [] for name in _ANSWER.split(", ")})
        bits, size = (np.frombuffer(own["bits"].iloc[0], np.uint8), int(own["size"].iloc[0])) if len(own) else (np.empty(0, np.uint8), 0)
        keys, where = _asked([np.frombuffer(k, np.uint64) for k in rows["keys"]])
        pairs, pair_where = _asked([_unpacked(p, int(b)) for p, b in zip(rows["pairs"], rows["bucket"], strict=True)])
        read = lambda grams: np.concatenate([probed(bits, size, grams[k : k + GRAMS_AT_ONCE]) for k in range(0, max(len(grams), 1), GRAMS_AT_ONCE)]).astype(np.uint8)
        word_level, pair_level = read(keys), read(_gram(pairs))
        counts = np.zeros(len(keys), np.int64)
        if len(own):
            words, known = np.frombuffer(own["words"].iloc[0], np.uint64), _grown(own["counts"].iloc[0], np.int64)
            at = np.minimum(np.searchsorted(words, keys), max(len(words) - 1, 0))
            if len(words):
                counts = np.where(words[at] == keys, known[at], 0)
        out = pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "keys": rows["keys"], "counts": [_shrunk(counts[w]) for w in where]})
        out["levels"] = [_shrunk(word_level[w]) for w in where]
        out["pair_levels"] = [_shrunk(pair_level[w]) for w in pair_where]
        return out.join(rows[["docs", "low", "high"]])

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        joined = lambda name, kind: np.concatenate([_grown(x, kind) for x in rows[name]])
        words, counts = np.frombuffer(b"".join(rows["keys"]), np.uint64), joined("counts", np.int64)
        single, double = (count_at(joined(n, np.uint8)) for n in ("levels", "pair_levels"))
        home = rows[rows["docs"].notna()].iloc[0]
        about = np.frombuffer(home["docs"], _ABOUT)
        at = _grown(home["low"], "<u2").astype(np.int64) | _grown(home["high"], "<u2").astype(np.int64) << 16
        _, pair_at = np.unique(pairs_of(words[at], buckets), return_inverse=True)
        # The end that closes the block also stands before its first token.
        before, first = np.concatenate([at[-1:], at[:-1]]), np.cumsum(about["tokens"]) - about["tokens"]
        score = log10_probabilities(single, double[pair_at], at, before, n_train, n_distinct)
        return pd.DataFrame(
            {
                "doc_id": pd.array(about["id"], "Int64").copy() if about["known"].all() else pd.arrays.IntegerArray(about["id"].copy(), ~about["known"]),
                "n_tokens": about["tokens"],
                "n_known": np.add.reduceat((counts[at] > 0).astype(np.int64), first),
                "train_tokens": n_train,
                "base_score": np.add.reduceat(np.log10((counts + 1) / (n_train + n_distinct + 1))[at], first),
                "score": np.add.reduceat(score, first),
            }
        )

    asked = documents(docs).mapInArrow(block_rows, _BLOCK).groupBy("bucket")
    back = asked.cogroup(model.segments.groupBy("bucket")).applyInPandas(answer, _ANSWER)
    return back.groupBy("block").applyInPandas(
        finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


_ANSWER = f"block long, bucket int, keys binary, counts binary, levels binary, pair_levels binary, {_DOCS}"


def scored(docs: DataFrame, folds: int = 7, out: int = 2) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    A null or empty text is one end. Rows that repeat a ``doc_id`` are documents of their own. Without a
    training document nothing is known and the scores are those of counts of 0. No row for an empty table.
    """
    held_out = fold(F.col("doc_id"), folds) == out
    model = learned(documents(docs).where(~held_out), buckets_for(docs, 12))
    return scores(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
