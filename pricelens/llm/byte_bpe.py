"""Byte-level BPE by backtracking, and its inverse.

Bytes are mapped to Latin-1 characters, so one automaton over the vocabulary finds, for every place
of a piece, the longest token that starts there. Encoding goes left to right with the longest token
that is compatible with the one before; where none is, it takes back a token and tries that token's
next shorter prefix. Places from which the rest cannot be encoded are remembered, so each is given
up once and the work is linear in the piece.

Two adjacent tokens are compatible if merging their bytes by rank would keep the boundary between
them: undoing the merges of both, latest first, no earlier merge may join the two touching parts.
The answer depends on the two tokens only and is memoised.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.chunks import ChunkEncoder, ids_of
from pricelens.llm.tables import documents

RANKS = "byte_bpe_50k.tiktoken"
#: Pairs whose compatibility is remembered, and texts encoded at a time.
REMEMBERED, TEXTS_AT_ONCE = 1_000_000, 256
_NONE = -1


class Vocabulary:
    """Tokens by rank, and what backtracking needs to know about each."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t.decode("latin-1"): r for r, t in enumerate(tokens)}
        self.length = [len(t) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for text, r in self.rank.items():
            self.automaton.add_word(text, (r, len(text)))
        self.automaton.make_automaton()
        self.shorter = [self._shorter(t) for t in self.rank]
        self.known: dict[int, bool] = {}
        self.merged: dict[int, int] = {}
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        for text, r in self.rank.items():
            self._learn_merge(text, r)
        self.known.clear()

    def _shorter(self, text: str) -> int:
        """The longest token that is a proper prefix."""
        return next((self.rank[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.rank), _NONE)

    def _learn_merge(self, text: str, r: int) -> None:
        """Which two tokens merge into this one: the split whose halves would stay apart until this rank."""
        head = self.shorter[r]
        while head != _NONE:
            tail = self.rank.get(text[self.length[head] :], _NONE)
            if tail != _NONE and head < r and tail < r and self._apart(head, tail):
                self.merged[head << 20 | tail] = r
                self.left[r], self.right[r] = head, tail
                return
            head = self.shorter[head]

    def _apart(self, a: int, b: int) -> bool:
        limit = 1 << 40
        while True:
            if self.merged.get(a << 20 | b, 1 << 40) < limit:
                return False
            if a > b:  # a was made by the later merge, so it is undone first
                limit, part = a, self.right[a]
                if part != a:
                    a = part
                    continue
                limit, part = b + 1, self.left[b]
                if part == b:
                    return True
                b = part
            else:
                limit, part = b + 1, self.left[b]
                if part != b:
                    b = part
                    continue
                limit, part = a, self.right[a]
                if part == a:
                    return True
                a = part

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        answer = self.known.get(key)
        if answer is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            answer = self.known[key] = self._apart(a, b)
        return answer

    def encode(self, piece: str) -> list[int]:
        """Ids of one piece, given as Latin-1 text of its bytes. A piece that is a token is that token."""
        if piece in self.rank:
            return [self.rank[piece]]
        n = len(piece)
        longest = [_NONE] * n
        for end, (r, length) in self.automaton.iter(piece):
            longest[end + 1 - length] = r  # ends rise, so the last one seen for a start is the longest
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + self.length[token]
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            while self.shorter[token] == _NONE:  # nothing fits here: give the place up and go back one token
                open_at[at] = 0
                token = out.pop()
                at -= self.length[token]
            token = self.shorter[token]


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.vocabulary = Vocabulary(tokens)
        self.pieces = regex.compile(pattern).findall
        self.encode_texts = ChunkEncoder(self._encode_all)

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        encode = self.vocabulary.encode
        return [
            np.array([i for p in self.pieces(t) for i in encode(p.encode("utf-8").decode("latin-1"))], "<u4").tobytes()
            for t in texts
        ]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, built once in each worker."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    return Codec([token for _, token in ranked], pattern)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Every row of ``docs`` with ``ids`` (little-endian unsigned 32-bit) and ``decoded`` (bytes). A null text
    counts as empty, repeated rows are answered one by one, and a text of any length as a whole; columns of
    these names are replaced."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for texts in batches:
            ids = own.encode_texts([t or "" for t in texts])
            yield pd.DataFrame({"ids": ids, "decoded": [own.decode(ids_of(x)) for x in ids]})

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("ids", "decoded")))
    coded = F.pandas_udf(encode, "ids binary, decoded binary")("text")
    return docs.select(row.alias("row"), coded.alias("coded")).select("row.*", "coded.ids", "coded.decoded")


def digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, over the ids and the
    bytes that ``encoded`` gives. A null text counts as empty; an empty table gives no row."""
    path = path or public_tokenizers.path(RANKS)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                ids = own.encode_texts([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                        "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                        "decoded_sha256": [hashlib.sha256(own.decode(ids_of(x))).hexdigest() for x in ids],
                    }
                )

    return documents(docs).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
