"""Token ids of documents by a tokenizer file, ready to be packed."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa

from pricelens.llm.chunks import ChunkEncoder

VOCABULARY = "byte_bpe_50k.json"
END = 1
#: How the vocabulary writes a space and a line feed.
_OPENING = ("\u0120", "\u010a")
#: Documents encoded at a time.
TEXTS_AT_ONCE = 256


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """An encoder by a ``tokenizers`` file, built once in each worker. Special tokens' strings in a text
    are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a task for each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode_all(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    opens = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, at in tokenizer.get_vocab().items():
        opens[at] = token[:1] in _OPENING
    return ChunkEncoder(encode_all, opens)


def token_rows(batches: Iterator[pa.RecordBatch], path: str, end: int = END) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document's id and its token ids followed by ``end``; a null text counts as empty."""
    encode = encoder(path)
    closing = np.array([end], "<u4")
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(start, TEXTS_AT_ONCE)
            ids, bounds = encode.flat([t or "" for t in part.column("text").to_pylist()])
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                yield doc_id, np.concatenate([ids[a:b], closing])
