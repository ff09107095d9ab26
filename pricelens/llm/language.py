"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1. An n-gram's vector binds its letters' vectors, each
rotated by its place, by multiplication. A text's vector bundles (adds up) its n-grams' vectors, and
a language's prototype bundles its texts. A text gets the language whose prototype has the largest
cosine with it.

Letters are lower-cased; runs of anything else count as one space, so n-grams see where words begin
and end. Vectors derive from a seed and the code point alone, so workers agree without a codebook.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.tables import documents, fold

DIMENSIONS, SIZE = 1024, 3
UNKNOWN = "und"
#: Texts bundled at a time and n-grams whose vectors are made at a time: both bound a task's memory.
TEXTS_AT_ONCE, GRAMS_AT_ONCE = 1024, 16384
_NO_LETTER = regex.compile(r"\P{L}+")


@lru_cache(maxsize=4096)
def _letter(code: int, dimensions: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64([20_24, code])).integers(0, 2, dimensions, dtype=np.int8)
    return (bits * 2 - 1).astype(np.int8)


def gram_vectors(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row for each n-gram (a row of code points): the product of its letters' rotated vectors."""
    codes, at = np.unique(grams, return_inverse=True)
    letters = np.stack([_letter(int(c), dimensions) for c in codes])
    at = at.reshape(grams.shape)
    out = letters[at[:, -1]]
    for place in range(grams.shape[1] - 1):
        out = out * np.roll(letters, grams.shape[1] - 1 - place, axis=1)[at[:, place]]
    return out


def _letters_only(text: str) -> np.ndarray:
    """Code points of the lower-cased text, anything but letters as single spaces, one at each end."""
    words = _NO_LETTER.sub(" ", text.lower()).strip()
    return np.frombuffer(f" {words} ".encode("utf-32-le"), dtype="<u4") if words else np.empty(0, "<u4")


def packed_grams(text: str, size: int = SIZE) -> np.ndarray:
    """The n-grams of a text in order, each packed into one number, 21 bits a letter."""
    codes = _letters_only(text).astype(np.uint64)
    n = len(codes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    packed = codes[:n].copy()
    for k in range(1, size):
        packed = (packed << np.uint64(21)) | codes[k : n + k]
    return packed


def _unpacked(packed: np.ndarray, size: int) -> np.ndarray:
    shifts = np.arange(size - 1, -1, -1, dtype=np.uint64) * np.uint64(21)
    return ((packed[:, None] >> shifts) & np.uint64((1 << 21) - 1)).astype(np.uint32)


def bundle_of(grams: np.ndarray, counts: np.ndarray, dimensions: int = DIMENSIONS, size: int = SIZE) -> np.ndarray:
    """The sum of the vectors of ``grams``, each as often as it counts."""
    out = np.zeros(dimensions, np.float64)
    for start in range(0, len(grams), GRAMS_AT_ONCE):
        part = slice(start, start + GRAMS_AT_ONCE)
        out += counts[part].astype(np.float32) @ gram_vectors(_unpacked(grams[part], size), dimensions).astype(np.float32)
    return out


def bundles(texts: list[str | None], dimensions: int = DIMENSIONS, size: int = SIZE) -> np.ndarray:
    """One row for each text: the sum of its n-grams' vectors, zero without a letter."""
    found = [np.unique(packed_grams(t, size), return_counts=True) if t else None for t in texts]
    out = np.zeros((len(texts), dimensions), np.float32)
    own = [f[0] for f in found if f and len(f[0])]
    keys = np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64)
    for start in range(0, len(keys), GRAMS_AT_ONCE):
        part = keys[start : start + GRAMS_AT_ONCE]
        vectors = gram_vectors(_unpacked(part, size), dimensions).astype(np.float32)
        for row, f in enumerate(found):
            if f:
                low, high = np.searchsorted(f[0], part[0]), np.searchsorted(f[0], part[-1], "right")
                out[row] += f[1][low:high].astype(np.float32) @ vectors[np.searchsorted(part, f[0][low:high])]
    return out


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS, size: int = SIZE) -> dict[str, np.ndarray]:
    """Bundle the texts of every language in ``docs`` (``text``, ``lang``).

    Each task sends one vector for each language it saw, so the driver receives languages times tasks
    vectors, whatever the number of documents.
    """

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for start in range(0, len(texts), TEXTS_AT_ONCE):
                    grams = np.concatenate([packed_grams(t, size) for t in texts.iloc[start : start + TEXTS_AT_ONCE]])
                    keys, counts = np.unique(grams, return_counts=True)
                    sums[lang] = sums.get(lang, 0) + bundle_of(keys, counts, dimensions, size)
        for lang, vector in sums.items():
            yield pd.DataFrame({"lang": lang, "at": np.arange(dimensions, dtype=np.int32), "v": vector})

    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    sums = known.mapInPandas(bundle, "lang string, at int, v double").groupBy("lang", "at").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for row in sums.toPandas().itertuples():
        out.setdefault(row.lang, np.zeros(dimensions))[row.at] = row.v
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if np.linalg.norm(v) > 0}


def _best(texts: list[str | None], names: list[str], table: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The language and the cosine of each text."""
    best, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    for start in range(0, len(texts) if names else 0, TEXTS_AT_ONCE):
        vectors = bundles(texts[start : start + TEXTS_AT_ONCE], table.shape[1], size)
        norms = np.linalg.norm(vectors, axis=1)
        cosines = vectors @ table.T / np.where(norms > 0, norms, 1)[:, None]
        for k in np.flatnonzero(norms > 0):
            best[start + k] = names[int(cosines[k].argmax())]
            score[start + k] = float(np.clip(cosines[k].max(), 0, 1))
    return best, score


def _table(profiles: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    names = sorted(profiles)
    return names, np.stack([profiles[n] for n in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = SIZE) -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``score``, the cosine with that prototype (at least 0).

    A text that is null, empty or without a letter gets ``und`` and 0; so does every text when nothing
    was learned. Ties go to the language that sorts first. Repeated rows are answered one by one, and a
    text of any length as a whole. Other columns pass through; columns of the two names are replaced.
    """
    names, table = _table(profiles)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            best, score = _best(texts.tolist(), names, table, size)
            yield pd.DataFrame({"lang_pred": best, "score": score})

    guess = F.pandas_udf(predict, "lang_pred string, score double")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")))
    return docs.select(row.alias("row"), guess("text").alias("guess")).select("row.*", "guess.lang_pred", "guess.score")


#: A text of so many code points whose cosine with every prototype is lower is in no known language.
CLEAR_LENGTH, CLEAR_SCORE = 400, 0.15


def in_known_language(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` without texts that have no letter, and without long ones far from every language.
    Short texts have low cosines by chance, so they stay if they have a letter. When nothing was learned,
    every text with a letter stays."""
    names, table = _table(profiles)
    if not names:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def accept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            best, score = _best(texts.tolist(), names, table, size)
            clear = np.array([len(t or "") >= CLEAR_LENGTH for t in texts], bool)
            yield pd.Series((best != UNKNOWN) & ~(clear & (score < CLEAR_SCORE)), dtype=bool)

    return docs.where(F.pandas_udf(accept, "boolean")("text"))


def learned(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from the documents whose crc32 fold of 4 is not 2."""
    taught = docs.where(fold(F.col("doc_id").cast("long"), 4) != 2)
    return prototypes(taught.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``. Learns from the documents whose
    crc32 fold of 4 is not 2; a null language teaches nothing. An empty table gives no row."""
    held_out = (fold(F.col("doc_id").cast("long"), 4) == 2).alias("held_out")
    return identify(documents(docs), learned(docs)).select("doc_id", held_out, "lang_pred", "score")
