"""Language ID by string kernels: blended-spectrum n-gram presence, Nyström landmarks, kernel ridge regression.

Two texts' kernel is, for each n, the number of (hashed) n-grams that both have, over the
geometric mean of their numbers of n-grams, blended over n by weight.  It is taken against a
few landmark texts only; the Nyström map of these values is the input of one ridge regression
a language (one against the rest).  A batch of texts is scored by two matrix products.

Training reads a sample of labelled rows, at most MAX_TRAIN and as many of each of the
MAX_LANGUAGES most frequent languages as there are.  Rows are chosen by a hash of id and text,
repeated rows once, so reruns agree.  Executors send bit sets of fixed
size, whatever the texts' length.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Rows learned from and landmarks, or as many for each language where that is more.
MAX_TRAIN, LANDMARKS, LANGUAGE_ROWS, LANGUAGE_LANDMARKS = 1_200, 96, 12, 2
RIDGE, SHARPNESS = 1e-3, 6.0
#: Rows of one matrix product when learning.
FIT_ROWS = 1_000
#: n, size of its hashed space, weight in the blend.
SPECTRA = ((1, 1 << 10, 0.2), (2, 1 << 12, 0.3), (3, 1 << 13, 0.5))
WIDTH = sum(size for _, size, _ in SPECTRA)
#: Texts, and characters, of one matrix product.
BATCH_TEXTS, BATCH_CHARS = 256, 1_000_000
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: Below 0x3000 others than letters become spaces; above, all chars stay.
_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(0x3000)], np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def presence(texts: list[str]) -> np.ndarray:
    """Which hashed n-grams each whole text has: bools, one row a text."""
    out = np.zeros((len(texts), WIDTH), bool)
    codes = np.frombuffer("".join(f" {t} " for t in texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    # lower-casing may lengthen a text, so rows are counted on the folded texts
    row = np.repeat(np.arange(len(texts)), [len(t.lower()) + 2 for t in texts])
    codes = np.where(codes < 0x3000, _FOLD[np.minimum(codes, 0x2FFF)], codes)
    key = np.zeros(len(codes), np.uint32)
    flat, base = out.reshape(-1), 0
    for n, size, _ in SPECTRA:
        if n > len(codes):
            break
        key = key[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :]
        whole = row[: len(key)] == row[n - 1 :]
        mixed = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - (size.bit_length() - 1))
        flat[(row[: len(key)] * WIDTH + base + mixed)[whole]] = True
        base += size
    return out


def scaled(present: np.ndarray) -> np.ndarray:
    """Rows whose inner product is the blended kernel."""
    out, base = present.astype(np.float32), 0
    for _, size, weight in SPECTRA:
        block = out[:, base : base + size]
        block *= np.sqrt(weight / np.maximum(block.sum(1, keepdims=True), 1)).astype(np.float32)
        base += size
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def decide(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best language and its score for each text."""
        kernel = scaled(presence(texts)) @ self.landmarks.T
        points = kernel @ self.weights
        shares = np.exp(SHARPNESS * (points - points.max(1, keepdims=True)))
        shares /= shares.sum(1, keepdims=True)
        best = points.argmax(1)
        return best, shares[np.arange(len(texts)), best]


def fit(present: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel | None:
    """Kernel ridge regression on the Nyström map; languages: the label of each row. None without rows."""
    if not len(languages):
        return None
    names = sorted(set(languages))
    label = np.searchsorted(names, languages)
    # landmarks: as many of each language as there are, first come
    place = pd.Series(label).groupby(label).cumcount().to_numpy()
    chosen = np.argsort(place, kind="stable")[: max(landmarks, LANGUAGE_LANDMARKS * len(names))]
    marks = scaled(present[chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-6 * values.max()
    back = vectors[:, good] / np.sqrt(values[good])
    z = np.concatenate([(scaled(present[at : at + FIT_ROWS]) @ marks.T) @ back for at in range(0, len(present), FIT_ROWS)])
    share = np.bincount(label)[label]
    weight = (1 / share)[:, None]
    target = (label[:, None] == np.arange(len(names))).astype(float)
    solved = np.linalg.solve(z.T @ (weight * z) + ridge * np.eye(z.shape[1]), z.T @ (weight * target))
    return LanguageModel(names, marks, (back @ solved).astype(np.float32))


def sample(docs: DataFrame, learn: Column, id: str, text: str, lang: str, most: int = MAX_TRAIN) -> tuple[np.ndarray, list[str]]:
    """Presence rows and languages of a sample of the rows where `learn` holds.

    Drawn are about `most` rows, or LANGUAGE_ROWS for each language where that is more, equally
    many of each language that has as many.
    """
    usable = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), learn.alias("learn")).filter("learn and lang is not null and text is not null")
    counts = usable.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return np.zeros((0, WIDTH), bool), []
    most = max(most, LANGUAGE_ROWS * languages)
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    # a row a language: as many as the model has columns
    counted = usable.join(F.broadcast(counts), F.col("lang") == F.col("of"))
    chance = F.least(F.lit(1.0), F.lit(most / languages) / F.col("n")) * (1 << 30)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[has_letter(t) for t in batch["text"]]]
            bits = [np.packbits(presence([text])[0]).tobytes() for text in batch["text"]]
            yield pd.DataFrame({"place": batch["place"].to_numpy(), "bits": bits, "lang": batch["lang"].to_numpy()})

    # each different row once, before any text is looked at; the hash decides who goes beyond the bound
    drawn = counted.select(place.alias("place"), "text", "lang", chance.alias("chance")).filter(F.col("place") < F.col("chance")).groupBy("place", "lang").agg(F.min("text").alias("text"))
    rows = drawn.mapInPandas(packed, "place long, bits binary, lang string").orderBy("place", "lang").limit(2 * most).toPandas()
    if not len(rows):
        return np.zeros((0, WIDTH), bool), []
    bits = np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(len(rows), -1)
    return np.unpackbits(bits, axis=1)[:, :WIDTH].astype(bool), rows["lang"].tolist()


def with_language(docs: DataFrame, learn: Column, into: str = "language", id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MAX_TRAIN) -> DataFrame:
    """`docs` with a struct column `into`: lang (a learned language) and score (0 to 1).

    Texts that are null or have no letter are `und` with score 0; so is every text if no row
    can be learned from.  Only the text is scored.  Rows where `learn` is null are not learned
    from.  Ties go to the first language by name.  `into` is lengthened by `_` where `docs` has
    a column of that name in any case.  Rows may repeat.
    """
    model = fit(*sample(docs, learn, id, text, lang, most))

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            held: list[int] = []
            chars = 0

            def flush() -> None:
                if held:
                    best, score = model.decide([texts[i] for i in held])
                    names[held] = [model.languages[b] for b in best]
                    scores[held] = score
                    held.clear()

            texts = batch.tolist()
            for i, t in enumerate(texts):
                if model is not None and has_letter(t):
                    if held and (len(held) >= BATCH_TEXTS or chars + len(t) > BATCH_CHARS):
                        flush()
                        chars = 0
                    held.append(i)
                    chars += len(t)
            flush()
            yield pd.DataFrame({"lang": names, "score": scores})

    return docs.withColumn(free_name(docs, into), predict(F.col(f"`{text}`")))
