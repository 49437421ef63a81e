"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on hashed words and word beginnings is trained in numpy from confirmed toxic texts (P) and
unlabelled ones (U).  With class prior p its risk is

    p * R+(P) + max(0, R-(U) - p * R-(P)),

the second part being the risk on clean texts, of which only a mixture is seen; where it turns
negative, a step is taken to raise it instead (non-negative correction).

Training reads at most MAX_POSITIVE and MAX_UNLABELLED rows, drawn by a hash of id and text,
repeated rows once; the words that tell P from U best are kept.  Scoring is one pass over whole texts, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

MAX_POSITIVE, MAX_UNLABELLED, SIZE, KEPT = 1_500, 6_000, 1 << 18, 256
#: Lengths of word beginnings in bytes.
STEMS = (4, 5, 6, 7, 8)
#: Prior where no label says one; steps, their length, weight penalty, tolerance and pace of the correction.
PRIOR, STEPS, RATE, PENALTY, BETA, GAMMA = 0.1, 400, 0.1, 2e-4, 0.0, 1.0
#: Words of one scored batch, and words whose columns a task remembers.
BATCH_WORDS, MEMO = 400_000, 200_000

#: ASCII other than letters and digits separates words; other chars belong to words.
_SEPARATE = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SEPARATE).lower().split()


def places_of(word: bytes) -> list[int]:
    """Hashed places of a word and of its beginnings, which inflected forms share."""
    parts = [word, *(b"^" + word[:n] for n in STEMS if len(word) >= n)]
    return [xxhash.xxh64_intdigest(part) % SIZE for part in parts]


@dataclass
class ToxicModel:
    places: np.ndarray  # ascending
    weights: np.ndarray
    bias: float
    #: Columns of words seen before, up to MEMO of them.
    seen: dict[bytes, list[int]] = field(default_factory=dict)

    def columns_of(self, words: Sequence[bytes]) -> list[list[int]]:
        if len(self.seen) > MEMO:
            self.seen.clear()
        if not hasattr(self, "index"):
            self.index = {p: i for i, p in enumerate(self.places.tolist())}
        for w in words:
            if w not in self.seen:
                self.seen[w] = [self.index[p] for p in places_of(w) if p in self.index]
        return [self.seen[w] for w in words]

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        start = 0
        while start < len(texts):
            split, n = [], 0
            for t in texts[start:]:
                own = words_of(t)
                if split and n + len(own) > BATCH_WORDS:
                    break
                split.append(own)
                n += len(own)
            flat = np.empty(n, object)
            flat[:] = [w for own in split for w in own]
            code, distinct = pd.factorize(flat)
            found = self.columns_of(distinct)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            columns = np.fromiter((c for own in found for c in own), np.int64, int(sizes.sum()))
            ends = np.cumsum(sizes)
            # only words with a known part go on
            hit = np.flatnonzero(sizes[code]) if n else np.empty(0, np.int64)
            word = code[hit]
            many = sizes[word]
            text = np.repeat(np.repeat(np.arange(len(split)), list(map(len, split)))[hit], many)
            place = np.repeat(ends[word], many) - np.repeat(np.cumsum(many), many) + np.arange(int(many.sum()))
            width = max(len(self.places), 1)
            cell = np.unique(text * width + columns[place])
            z = self.bias + np.bincount(cell // width, self.weights[cell % width], minlength=len(split))
            out[start : start + len(split)] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            start += len(split)
        return out


def risk_slopes(x: np.ndarray, y: np.ndarray, weights: np.ndarray, bias: float, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The risk on clean texts R-(U) - p * R-(P), its slope by (weights, bias), and the slope of p * R+(P).

    x: rows of P, y: rows of U; losses are logistic.
    """

    def slope(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.append(rows.T @ by, by.sum()) / len(rows)

    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    on_p, on_u = x @ weights + bias, y @ weights + bias
    clean = np.logaddexp(0, on_u).mean() - prior * np.logaddexp(0, on_p).mean()
    return clean, slope(y, sigmoid(on_u)) - prior * slope(x, sigmoid(on_p)), prior * slope(x, sigmoid(on_p) - 1)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, kept: int = KEPT, steps: int = STEPS) -> ToxicModel:
    """positive, unlabelled: the distinct word places of each text; nothing to learn from gives score 0.05 or less everywhere."""
    none = ToxicModel(np.empty(0, np.int64), np.empty(0), -3.0)
    if not positive or not unlabelled:
        return none
    count = lambda texts: np.bincount(np.concatenate(texts) if texts else [], minlength=SIZE)
    p, u = count(positive) / len(positive), count(unlabelled) / len(unlabelled)
    # standard scores of the difference of the shares of texts with the word
    pooled = (p * len(positive) + u * len(unlabelled)) / (len(positive) + len(unlabelled))
    spread = np.sqrt(pooled * (1 - pooled) * (1 / len(positive) + 1 / len(unlabelled)))
    z = np.abs(p - u) / np.maximum(spread, 1e-9)
    places = np.sort(np.argsort(-z, kind="stable")[:kept])
    places = places[z[places] > 3]
    if not len(places):
        return none

    def dense(texts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(texts), len(places)), np.float32)
        for i, own in enumerate(texts):
            at = np.minimum(np.searchsorted(places, own), len(places) - 1)
            out[i, at[places[at] == own]] = 1
        return out

    x, y = dense(positive), dense(unlabelled)
    weights, bias = np.zeros(len(places)), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(len(places) + 1), np.zeros(len(places) + 1)
    for step in range(1, steps + 1):
        clean, up, known = risk_slopes(x, y, weights, bias, prior)
        change = -GAMMA * up if clean < -BETA else up + known
        change = change + PENALTY * np.append(weights, 0)
        mean, square = 0.9 * mean + 0.1 * change, 0.999 * square + 0.001 * change**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return ToxicModel(places, weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", label_id: str = "doc_id", toxic: str = "toxic", most: tuple[int, int] = (MAX_POSITIVE, MAX_UNLABELLED)) -> ToxicModel:
    """A model from the rows of `docs` where `learn` (of the id column) holds, and the toxic ids among `labels`.

    The class prior is the share of toxic among the labels of learned ids.  Rows alike in id
    and text count once.  However often an id repeats, at most `most` texts of each kind are
    drawn, those of the lowest hashes.
    """
    named = F.col(f"`{label_id}`").alias(id), F.col(f"`{toxic}`").alias("toxic")
    known = labels.select(*named).filter(learn).filter("toxic is not null")
    seen = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0)).alias("toxic")).first()
    prior = min(max(seen["toxic"] / seen["n"], 0.001), 0.9) if seen["n"] else PRIOR
    here = F.col(f"`{id}`")
    ids = known.filter("toxic = 1").select(here.alias("toxic_id")).distinct().orderBy(F.xxhash64("toxic_id")).limit(2 * most[0])
    rows = docs.select(here.alias(id), F.col(f"`{text}`").alias("text")).filter(learn)
    placed = rows.select(here.alias("of"), "text", F.pmod(F.xxhash64(here, "text"), F.lit(1 << 40)).alias("place"))
    # the toxic ids are of a known bound
    positive = placed.join(F.broadcast(ids), F.col("of") == F.col("toxic_id"), "left_semi")
    return fit(_drawn(positive, most[0]), _drawn(placed, most[1]), prior)


def _drawn(placed: DataFrame, most: int) -> list[np.ndarray]:
    """The distinct word places of the `most` texts with the lowest hashes `place`."""
    # a first threshold, from the number of rows, leaves about twice as many as are wanted
    n = placed.count()
    near = placed.filter(F.col("place") <= min(1 << 40, -(-(2 * most + 100) * (1 << 40) // max(n, 1))))
    lowest = near.select("place").distinct().orderBy("place").limit(most)
    last = lowest.agg(F.max("place").alias("last"), F.count("*").alias("n")).first()
    if n > 2 * most + 100 and last["n"] < most:
        # many repeated rows: the lowest hashes of all
        last = placed.select("place").distinct().orderBy("place").limit(most).agg(F.max("place").alias("last")).first()

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [np.unique(np.fromiter((p for w in set(words_of(text)) for p in places_of(w)), np.int32)).tobytes() for text in batch["text"]]
            yield pd.DataFrame({"place": batch["place"].to_numpy(), "places": own})

    if last["last"] is None:
        return []
    once = placed.filter(F.col("place") <= last["last"]).groupBy("place").agg(F.min("text").alias("text"))
    found = once.mapInPandas(places, "place long, places binary").toPandas().sort_values("place")
    return [np.frombuffer(b, np.int32).astype(np.int64) for b in found["places"]]


def with_toxicity(docs: DataFrame, model: ToxicModel, into: str = "toxicity", text: str = "text") -> DataFrame:
    """`docs` with a double column `into` (0 to 1) from the whole text alone.

    Null counts as empty, which scores the bias.  `into` is lengthened by `_` where `docs` has
    a column of that name in any case.  Rows may repeat.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(batch.tolist()))

    return docs.withColumn(free_name(docs, into), score(F.col(f"`{text}`")))
