"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

A text's words are read twice: as they are, and as shapes, in which runs of
upper, lower and digit characters shrink to one sign and a word equal to the one
before it is marked. Single words and pairs of both readings are hashed into one
space of weights. Each of the four readings counts alike, whatever the length of
the text, so a value is an n-gram's share of its reading.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countercheck.llm.support import put, small_batches

BITS = 18
BIAS = 0  # the weight of every text
SCALE = 4.0  # of a reading's values
TRAIN_ROWS = 20_000  # bound of the labelled sample that is learned from
WORKERS = 8  # models that are trained side by side and averaged
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.1
CACHED = 300_000

SAME = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xC2B2AE3D27D4EB4F)
SHIFT = np.uint64(64 - BITS)


def shape(word: str) -> str:
    """The kind of a word: ``Thing!!`` is ``Aa!!``, ``x12`` is ``a0``."""
    runs = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not runs or runs[-1] != kind or kind not in "Aa0":
            runs.append(kind)
    return "".join(runs[:12])


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        own = xxhash.xxh32_intdigest(word.lower().encode())
        found = self[word] = own << 32 | xxhash.xxh32_intdigest(shape(word).encode(), 1)
        return found


class Features:
    """Turns texts into weight numbers; remembers words between texts, CACHED or so."""

    def __init__(self) -> None:
        self.known = _Hashes()

    def readings(self, text: str) -> list[np.ndarray]:
        """Weight numbers of words, word pairs, shapes and shape pairs."""
        words = text.split()
        if len(self.known) > CACHED:
            self.known.clear()
        both = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        word, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        form[1:] += SAME * (word[1:] == word[:-1])
        out = []
        for kind, codes in ((1, word), (3, form)):
            single = (codes + np.uint64(kind)) * MIX
            pair = (single[:-1] ^ (single[1:] >> np.uint64(7))) * MIX + np.uint64(kind)
            out += [(single * SAME) >> SHIFT, (pair * SAME) >> SHIFT]
        return [x.astype(np.int64) for x in out]

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct weight numbers and their values."""
        readings = [x for x in self.readings(text) if len(x)]
        at = np.concatenate([[BIAS], *readings]).astype(np.int64)
        value = np.concatenate([[1.0], *[np.full(len(x), SCALE / len(x)) for x in readings]])
        at, where = np.unique(at, return_inverse=True)
        return at, np.bincount(where, weights=value, minlength=len(at))

    def dot(self, text: str, weights: np.ndarray) -> float:
        readings = [weights[x].mean() for x in self.readings(text) if len(x)]
        return float(weights[BIAS] + SCALE * sum(readings))


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Follow the regularised leader, proximal, one coordinate at a time."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        rate = (BETA + np.sqrt(self.n[at])) / ALPHA + L2
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / rate)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        own = self.weights(at)
        step = (_sigmoid(float(own @ value)) - label) * value
        before = self.n[at]
        self.n[at] = before + step * step
        self.z[at] += step - (np.sqrt(self.n[at]) - np.sqrt(before)) / ALPHA * own


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One model from one part of the sample: its weights other than 0."""
    features, model, rows = Features(), Ftrl(), []
    for batch in batches:
        rows += [(*features.vector(t), y) for t, y in zip(batch["text"], batch["label"], strict=True)]
    for _ in range(EPOCHS):
        for at, value, label in rows:
            model.learn(at, value, label)
    weights = model.weights(slice(None))
    at = np.flatnonzero(weights)
    if rows:
        yield pd.DataFrame({"at": [-1, *at], "weight": [1.0, *weights[at]]})


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: int = TRAIN_ROWS,
) -> np.ndarray:
    """Weights learned from labelled documents.

    At most ``rows`` labelled keys are taken, those with the smallest hash, so
    that the sample has a bound and stays the same. WORKERS models learn from a
    part each, EPOCHS times in a fixed order, and their weights are averaged;
    2**BITS weights come to the driver. Rows with a null key or a label other
    than 0 and 1 teach nothing; a key labelled twice or found in two documents
    counts each time. Without any labelled document all weights are 0, and
    every score is 0.5.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"))
    known = known.filter("key is not null and label in (0, 1)")
    known = known.orderBy(F.xxhash64("key"), "key", "label").limit(rows)
    own = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = F.xxhash64("key", F.lit(1))
    sample = own.join(F.broadcast(known), "key").withColumn("order", order)
    parts = sample.repartition(WORKERS, "order").sortWithinPartitions("order", "key", "text", "label")
    models = parts.select("text", "label").mapInPandas(_train, "at int, weight double")
    total = models.groupBy("at").agg(F.sum("weight").alias("weight")).collect()
    weights = np.zeros(1 << BITS)
    n = 1.0
    for at, weight in total:
        if at < 0:
            n = weight
        else:
            weights[at] = weight
    return weights / n


def score(df: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the probability from 0 to 1 that a text has label 1.

    Whole texts of any length are scored; a null or blank one by the bias
    alone. Rows and other columns stay; a column called ``out`` is replaced.
    """
    return put(df, {out: scored(df, weights, F.col(f"`{text}`"))})


def scored(df: DataFrame, weights: np.ndarray, text: Column) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(weights)
    small_batches(df.sparkSession)

    @F.arrow_udf("double")
    def score_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = Features()
        for batch in batches:
            sums = [features.dot(x.as_py() or "", shared.value) for x in batch]
            yield pa.array(_sigmoid(np.array(sums, np.float64)), pa.float64())

    return score_texts(text)
