"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import append, labelled_sample, texts_of

BITS = 18
OWN_SLOTS = 2
SAMPLE = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 1.0
CACHED_WORDS = 50_000
WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+").findall


class Hashes(dict):
    """crc32 of words; emptied when full."""

    def __missing__(self, word: str) -> int:
        out = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out
        return out


def grams(text: str, known: Hashes, bits: int) -> np.ndarray:
    """Distinct hashed words, word pairs and repeats of a lower-cased text.

    Slot 0 is the bias; slot 1 stands for words that often repeat the one before. No n-gram has these.
    """
    words = WORD(text.lower())
    one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B1) + one[1:]
    two = (two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    slots = np.concatenate([one * np.uint64(0x9E3779B97F4A7C15), two]) >> np.uint64(64 - bits)
    slots = np.unique(slots % np.uint64((1 << bits) - OWN_SLOTS)) + np.uint64(OWN_SLOTS)
    repeats = len(one) > 1 and (one[1:] == one[:-1]).mean() > 0.1
    return np.concatenate([np.arange(2 if repeats else 1, dtype=np.uint64), slots]).astype(np.int32)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, sample: int = SAMPLE, bits: int = BITS,
    epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text",
) -> np.ndarray:
    """Weights of the 2**bits slots, from at most ``sample`` labelled rows outside the held-out fold.

    Features are hashed where the texts are; one task then runs FTRL-proximal
    over the bounded sample in the order of a hash, so that a lost executor
    changes nothing. What reaches the driver is bounded by the number of slots.
    """
    rows = labelled_sample(docs, labels, label, folds, held, sample, id_col, text_col)
    rows = rows.select("text", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("place"))

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        known = Hashes()
        return lambda column: [pa.array([grams(t, known, bits) for t in texts_of(column)], pa.list_(pa.int32()))]

    hashed = append(rows, ["text"], make, [T.StructField("slots", T.ArrayType(T.IntegerType()))]).select("label", "place", "slots", F.lit(0).alias("all"))

    def fit(data: pd.DataFrame) -> pd.DataFrame:
        data = data.assign(size=data["slots"].map(len)).sort_values(["place", "label", "size"], kind="stable")
        z, n = np.zeros(1 << bits), np.zeros(1 << bits)

        def weights(i: np.ndarray | slice) -> np.ndarray:
            return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

        for _ in range(epochs):
            for slots, mark in zip(data["slots"], data["label"]):
                w, x = weights(slots), len(slots) ** -0.5
                g = (1 / (1 + np.exp(-np.clip(w.sum() * x, -30, 30))) - (mark > 0)) * x
                z[slots] += g - (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / ALPHA * w
                n[slots] += g * g
        w = weights(slice(None))
        used = np.flatnonzero(w)
        return pd.DataFrame({"slot": used.astype(np.int32), "weight": w[used]})

    out = np.zeros(1 << bits)
    for slot, weight in hashed.groupBy("all").applyInPandas(fit, "slot int, weight double").collect():
        out[slot] = weight
    return out


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` or more).

    A null or empty text has the bias slot only. Whole texts are hashed; columns
    of the input with these names give way. One pass without a shuffle.
    """
    bits = len(weights).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**bits numbers at every size

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        known, w = Hashes(), shared.value

        def work(column: pa.Array) -> list[pa.Array]:
            loads = []
            for text in column:
                slots = grams(text.as_py() or "", known, bits)
                loads.append(float(w[slots].sum()) * len(slots) ** -0.5)
            scores = 1 / (1 + np.exp(-np.clip(np.array(loads, float), -30, 30)))
            return [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())]

        return work

    return append(docs, [text_col], make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
