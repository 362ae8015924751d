"""Language identification with hyperdimensional profiles.

Each letter has a vector of +1 and -1 of its own, made from a hash of the letter.
A window of three letters is the product (binding) of its letters' vectors, each
rolled (permuted) by its place; a text is the sum (bundle) of its windows. A
language's prototype is the bundle of all texts learned for it, and a text takes
the language of greatest cosine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import append, map_batches, pick, texts_of

UNDETERMINED = "und"
DIMENSIONS = 512
SEED = 7
MOST_LANGUAGES = 10_000
PIECE_CHARS = 1 << 18
BLOCK_CELLS = 1 << 20
BLOCK_WINDOWS = 4_096
KEPT_WINDOWS = 16_384
HELD_LANGUAGES = 512
EDGE = 0
P1, P2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point the letter it stands for, case folded; ``EDGE`` for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        letter = chr(c)
        if letter.isalpha():
            table[c] = ord(letter.lower()[0])
    return table


def letter_vectors(of: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """The vectors of letters (or of the edge of a word): bits of a hash of letter and place."""
    words = -(-dimensions // 64)
    x = (of.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)) + np.array([seed], np.uint64) * P1
    for prime in (P1, P2):
        x = (x ^ (x >> np.uint64(30))) * prime
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(of), words * 8), axis=1)[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


class Windows:
    """Bound vectors of windows; a bounded number is kept."""

    def __init__(self, dimensions: int, seed: int) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.forget()

    def forget(self) -> None:
        self.keys = np.empty(0, np.int64)
        self.rows = np.empty((0, self.dimensions), np.int8)

    def made(self, keys: np.ndarray) -> np.ndarray:
        """The products of the rolled letter vectors of windows, which are three letters of 21 bits."""
        known, place = np.unique(np.concatenate([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF]), return_inverse=True)
        vectors = letter_vectors(known, self.dimensions, self.seed)
        before, here, after = place.reshape(3, -1)
        return np.roll(vectors, 2, 1)[before] * np.roll(vectors, 1, 1)[here] * vectors[after]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of at most ``BLOCK_WINDOWS`` different windows, in float32."""
        at = np.searchsorted(self.keys, keys)
        new = (self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            if len(self.keys) + new.sum() > KEPT_WINDOWS:
                self.forget()
                new[:] = True
            all_keys = np.concatenate([self.keys, keys[new]])
            order = np.argsort(all_keys)
            self.rows = np.concatenate([self.rows, self.made(keys[new])])[order]
            self.keys = all_keys[order]
            at = np.searchsorted(self.keys, keys)
        return self.rows[at].astype(np.float32)


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each letter of the texts its text's number and its window, in pieces of about ``PIECE_CHARS``; long texts are cut, windows are not."""
    table = letters()

    def windows(line: str, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``line`` has a character before and behind those that ``own`` numbers."""
        codes = table[np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
        at = np.flatnonzero(codes[1:-1]) + 1
        return own[at - 1], codes[at - 1] << 42 | codes[at] << 21 | codes[at + 1]

    first, size = 0, 0
    for i, text in enumerate([*texts, None]):
        if i > first and (text is None or size + len(text) > PIECE_CHARS):
            group = texts[first:i]
            yield windows(f" {' '.join(group)}  ", np.repeat(np.arange(first, i, dtype=np.int32), [len(t) + 1 for t in group]))
            first, size = i, 0
        if text is not None and len(text) > PIECE_CHARS:
            for start in range(0, len(text), PIECE_CHARS):
                stop = min(start + PIECE_CHARS, len(text))
                line = (text[start - 1] if start else " ") + text[start:stop] + (text[stop] if stop < len(text) else " ")
                yield windows(line, np.full(stop - start, i, np.int32))
            first = i + 1
        elif text is not None:
            size += len(text) + 1


def bundles(texts: list[str], known: Windows, groups: np.ndarray | None = None, n: int = 0) -> np.ndarray:
    """The vectors of the texts, or with ``groups`` the sums of ``n`` groups of them."""
    out = np.zeros((len(texts) if groups is None else n, known.dimensions))
    for own, keys in pieces(texts):
        if not len(keys):
            continue
        own = own if groups is None else groups[own]
        present, ids = np.unique(keys, return_inverse=True)
        rows, own = np.unique(own, return_inverse=True)
        order = None
        for first in range(0, len(present), BLOCK_WINDOWS):
            part = present[first : first + BLOCK_WINDOWS]
            mine, here = own, ids
            if len(present) > BLOCK_WINDOWS:
                order = np.argsort(ids, kind="stable") if order is None else order
                a, b = np.searchsorted(ids[order], [first, first + len(part)])
                mine, here = own[order[a:b]], ids[order[a:b]] - first
            vectors = known.of(part)
            step = max(1, BLOCK_CELLS // len(part))
            cells = mine.astype(np.int64) * len(part) + here
            for low in range(0, len(rows), step):
                high = min(low + step, len(rows))
                inside = cells if step >= len(rows) else cells[(mine >= low) & (mine < high)] - low * len(part)
                counts = np.bincount(inside, minlength=(high - low) * len(part)).reshape(high - low, len(part))
                out[rows[low:high]] += counts.astype(np.float32) @ vectors  # whole numbers below 2**24: exact
    return out


def learn(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED, most: int = MOST_LANGUAGES
) -> dict[str, list[float]]:
    """Prototypes of the languages of ``docs``: sums over all rows with a text and a language.

    Each task sums its rows; what reaches the driver is one vector per language.
    Labels of more than ``most`` languages are a ValueError, so that the vectors
    stay small enough for driver and tasks. Sums of integers: the same in any order.
    """
    rows = pick(docs, text=text_col, lang=lang_col).where("text is not null and lang is not null")

    def told(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        langs = pa.array(np.repeat(np.array([*sums], object), dimensions), pa.string())
        places = pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(sums)))
        values = np.concatenate([*sums.values(), np.empty(0)])
        return pa.RecordBatch.from_arrays([langs, places, pa.array(np.rint(values).astype(np.int64))], names=["lang", "place", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Windows(dimensions, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            groups = np.array([number[x] for x in langs], np.int64)
            for name, own in zip(names, bundles(batch.column("text").to_pylist(), known, groups, len(names))):
                sums[name] = sums[name] + own if name in sums else own
            if len(sums) > HELD_LANGUAGES:
                yield told(sums)
                sums = {}
        yield told(sums)

    sums = map_batches(rows, run, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    vectors = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).getField("value").alias("vector"))
    found = vectors.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} languages")
    return {r.lang: [float(x) for x in r.vector] for r in sorted(found) if any(r.vector)}


def identify(docs: DataFrame, prototypes: dict[str, list[float]], text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``docs`` with ``lang_pred`` (string) and ``score`` (cosine cut to 0 to 1).

    ``und`` with score 0 for a null or empty text, one without a letter, or no
    prototypes. Equal cosines, as of a bundle that cancels out to nothing: the
    first language by name. Whole texts are used; columns of the input with these
    names give way. One pass without a shuffle.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float64).reshape(len(names), -1 if names else 1)
    units = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        known = Windows(units.shape[1], seed)

        def work(column: pa.Array) -> list[pa.Array]:
            texts = texts_of(column)
            langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if names:
                vectors = bundles(texts, known)
                cosines = vectors @ units.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                lettered = np.zeros(len(texts), bool)
                empty = ~vectors.any(axis=1)
                lettered[~empty] = True
                for i in np.flatnonzero(empty):
                    lettered[i] = any(c.isalpha() for c in texts[i])
                for i in np.flatnonzero(lettered):
                    best = int(cosines[i].argmax())
                    langs[i], scores[i] = names[best], float(np.clip(cosines[i, best], 0, 1))
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return work

    return append(docs, [text_col], make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
