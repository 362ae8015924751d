"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases words, maps look-alike letters to Latin ones and digits
between letters to the letters they stand for. Entries are whole words or word
beginnings; a phrase of the exception list hides the entries inside it. The sum
of the weights, divided by the text's length, is turned into a probability by
a monotone fit.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import append, checkpoint, labelled_sample, map_batches, texts_of

SAMPLE = 20_000
BEGINNINGS = (4, 5, 6, 7, 8)
LEAST_SUPPORT = 5
LEAST_WEIGHT = 2.5
CACHED_WORDS = 50_000
MOST_COUNTED = 100_000
MOST_ENTRIES = 100_000
MOST_PHRASES = 100_000

# Insults that count before anything is learned, and their weight.
SEED_WORDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
SEED_WEIGHT = 4.0
# Phrases in which such a word is no insult.
SEED_PHRASES = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum")
# Look-alike letters and what they look like; digits and signs and what they stand for.
LOOK_ALIKE = dict(zip("аеорсухівкмнтзαεοριτκνυѕјԁ", "aeopcyxibkmhtzaeopitkvusjd"))
STANDS_FOR = dict(zip("013457@$!", "oieastasi"))
SIGNS = re.compile(r"(?<=[^\W\d_])[013457@$!]+(?=[^\W\d_])|^[013457@$!](?=[^\W\d_])|(?<=[^\W\d_]{2})[01345@$7]$")
NOT_LETTERS = re.compile(r"[\W_]+")
STRIP = ".,;:!?\"'()[]{}<>|*#%&-"


def fold(word: str) -> str:
    """One word folded; what is no letter or digit inside it becomes a space."""
    word = word.lower().strip(STRIP)
    if not word.isascii():
        word = "".join(LOOK_ALIKE.get(c, c) for c in word)
    if not word.isalpha():
        word = SIGNS.sub(lambda m: "".join(STANDS_FOR[c] for c in m[0]), word)
        word = NOT_LETTERS.sub(" ", word).strip()
    return word


class Folded(dict):
    """Folded forms of words; emptied when full."""

    def __missing__(self, word: str) -> str:
        out = fold(word)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out
        return out


@dataclass
class Model:
    """Entries (`` word `` or `` begin``, with their leading space) and weights, phrases, and the steps of the fit."""

    entries: dict[str, float] = field(default_factory=dict)
    phrases: list[str] = field(default_factory=list)
    at: list[float] = field(default_factory=list)
    chance: list[float] = field(default_factory=list)


class Matcher:
    """Length-normalised weight of a text under a model."""

    def __init__(self, entries: dict[str, float], phrases: list[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for entry, weight in entries.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in phrases:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.folded = Folded()

    def load(self, text: str) -> float:
        """Weight of a text over the square root of its number of words."""
        words = text.split()
        if not words or not len(self.automaton):
            return 0.0
        line = f" {' '.join(map(self.folded.__getitem__, words))} "
        best: dict[int, float] = {}
        hidden: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(line):
            start = end - length + 1
            if weight is None:
                hidden.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if hidden:
            # Both in order of their places: a start is hidden if a phrase that begins at it or before ends behind it.
            hidden.sort()
            shown, at, reach = {}, 0, -1
            for s in sorted(best):
                while at < len(hidden) and hidden[at][0] <= s:
                    reach = max(reach, hidden[at][1])
                    at += 1
                if s >= reach:
                    shown[s] = best[s]
            best = shown
        return sum(best.values()) / math.sqrt(len(words)) if best else 0.0


def features(text: str, folded: Folded) -> set[str]:
    """Entries that a text would support: its folded words, and their beginnings."""
    words = {w for x in text.split() for w in folded[x].split()}
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) > n}


def rising(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Monotone fit of 0/1 outcomes: pool adjacent violators, at most 64 steps, smoothed."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order].astype(float)
    values, first = np.unique(x, return_index=True)
    blocks: list[list[float]] = []
    for v, part in zip(values, np.split(y, first[1:])):
        blocks.append([v, part.sum(), len(part)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            v2, s, n = blocks.pop()
            blocks[-1][1] += s
            blocks[-1][2] += n
    while len(blocks) > 64:
        i = min(range(1, len(blocks)), key=lambda k: blocks[k][2] + blocks[k - 1][2])
        s, n = blocks.pop(i)[1:]
        blocks[i - 1][1] += s
        blocks[i - 1][2] += n
    return [b[0] for b in blocks], [(b[1] + 0.2) / (b[2] + 1) for b in blocks]


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, sample: int = SAMPLE,
    id_col: str = "doc_id", text_col: str = "text", most_entries: int = MOST_ENTRIES, most_phrases: int = MOST_PHRASES,
) -> Model:
    """Lexicon, exception phrases and fit from at most ``sample`` labelled rows outside the held-out fold.

    Two thirds of the sample weigh the entries, one third fits the chances.
    Entries need ``LEAST_SUPPORT`` of its texts, phrases three. The model, which comes
    to the driver, holds ``most_entries`` of most weight times support and ``most_phrases`` of
    most support at most. Texts are counted in slices of bounded size, whatever their
    length. Documents that repeat an id count once, with their least text; null
    texts have no words. Without labels: the seed words and a fixed curve.
    """
    rows = checkpoint(
        labelled_sample(docs, labels, label, folds, held, sample, id_col, text_col)
        .select("text", F.col("label").cast("int").alias("label"), (F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string")).cast("binary")) % 3 == 0).alias("fit"))
    )
    size = {(bool(f), int(x)): n for f, x, n in rows.groupBy("fit", F.col("label") > 0).count().collect()}
    good, bad = (size.get((False, x), 0) for x in (0, 1))

    def count(find: Callable[[], Callable[[str], set[str]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work = find()
            seen = (Counter(), Counter())
            for batch in batches:
                for text, mark in zip(texts_of(batch.column("text")), batch.column("label").to_pylist()):
                    seen[mark > 0].update(work(text))
                if sum(map(len, seen)) > MOST_COUNTED:
                    yield from told(seen)
                    seen = (Counter(), Counter())
            yield from told(seen)

        def told(seen: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())] + [pa.array([c[k] for k in keys], pa.int64()) for c in seen], names=["entry", "good", "bad"])

        return run

    def words() -> Callable[[str], set[str]]:
        folded = Folded()
        return lambda text: features(text, folded)

    learning = rows.where("not fit").select("text", "label")
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    found = (
        map_batches(learning, count(words), "entry string, good long, bad long").groupBy("entry").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        .where(F.col("bad") >= LEAST_SUPPORT).withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT)
    )
    found = found.orderBy((F.col("weight") * F.col("bad")).desc(), "entry").limit(most_entries)
    entries = {f" {w} ": SEED_WEIGHT for w in SEED_WORDS} | {r.entry: float(r.weight) for r in found.collect()}
    whole = {e.strip() for e in entries if e.endswith(" ")}

    def pairs() -> Callable[[str], set[str]]:
        folded = Folded()

        def work(text: str) -> set[str]:
            line = " ".join(map(folded.__getitem__, text.split())).split()
            return {f"{a} {b}" for a, b in zip(line, line[1:]) if a in whole or b in whole}

        return work

    neutral = (
        map_batches(learning, count(pairs), "entry string, good long, bad long").groupBy("entry").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        .where("good >= 3 and bad = 0")
    )
    neutral = neutral.orderBy(F.col("good").desc(), "entry").limit(most_phrases)
    phrases = sorted({*SEED_PHRASES, *(r.entry for r in neutral.collect())})

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        matcher = Matcher(entries, phrases)
        return lambda column: [pa.array([matcher.load(t) for t in texts_of(column)], pa.float64())]

    loads = append(rows.where("fit").select("text", "label"), ["text"], make, [T.StructField("load", T.DoubleType())]).select("load", "label").collect()
    model = Model(entries, phrases, [0.0, 0.2, 1.0], [0.02, 0.4, 0.9])
    if any(r.label > 0 for r in loads):
        model.at, model.chance = rising(np.array([r.load for r in loads]), np.array([r.label > 0 for r in loads]))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` or more).

    Null and empty texts have no weight and get the lowest chance. Whole texts
    are matched; columns of the input with these names give way. No shuffle.
    """
    def make() -> Callable[[pa.Array], list[pa.Array]]:
        matcher = Matcher(model.entries, model.phrases)
        at, chance = np.array(model.at), np.array(model.chance)

        def work(column: pa.Array) -> list[pa.Array]:
            loads = np.array([matcher.load(t) for t in texts_of(column)], float)
            scores = chance[np.maximum(np.searchsorted(at, loads, side="right") - 1, 0)] if len(loads) else loads
            return [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())]

        return work

    return append(docs, [text_col], make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
