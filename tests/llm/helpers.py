"""Fixtures and brute force that the tests of this folder share."""

import random
import string

ODD_TEXTS = [None, "", " \n\t ", "a", "naïve 日本 😀", "x" * 50_000, "word " * 20_000, "same text here twice", "same text here twice"]


def odd_docs(spark, ids=True):
    """Nulls in any column, empty and long texts, ties, repeats, and columns whose names clash with results."""
    rows = [(i if ids else 1, t, None if i % 2 else "en", None, 7) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "text without an id", "de", "s", 1), rows[-1], rows[-1]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, Score string, n_words int")


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def words(rng, n, size=400):
    return [rng.choice(VOCABULARY[:size]) for _ in range(n)]


_rng = random.Random(11)
VOCABULARY = ["".join(_rng.choice(string.ascii_lowercase) for _ in range(_rng.randrange(3, 9))) for _ in range(2000)]


def auc(labels, scores):
    order = sorted(range(len(scores)), key=lambda i: scores[i])
    ranks, i = [0.0] * len(scores), 0
    while i < len(order):
        j = i
        while j < len(order) and scores[order[j]] == scores[order[i]]:
            j += 1
        for k in order[i:j]:
            ranks[k] = (i + j + 1) / 2
        i = j
    ones = sum(labels)
    return (sum(r for r, y in zip(ranks, labels) if y) - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))
