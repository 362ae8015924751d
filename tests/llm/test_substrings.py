"""Substring dedup against a search of every window in every document."""

import hashlib
import random
import re
import time

import helpers
import numpy as np
import pytest

from glyphmill.llm import substrings


def brute(rows, window):
    own = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in own:
        for k in range(len(w) - window + 1 if i is not None else 0):
            g = tuple(w[k : k + window])
            least[g] = min(i, least.get(g, i))
    out = []
    for i, w in own:
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, window=50, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in substrings.dedup(df, window=window, **more).collect()]
    assert sorted(got, key=repr) == brute(rows, window)


def shared_passages(seed, n=120, window=50):
    """Passages around the threshold in texts of their own, near copies, copies, and runs of few words."""
    rng = random.Random(seed)
    passages = [helpers.words(rng, rng.choice([window - 1, window, window + 1, 2 * window, 3 * window])) for _ in range(6)]
    base = helpers.words(rng, 6 * window)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            text = list(base)
            for _ in range(rng.randrange(6)):
                text[rng.randrange(len(text))] = rng.choice(helpers.VOCABULARY)
        elif kind < 0.4 and rows:
            text = rng.choice(rows)[1].split()
        elif kind < 0.5:
            text = [rng.choice("ab")] * rng.randrange(3 * window) + [rng.choice("ab") for _ in range(rng.randrange(2 * window))]
        else:
            text = []
            for _ in range(rng.randrange(4)):
                p = rng.choice(passages)
                a = rng.randrange(3)
                text += helpers.words(rng, rng.randrange(2 * window)) + p[a : len(p) - rng.randrange(3)]
        rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    return rows


def test_against_every_window(spark):
    check(spark, shared_passages(1))


def test_short_windows_and_few_partners(spark):
    check(spark, shared_passages(2, n=80, window=20), window=20, seed=5, partners=1)


def test_what_seeds_leave_out_is_found(spark, monkeypatch):
    """Without a single extension all windows are settled by their hashes."""
    monkeypatch.setattr(substrings, "extended", lambda *_: [])
    check(spark, shared_passages(3, n=60))


def test_an_anchor_in_other_surroundings(spark):
    """The least document of an anchor holds too little of the passage; the others still find each other."""
    rng = random.Random(4)
    passage = helpers.words(rng, 60)
    rows = [(0, " ".join(helpers.words(rng, 30) + passage[10:50] + helpers.words(rng, 30)))]
    rows += [(i, " ".join(helpers.words(rng, 30) + passage + helpers.words(rng, 30))) for i in range(1, 90)]
    check(spark, rows)


def test_ids_shared_and_missing(spark):
    rng = random.Random(5)
    a, b = (" ".join(helpers.words(rng, 120)) for _ in range(2))
    rows = [(3, a), (3, a), (3, f"{a} {b}"), (5, b), (None, a), (7, a), (7, f"x {a}"), (2, " ".join(a.split()[:49])), (9, b.replace(" ", "\n\t"))]
    check(spark, rows)


def test_odd_rows(spark):
    df = helpers.odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = [tuple(r) for r in substrings.dedup(df).collect()]
    assert sorted(got, key=repr) == brute(rows, 50)
    assert substrings.dedup(helpers.empty_docs(spark)).count() == 0


def test_repeated_words_take_linear_time():
    known = substrings.Hashes()
    took = []
    for n in (20_000, 160_000):
        words = substrings.hashed([b"a"] * n, known)
        began = time.perf_counter()
        hashes, places, firsts = substrings.winnowed(words, 50, 16)
        assert len(hashes) == n - 49 and (hashes == hashes[0]).all()
        assert substrings.extended(words, words, [(0, int(p)) for p in places[:n]], 50)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * max(took[0], 0.01)


@pytest.mark.parametrize("size", [1, 2, 3, 16, 50])
def test_runs_tell_equal_sequences(size):
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2, 400).astype(np.uint64)
    got = substrings.runs(words, size)
    assert len(got) == 400 - size + 1
    seen = {}
    for k, h in enumerate(got.tolist()):
        assert seen.setdefault(h, tuple(words[k : k + size])) == tuple(words[k : k + size])
    assert len(seen) == len({tuple(words[k : k + size]) for k in range(len(got))})
    assert len(substrings.runs(words[: size - 1], size)) == 0 if size > 1 else True
