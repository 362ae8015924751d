"""Importance resampling against a plain reading of its definition."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import helpers
import pytest

from glyphmill.llm import resample

LONG = {"chunk_words": 40, "long_bytes": 200}


def features(text, most):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, most=2, buckets=10_000, percent=25, least=20, seed="7"):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text, most)[1]) for texts in ([x for _, x in rows], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (total_s + buckets) / ((s[b] + 1.0) * (total_t + buckets))))
    out = []
    for i, text in rows:
        words, found = features(text, most)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    drawn = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for rank, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def check(spark, rows, target, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    other = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = [tuple(r) for r in resample.resample(docs, other, **{k: v for k, v in more.items() if k != "most"}).collect()]
    plain = {"most": more.get("max_n", 2)} | {k: more[k] for k in ("buckets", "percent", "seed") if k in more} | ({"least": more["least_words"]} if "least_words" in more else {})
    assert sorted(got, key=repr) == brute(rows, target, **plain)
    return got


def texts(seed, n=150):
    rng = random.Random(seed)
    rows = [(i, " ".join(helpers.words(rng, rng.choice([1, 19, 20, 21, 60, 300]), 300))) for i in range(n)]
    return rows, [" ".join(helpers.words(rng, 80, 60)) for _ in range(5)]


@pytest.mark.parametrize("more", [{}, LONG, LONG | {"max_n": 3}, {"max_n": 1, "buckets": 7, "percent": 60, "least_words": 1, "seed": "x"}])
def test_against_plain_reading(spark, more):
    check(spark, *texts(1), **more)


def test_chunks_own_each_start_once(spark):
    """Texts around a multiple of the chunk, words beyond ASCII, and separators of every kind."""
    rng = random.Random(2)
    rows = [(n, "-".join(["Größe", "日本", "x1"][k % 3] + rng.choice("abc") for k in range(n))) for n in (39, 40, 41, 79, 80, 81, 120, 121)]
    check(spark, rows, ["Größea 日本b"], **(LONG | {"long_bytes": 1}))
    assert check(spark, rows, ["Größea 日本b"], **LONG)


def test_rows_that_repeat_and_ties(spark):
    rows, target = texts(3, 40)
    rows += [rows[5]] * 3 + [(rows[7][0], rows[8][1]), (None, rows[9][1]), (None, rows[9][1]), (None, None), (50, None), (51, "")]
    check(spark, rows, target, percent=100)
    check(spark, rows, target, percent=37)


def test_odd_rows(spark):
    df = helpers.odd_docs(spark)
    target = spark.createDataFrame([(1, None), (2, "same text"), (3, "")], "item_id long, text string")
    got = [tuple(r) for r in resample.resample(df, target).collect()]
    assert sorted(got, key=repr) == brute([(r.doc_id, r.text) for r in df.collect()], [None, "same text", ""])
    assert resample.resample(helpers.empty_docs(spark), target).count() == 0


def test_empty_target(spark):
    rows, _ = texts(4, 30)
    check(spark, rows, ["..."])
    empty = spark.createDataFrame([], "item_id long, text string")
    got = [tuple(r) for r in resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), empty).collect()]
    assert sorted(got, key=repr) == brute(rows, [])
