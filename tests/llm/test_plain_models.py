"""Toxicity matching and the quality classifier's training against plain readings of both."""

import math
import random
import re
import zlib

import helpers
import numpy as np
import oracle
from pyspark.sql import functions as F

from glyphmill.llm import quality, toxicity


def plain_load(text, entries, phrases):
    """Every entry and phrase tried at every place of the folded line; what begins within a phrase does not count."""
    words = text.split()
    line = f" {' '.join(map(toxicity.fold, words))} "
    best = {}
    for i in range(len(line)):
        own = [w for e, w in entries.items() if line.startswith(e, i)]
        inside = any(line.startswith(f" {p} ", j) and j <= i < j + len(p) + 1 for p in phrases for j in range(len(line)))
        if own and not inside:
            best[i] = max(own)
    return sum(best.values()) / math.sqrt(len(words)) if words else 0.0


def test_matching_against_every_entry_at_every_place():
    rng = random.Random(6)
    words = ["bad", "badly", "worse", "can", "trash", "ok", "b4d", "BAD!", "wör-se", "аbad", "x"]
    for _ in range(300):
        entries = {f" {rng.choice(words[:5])}{rng.choice([' ', ''])}": rng.uniform(0.5, 5) for _ in range(rng.randrange(5))}
        phrases = sorted({" ".join(rng.choice(words[:6]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4))})
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(12)))
        assert abs(toxicity.Matcher(entries, phrases).load(text) - plain_load(text, entries, phrases)) < 1e-9


def test_a_learned_lexicon_against_the_same_scan(spark):
    docs, labels = (spark.read.parquet(f"{oracle.SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs.select("doc_id", "text"), labels)
    rng = random.Random(7)
    entries = dict(rng.sample(sorted(model.entries.items()), min(60, len(model.entries))))
    phrases = rng.sample(model.phrases, min(20, len(model.phrases)))
    matcher = toxicity.Matcher(entries, phrases)
    for r in docs.where("length(text) < 600").limit(40).collect():
        assert abs(matcher.load(r.text) - plain_load(r.text, entries, phrases)) < 1e-9


def test_what_a_model_holds_is_bounded_and_long_texts_count_like_short_ones(spark):
    rows = [(i, f"vile{i % 3} word " * (1 + 9_000 * (i % 2)), i % 2) for i in range(40)] + [(100 + i, f"fine word{i % 5} idiot savant", 0) for i in range(20)]
    rows += [(200, None, 1), (201, "", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, sample=1_000)
    short = docs.select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 12), " ").alias("text"))
    same = toxicity.learn(short, labels, sample=1_000)
    assert model.entries == same.entries and model.phrases == same.phrases
    assert "idiot savant" in model.phrases
    few = toxicity.learn(docs, labels, sample=1_000, most_entries=1, most_phrases=1)
    assert len(few.entries) <= len(toxicity.SEED_WORDS) + 1 and len(few.phrases) <= len(toxicity.SEED_PHRASES) + 1


def plain_slots(text, bits):
    """Slots by whole-number arithmetic, one n-gram after another."""
    words = re.findall(r"[^\W_]+|[^\w\s]+|_+", text.lower())
    one, most = [zlib.crc32(w.encode()) for w in words], 1 << 64
    hashes = [x * 0x9E3779B97F4A7C15 % most for x in one]
    for a, b in zip(one, one[1:]):
        two = (a * 0x9E3779B1 + b) % most
        hashes.append((two ^ two >> 29) * 0xBF58476D1CE4E5B9 % most)
    slots = {(h >> 64 - bits) % ((1 << bits) - 2) + 2 for h in hashes} | {0}
    same = [a == b for a, b in zip(one, one[1:])]
    return sorted(slots | ({1} if same and sum(same) / len(same) > 0.1 else set()))


def plain_ftrl(rows, bits, epochs):
    """Follow the regularised leader over dictionaries, one slot after another."""
    z, n = {}, {}

    def weight(i):
        s = z.get(i, 0.0)
        return 0.0 if abs(s) <= quality.L1 else -(s - math.copysign(quality.L1, s)) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for text, label in rows:
            slots = plain_slots(text, bits)
            x = 1 / math.sqrt(len(slots))
            w = {i: weight(i) for i in slots}
            g = (1 / (1 + math.exp(-sum(w.values()) * x)) - label) * x
            for i in slots:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / quality.ALPHA * w[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_weights_against_plain_ftrl(spark):
    docs, labels = (spark.read.parquet(f"{oracle.SMALL}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    got = quality.train(docs, labels, bits=14, epochs=2)
    rows = docs.join(labels.where("quality is not null"), "doc_id").select("text", "quality", "doc_id", F.xxhash64("doc_id").alias("place")).collect()
    rows = sorted((r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2), key=lambda r: r.place)
    wanted = plain_ftrl([(r.text, r.quality) for r in rows], 14, 2)
    assert len(rows) > 30 and wanted
    assert np.allclose(got, [wanted.get(i, 0.0) for i in range(1 << 14)], atol=1e-9)
    scored = quality.score(docs, got).collect()
    for r in random.Random(1).sample(scored, 50):
        slots = plain_slots(r.text or "", 14)
        assert abs(r.score - 1 / (1 + math.exp(-sum(wanted.get(i, 0.0) for i in slots) / math.sqrt(len(slots))))) < 1e-5


def test_slots_of_odd_texts():
    rng = random.Random(9)
    texts = ["", "a", "a a a a", "__ __ !!", "naïve 日本 x_y", "".join(chr(rng.randrange(32, 3000)) for _ in range(400)), " ".join(helpers.words(rng, 300))]
    for text in texts:
        assert quality.grams(text, quality.Hashes(), 12).tolist() == plain_slots(text, 12)
