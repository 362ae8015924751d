"""Wu-Manber decontamination against windows compared one by one."""

import pickle
import random
import re
import time

import helpers
import pytest

from glyphmill.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def found(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, ids = found(t), set(), set()
        for item, text in items:
            p = found(text)
            n = min(13, len(p))
            for a in range(len(p) - n + 1) if p and item is not None else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == p[a : a + n]:
                        hit |= set(range(b, b + n))
                        ids.add(item)
        out.append((i, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def rows(seed=4):
    rng = random.Random(seed)
    items = [(k, " ".join(helpers.words(rng, n, 60))) for k, n in enumerate([1, 2, 5, 12, 13, 14, 30, 30, 60])]
    items += [(20, ""), (21, None), (None, "lone words"), (2, items[2][1]), (22, "Ünï cödé 9x")]
    docs = []
    for i in range(60):
        text = helpers.words(rng, rng.randrange(5, 200), 60)
        if i % 3 == 0:
            part = found(rng.choice(items[:9])[1])
            a = rng.randrange(len(text))
            text[a:a] = part[rng.randrange(len(part)) // 3 :]
        docs.append((i, rng.choice([" ", "-", "\n"]).join(text).title()))
    return docs + [(100, None), (101, ""), (102, "ünï CÖDÉ 9X ünï cödé 9x"), (102, "repeated id"), (None, docs[0][1])], items


@pytest.mark.parametrize("block_chars", [decontam.BLOCK_CHARS, 150])
def test_against_brute_force(spark, block_chars):
    docs, items = rows()
    got = decontam.judge(decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()), key=repr) == brute(docs, items)


def test_ids_that_are_strings_and_shifts_that_collide(spark, monkeypatch):
    docs, items = rows(9)
    named = [(None if k is None else f"item-{k}", t) for k, t in items]
    monkeypatch.setattr(decontam, "MOST_SHIFT_BITS", 3)
    got = decontam.judge(decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(named, "item_id string, text string"), block_chars=400))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()), key=repr) == brute(docs, named)


def test_what_is_sent_is_a_small_multiple_of_the_items():
    rng = random.Random(2)
    items = [(k, " ".join(helpers.words(rng, 2000, 2000))) for k in range(40)]
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(decontam.Searcher(items, 13))) < 12 * size
    same_ends = [(k, " ".join([*helpers.words(rng, 11, 2000), "the", "end"])) for k in range(3000)]  # one very common last pair
    searcher = decontam.Searcher(same_ends, 13)
    start = time.process_time()
    runs, found_items = searcher.search(found(" ".join(t for _, t in same_ends)), decontam.Hashes())
    assert len(found_items) == 3000 and time.process_time() - start < 5


def test_odd_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "same text here"), (2, "word " * 13)], "item_id long, text string")
    out = decontam.judge(decontam.find(helpers.odd_docs(spark), items))
    assert out.count() == helpers.odd_docs(spark).count() and out.columns.count("n_words") == 1
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.judge(decontam.find(helpers.odd_docs(spark), none)).where("contaminated").count() == 0
    assert decontam.find(helpers.empty_docs(spark), items).count() == 0


def peak_of(run):
    import tracemalloc

    tracemalloc.start()
    try:
        began = time.process_time()
        out = run()
        return out, time.process_time() - began, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_repeated_words_take_linear_time_and_memory():
    """An item and a document of n equal words: one pattern, n places."""
    took = {}
    for n in (2_000, 8_000, 20_000):
        (runs, ids), seconds, mb = peak_of(lambda n=n: decontam.Searcher([(7, "word " * n)], 13).search(["word"] * n, decontam.Hashes()))
        assert runs == [(0, n)] and ids == {7} and mb < 100
        took[n] = seconds
    assert took[8_000] < 10 * max(took[2_000], 0.02) and took[20_000] < 6 * max(took[8_000], 0.05)


def test_a_passage_that_many_items_share():
    """Posting lists count once for a text, whatever the occurrences."""
    rng = random.Random(8)
    passage = helpers.words(rng, 13)
    items = [(k, " ".join([*helpers.words(rng, 3), *passage, *helpers.words(rng, 3)])) for k in range(4_000)]
    searcher = decontam.Searcher(items, 13)
    text = [w for _ in range(200) for w in [*passage, "between", "them"]]
    (runs, ids), seconds, mb = peak_of(lambda: searcher.search(text, decontam.Hashes()))
    assert len(ids) == 4_000 and runs == [(15 * k, 15 * k + 13) for k in range(200)] and seconds < 1 and mb < 50


def test_periodic_texts_against_brute_force(spark):
    rng = random.Random(10)
    few = lambda n, k: " ".join(rng.choice("abc"[:k]) for _ in range(n))
    items = [(k, few(rng.randrange(1, 40), 1 + k % 3)) for k in range(25)] + [(99, "a " * 60), (98, "a " * 13), (97, "a b " * 20)]
    docs = [(i, few(rng.randrange(60), 1 + i % 3)) for i in range(40)] + [(50, "a " * 300), (51, "b a " * 100)]
    got = decontam.judge(decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=500))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()), key=repr) == brute(docs, items)
