"""The n-gram Jaccard join against all pairs."""

import random
import re

import helpers

from glyphmill.llm import jaccard


def sets(text, n=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return set()
    n = min(n, len(found))
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)}


def brute(rows, n=3, percent=90):
    own = [(i, sets(t, n)) for i, t in rows]
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            x, y = own[a][1], own[b][1]
            if x and y and own[a][0] is not None and own[b][0] is not None:
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(own):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), None if i is None else least[find(k)]) for k, (i, s) in enumerate(own)), key=repr)


def check(spark, rows, words=3, percent=90):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.join(df, words=words, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, words, percent)


def groups_of_copies(seed=1, most=2):
    rng = random.Random(seed)
    rows, n = [], 0
    for size in (1, 1, 2, 5, 40, 120):
        base = helpers.words(rng, rng.randrange(40, 160))
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(most + 1)):
                text[rng.randrange(len(text))] = rng.choice(helpers.VOCABULARY)
            rows.append((n, " ".join(text).upper() if rng.random() < 0.2 else " ".join(text)))
            n += 1
    rng.shuffle(rows)
    return rows


def test_groups_of_copies(spark):
    check(spark, groups_of_copies())


def test_five_words_at_four_fifths(spark):
    check(spark, groups_of_copies(3, 4), 5, 80)


def test_chains_where_the_ends_are_far_apart(spark):
    rng = random.Random(2)
    text = helpers.words(rng, 200)
    rows = []
    for i in range(60):
        rows.append((i, " ".join(text)))
        text[rng.randrange(200)] = rng.choice(helpers.VOCABULARY)
    check(spark, rows)


def test_at_the_threshold(spark):
    base = helpers.VOCABULARY[:40]  # 38 n-grams; one word more makes 38 of 39, four more 38 of 42
    rows = [(1, " ".join(base)), (2, " ".join(base + helpers.VOCABULARY[100:104])), (3, " ".join(base + helpers.VOCABULARY[100:105]))]
    check(spark, rows)


def test_short_texts_and_odd_rows(spark):
    rows = [(1, "a b"), (2, "A  b"), (3, "b a"), (4, None), (5, ""), (6, " \t"), (7, "a b c"), (7, "a b c"), (8, "a\x0bb\x0cc"), (None, "a b c"), (9, "à b c"), (10, "À b c")]
    check(spark, rows)


def test_an_id_that_different_texts_share(spark):
    rows = [(1, "one two three four"), (1, "five six seven eight"), (2, "five six seven eight"), (3, "one two three four")]
    got = {(r.doc_id, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_the_least_blocks_and_edges_in_many_tasks(spark, monkeypatch):
    for name, value in {"BLOCK_ROWS": 7, "MOST_SENT": 0, "TASK_EDGES": 3, "NEAREST": 1, "HELD_PAIRS": 5, "FAN": 2, "TOLD_ROWS": 3, "MOST_FREQUENT": 50, "CHUNK_GRAMS": 500}.items():
        monkeypatch.setattr(jaccard, name, value)
    test_chains_where_the_ends_are_far_apart(spark)
    near_the_threshold = groups_of_copies(5, 5)[:90]
    check(spark, near_the_threshold, 3, 90)


def test_a_forest_of_pairs_is_least():
    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(2, 9)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 20))]
        edges = [(a, b) for a, b in edges if a != b] or [(0, 1)]
        far = [rng.randrange(5) for _ in edges]
        root, wanted = list(range(n)), []
        for i in sorted(range(len(edges)), key=lambda i: (far[i], i)):
            a, b = (x for x in edges[i])
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[a] = b
                wanted.append(i)
        left, right = np.array(edges).T
        assert jaccard.forest(left, right, np.array(far)).tolist() == sorted(wanted)


def test_a_long_text_and_columns_of_any_name(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long, "k", 1), (2, long + " end", "k", 2), (3, None, None, None), (4, "a b", "k", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, COMPONENT_ID int")
    assert {(r.doc_id, r.component_id) for r in jaccard.join(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    out = jaccard.keyed(df)
    assert [c.lower() for c in out.columns] == ["doc_id", "text", "component_id", "key"] and len({bytes(r.key) for r in out.collect()}) == 4


def test_every_column_tells_its_nearest_pairs(spark):
    # Two components meet in two columns of one chunk; the nearer pairs stand in the first and must not take all the places.
    first = [(1, f"{c}{i}", c, 40, 0) for c in "pq" for i in range(3)]
    rows = [(gram, key.encode(), comp.encode(), n, bits) for gram, key, comp, n, bits in [*first, (2, "p8", "p", 100, 0), (2, "q8", "q", 100, 3), (3, "p9", "p", 100, 0), (3, "q9", "q", 100, 3)]]  # the last column of a stream is a chunk of its own
    assert len(first) ** 2 // 4 > jaccard.NEAREST
    entries = spark.createDataFrame([r[:4] for r in rows], "gram long, key binary, comp binary, n long").coalesce(1)
    classes = spark.createDataFrame([(k, bytes([bits, *bytes(7)])) for _, k, _, _, bits in rows], "key binary, sketch binary")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        told = {(bytes(r.a), bytes(r.b)) for r in jaccard.within_blocks(entries, classes, 90, "closest", jaccard.Tables(spark)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert (b"p8", b"q8") in told and len(told) == jaccard.NEAREST + 2


def test_empty_table(spark):
    assert jaccard.join(helpers.empty_docs(spark)).count() == 0
