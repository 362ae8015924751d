"""Hard-negative mining against all products in whole numbers."""

import math
import random

import numpy as np
import pytest

from glyphmill.llm import negatives


def brute(rows, positives=5, wanted=3):
    own = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        code = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in code) >= 2**56:
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, code)
        own[i] = min(own.get(i, row), row)
    width = max((len(c) for _, c in own.values()), default=0)
    product = lambda a, b: sum(x * y for x, y in zip(a + [0] * width, b))
    out = []
    for a, (label, code) in own.items():
        if a % 50:
            continue
        scores = [(-product(code, c), i, other == label) for i, (other, c) in own.items() if i != a]
        for s, p, _ in sorted(x for x in scores if x[2])[:positives]:
            fits = sorted(x for x in scores if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s)[:wanted]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted(tuple(r) for r in negatives.mine(df, **more).collect())
    assert got == brute(rows)
    return got


def vectors(seed, n, width=16, spread=None, labels=4, first=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(labels, width)) if spread is None else spread
    label = rng.integers(0, labels, n)
    v = (middle[label] + rng.normal(size=(n, width))) / math.sqrt(width)
    return [(first + i, [float(x) for x in v[i]], int(label[i])) for i in range(n)]


@pytest.mark.parametrize("width", [1, 3, 16, 64])
def test_against_all_products(spark, width):
    assert check(spark, vectors(width, 400, width))


def test_more_rows_than_a_step(spark, monkeypatch):
    """Steps, seeds and verified pairs cut small, so that bounds and thresholds of earlier steps count."""
    for name, n in (("ROW_STEP", 7), ("ANCHOR_ROWS", 2), ("VERIFIED", 5), ("SEEDS", 4)):
        monkeypatch.setattr(negatives, name, n)
    assert check(spark, vectors(5, 500, 24), cell_bytes=20_000)


def test_ties_go_to_smaller_ids(spark):
    rng = random.Random(1)
    few = [[1.0, 0.0], [0.9, 0.1], [0.7, 0.2], [0.0, 1.0], [-1.0, 0.0], [0.0, 0.0]]
    assert check(spark, [(i, rng.choice(few), rng.randrange(3)) for i in range(300)])


def test_one_label_holds_most_rows(spark):
    rows = [(i, v, 0 if i % 10 else label) for i, v, label in vectors(7, 400)]
    assert check(spark, rows)
    assert check(spark, [(i, v, 0) for i, v, _ in rows])  # only ids divisible by 7 have another label


def test_large_components(spark):
    """Products near what a long holds a hundred times."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) * 2.0**18 + rng.integers(-9, 9, 4)], int(i % 3)) for i in range(200)]
    assert check(spark, rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(9, 120, 4)
    rows += [(None, [1.0] * 4, 1), (200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [nan] * 4, 1), (203, [inf, 0.0, 0.0, 0.0], 2), (204, [1.0] * 4, None), (250, [], 1), (251, [1.0], 2), (252, [1.0] * 6, 2)]
    rows += [(253, [3.4e38] * 4, 1), (254, [2.0**20] * 4, 1), (50, rows[50][1], rows[50][2]), (50, rows[51][1], 0), (61, rows[61][1], 0), (61, [0.1] * 3, 0), (62, [-0.5], 1), (62, [-0.5, -0.1], 1), (-50, [0.5] * 4, -3)]
    df = spark.createDataFrame([(*r, "x", r[2]) for r in rows], "vec_id long, embedding array<float>, label int, LABEL_2 string, rank int")
    got = sorted(tuple(r) for r in negatives.mine(df).collect())
    assert got == brute(rows) and got
    assert negatives.mine(df.limit(0)).count() == 0
    assert negatives.mine(df.where("vec_id = 204")).count() == 0


def test_survivors_lose_no_pair():
    """Bounds against exact products, with vectors far from the axes they are turned to."""
    rng = np.random.default_rng(4)
    code = rng.integers(-300, 300, (200, 32)).astype(np.int32)
    axes = np.linalg.qr(rng.normal(size=(32, 32)))[0]
    heads = [8, 24]
    a, b = (negatives.Turned(np.arange(len(c)), np.zeros(len(c), np.int64), c, axes, heads) for c in (code[:20], code))
    exact = code[:20].astype(np.int64) @ code.T.astype(np.int64)
    low, most = np.quantile(exact, 0.9, axis=1).astype(np.int64), np.quantile(exact, 0.95, axis=1).astype(np.int64)
    x, y, s = negatives.survivors(a, b, heads, lambda *_: low.astype(float), most.astype(float), None)
    found = dict(zip(zip(x.tolist(), y.tolist()), s.tolist()))
    wanted = {(i, j): exact[i, j] for i in range(20) for j in range(200) if low[i] <= exact[i, j] <= most[i]}
    assert wanted.items() <= found.items()
    assert len(found) < exact.size
