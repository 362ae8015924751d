"""Exact top-k search against all distances."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import hamming
from glyphmill.llm.common import Tables


def brute(codes, queries, k):
    codes = sorted({*codes})
    out = set()
    for q, c in {*queries}:
        near = sorted((bin(int.from_bytes(c, "big") ^ int.from_bytes(x, "big")).count("1"), i) for i, x in codes)[:k]
        out |= {(q, n, i, d) for n, (d, i) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("n, k, segments", [(300, 5, 2), (40, 50, 4), (1, 3, 1)])
def test_against_all_distances(spark, monkeypatch, n, k, segments):
    monkeypatch.setattr(hamming, "BLOCK_CODES", 16)
    rng = random.Random(n)
    centre = rng.randbytes(2 * segments)
    rows = [(i, centre if i % 3 == 0 else bytes(b ^ (1 << rng.randrange(8)) for b in centre) if i % 3 == 1 else rng.randbytes(2 * segments)) for i in range(n)]
    rows += rows[:3]
    codes = spark.createDataFrame([(i, bytearray(c)) for i, c in rows], "vec_id long, code binary")
    got = hamming.search(codes, codes.where(F.col("vec_id") % 10 == 0), k, segments)
    assert {tuple(r) for r in got.collect()} == brute(rows, [r for r in rows if r[0] % 10 == 0], k)


def test_few_pairs_at_a_time_and_rows_of_any_columns(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK_CODES", 8)
    monkeypatch.setattr(hamming, "MOST_PAIRS", 20)
    rng = random.Random(5)
    rows = [(i, bytes([rng.randrange(4), 0, rng.randrange(256), 7])) for i in range(120)]
    codes = spark.createDataFrame([(i, bytearray(c), "x", 1, 2) for i, c in rows] + [(None, bytearray(4), "x", 1, 2), (500, None, None, None, None)], "vec_id long, code binary, ids string, Code2 int, worst int")
    got = hamming.search(codes, codes.where("vec_id % 3 = 0 or vec_id is null or code is null"), 4, 2)
    assert {tuple(r) for r in got.collect()} == brute(rows, [r for r in rows if r[0] % 3 == 0], 4)
    assert not [t for t in spark.catalog.listTables() if not t.isTemporary]


def test_lots_of_queries_of_a_block_that_many_ask(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK_CODES", 16)
    rng = random.Random(12)
    rows = [(i, bytes([7, 7]) + rng.randbytes(2) if i % 3 else rng.randbytes(4)) for i in range(240)]
    codes = spark.createDataFrame([(i, bytearray(c)) for i, c in rows], "vec_id long, code binary")
    asked = codes.where("vec_id % 2 = 0")
    whole = {tuple(r) for r in hamming.search(codes, asked, 5, 2).collect()}
    seen, answers = [], hamming.answers

    def watched(probes, dealt, r, k, left):
        seen.append(left)
        return answers(probes, dealt, r, k, left)

    monkeypatch.setattr(hamming, "answers", watched)
    monkeypatch.setattr(hamming, "MOST_QUERIES", 9)
    got = {tuple(r) for r in hamming.search(codes, asked, 5, 2).collect()}
    assert max(seen) == 120 and got == whole == brute(rows, [r for r in rows if r[0] % 2 == 0], 5)


def test_tables_go_after_an_error(spark, monkeypatch):
    made = []

    class Watched(Tables):
        def clear(self):
            made.append(self.folder)
            super().clear()

    def fails(*_):
        raise RuntimeError("stop")

    monkeypatch.setattr(hamming, "Tables", Watched)
    monkeypatch.setattr(hamming, "answers", fails)
    codes = spark.createDataFrame([(1, bytearray(b"ab")), (2, bytearray(b"cd"))], "vec_id long, code binary")
    with pytest.raises(RuntimeError, match="stop"):
        hamming.search(codes, codes, 1, 1)
    assert len(made) == 1 and not [t for t in spark.catalog.listTables() if not t.isTemporary]


def test_joins_with_a_bucketed_table_do_not_shuffle_it(spark):
    tables = Tables(spark)
    index = tables.bucketed(spark.range(1000).selectExpr("id % 7 as k", "id"), ["k"], 16)
    plan = spark.range(5).withColumnRenamed("id", "k").groupBy("k").cogroup(index.groupBy("k")).applyInPandas(lambda a, b: a, "k long")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and index.count() == 1000
    tables.clear()


def test_codes_of_odd_vectors(spark):
    rows = [(1, [1.0, -1.0]), (2, None), (None, [1.0]), (3, []), (4, [0.0, None]), (5, [float(x) for x in np.resize([1, -1], 20)])]
    got = {r.vec_id: bytes(r.code) for r in hamming.binary_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: b"\x80\0\0\0", 4: b"\x80\0\0\0", 5: b"\xaa\xaa\xa0\0"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, code binary")
    one = spark.createDataFrame([(1, bytearray(b"ab"))], "vec_id long, code binary")
    assert hamming.search(none, one, 3, 1).count() == 0 and hamming.search(one, none, 3, 1).count() == 0
