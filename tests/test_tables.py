"""SQL table functions and views give what the DataFrame functions give."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import rules
from glyphmill.operators import binaries, findings, tables
from glyphmill.plans import synthetic

MARKS = [chr(c) for r in rules.RULES for a, b in r.ranges for c in {a, b, (a + b) // 2}]


@pytest.fixture(scope="module")
def docs(spark):
    tables.register(spark)
    rng = random.Random(3)
    texts = [None, "", "plain words", "A​B‍C\xa0D", "…“Ａ＼＇—B…”\0", "x" * 50, "\U0010fffd \U000e0041"]
    texts += ["".join(rng.choice([*MARKS, "a", "é", " ", "日"]) for _ in range(rng.randrange(1, 120))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, "own", i % 3) for i, t in enumerate(texts)], "doc_id long, text string, Status string, n int")
    df.createOrReplaceTempView("sql_docs")
    return df


def test_analyze_text(spark, docs):
    got = spark.sql("select * from analyze_text(table(sql_docs))")
    want = findings.analyze_text(docs)
    assert got.columns == want.columns and [f.dataType.simpleString() for f in got.schema] == [f.dataType.simpleString() for f in want.schema]
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("mode", rules.MODES)
def test_sanitize_text(spark, docs, mode):
    got = spark.sql(f"select * from sanitize_text(table(sql_docs), '{mode}')")
    want = findings.sanitize_text(docs, mode)
    assert [c.lower() for c in got.columns if c != "changes"] == [c.lower() for c in ["doc_id", "text", "n", *[c for c in want.columns if c.lower() not in ("doc_id", "text", "n", "status")][:11], "status", "next_mode", "fully_clean"]]
    same = [c for c in got.columns if c != "changes"]
    assert sorted(map(str, got.select(*same).collect())) == sorted(map(str, want.select(*same).collect()))
    told = got.select("doc_id", F.inline("changes"))
    assert sorted(told.collect()) == sorted(findings.ledger(docs, mode).collect())


def test_other_columns_and_bad_arguments(spark, docs):
    docs.select("doc_id", F.col("text").alias("body"), "n").createOrReplaceTempView("sql_bodies")
    assert spark.sql("select sum(analysis.finding_count) s from analyze_text(table(sql_bodies), 'body') where n = 1").first().s > 0
    assert spark.sql("select * from sanitize_text(table(select body from sql_bodies where doc_id = 3), 'safe', text_column => 'body')").first().removed_count == 1
    for bad in ("analyze_text(table(sql_bodies))", "sanitize_text(table(sql_docs), 'Safe')", "analyze_text(table(sql_bodies), 'n')"):
        with pytest.raises(Exception, match="text column|mode must be"):
            spark.sql(f"select * from {bad}").collect()
    assert spark.sql("select * from analyze_text(table(select * from sql_docs where false))").count() == 0


def test_views_over_files(spark):
    rows = [(f"{f}-{v}", bytearray(synthetic.build(f, v, "words"))) for f in ("png", "docx", "pdf") for v in range(4)] + [("null", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    df.createOrReplaceTempView("sql_files")
    tables.publish(spark, "sql_files")
    assert sorted(map(str, spark.sql("select * from analyze_binary_sql_files").collect())) == sorted(map(str, binaries.analyze_binary(df).collect()))
    got = spark.sql("select b.path, b.status, s.removed_items, a.metadata_count from batch_status_sql_files b join sanitize_binary_sql_files s using (path) join analyze_binary_sql_files a using (path)").collect()
    assert len(got) == len(rows) and all(r.removed_items == r.metadata_count for r in got) and {r.status for r in got} == {"verified", "error"}
