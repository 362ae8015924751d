"""The SQL names give what the column functions give."""

from pyspark.sql import functions as F

from glyphmill.functions import registered, rules
from glyphmill.functions import text as tx
from glyphmill.operators import findings

TEXTS = ["plain", "", None, "A​B‍C\xa0D", "“Ａ＼＇—B…”\0", "‮x "]


def test_functions_and_table_function(spark):
    registered.register(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    df.createOrReplaceTempView("texts")
    for m in rules.MODES:
        rows = spark.sql(f"select doc_id, sanitize_{m}(text) as o, clean_for_{m}(text) as c from texts").exceptAll(df.select("doc_id", tx.sanitize(F.col("text"), m), tx.is_clean(F.col("text"), m)))
        assert rows.count() == 0
    got = spark.sql("select doc_id, finding_count(text) as n, required_mode(text) as r from texts").exceptAll(df.select("doc_id", tx.finding_count(F.col("text")), tx.required_mode(F.col("text"))))
    assert got.count() == 0
    told = {(r.doc_id, r.codepoint, r.position) for r in spark.sql("select doc_id, f.* from texts, lateral text_findings(text) f").collect()}
    assert told == {(r.doc_id, f"U+{r.codepoint:04X}", r.position) for r in findings.located(df).collect()}
