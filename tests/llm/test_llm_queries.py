"""The queries with SQL against it, and all of them for their columns, rows and repeated ids."""

import oracle
import pytest

from glyphmill.llm import queries

COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"], "op2_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3_toxicity": ["doc_id", "held_out", "score", "predicted"], "op4_hamming_top_k": ["query_id", "rank", "vec_id", "distance"],
    "op5_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_added"], "op6_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op7_jaccard_join": ["doc_id", "n_shingles", "component_id"], "op8_quality": ["doc_id", "held_out", "score", "predicted"],
    "op9_html": ["page_id", "url", "text", "n_chars"], "op10_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans", "n_added"],
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert oracle.compare(queries.queries()[name](spark, oracle.SMALL), queries.oracle_sql()[name]) > 0


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(queries.oracle_sql())))
def test_columns_and_rows(spark, name):
    out = queries.queries()[name](spark, oracle.SMALL)
    assert out.columns == COLUMNS[name]
    table = "pages" if name == "op9_html" else "documents"
    assert out.count() == spark.read.parquet(f"{oracle.SMALL}/{table}.parquet").count()


def test_folds(spark):
    import zlib

    from pyspark.sql import functions as F

    from glyphmill.llm.common import fold_of

    rows = spark.range(200).select("id", fold_of(F.col("id"), 3).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in rows)
