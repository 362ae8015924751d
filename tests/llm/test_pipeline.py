"""The pipeline's stages on a small corpus, each against a plain reading of what it should keep."""

import helpers
import oracle
import pytest
from pyspark.sql import functions as F
from test_decontam import brute as contamination
from test_jaccard import brute as components

import corpus_pipeline
from glyphmill.llm import bpe, jaccard, toxicity

NAMES = [n for n, _ in corpus_pipeline.STAGES]
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{oracle.SMALL}/documents.parquet").limit(200)


def test_the_order_of_the_stages():
    assert NAMES == ["toxicity", "jaccard_join", "decontamination", "pii", "bpe"]


@pytest.mark.parametrize("name", NAMES[:-1])
def test_columns_stay_and_odd_rows_do_no_harm(spark, docs, name):
    assert STAGE[name](spark, docs, oracle.SMALL).columns == docs.columns
    odd = helpers.odd_docs(spark)
    out = STAGE[name](spark, odd, oracle.SMALL)
    assert out.columns == odd.columns and out.count() <= odd.count()
    assert STAGE[name](spark, docs.limit(0), oracle.SMALL).count() == 0


@pytest.mark.parametrize("name", NAMES[:-1])
def test_clashing_names_keep_their_values(spark, docs, name):
    names = ["key", "predicted", "Score", "hits", "contaminated", "masked", "spans", "_copy", "n_words", "Text"]
    own = docs.select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names) if n != "Text"], F.lit(9).alias("Text")).limit(60)
    out = STAGE[name](spark, own, oracle.SMALL)
    assert out.columns == own.columns
    assert {tuple(r)[2:] for r in out.collect()} == {tuple(range(len(names)))}


def test_toxic_documents_go_and_others_stay(spark, docs):
    model = toxicity.learn(docs, spark.read.parquet(f"{oracle.SMALL}/labels.parquet"))
    matcher = toxicity.Matcher(model.entries, model.phrases)
    kept = {r.doc_id for r in STAGE["toxicity"](spark, docs, oracle.SMALL).collect()}
    for r in docs.collect():
        load = matcher.load(r.text or "")
        chance = model.chance[max(0, sum(a <= load for a in model.at) - 1)]
        assert (r.doc_id in kept) == (chance < 0.3)
    assert docs.count() * 0.7 < len(kept) < docs.count()


def test_one_document_of_each_group_stays(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = {i: c for i, _, c in components(rows, 5, 80)}
    kept = sorted(r.doc_id for r in STAGE["jaccard_join"](spark, docs, oracle.SMALL).collect())
    assert kept == sorted({*groups.values()}) and len(kept) < len(rows)


def test_contaminated_documents_go(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{oracle.SMALL}/benchmark.parquet").collect()]
    wanted = {i for i, *_, bad in contamination([(r.doc_id, r.text) for r in docs.limit(60).collect()], items) if not bad}
    assert {r.doc_id for r in STAGE["decontamination"](spark, docs.limit(60), oracle.SMALL).collect()} == wanted


def test_personal_data_is_masked(spark, docs):
    before = docs.where(F.col("text").contains("@")).count()
    out = STAGE["pii"](spark, docs, oracle.SMALL)
    assert out.count() == docs.count() and before > 0
    assert out.where(F.col("text").rlike("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]")).count() == 0
    assert out.where("n_chars <> length(text)").count() == 0


def test_tokens_that_do_not_decode_to_the_text_are_null(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "plain text"), (2, "naïve 日本 😀"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids) for r in STAGE["bpe"](spark, rows, oracle.SMALL).collect()}
    assert len(got) == 4 and got[3] == got[4] == (0, []) and all(n == len(ids) > 0 for n, ids in (got[1], got[2]))
    real = bpe.encode
    wrong = F.when(F.col("doc_id") == 2, F.lit("other")).otherwise(F.col("decoded_sha256"))
    monkeypatch.setattr(bpe, "encode", lambda docs, **more: real(docs, **more | {"digests": True}).withColumn("decoded_sha256", wrong))
    bad = {r.doc_id: (r.n_tokens, r.ids) for r in STAGE["bpe"](spark, rows, oracle.SMALL).collect()}
    assert bad == got | {2: (None, None)}


def test_the_whole_run(spark):
    out = corpus_pipeline.run(spark, oracle.SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    rows = out.collect()
    assert 0 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.n_tokens == len(r.ids) for r in rows)
    assert bpe.decode(out).where(F.col("decoded").rlike("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]")).count() == 0


def test_tables_go_when_their_stage_is_over(spark, monkeypatch):
    """Of all that the stages write, the last stage's input stays; where a stage fails, so does what it read."""
    import glob

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/tables-*"))
    out = corpus_pipeline.run(spark, oracle.SMALL)
    left = set(glob.glob(f"{folder}/tables-*")) - before
    assert len(left) == 1 and out.count() > 0

    def fails(*_):
        jaccard.Tables(spark).cut(spark.range(3))
        raise RuntimeError("stage")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], ("fails", fails), ("never", fails)])
    with pytest.raises(RuntimeError, match="stage"):
        corpus_pipeline.run(spark, oracle.SMALL)
    assert len(set(glob.glob(f"{folder}/tables-*")) - before - left) == 1
