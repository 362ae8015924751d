"""Language, toxicity and quality: held-out accuracy, odd rows and what each is made of."""

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import langid, quality, queries, toxicity
from glyphmill.llm.common import fold_of

DIR = "/root/testdata/sf0.1"


def table(spark, name):
    return spark.read.parquet(f"{DIR}/{name}.parquet")


def test_held_out_languages(spark):
    rows = queries.op1_language_id(spark, DIR).join(table(spark, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_are_learned_outside_the_fold_only(spark):
    docs = spark.createDataFrame([(i, "abc def ghi", "xx") for i in range(50)], "doc_id long, text string, lang string")
    learned = langid.learn(docs.where(fold_of(F.col("doc_id"), 3) == 1))
    out = langid.identify(docs, learned)
    assert {r.lang_pred for r in out.collect()} == {"xx"}
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_odd_texts_have_no_language(spark):
    learned = langid.learn(table(spark, "documents").limit(500))
    rows = {r.text: r for r in langid.identify(helpers.odd_docs(spark), learned).collect()}
    assert rows[None].lang_pred == rows[""].lang_pred == rows[" \n\t "].lang_pred == "und" and rows[None].score == 0
    assert all(rows[t].lang_pred in learned for t in ("a", "x" * 50_000, "naïve 日本 😀"))
    assert langid.identify(helpers.empty_docs(spark), learned).count() == 0
    assert langid.learn(helpers.empty_docs(spark)) == {}


def plain_vector(text, dimensions):
    """The sum over all letters of the product of three rolled letter vectors."""
    codes = [0, *(int(langid.letters()[ord(c)]) for c in text), 0]
    vectors = langid.letter_vectors(np.array(codes), dimensions, langid.SEED).astype(int)
    return sum((np.roll(vectors[i - 1], 2) * np.roll(vectors[i], 1) * vectors[i + 1] for i in range(1, len(codes) - 1) if codes[i]), np.zeros(dimensions))


LANGUAGES = [(1, "the cat sat on the mat", "a"), (2, "Die Katze saß auf der Matte", "b"), (3, "кошка сидела на ковре", "c"), (4, "猫はマットの上に座った", "d"), (5, None, "a"), (6, "", "b"), (7, "lost", None), (8, "x1y2 Ünïcode", "a")]


@pytest.mark.parametrize("piece, block, cells", [(1 << 18, 4096, 1 << 20), (5, 3, 2)])
def test_languages_by_plain_cosines(spark, monkeypatch, piece, block, cells):
    monkeypatch.setattr(langid, "PIECE_CHARS", piece)
    monkeypatch.setattr(langid, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(langid, "BLOCK_CELLS", cells)
    docs = spark.createDataFrame(LANGUAGES, "doc_id long, text string, lang string")
    learned = langid.learn(docs)
    for name in "abcd":
        assert np.array_equal(learned[name], sum((plain_vector(t, 512) for _, t, x in LANGUAGES if x == name and t), np.zeros(512)))
    texts = ["the mat", "der Matte", "на ковре", "の上に", "12 34", "long words " * 30, "mixed слова words"]
    got = {r.text: r for r in langid.identify(spark.createDataFrame([(t,) for t in texts], "text string"), learned).collect()}
    for t in texts:
        own = plain_vector(t, 512)
        cosines = {n: own @ np.array(v) / max(np.linalg.norm(own), 1e-9) / np.linalg.norm(v) for n, v in learned.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert got[t].lang_pred == ("und" if t == "12 34" else best) and abs(got[t].score - max(0, cosines[best])) < 1e-9


def test_equal_cosines_and_too_many_languages(spark):
    same = spark.createDataFrame([(1, "same words", "z"), (2, "same words", "y"), (3, "same words", "z")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(same, langid.learn(same)).collect()} == {"y"}
    with pytest.raises(ValueError):
        langid.learn(same, most=1)


@pytest.mark.parametrize("op, label, least", [(queries.op3_toxicity, "toxic", 0.93), (queries.op8_quality, "quality", 0.98)])
def test_held_out_labels(spark, op, label, least):
    rows = op(spark, DIR).join(table(spark, "labels"), "doc_id").where("held_out").collect()
    assert helpers.auc([r[label] for r in rows], [r.score for r in rows]) > least
    assert all(0 <= r.score <= 1 for r in rows)


def test_folding_and_exceptions():
    m = toxicity.Matcher({" idiot ": 4.0, " stup": 3.0}, ["idiot proof"])
    assert m.load("you IDIOT") > 0 and m.load("an 1d10t!") > 0 and m.load("an іdіоt.") > 0 and m.load("stupidly") > 0
    assert m.load("it is idiot proof") == 0 and m.load("an idiot, idiot proof") > 0
    assert m.load("") == 0 and m.load("idiotic plan" if False else "plain words") == 0
    assert m.load("idiot a") > m.load("idiot " + "a " * 50)


def test_chances_rise():
    at, chance = toxicity.rising(np.array([0, 0, 1, 2, 2, 3.0]), np.array([0, 0, 1, 0, 1, 1]))
    assert at == sorted(at) and chance == sorted(chance)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, module, label):
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)] + [(None, 1, 1), (3, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")
    learn = module.learn if module is toxicity else module.train
    model = learn(helpers.odd_docs(spark), marks)
    out = module.score(helpers.odd_docs(spark), model)
    rows = out.collect()
    assert len(rows) == helpers.odd_docs(spark).count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert [c.lower() for c in out.columns].count("score") == 1
    none = learn(helpers.odd_docs(spark), marks.limit(0))
    assert module.score(helpers.empty_docs(spark), none).count() == 0


def test_training_repeats_itself(spark):
    docs, labels = table(spark, "documents").select("doc_id", "text"), table(spark, "labels")
    a, b = quality.train(docs, labels), quality.train(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(a, b)
