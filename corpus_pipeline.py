"""Cleaning a corpus: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe, decontam, jaccard, pii, toxicity
from glyphmill.llm.common import Tables, checkpoint, position, read, scratch
from glyphmill.llm.jaccard import MOST_SENT


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` with doc_id and text, and its other columns under names that clash with nothing."""
    own = {position(docs, "doc_id"): "doc_id", position(docs, "text"): "text"}
    return docs.toDF(*[own.get(i, f"_{i}") for i in range(len(docs.columns))])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject.

    Each row is judged by its own text, so equal texts go or stay together and
    repeated rows stay repeated. Null and empty texts have the lowest score and
    stay; rows without an id are judged, but nothing is learned from them.
    """
    own = plain(docs)
    model = toxicity.learn(own, read(spark, sf_dir, "labels"))
    return toxicity.score(own, model).where("predicted = 0").select(*own.columns).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of the n-gram Jaccard join over sets of five words linked at 80 % of their union.

    Rows are told apart by their set and id, so an id that different texts share
    does no harm. Rows with the least id and one set are repeats: the one of least
    text stays, whatever its words' case and spaces. Rows without an id, and null,
    empty and blank texts, link with nothing: all of them stay, repeats too.

    Only rows whose id stands for a row that goes, or a repeated one, are looked at
    again; while these ids are at most ``MOST_SENT`` they are broadcast, and no text is shuffled.
    """
    own = plain(docs)
    groups = jaccard.join(own).where("doc_id is not null and n_shingles > 0").select("key", "doc_id", "component_id")
    rows = groups.groupBy("key", "doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("least"))
    seen = checkpoint(rows.where("n > 1 or doc_id <> least").select("key", "doc_id", (F.col("doc_id") == F.col("least")).alias("_stays")))
    ids = checkpoint(seen.select("doc_id").distinct())
    sent = F.broadcast(ids) if ids.count() <= MOST_SENT else ids
    names = [f"_own{i}" for i in range(len(own.columns))]
    again = jaccard.keyed(own.join(sent, "doc_id", "left_semi")).join(seen, ["key", "doc_id"], "left")
    row = F.struct(*[F.col(c).alias(n) for c, n in zip(own.columns, names)])
    others = F.to_json(F.struct(*[F.col(c) for c in own.columns if c not in ("doc_id", "text")])) if len(own.columns) > 2 else F.lit("")
    first = again.where("_stays").groupBy("key", "doc_id").agg(F.min_by(row, F.struct(F.col("text"), others)).alias("row"))
    single = again.where("_stays is null").select(*own.columns)
    out = own.join(sent, "doc_id", "left_anti").select(*own.columns).unionAll(single).unionAll(first.select(*[F.col("row").getField(n) for n in names]))
    return out.toDF(*docs.columns)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark has not contaminated.

    Each row is judged by its own text; null and empty texts have no words and
    stay, rows without an id are judged like others, repeated rows stay repeated.
    """
    own = plain(docs)
    judged = decontam.judge(decontam.find(own, read(spark, sf_dir, "benchmark")))
    return judged.where("not contaminated").select(*own.columns).toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data masked; ``n_chars`` follows the text.

    All rows stay, repeated ones and those without an id too. A null text stays
    null, and so does its ``n_chars``.
    """
    own = plain(docs)
    out = pii.detect(own, pii.learn(own), masked="masked")
    counted = f"_{position(docs, 'n_chars')}" if "n_chars" in docs.columns else ""
    columns = [F.col("masked") if c == "text" else F.length("masked").cast("long") if c == counted else F.col(c) for c in own.columns]
    return out.select(*[c.alias(f"_{i}") for i, c in enumerate(columns)]).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids and tokens, decoded again: where that does not give the text, the tokens are null.

    One row for each row, repeated ones and those without an id too; null and empty texts have no tokens.
    """
    own = bpe.encode(plain(docs), digests=True)
    same = F.col("decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return own.select("doc_id", *[F.when(same, F.col(c)).alias(c) for c in ("n_tokens", "ids")])


STAGES = [
    ("toxicity", toxic),
    ("jaccard_join", near_copies),
    ("decontamination", contaminated),
    ("pii", personal_data),
    ("bpe", encode),
]

#: No SQL has learned models or merges in it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage returns is written before the next one reads it.

    Tables that a stage needed go once its rows are written, also where it fails, and
    so do a stage's rows once the next one's are. The input of the last stage stays in
    the shared folder, as the result reads it.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        own = Tables(spark, kept=True)
        with scratch():
            docs = own.cut(stage(spark, docs, sf_dir))
        if before:
            before.clear()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
