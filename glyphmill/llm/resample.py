"""Importance resampling towards a target distribution, over hashed word n-grams.

Features are runs of words, told by the CRC of their bytes modulo a number of
buckets. Bucket counts of the corpus and of the target give each bucket a gain, the
logarithm of how much likelier the target makes it; a document's weight is the mean
gain of its features, and Gumbel noise from a hash of its id turns the highest sums
into a sample without replacement.

Texts of more than ``LONG_BYTES`` are cut into chunks that are dealt out over the
tasks. A chunk owns the starting positions of its words and carries ``max_n - 1`` words
of the next one, so that each feature is counted once, in the chunk where it starts;
counts and gains of chunks are summed by document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import Tables, map_batches, pick

BUCKETS = 10_000
MAX_N = 2
PERCENT = 25
LEAST_WORDS = 20
SEED = "7"
LONG_BYTES = 1 << 16
CHUNK_WORDS = 8_192

#: Bytes of words as they are, A to Z in lower case, all others as spaces. Bytes beyond 127 belong to words.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def words_of(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A to Z alone, as UTF-8."""
    return (text or "").encode().translate(FOLD).split()


def hashes(words: list[bytes], own: int, max_n: int) -> list[int]:
    """CRCs of the runs of 1 to ``max_n`` words that start at one of the first ``own`` words."""
    level = list(map(crc32, words))
    out = level[:own]
    tails = [b" " + w for w in words]
    for k in range(1, max_n):
        level = list(map(crc32, tails[k:], level))  # the CRC goes on from that of the shorter run
        out += level[:own]
    return out


def chunks(docs: DataFrame, max_n: int, chunk_words: int, long_bytes: int) -> DataFrame:
    """(doc_id, digest, chunk, own, text): chunks of (doc_id, text) and how many words each owns; a short text is one chunk, with ``own`` null.

    Chunks of long texts are dealt out by document and number; short texts stay where they are.
    """
    docs = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text")
    size = F.octet_length(F.coalesce("text", F.lit("")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = words_of(batch.column(2)[row].as_py())
                for k, at in enumerate(range(0, max(1, len(words)), chunk_words)):
                    text = b" ".join(words[at : at + chunk_words + max_n - 1]).decode()
                    own = min(chunk_words, len(words) - at)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([k], pa.int32()), pa.array([own], pa.int32()), pa.array([text])],
                        names=["doc_id", "digest", "chunk", "own", "text"],
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    long = map_batches(docs.where(size > long_bytes), cut, f"doc_id {kind}, digest string, chunk int, own int, text string")
    short = docs.where(size <= long_bytes).select("doc_id", "digest", F.lit(0).alias("chunk"), F.lit(None).cast("int").alias("own"), "text")
    return short.unionAll(long.repartition("doc_id", "digest", "chunk"))


def bucket_counts(texts: DataFrame, max_n: int, buckets: int) -> np.ndarray:
    """How many features of all chunks fall into each bucket; a task tells one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                held = own.as_py()
                found = np.array(hashes(words, len(words) if held is None else held, max_n), np.int64)
                total += np.bincount(found % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = map_batches(texts.select("own", "text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # one row a bucket at most
        out[r.bucket] = r.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths: the logarithm of its smoothed share in the target over that in the source, in doubles."""
    n = len(source)
    up, down = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * up / ((s + 1.0) * down))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(texts: DataFrame, gains: np.ndarray, max_n: int) -> DataFrame:
    """(doc_id, digest, rows, n_words, n_features, weight): sums of the chunks of equal rows; ``rows`` is how many these are."""
    sent = texts.sparkSession.sparkContext.broadcast(gains)  # one number a bucket
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_gains = sent.value
        for batch in batches:
            counts = []
            for own, text in zip(batch.column(3), batch.column(4)):
                words = words_of(text.as_py())
                held = len(words) if own.as_py() is None else own.as_py()
                found = np.array(hashes(words, held, max_n), np.int64)
                counts.append((held, len(found), int(own_gains[found % len(own_gains)].sum())))
            told = [pa.array(x, pa.int64()) for x in zip(*counts)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *told], names=["doc_id", "digest", "chunk", "words", "features", "gain"])

    parts = map_batches(texts, run, f"doc_id {kind}, digest string, chunk int, words long, features long, gain long")
    sums = parts.groupBy("doc_id", "digest").agg(F.sum((F.col("chunk") == 0).cast("long")).alias("rows"), *[F.sum(c).alias(c) for c in ("words", "features", "gain")])
    each = lambda c: F.expr(f"{c} div rows")  # noqa: E731  equal rows have equal sums
    out = sums.select("doc_id", "digest", "rows", each("words").alias("n_words"), each("features").alias("n_features"), each("gain").alias("gain"))
    mean = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features"))
    return out.withColumn("weight", mean).drop("gain")


def noise(doc_id: F.Column, seed: str) -> F.Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash of seed and id, in doubles."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS,
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, chunk_words: int = CHUNK_WORDS, long_bytes: int = LONG_BYTES,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of ``docs``; ``rank`` is null for rows that are not drawn.

    ``percent`` of the rows with ``least_words`` words or more are drawn, by highest
    score, ties to the smaller id, then to fewer features. Null and empty texts have no
    features and weight 0. A null id is hashed as the empty string and comes last among
    ties. Rows that repeat are rows of their own: they have one score and ranks that
    follow each other. Other columns, whatever their names, are left out. An empty
    target or corpus counts nought in each bucket.

    Ranks need no global sort: rows are counted by score, which takes few values at any
    size (gains and noise are thousandths of logarithms), and only rows at or above the
    last drawn score are put in order, each score by itself.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    own = chunks(pick(docs, doc_id=id_col, text=text_col), max_n, chunk_words, long_bytes)
    other = chunks(pick(target, text=target_text).select(F.lit(0).cast("long").alias("doc_id"), "text"), max_n, chunk_words, long_bytes)
    gains = gains_of(bucket_counts(own, max_n, buckets), bucket_counts(other, max_n, buckets))
    scored = tables.cut(weighed(own, gains, max_n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))

    fits = F.col("n_words") >= least_words
    levels = sorted(((r.score, r.n) for r in scored.where(fits).groupBy("score").agg(F.sum("rows").alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in levels) // 100
    before, held = [], 0
    for score, n in levels:
        if held >= wanted:
            break
        before.append((score, held))
        held += n
    least = before[-1][0] if before else None
    starts = F.broadcast(spark.createDataFrame(before, "score long, before long"))  # one row a score

    result = ["doc_id", "n_features", "weight", "score"]
    drawn = scored.where(fits & (F.col("score") >= least)) if before else scored.limit(0)
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = drawn.join(starts, "score").withColumn("first", F.col("before") + F.sum("rows").over(order) - F.col("rows"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy")
    drawn = drawn.select(*result, "first", copy).select(*result, F.when(F.col("first") + F.col("copy") <= wanted, F.col("first") + F.col("copy")).alias("rank"))
    rest = scored.where(~(fits & (F.col("score") >= least))) if before else scored
    rest = rest.select(*result, copy).select(*result, F.lit(None).cast("long").alias("rank"))
    return drawn.unionAll(rest)
