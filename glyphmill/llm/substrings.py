"""Removal of word passages that repeat across documents, by seeds that are extended.

1. Texts of one word sequence (exact copies) are one class, which its least id stands
   for: the others lose all that a window covers.
2. A class is winnowed: each window of ``WINDOW`` words picks the least hash of the runs
   of ``SEED`` words in it, the last of equal ones. Windows that are equal pick equal
   runs, so documents that share a window share an anchor. An anchor owns the windows
   that picked it; they follow each other.
3. Documents are joined on anchors, each with the least document of its anchor. Of
   these partners a document keeps the few with which it shares most anchors; the
   partner's words are sent with those of up to ``FAN`` documents, and each seed is
   extended both ways to the maximal repeat, which counts from ``WINDOW`` words on.
4. Windows that are not settled thus, and whose anchor unsettled windows of another
   document have too, are extended to their whole window and grouped by anchor and hash
   of it; the least document of the group tells the rest. The least document that has
   a window is never settled for it, so nothing is lost whatever step 3 left out.

Words are compared by 64-bit hashes, classes by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import Tables, append, map_batches, pick

WINDOW = 50
SEED = 16
PARTNERS = 4
FAN = 64
CACHED_WORDS = 50_000
MOST_SENT = 1_000_000
TOLD_ROWS = 10_000
PRIME, OTHER = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


class Hashes(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out
        return out


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return (text or "").encode().split()


def hashed(words: list[bytes], known: Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words at each place: runs of powers of two, put together."""
    out, have, power = None, 0, words
    step = 1
    while size:
        if size & step:
            out = power if out is None else mixed(out[: len(power) - have], power[have:]) if len(power) > have else power[:0]
            have += step
            size -= step
        if size:
            power = mixed(power[:-step], power[step:]) if len(power) > step else power[:0]
            step *= 2
    return out


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes, element by element; ``a`` may be longer."""
    out = (a[: len(b)] * PRIME) ^ b
    out ^= out >> np.uint64(29)
    out *= OTHER
    return out ^ (out >> np.uint64(32))


def winnowed(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window) of each anchor: the least seed of each window, the last of equal ones, by place."""
    seeds = runs(words, seed)
    width = window - seed + 1  # seeds in a window
    best = np.arange(len(seeds))
    span = 1
    later = lambda a, b: np.where(seeds[a] < seeds[b], a, b)  # noqa: E731  the later of equal ones
    while span * 2 <= width:
        best = later(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = later(best[: len(seeds) - width + 1], best[width - span :])
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    place = best[first]
    return seeds[place], place, first


def described(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(doc_id, n_words, key, whole, anchors, places, firsts): size, class and digest of each row, and the anchors of its class."""

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        known = Hashes()

        def work(column: pa.Array) -> list[pa.Array]:
            sizes, keys, whole, found = [], [], [], []
            for text in column:
                words = words_of(text.as_py())
                joined = b" ".join(words)
                sizes.append(len(words))
                keys.append(xxhash.xxh3_128_digest(joined))
                whole.append(hashlib.sha256(joined).hexdigest())
                found.append(winnowed(hashed(words, known), window, seed) if len(words) >= window else [np.empty(0, np.int64)] * 3)
            lists = [pa.array([f[0].view(np.int64) for f in found], pa.list_(pa.int64())), *[pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (1, 2)]]
            return [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(whole), *lists]

        return work

    ints = T.ArrayType(T.IntegerType())
    fields = [("n_words", T.LongType()), ("key", T.BinaryType()), ("whole", T.StringType()), ("anchors", T.ArrayType(T.LongType())), ("places", ints), ("firsts", ints)]
    return append(docs, ["text"], make, [T.StructField(*f) for f in fields]).drop("text")


def texts_of(keys: DataFrame, docs: DataFrame, tables: Tables) -> DataFrame:
    """(key, text) of the given (key, doc_id), from the documents with these ids.

    The ids go to the documents where there are at most ``MOST_SENT`` of them; beyond that both sides are shuffled.
    """
    ids = tables.cut(keys.select("doc_id").distinct())
    wanted = docs.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, "doc_id", "left_semi")

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        return lambda column: [pa.array([xxhash.xxh3_128_digest(b" ".join(words_of(t.as_py()))) for t in column], pa.binary())]

    found = append(wanted, ["text"], make, [T.StructField("key", T.BinaryType())])
    # An id may stand for several texts, and repeated rows for one.
    return found.select("key", "text").join(keys.select("key"), "key", "left_semi").dropDuplicates(["key"])


def agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first elements of two arrays agree; looks no further than about twice that."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def extended(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Maximal repeats of ``window`` words or more, as (start, end) in ``b``: each seed (place in a, place in b) goes on both ways while words agree.

    An anchor that ``b`` has more than once is a seed at its first place only.
    """
    reach: dict[int, int] = {}
    used: set[int] = set()
    out = []
    for x, y in sorted(seeds, key=lambda s: s[1]):
        if x in used or reach.get(y - x, -1) > y:
            continue
        used.add(x)
        right = y + agree(a[x:], b[y:])
        left = y - agree(a[:x][::-1], b[:y][::-1])
        reach[y - x] = right
        if right - left >= window:
            out.append((left, right))
    return out


def repeats(pairs: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(key, starts, ends): the maximal repeats of ``key`` in ``partner`` for each pair (partner, key, seeds)."""
    fans = pairs.groupBy("partner").agg(F.ceil(F.count("*") / FAN).alias("fans"))
    dealt = pairs.join(fans, "partner").withColumn("fan", F.pmod(F.xxhash64("key"), "fans").cast("int"))
    leaves = dealt.join(texts, "key").select("partner", "fan", F.lit(1).alias("leaf"), "key", "seeds", "text")
    heads = fans.select("partner", F.explode(F.sequence(F.lit(0), F.col("fans").cast("int") - 1)).alias("fan"))
    heads = heads.join(texts.withColumnRenamed("key", "partner"), "partner")
    heads = heads.select("partner", "fan", F.lit(0).alias("leaf"), F.col("partner").alias("key"), F.lit(None).cast(pairs.schema["seeds"].dataType).alias("seeds"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = Hashes(), np.empty(0, np.uint64)
        for batch in batches:
            keys, starts, ends = [], [], []
            for leaf, key, seeds, text in zip(*(batch.column(c) for c in ("leaf", "key", "seeds", "text"))):
                own = hashed(words_of(text.as_py()), known)
                if not leaf.as_py():
                    held = own
                    continue
                found = extended(held, own, [(s["x"], s["y"]) for s in seeds.as_py()], window)
                if found:
                    keys.append(key.as_py())
                    starts.append([a for a, _ in found])
                    ends.append([b for _, b in found])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *[pa.array(x, pa.list_(pa.int32())) for x in (starts, ends)]], names=["key", "starts", "ends"])

    fanned = heads.unionAll(leaves).repartition("partner", "fan").sortWithinPartitions("partner", "fan", "leaf")
    return map_batches(fanned, run, "key binary, starts array<int>, ends array<int>")


def left_over(classes: DataFrame, settled: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id, key, start, end): runs of window starts, by the anchor that owns them, that no repeat settles."""
    # Repeats of all partners together, as window starts.
    spans = settled.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    both = classes.join(spans, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, doc_id, n, anchors, firsts, starts, ends in zip(*(batch.column(c) for c in ("key", "doc_id", "n_words", "anchors", "firsts", "starts", "ends"))):
                n = n.as_py() - window + 1
                done = np.zeros(n + 1, bool)
                for a, b in zip(starts.as_py() or (), ends.as_py() or ()):
                    done[a : b - window + 1] = True
                done[n] = True
                owner = np.repeat(np.arange(len(anchors)), np.diff([*firsts.as_py(), n]))
                open_ = ~done[:n]
                begin = np.flatnonzero(open_ & np.concatenate([[True], done[: n - 1] | (owner[1:] != owner[:-1])]))
                end = np.flatnonzero(open_ & np.concatenate([done[1:n] | (owner[1:] != owner[:-1]), [True]])) + 1
                named = anchors.as_py()
                for i, (a, b) in enumerate(((named[owner[s]], doc_id.as_py()) for s in begin)):
                    for column, value in zip(out, (a, b, key.as_py(), int(begin[i]), int(end[i]))):
                        column.append(value)
            kinds = (pa.int64(), batch.schema.field("doc_id").type, pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["anchor", "doc_id", "key", "start", "end"])

    kind = classes.schema["doc_id"].dataType.simpleString()
    return map_batches(both.select("key", "doc_id", "n_words", "anchors", "firsts", "starts", "ends"), run, f"anchor long, doc_id {kind}, key binary, start int, end int")


def windows(runs_of: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(anchor, window, doc_id, key, start) for each window start of the runs of (key, doc_id, runs); equal windows of a class once, with all its starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            for key, doc_id, own, text in zip(*(batch.column(c) for c in ("key", "doc_id", "runs", "text"))):
                grams = runs(hashed(words_of(text.as_py()), known), window).view(np.int64)
                own = own.as_py()
                at = np.concatenate([np.arange(r["start"], r["end"]) for r in own])
                anchor = np.concatenate([np.full(r["end"] - r["start"], r["anchor"]) for r in own])
                for k in range(0, len(at), TOLD_ROWS):
                    s = slice(k, k + TOLD_ROWS)
                    n = len(at[s])
                    told = [pa.array(anchor[s]), pa.array(grams[at[s]]), pa.array([doc_id.as_py()] * n, batch.schema.field("doc_id").type), pa.array([key.as_py()] * n, pa.binary()), pa.array(at[s].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(told, names=["anchor", "window", "doc_id", "key", "start"])

    kind = runs_of.schema["doc_id"].dataType.simpleString()
    return map_batches(runs_of.join(texts, "key").select("key", "doc_id", "runs", "text"), run, f"anchor long, window long, doc_id {kind}, key binary, start int")


def cleaned(spans: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(key, removed, kept): how many words of a class lie in its spans (flat starts and ends), and the digest of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, removed, kept = [], [], []
            for key, starts, ends, text in zip(*(batch.column(c) for c in ("key", "starts", "ends", "text"))):
                words = words_of(text.as_py())
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, starts.as_py(), 1)
                np.add.at(edge, ends.as_py(), -1)
                stays = np.cumsum(edge[:-1]) == 0
                keys.append(key.as_py())
                removed.append(int((~stays).sum()))
                kept.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(stays)])).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["key", "removed", "kept"])

    return map_batches(spans.join(texts, "key").select("key", "starts", "ends", "text"), run, "key binary, removed long, kept string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, partners: int = PARTNERS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts in a row with
    a smaller id; windows are judged on the input. Null and empty texts have no words;
    texts of fewer words than a window keep all. Rows that share an id take nothing
    from each other. Rows without an id keep all, and nothing is removed for them.
    Repeated rows are rows of their own with one result. Other columns, whatever their
    names, are left out. ``seed`` is less than ``window``.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    tables = Tables(docs.sparkSession)
    rows = tables.cut(described(docs, window, seed))
    named = rows.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    classes = tables.cut(named.groupBy("key").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n_words", "anchors", "places", "firsts")]))

    # Seeds: anchors of two ids or more, each with its least document.
    seeds = classes.select("key", "doc_id", F.explode(F.arrays_zip("anchors", "places")).alias("a")).select("key", "doc_id", F.col("a.anchors").alias("anchor"), F.col("a.places").alias("place"))
    first = seeds.groupBy("anchor").agg(F.min(F.struct("doc_id", "key", "place")).alias("least"), F.max("doc_id").alias("last")).where("least.doc_id < last")
    first = tables.cut(first.select("anchor", F.col("least.doc_id").alias("partner_id"), F.col("least.key").alias("partner"), F.col("least.place").alias("x")))
    met = seeds.join(first, "anchor").where(F.col("partner_id") < F.col("doc_id"))
    pairs = met.groupBy("key", "doc_id", "partner", "partner_id").agg(F.collect_list(F.struct("x", F.col("place").alias("y"))).alias("seeds"))
    most = Window.partitionBy("key").orderBy(F.size("seeds").desc(), "partner")
    pairs = tables.cut(pairs.withColumn("n", F.row_number().over(most)).where(F.col("n") <= partners).drop("n"))
    wanted = pairs.select("key", "doc_id").unionAll(pairs.select("partner", "partner_id")).distinct()
    settled = tables.cut(repeats(pairs.select("partner", "key", "seeds"), texts_of(wanted, docs, tables), window))

    # What is left: windows whose anchor unsettled windows of two ids or more have.
    left = tables.cut(left_over(classes.drop("places"), settled, window))
    shared = left.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").select("anchor")
    open_runs = tables.cut(left.join(shared, "anchor").groupBy("key", "doc_id").agg(F.collect_list(F.struct("anchor", "start", "end")).alias("runs")))
    told = tables.cut(windows(open_runs, texts_of(open_runs, docs, tables), window))
    repeated = told.groupBy("anchor", "window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").select("anchor", "window", "least")
    more = told.join(repeated, ["anchor", "window"]).where(F.col("least") < F.col("doc_id")).select("key", F.array("start").alias("starts"), F.array(F.col("start") + window).alias("ends"))

    spans = settled.unionAll(more).groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    spans = tables.cut(spans)
    found = tables.cut(cleaned(spans, texts_of(spans.select("key").join(classes.select("key", "doc_id"), "key"), docs, tables), window))

    # Later rows of a class lose all; its first ones what was found.
    ids = classes.select("key", F.col("doc_id").alias("least")).join(found, "key", "left")
    out = rows.select("doc_id", "n_words", "key", "whole").join(ids, "key", "left")
    copy = F.col("doc_id") > F.col("least")
    removed = F.when(F.col("doc_id").isNull(), 0).when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0)))
    kept = F.when(F.col("doc_id").isNull(), F.col("whole")).when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "whole"))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))
