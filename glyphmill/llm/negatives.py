"""Exact hard-negative mining by partial products in rotated space.

Vectors of whole numbers are rotated to the principal axes of all rows, so that
leading components hold most of a product. What the rest can add is at most the
product of the two residual norms (Cauchy and Schwarz), and a slack covers rounding.
Pairs whose bound does not reach what is already found are discarded after a few
components; those that stay are verified by products of whole numbers. The result
does not depend on the rotation, only the work does.

Rows are dealt out in cells of bounded size by a hash of their id. A task holds one
cell at a time, rows of which are turned once, and the anchors pass it in batches; a
first pass finds each anchor's positives, a second one its negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import Tables, map_batches, pick
from glyphmill.llm.hamming import least

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
ANCHOR_STEP = 50
MOVED_STEP, LABELS = 7, 10
LOWEST, HIGHEST = 50, 95  # percent of the positive's score
CELL_BYTES = 32 << 20
ROW_STEP = 4_096
ANCHOR_ROWS = 256
VERIFIED = 1 << 15
SEEDS = 16
#: Shares of the energy that the leading components of each round hold.
ENERGY = (0.5, 0.8)
#: Of the components of a row: a hundred times a product of two such rows fits a long.
MOST_SQUARES = 2.0**56
NONE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def codes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, code): rows that take part, with components of whole numbers and labels as the contract changes them."""
    rows = pick(vectors, vec_id=id_col, vector=vector_col, label=label_col).where("vec_id is not null and label is not null and vector is not null")
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    whole = F.transform("vector", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double"))
    rows = rows.where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("code"))
    rows = rows.where(F.aggregate("code", F.lit(0.0), lambda s, x: s + x * x) < MOST_SQUARES)
    label = F.when(F.col("vec_id") % MOVED_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), F.transform("code", lambda x: x.cast("int")).alias("code"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones end in noughts."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.int32)
    out = np.zeros((len(sizes), width), np.int32)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def rotation(codes: DataFrame, width: int) -> tuple[np.ndarray, list[int]]:
    """Principal axes of all rows, by falling energy, and how many of them each round takes; tasks tell one number for each two components."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = matrix(batch.column(0), width).astype(np.float64)
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), pa.array(total[upper])], names=["i", "j", "v"])

    moments = np.zeros((width, width))
    for r in map_batches(codes.select("code"), run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        moments[r.i, r.j] = moments[r.j, r.i] = r.v
    energy, axes = np.linalg.eigh(moments)
    share = np.cumsum(energy[::-1]) / max(energy.sum(), 1e-300)
    heads = sorted({min(width, int(np.searchsorted(share, s)) + 1) for s in ENERGY})
    return np.ascontiguousarray(axes[:, ::-1]), heads


class Turned:
    """Rows of whole numbers, turned, with the norms of what follows the leading components of each round."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, code: np.ndarray, axes: np.ndarray, heads: list[int]) -> None:
        self.ids, self.labels, self.code = ids, labels, code
        turned = code.astype(np.float64) @ axes
        self.rest = [np.sqrt((turned[:, m:] ** 2).sum(1)).astype(np.float32) for m in heads]
        self.norm = np.sqrt((turned**2).sum(1)).astype(np.float32)
        self.turned = turned.astype(np.float32)

    def part(self, at: slice | np.ndarray) -> Turned:
        out = object.__new__(Turned)
        out.ids, out.labels, out.code, out.norm, out.turned = (x[at] for x in (self.ids, self.labels, self.code, self.norm, self.turned))
        out.rest = [r[at] for r in self.rest]
        return out


def once(ids: np.ndarray, labels: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each id, that of least label and then least components; by label."""
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort([*code.T[::-1], labels, ids])
        ids, labels, code = ids[order], labels[order], code[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        ids, labels, code = ids[first], labels[first], code[first]
    order = np.argsort(labels, kind="stable")
    return ids[order], labels[order], code[order]


def verified(a: Turned, b: Turned, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whole-number products of the rows x of ``a`` with the rows y of ``b``."""
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), VERIFIED):
        s = slice(at, at + VERIFIED)
        out[s] = np.einsum("ij,ij->i", a.code[x[s]].astype(np.int64), b.code[y[s]].astype(np.int64))
    return out


def survivors(a: Turned, b: Turned, heads: list[int], least_of: Callable[[np.ndarray, np.ndarray], np.ndarray], most: np.ndarray, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, product) of the pairs whose product may lie between a least value of x and ``most`` of x.

    ``least_of`` gets the pairs (x, product) that were verified first, those of
    greatest partial product, and tells the least value that still matters to each x.
    """
    m = heads[0]
    part = a.turned[:, :m] @ b.turned[:, :m].T
    if allowed is not None:
        part[~allowed] = -np.inf
    seeds = min(SEEDS, part.shape[1])
    top = np.argpartition(-part, seeds - 1, axis=1)[:, :seeds]
    x = np.repeat(np.arange(len(a.ids)), seeds)
    y = top.ravel()
    real = np.isfinite(part[x, y])
    x, y = x[real], y[real]
    low = least_of(x, verified(a, b, x, y), y)
    slack = lambda n: np.float32((n + 8) * 2.0**-22)  # noqa: E731  of both norms' product: rounding of n single-precision products
    spread = np.outer(a.rest[0], b.rest[0]) + slack(m) * np.outer(a.norm, b.norm)
    x, y = np.nonzero((part + spread >= low[:, None]) & (part - spread <= most[:, None]))
    part = part[x, y].astype(np.float64)
    for k in range(1, len(heads)):
        keep = np.empty(len(x), bool)
        for at in range(0, len(x), VERIFIED):
            s = slice(at, at + VERIFIED)
            part[s] += np.einsum("ij,ij->i", a.turned[x[s], heads[k - 1] : heads[k]], b.turned[y[s], heads[k - 1] : heads[k]])
            wide = a.rest[k][x[s]].astype(np.float64) * b.rest[k][y[s]] + slack(heads[k]) * a.norm[x[s]].astype(np.float64) * b.norm[y[s]]
            keep[s] = (part[s] + wide >= low[x[s]]) & (part[s] - wide <= most[x[s]])
        x, y, part = x[keep], y[keep], part[keep]
    return x, y, verified(a, b, x, y)


def cells_and_anchors(dealt: DataFrame, width: int, cells: int, sent: object, found: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``found(cell, anchors, rows)`` for each cell and each batch of the anchors that pass it; ``rows`` is the anchors' part of the batch.

    ``dealt`` has (cell, anchor, label, vec_id, code, ...). A cell's rows come before its anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, heads = sent.value
        now, parts, held = None, [], None
        for batch in batches:
            cell, anchor = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            ids, labels = batch.column(3).to_numpy(), batch.column(2).to_numpy()
            for at in np.split(np.arange(len(cell)), np.flatnonzero((cell[1:] != cell[:-1]) | (anchor[1:] != anchor[:-1])) + 1):
                if not len(at):
                    continue
                first, n = int(at[0]), len(at)
                if cell[first] != now:
                    now, parts, held = cell[first], [], None
                code = matrix(batch.column(4).slice(first, n), width)
                if not anchor[first]:
                    parts.append((ids[at], labels[at], code))
                    continue
                if held is None:
                    held = Turned(*once(*[np.concatenate(p) for p in zip(*parts)]), axes, heads) if parts else False
                    parts = []
                if held:
                    for k in range(0, n, ANCHOR_ROWS):
                        s = slice(k, k + ANCHOR_ROWS)
                        yield from found(held, Turned(ids[at][s], labels[at][s], code[s], axes, heads), batch.slice(first + k, min(ANCHOR_ROWS, n - k)))

    ordered = dealt.repartition(cells, "cell").sortWithinPartitions("cell", "anchor", "label", "vec_id")
    return map_batches(ordered, run, schema)


def mine(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors: str | F.Column | None = None,
    positives: int = POSITIVES, negatives: int = NEGATIVES, cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive, best negatives first.

    ``anchors`` is a condition on ``vec_id`` (by default those divisible by 50). Rows with a null id, label or
    vector, or a component that is null or not finite, take no part; nor do rows whose
    components' squares sum to ``MOST_SQUARES`` or more, as their scores might not fit a long. Of
    rows that share an id the one of least label, then of least components counts.
    Vectors that differ in length, empty ones too, end in noughts. A positive of negative
    score has no negatives, as none lies within its limits. Ties go to the smaller id.
    Other columns, whatever their names, are left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    tables = Tables(spark)
    codes = tables.cut(codes_of(vectors, id_col, vector_col, label_col))
    n, shortest, width = codes.agg(F.count("*"), F.min(F.size("code")), F.max(F.size("code"))).first()
    width = max(1, width or 1)
    if n and shortest < width:
        codes = codes.withColumn("code", F.concat("code", F.array_repeat(F.lit(0), F.lit(width) - F.size("code"))))
    sent = spark.sparkContext.broadcast(rotation(codes, width))  # a square of the vectors' width
    cells = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * width * 12 // cell_bytes))
    rows = codes.select(F.pmod(F.xxhash64("vec_id"), F.lit(cells)).alias("cell"), F.lit(False).alias("anchor"), "label", "vec_id", "code")
    # An anchor stands for its id, so the same row counts as in the cells.
    chosen = codes.where(anchors if anchors is not None else F.col("vec_id") % ANCHOR_STEP == 0)
    chosen = tables.cut(chosen.groupBy("vec_id").agg(F.min(F.struct("label", "code")).alias("least")).select("vec_id", "least.label", "least.code"))
    heads = sent.value[1]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell")

    def everywhere(asked: DataFrame, *more: str) -> DataFrame:
        return asked.select(every, F.lit(True).alias("anchor"), "label", "vec_id", "code", *more)

    def best(held: Turned, asked: Turned, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for label in np.unique(asked.labels):
            own = asked.part(asked.labels == label)
            lo, hi = np.searchsorted(held.labels, label), np.searchsorted(held.labels, label, "right")
            who, score, ids = (np.empty(0, np.int64) for _ in range(3))
            floor = np.full(len(own.ids), float(NONE))

            def fifth(x: np.ndarray, s: np.ndarray, y: np.ndarray, floor: np.ndarray = floor) -> np.ndarray:
                out = floor.copy()
                if len(x):
                    keep = least(x, -s, y, positives + 1)
                    many = np.bincount(x[keep], minlength=len(out))
                    full = many == positives + 1  # one more than asked for: the anchor itself may be among them
                    last = np.full(len(out), MOST)
                    np.minimum.at(last, x[keep], s[keep])
                    out[full] = np.maximum(out[full], last[full])
                return out

            for at in range(lo, hi, ROW_STEP):
                part = held.part(slice(at, min(hi, at + ROW_STEP)))
                x, y, s = survivors(own, part, heads, fifth, np.full(len(own.ids), np.inf), None)
                keep = own.ids[x] != part.ids[y]
                who, score, ids = np.concatenate([who, x[keep]]), np.concatenate([score, s[keep]]), np.concatenate([ids, part.ids[y[keep]]])
                keep = least(who, -score, ids, positives) if len(who) else np.empty(0, np.int64)
                who, score, ids = who[keep], score[keep], ids[keep]
                full = np.bincount(who, minlength=len(own.ids)) == positives
                last = np.full(len(own.ids), MOST)
                np.minimum.at(last, who, score)
                floor[full] = last[full]
            yield pa.RecordBatch.from_arrays([pa.array(own.ids[who]), pa.array(ids), pa.array(score)], names=["anchor_id", "positive_id", "positive_score"])

    told = cells_and_anchors(rows.unionAll(everywhere(chosen)), width, cells, sent, best, "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = tables.cut(told.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives).drop("n"))

    # The scores that a positive allows, as whole numbers.
    low, high = F.expr(f"({LOWEST} * positive_score + 99) div 100").alias("low"), F.expr(f"({HIGHEST} * positive_score) div 100").alias("high")
    pairs = pairs.where("positive_score >= 0").select("*", low, high)
    limits = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set(F.struct("low", "high")).alias("limits"))
    asked = chosen.join(limits, "vec_id").select("label", "vec_id", "code", F.col("limits.low").alias("low"), F.col("limits.high").alias("high"))

    def within(held: Turned, asked: Turned, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = len(asked.ids)
        lows, highs = (batch.column(c).to_pylist() for c in (5, 6))
        low, high = np.full((n, positives), MOST), np.full((n, positives), NONE)
        for i, (a, b) in enumerate(zip(lows, highs)):
            low[i, : len(a)], high[i, : len(b)] = a, b
        floor = low.copy()  # the least score that still matters to each anchor and limit
        kept = [tuple(np.empty(0, np.int64) for _ in range(3)) for _ in range(positives)]

        def third(x: np.ndarray, s: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = floor.copy()
            for j in range(positives):
                at = np.flatnonzero((s >= low[x, j]) & (s <= high[x, j]))
                if len(at):
                    keep = at[least(x[at], -s[at], y[at], negatives)]
                    full = np.bincount(x[keep], minlength=n) == negatives
                    last = np.full(n, MOST)
                    np.minimum.at(last, x[keep], s[keep])
                    out[full, j] = np.maximum(out[full, j], last[full])
            return out.min(axis=1).astype(np.float64)

        for at in range(0, len(held.ids), ROW_STEP):
            part = held.part(slice(at, at + ROW_STEP))
            x, y, s = survivors(asked, part, heads, third, high.max(axis=1).astype(np.float64), asked.labels[:, None] != part.labels[None, :])
            for j in range(positives):
                fits = (s >= low[x, j]) & (s <= high[x, j])
                who, score, ids = (np.concatenate(p) for p in zip(kept[j], (x[fits], s[fits], part.ids[y[fits]])))
                keep = least(who, -score, ids, negatives) if len(who) else np.empty(0, np.int64)
                kept[j] = who[keep], score[keep], ids[keep]
                full = np.bincount(who[keep], minlength=n) == negatives
                last = np.full(n, MOST)
                np.minimum.at(last, who[keep], score[keep])
                floor[full, j] = last[full]
        for j in range(positives):
            who, score, ids = kept[j]
            told = [asked.ids[who], low[who, j], high[who, j], ids, score]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in told], names=["anchor_id", "low", "high", "negative_id", "negative_score"])

    dealt = rows.unionByName(everywhere(asked, "low", "high"), allowMissingColumns=True)
    told = cells_and_anchors(dealt, width, cells, sent, within, "anchor_id long, low long, high long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "low", "high").orderBy(F.desc("negative_score"), "negative_id")
    ranked = told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return pairs.join(ranked, ["anchor_id", "low", "high"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
