"""Exact top-k search among binary codes by multi-index hashing.

A code is cut into segments of 16 bits and indexed under each. Codes within
distance m (r + 1) - 1 of a query agree with it in some one of m segments up to r
bits. So segments are searched with radius 0, 1, 2 ... and a query is done as soon as
its k-th verified distance is within what the radius covers.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import Tables, append, checkpoint, pick

SEGMENT = 16
BLOCK_CODES = 8_192
MOST_HIGH_BITS = 12
BUCKET_ROWS = 262_144
MOST_BUCKETS = 20_000
MOST_PAIRS = 1 << 20
MOST_QUERIES = 200_000


def masks(r: int, bits: int = SEGMENT) -> np.ndarray:
    """All values of ``bits`` bits of which r are set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), r)], np.uint16)


def binary_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", segments: int | None = None) -> DataFrame:
    """(vec_id, code): a bit for each component, set where it is 0 or more.

    Shorter vectors, null components and the rest of the last segment have bits of
    nought. Rows without an id or a vector are left out.
    """
    rows = pick(vectors, vec_id=id_col, vector=vector_col).where("vec_id is not null and vector is not null and size(vector) > 0")
    width = segments or -(-(rows.agg(F.max(F.size("vector"))).first()[0] or 1) // SEGMENT)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        def code(vector: list[float | None]) -> bytes:
            bits = np.zeros(width * SEGMENT, np.uint8)
            bits[: len(vector)] = [x is not None and x >= 0 for x in vector]
            return np.packbits(bits).tobytes()

        return lambda column: [pa.array([code(v) for v in column.to_pylist()], pa.binary())]

    return append(rows, ["vector"], make, [T.StructField("code", T.BinaryType())]).select("vec_id", "code")


def segment(n: int) -> F.Column:
    """The value of a code's n-th segment."""
    return F.conv(F.hex(F.substring("code", 2 * n + 1, 2)), 16, 10).cast("int")


def search(codes: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest rows of ``codes`` for each row of ``queries``.

    Both have vec_id and code, of ``2 * segments`` bytes; other columns may have any
    names, and rows without an id or a code are left out. Ties go to the lower vec_id; fewer than k rows give all.
    Repeated rows count once, in both.
    Codes that repeat are searched once, with their k least ids; so do queries. The
    index is dealt out in blocks of about ``BLOCK_CODES`` codes, large buckets in several,
    and each block answers with k rows for a query at most. It is shuffled once, into a
    bucketed table in the shared folder, to which each radius sends its queries. A query
    asks a block once, so while there are ``MOST_QUERIES`` or fewer no block has more; beyond
    that, blocks that are asked by more answer lots of so many, each with a copy of the block.
    The table goes at the end, also after an error.
    """
    codes, queries = (pick(x, vec_id="vec_id", code="code").where("vec_id is not null and code is not null") for x in (codes, queries))
    rank = Window.partitionBy("code").orderBy("vec_id")
    index = checkpoint(
        codes.dropDuplicates(["vec_id", "code"]).withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k)
        .groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    total = index.count()
    high = min(MOST_HIGH_BITS, max(0, (total // BLOCK_CODES).bit_length()))
    low = SEGMENT - high
    parts = index.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), segment(i).alias("value")) for i in range(segments)])))
    parts = parts.select("code", "ids", "s.seg", F.shiftright("s.value", low).alias("top"))
    sizes = parts.groupBy("seg", "top").agg(F.ceil(F.count("*") / (2 * BLOCK_CODES)).alias("cuts"))
    sizes = checkpoint(sizes)
    dealt = parts.join(sizes, ["seg", "top"]).select(F.col("seg").alias("i_seg"), F.col("top").alias("i_top"), F.pmod(F.xxhash64("code"), "cuts").alias("i_cut"), F.col("code").alias("entry"), "ids")
    own = Tables(codes.sparkSession)
    buckets = max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, total * segments // BUCKET_ROWS))
    try:
        dealt = own.bucketed(dealt, ["i_seg", "i_top", "i_cut"], buckets)
        asked = checkpoint(queries.select("code").distinct())
        best = asked.select("code", F.lit(0).alias("distance"), F.lit(0).cast("long").alias("vec_id")).limit(0)
        active = asked.withColumn("worst", F.lit(1 << 30))
        r = 0
        while r <= SEGMENT and (left := active.count()):
            flips = [(i, bin(i).count("1")) for i in range(1 << high) if bin(i).count("1") <= r]
            near = F.array(*[F.struct(F.lit(a).alias("flip"), F.lit(b).alias("used")) for a, b in flips])
            probes = active.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), segment(i).alias("value")) for i in range(segments)])))
            probes = probes.withColumn("f", F.explode(near)).select("code", "worst", "s.seg", F.shiftright("s.value", low).bitwiseXOR(F.col("f.flip")).alias("top"))
            probes = probes.join(sizes, ["seg", "top"]).withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).select("seg", "top", "cut", "code", "worst")
            ranked = best.union(answers(probes, dealt, r, k, left)).withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("distance", "vec_id"))).where(F.col("n") <= k)
            best = checkpoint(ranked.drop("n"))
            covered = segments * (r + 1) - 1
            state = best.groupBy("code").agg(F.count("*").alias("n"), F.max("distance").alias("worst"))
            active = asked.join(state, "code", "left").where((F.coalesce("n", F.lit(0)) < k) | (F.col("worst") > covered))
            active = checkpoint(active.select("code", F.when(F.coalesce("n", F.lit(0)) < k, 1 << 30).otherwise(F.col("worst")).alias("worst")))
            r += 1
    finally:
        own.clear()
    out = queries.select(F.col("vec_id").alias("query_id"), "code").distinct().join(best, "code")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "code").orderBy("distance", "vec_id")))
    return ranked.select("query_id", "rank", "vec_id", "distance")


def answers(probes: DataFrame, dealt: DataFrame, r: int, k: int, left: int) -> DataFrame:
    """(code, distance, vec_id) that the blocks answer to ``probes`` of ``left`` queries; groups hold ``MOST_QUERIES`` of them or about so many.

    Only blocks that are asked by more are shuffled again; how many segments and
    leading bits there are bounds their list, which is broadcast.
    """
    schema = "code binary, distance int, vec_id long"
    index, keys = ["i_seg", "i_top", "i_cut"], ["seg", "top", "cut"]
    if left <= MOST_QUERIES:
        return probes.groupBy(*keys).cogroup(dealt.groupBy(*index)).applyInPandas(matcher(r, k), schema)
    asked = probes.where("cut = 0").groupBy("seg", "top").agg(F.ceil(F.count("*") / MOST_QUERIES).alias("lots")).where("lots > 1")
    hot = F.broadcast(checkpoint(asked))
    few = probes.join(hot, ["seg", "top"], "left_anti").groupBy(*keys).cogroup(dealt.groupBy(*index)).applyInPandas(matcher(r, k), schema)
    many = probes.join(hot, ["seg", "top"]).withColumn("lot", F.pmod(F.xxhash64("code"), "lots"))
    blocks = dealt.join(hot.toDF("i_seg", "i_top", "lots"), ["i_seg", "i_top"]).withColumn("i_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)))
    more = many.groupBy(*keys, "lot").cogroup(blocks.groupBy(*index, "i_lot")).applyInPandas(matcher(r, k), schema)
    return few.union(more)


def matcher(r: int, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Finds, within one block of a segment, the codes that this radius adds, and verifies them.

    A code is told by the first of its segments of least distance, and only there,
    so that no code is told twice. Queries are taken as many at a time as make
    ``MOST_PAIRS`` pairs with the block at most.
    """
    flips = masks(r)

    def run(queries: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(queries) and len(codes):
            seg = int(codes["i_seg"].iat[0])
            table = numbers(codes["entry"])
            order = np.argsort(table[:, seg], kind="stable")
            table = table[order]
            values, starts, sizes = np.unique(table[:, seg], return_index=True, return_counts=True)
            slots = np.full(1 << SEGMENT, -1, np.int32)
            slots[values] = np.arange(len(values))
            named = codes["ids"].to_numpy()[order]
            firsts = np.cumsum([0] + [len(i) for i in named])
            ids = np.concatenate(named).astype(np.int64)
            asked, worst = numbers(queries["code"]), queries["worst"].to_numpy()
            step = max(1, MOST_PAIRS // max(len(codes), min(len(flips), len(values))))
            for at in range(0, len(asked), step):
                q = asked[at : at + step]
                if len(flips) < len(values):
                    slot = slots[flips ^ q[:, seg, None]]
                    who, which = np.nonzero(slot >= 0)
                    which = slot[who, which]
                else:
                    who, which = np.nonzero(np.bitwise_count(values ^ q[:, seg, None]) == r)
                who, rows = np.repeat(who, sizes[which]), ranges(starts[which], sizes[which])
                apart = np.bitwise_count(table[rows] ^ q[who])
                distance = apart.sum(1, dtype=np.int32)
                keep = (apart.argmin(1) == seg) & (distance <= worst[at + who])
                who, rows, distance = who[keep], rows[keep], distance[keep]
                # codes as far as each query's k-th, then their ids
                keep = least(who, distance, rows, k, ties=True)
                who, rows, distance = who[keep], rows[keep], distance[keep]
                many = firsts[rows + 1] - firsts[rows]
                who, distance, told = np.repeat(who, many), np.repeat(distance, many), ids[ranges(firsts[rows], many)]
                keep = least(who, distance, told, k)
                found.append(pd.DataFrame({"code": queries["code"].to_numpy()[at + who[keep]], "distance": distance[keep], "vec_id": told[keep]}))
        return pd.concat(found) if found else pd.DataFrame({"code": [], "distance": np.empty(0, np.int32), "vec_id": np.empty(0, np.int64)})

    return run


def numbers(codes: pd.Series) -> np.ndarray:
    """Codes as rows of their segments' values."""
    return np.frombuffer(b"".join(codes), ">u2").reshape(len(codes), -1).astype(np.uint16)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def least(who: np.ndarray, distance: np.ndarray, then: np.ndarray, k: int, ties: bool = False) -> np.ndarray:
    """Places of the k rows of least (distance, then) for each of ``who``; with ``ties`` all rows as far as the k-th."""
    order = np.lexsort((then, distance, who))
    _, starts, sizes = np.unique(who[order], return_index=True, return_counts=True)
    if ties:
        last = distance[order][starts + np.minimum(sizes, k) - 1]
        return order[distance[order] <= np.repeat(last, sizes)]
    return order[ranges(np.zeros_like(sizes), sizes) < k]
