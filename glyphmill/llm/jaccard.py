"""Join of documents by the Jaccard similarity of their word n-gram sets, and its components.

The document by n-gram incidence matrix times its transpose, of which only the
blocks that can hold a link are worked out:

1. documents of one set (exact copies) are one row of the matrix;
2. two sets that link share one of their first ``n - ceil(t n) + 1`` n-grams in
   any common order, so only those columns are multiplied. N-grams that many
   documents share come last in the order, and a column holds sets of like size
   only (one near the edge of a size class is in two), so that columns stay short;
3. columns with the same rows give the same products, so one of them is kept;
4. a column's rows are first compared with one row, its least, and each row is
   linked to the nearest such row: as many pairs as matrix entries, however
   large a group of near copies is;
5. what is still apart within a column is compared in blocks of bounded size. At
   first each block tells a least spanning forest of its pairs: if all of them
   hold, no other can join more. Only columns of which some pair failed are
   compared again, at last with all pairs that are left told;
6. pairs are discarded when the sizes, or parity sketches of 64 to 4,096 bits by
   size, bound the overlap below what the threshold asks for: sets whose sketches
   differ in d bits differ in d n-grams or more;
7. the overlap of the remaining pairs is counted on the whole sets.

Every link between different sets is thus found or known to lie within one
component. Sets are kept as 64-bit hashes, classes as 128-bit digests.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import Tables, append, map_batches, pick, written

WORDS = 5
PERCENT = 80
LEAST_SKETCH, MOST_SKETCH = 8, 512
BLOCK_ROWS = 300
MOST_FREQUENT = 1_000_000
MOST_SENT = 1_000_000
SEEN_OFTEN = 2
CACHED_WORDS = 50_000
CHUNK_GRAMS = 1_000_000
HELD_PAIRS = 200_000
TOLD_ROWS = 10_000
FAN = 64
NEAREST = 8
TASK_EDGES = 250_000
SIZE_CLASSES = [round(1.5**k) for k in range(100)]

P1, P2, P3 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Hashes(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out
        return out


def shingles(text: str | None, known: Hashes, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams; the whole sequence as one if it is shorter."""
    found = (text or "").encode().lower().split()  # bytes: A to Z, and ASCII white space, alone
    one = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    if not len(one):
        return one
    size = min(words, len(one))
    grams = np.full(len(one) - size + 1, size, np.uint64)
    for k in range(size):
        grams = (grams ^ one[k : len(one) - size + 1 + k]) * P1
        grams ^= grams >> np.uint64(31)
    grams *= P2
    return np.unique(grams ^ (grams >> np.uint64(29)))


def sketch(grams: np.ndarray) -> bytes:
    """Parity of the n-grams on each of the sketch's bits, of which there is about one for each n-gram."""
    size = LEAST_SKETCH
    while size < MOST_SKETCH and size * 8 < len(grams):
        size *= 2
    bits = np.bincount((grams * P3 >> np.uint64(20) & np.uint64(size * 8 - 1)).astype(np.int64), minlength=size * 8) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


class Sketches:
    """Sketches of many rows; those of a larger size are folded where a pair's sizes differ."""

    def __init__(self, sketches: list[bytes]) -> None:
        self.sketches = sketches
        self.size = np.fromiter(map(len, sketches), np.int64, len(sketches))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's place in the table of sketches of ``size`` bytes, and the table."""
        if size not in self.tables:
            place = np.full(len(self.size), -1)
            parts, at = [], 0
            for own in np.unique(self.size[self.size >= size]):
                rows = np.flatnonzero(self.size == own)
                bits = np.frombuffer(b"".join(self.sketches[i] for i in rows), np.uint64).reshape(len(rows), own // size, size // 8)
                parts.append(np.bitwise_xor.reduce(bits, axis=1))
                place[rows] = np.arange(at, at + len(rows))
                at += len(rows)
            self.tables[size] = place, np.concatenate(parts)
        return self.tables[size]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of the rows x and y differ, pair by pair."""
        out = np.zeros(len(x), np.int64)
        sizes = np.minimum(self.size[x], self.size[y])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            place, bits = self.table(int(size))
            out[at] = np.bitwise_count(bits[place[x[at]]] ^ bits[place[y[at]]]).sum(1, dtype=np.int64)
        return out


def columns(head: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Columns of a set of ``n`` n-grams: those of ``head`` within each size class that holds sets it may link with and not larger."""
    low, high = (bisect_right(SIZE_CLASSES, x) for x in (-(-percent * n // 100), n))
    own = np.arange(low, high + 1, dtype=np.uint64) * P3
    return ((head[None, :] ^ own[:, None]) * P1).ravel()


def frequent(docs: DataFrame, words: int, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that many documents hold, and their place among them by rising count.

    A part of the order only: results do not depend on it. A task tells those it
    sees in ``SEEN_OFTEN`` or more different sets of a chunk of its documents, and
    those of greatest sum are kept, ``MOST_FREQUENT`` at most, so what is sent is bounded.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        held: dict[int, np.ndarray] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            grams, counts = np.unique(np.concatenate([*held.values(), np.empty(0, np.uint64)]), return_counts=True)
            often = np.flatnonzero(counts >= SEEN_OFTEN)
            for at in (often[i : i + TOLD_ROWS] for i in range(0, len(often), TOLD_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(counts[at].astype(np.int64))], names=["gram", "n"])

        for batch in batches:
            for text in batch.column(0):
                grams = shingles(text.as_py(), known, words)
                held[hash(grams.tobytes())] = grams
                size += len(grams)
                if size > CHUNK_GRAMS:
                    yield from told()
                    held, size = {}, 0
        yield from told()

    counts = tables.cut(map_batches(docs.select("text"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    # Counts in steps of a tenth: a few hundred steps at any size.
    step = F.floor(F.log("n") * 10).cast("int")
    least, held = None, 0
    for level, size in sorted(((r.step, r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True):
        if held + size > MOST_FREQUENT:
            break
        least, held = level, held + size
    top = counts.where(step >= least if least is not None else F.lit(False)).toArrow()
    grams, n = top.column("gram").to_numpy().view(np.uint64), top.column("n").to_numpy()
    place = np.empty(len(n), np.int32)
    place[np.lexsort((grams, n))] = np.arange(len(n), dtype=np.int32)
    order = np.argsort(grams)
    return grams[order], place[order]


def digests(docs: DataFrame, words: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, key, n_shingles, sketch, head): a set's digest and size, and the columns to multiply."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most MOST_FREQUENT n-grams

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        known = Hashes()
        often, place = shared.value

        def work(column: pa.Array) -> list[pa.Array]:
            keys, sizes, sketches, heads = [], [], [], []
            for text in column:
                grams = shingles(text.as_py(), known, words)
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()))
                sizes.append(len(grams))
                sketches.append(sketch(grams))
                first = len(grams) - -(-percent * len(grams) // 100) + 1 if len(grams) else 0
                if len(often):
                    at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
                    late = np.where(often[at] == grams, place[at], -1)
                    grams = grams[np.argsort(late, kind="stable")]
                heads.append(columns(grams[:first], len(grams), percent).view(np.int64))
            return [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(heads, pa.list_(pa.int64()))]

        return work

    fields = [T.StructField("key", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("head", T.ArrayType(T.LongType()))]
    return append(docs, ["text"], make, fields).drop("text")


def keyed(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with ``key``, the digest of the row's n-gram set; null, empty and blank texts have that of the empty set. An own ``key`` gives way."""
    def make() -> Callable[[pa.Array], list[pa.Array]]:
        known = Hashes()
        return lambda column: [pa.array([xxhash.xxh3_128_digest(shingles(t.as_py(), known, words).tobytes()) for t in column], pa.binary())]

    return append(docs, [text_col], make, [T.StructField("key", T.BinaryType())])


def may_link(percent: int) -> F.Column:
    """Whether sizes and sketches of the sides a and b allow the threshold."""
    sizes = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
    # overlap <= (a + b - d) / 2 must reach percent / (100 + percent) of a + b
    return sizes & ((F.col("a_n") + F.col("b_n") - F.col("apart")) * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * (2 * percent))


def apart(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``apart``: the bits in which the two sketches differ."""
    def make() -> Callable[..., list[pa.Array]]:
        def work(a: pa.Array, b: pa.Array) -> list[pa.Array]:
            known = Sketches(a.to_pylist() + b.to_pylist())
            return [pa.array(known.apart(np.arange(len(a)), np.arange(len(a)) + len(a)), pa.int64())]

        return work

    return append(pairs, ["a_sketch", "b_sketch"], make, [T.StructField("apart", T.LongType())])


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, root) for the edges (a, b) of a partition: the least key that its edges reach from each key that is not least itself."""
    parts = [np.stack([np.asarray(batch.column(c).cast(pa.binary(16)).to_numpy(zero_copy_only=False), "V16") for c in ("a", "b")]) for batch in batches if batch.num_rows]
    if not parts:
        return
    ends = np.ascontiguousarray(np.concatenate(parts, axis=1)).view(">u8").reshape(2, -1, 2).astype(np.uint64)
    order = np.lexsort((ends[..., 1].ravel(), ends[..., 0].ravel()))
    flat = ends.reshape(-1, 2)[order]
    first = np.concatenate([[True], (flat[1:] != flat[:-1]).any(axis=1)])
    place = np.empty(len(flat), np.int64)
    place[order] = np.cumsum(first) - 1
    a, b = place.reshape(2, -1)
    keys = flat[first]
    root = np.arange(len(keys))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(keys)))
    names = [k.astype(">u8").tobytes() for k in keys]
    for at in (moved[i : i + TOLD_ROWS] for i in range(0, len(moved), TOLD_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], pa.binary()), pa.array([names[root[i]] for i in at], pa.binary())], names=["key", "root"])


def resolve(parents: DataFrame, tables: Tables) -> DataFrame:
    """(key, root) of a forest given as (key, parent) with parent < key, by pointer jumping."""
    trees = tables.cut(parents.select("key", F.col("parent").alias("root")))
    while True:
        up = trees.select(F.col("key").alias("root"), F.col("root").alias("top"))
        moved = tables.cut(trees.join(up, "root", "left").select("key", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        trees = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return trees


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(key, root): for each key of ``edges`` (a, b) the least key of its component, itself included.

    Tasks first contract edges among themselves, ``TASK_EDGES`` at most in each; where
    one task has them all, that is the result. Otherwise each round hangs every key
    on its least neighbour, finds the trees' roots by pointer jumping and merges
    the trees; at least half of the keys go each time.
    """
    edges = tables.cut(edges.select("a", "b").where("a <> b").distinct())
    tasks = max(1, -(-edges.count() // TASK_EDGES))
    known = tables.cut(map_batches(edges.repartition(tasks), contract, "key binary, root binary"))
    if tasks > 1:
        edges, known = known.select(F.col("key").alias("a"), F.col("root").alias("b")), None
        while not edges.isEmpty():
            both = edges.union(edges.select("b", "a"))
            least = both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("least"))
            roots = resolve(least.where("least < key").select("key", F.col("least").alias("parent")), tables)
            at = lambda side: roots.select(F.col("key").alias(side), F.col("root").alias(f"{side}_root"))
            if known is None:
                known = roots
            else:
                step = roots.select(F.col("key").alias("root"), F.col("root").alias("next"))
                known = tables.cut(known.join(step, "root", "left").select("key", F.coalesce("next", "root").alias("root")).union(roots.join(known, "key", "left_anti")))
            edges = edges.join(at("a"), "a", "left").join(at("b"), "b", "left")
            edges = tables.cut(edges.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b").distinct())
    return known.union(known.select(F.col("root").alias("key"), "root").distinct())


def merged(whole: DataFrame, links: DataFrame, tables: Tables) -> DataFrame:
    """(key, root) of the components ``whole`` after ``links`` (a, b) between their rows; rows without a row are their own root."""
    roots = whole.select(F.col("key").alias("x"), "root")
    for s in ("a", "b"):
        links = links.join(roots.withColumnRenamed("x", s), s, "left").withColumn(s, F.coalesce("root", s)).drop("root")
    joined = components(links, tables)
    out = whole.join(joined.select(F.col("key").alias("root"), F.col("root").alias("top")), "root", "left").select("key", F.coalesce("top", "root").alias("root"))
    return tables.cut(out.union(joined.join(whole, "key", "left_anti")))


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Chunks of a sorted stream that hold whole groups, with the starts of these; a group may span batches."""
    rest = None
    for batch in batches:
        rows = batch.to_pandas()
        rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
        if not len(rows):
            continue
        starts = np.flatnonzero((rows[columns] != rows[columns].shift()).any(axis=1).to_numpy())
        rest = rows.iloc[starts[-1] :]
        if starts[-1]:
            yield rows.iloc[: starts[-1]], starts[:-1]
    if rest is not None and len(rest):
        yield rest, np.zeros(1, np.int64)


def shared_columns(cells: DataFrame) -> DataFrame:
    """(gram): columns of two rows or more, one of those with the same rows.

    Rows are summed where they are, so a column of any length is one row for each task.
    """
    columns = cells.groupBy("gram").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("key")).alias("rows"))
    return columns.where("size > 1").groupBy("size", "rows").agg(F.min("gram").alias("gram")).select("gram")


def forest(left: np.ndarray, right: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the least spanning forest of the graph with the edges (left, right), by Boruvka's rounds; of equal edges the first."""
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    order = np.argsort(apart, kind="stable")
    a, b = a[order], b[order]
    root = np.arange(len(nodes))
    kept = np.zeros(len(a), bool)
    live = np.arange(len(a))
    while True:
        live = live[root[a[live]] != root[b[live]]]
        if not len(live):
            return np.sort(order[kept])
        x, y = root[a[live]], root[b[live]]
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, x, live)
        np.minimum.at(best, y, live)
        own = np.flatnonzero(best < len(a))
        kept[best[own]] = True
        # Each root goes over the least edge that it has; two that share one keep the lower.
        edge = best[own]
        to = np.where(root[a[edge]] == own, root[b[edge]], root[a[edge]])
        up = np.arange(len(nodes))
        up[own] = to
        both = up[up] == np.arange(len(nodes))
        up = np.where(both, np.minimum(up, np.arange(len(nodes))), up)
        while (up != up[up]).any():
            up = up[up]
        root = up[root]


def closest(group: np.ndarray, p: np.ndarray, q: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the ``NEAREST`` pairs of each two components (p, q) within each group; of equal pairs the first.

    A group with a pair that is not told thus tells others of the same components:
    one of them holds, or the group's column holds a key of a pair that failed.
    """
    order = np.lexsort((apart, q, p, group))
    keys = np.stack([group[order], p[order], q[order]])
    first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return np.sort(order[rank < NEAREST])


def blocks_of(entries: DataFrame, tables: Tables) -> DataFrame:
    """``entries`` (gram, key, comp, n) dealt out in pairs of blocks: (gram, i, j, own, key, comp, n).

    A column's rows of its largest component need no comparison with each other.
    The others, its strays, are cut into blocks of about ``BLOCK_ROWS`` by a hash of
    the key, and so are the former; each block of strays meets each block.
    Columns of one component are left out.
    """
    comps = entries.groupBy("gram", "comp").agg(F.count("*").alias("size"))
    columns = comps.groupBy("gram").agg(F.sum("size").alias("size"), F.max(F.struct("size", "comp")).alias("top")).where("top.size < size")
    columns = columns.select("gram", F.col("top.comp").alias("main"), F.ceil((F.col("size") - F.col("top.size")) / BLOCK_ROWS).cast("int").alias("s"), F.ceil(F.col("top.size") / BLOCK_ROWS).cast("int").alias("m"))
    cut = entries.join(tables.cut(columns), "gram").withColumn("stray", F.col("comp") != F.col("main"))
    own = F.when(F.col("stray"), F.pmod(F.xxhash64("key"), "s")).otherwise(F.col("s") + F.pmod(F.xxhash64("key"), "m")).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("stray"), F.col("s") + F.col("m")).otherwise(F.col("s")) - 1)))
    return cut.select("gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "comp", F.col("n").cast("int").alias("n"))


def within_blocks(entries: DataFrame, classes: DataFrame, percent: int, told: str, tables: Tables) -> DataFrame:
    """Pairs (a, b) of one column and different components that sizes and sketches allow: as ``told``, a forest, the closest, or all.

    ``entries`` are (gram, key, comp, n). Pairs of blocks are compared one by one
    in steps of bounded size; what is told is kept up with step by step.
    """
    cut = blocks_of(entries, tables).join(classes.select("key", "sketch"), "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["gram", "i", "j"]):
            sizes = np.diff(np.append(starts, len(rows)))
            left_of = np.repeat(starts + sizes, sizes) - np.arange(len(rows)) - 1  # rows of the group that follow
            n, own, across = rows["n"].to_numpy(), rows["own"].to_numpy(), (rows["i"] != rows["j"]).to_numpy()
            comp = pd.factorize(rows["comp"])[0].astype(np.int64)
            keys = rows["key"].to_numpy()
            sketches = Sketches(rows["sketch"].tolist())
            group = np.repeat(np.arange(len(starts)), sizes)
            held = [np.empty((3, 0), np.int64)]

            def folded() -> np.ndarray:
                x, y, d = np.concatenate(held, axis=1)
                order = np.lexsort((y, x, d))
                x, y, d = x[order], y[order], d[order]
                if told == "forest":
                    few = forest(group[x] * len(rows) + comp[x], group[y] * len(rows) + comp[y], d)
                elif told == "closest":
                    few = closest(group[x], np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y]), d)
                else:
                    few = np.arange(len(x))
                return np.stack([x, y, d])[:, few]

            def pairs() -> Iterator[pa.RecordBatch]:
                x, y, _ = folded()
                for at in range(0, len(x), TOLD_ROWS):
                    a, b = keys[x[at : at + TOLD_ROWS]], keys[y[at : at + TOLD_ROWS]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.binary()), pa.array(np.maximum(a, b), pa.binary())], names=["a", "b"])

            for step in range(1, int(sizes.max())):
                x = np.flatnonzero(left_of >= step)
                y = x + step
                fits = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent) & ~(across[x] & (own[x] == own[y]))
                x, y = x[fits], y[fits]
                d = sketches.apart(x, y)
                fits = (n[x] + n[y] - d) * (100 + percent) >= (n[x] + n[y]) * 2 * percent
                held.append(np.stack([x[fits], y[fits], d[fits]]))
                if sum(h.shape[1] for h in held[1:]) > HELD_PAIRS:
                    if told == "all":
                        yield from pairs()
                        held[:] = [np.empty((3, 0), np.int64)]
                    else:
                        held[:] = [folded()]
            yield from pairs()

    dealt = cut.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")
    return map_batches(dealt, compare, "a binary, b binary").distinct()


def near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow, with ``apart``."""
    side = lambda s: classes.select(F.col("key").alias(s), F.col("n").alias(f"{s}_n"), F.col("sketch").alias(f"{s}_sketch"))
    return apart(pairs.join(side("a"), "a").join(side("b"), "b")).where(may_link(percent)).select("a", "b", "apart")


def sets_of(keys: DataFrame, docs: DataFrame, classes: DataFrame, words: int, tables: Tables) -> DataFrame:
    """(key, grams) of the given keys: the whole sets as bytes, worked out again from one document of each.

    The ids go to the documents where there are at most ``MOST_SENT`` of them;
    beyond that both sides are shuffled.
    """
    ids = tables.cut(keys.distinct().join(classes.select("key", "doc_id"), "key").select("doc_id").distinct())
    few = ids.count() <= MOST_SENT
    wanted = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        known = Hashes()

        def work(column: pa.Array) -> list[pa.Array]:
            sets = [shingles(t.as_py(), known, words).tobytes() for t in column]
            return [pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.large_binary()).cast(pa.binary())]

        return work

    fields = [T.StructField("key", T.BinaryType()), T.StructField("grams", T.BinaryType())]
    # An id may stand for several texts, and a key for several of these rows.
    return tables.cut(append(wanted, ["text"], make, fields).select("key", "grams").groupBy("key").agg(F.first("grams").alias("grams")))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, tables: Tables) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold.

    The row of a pair that is in more of them is its centre. A centre's set is sent
    once for each ``FAN`` of its pairs, and the sets of their other rows follow it:
    no set is repeated for each pair, and no centre is one task's work.
    """
    pairs = tables.cut(pairs.select("a", "b"))
    sides = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key")))
    degree = tables.cut(sides.groupBy("key").agg(F.count("*").alias("n")))
    sets = sets_of(degree.select("key"), docs, classes, words, tables)
    at = lambda s: degree.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"))
    turned = pairs.join(at("a"), "a").join(at("b"), "b").withColumn("turned", F.col("n_b") > F.col("n_a"))
    fans = F.ceil(F.greatest("n_a", "n_b") / FAN)
    turned = turned.select(F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")).alias("centre"), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("key"), fans.alias("fans"))
    turned = tables.cut(turned.withColumn("fan", F.pmod(F.xxhash64("key"), "fans").cast("int")).drop("fans"))
    leaves = turned.join(sets, "key").select("centre", "fan", F.lit(1).alias("leaf"), "key", "grams")
    heads = turned.select("centre", "fan").distinct().join(sets.withColumnRenamed("key", "centre"), "centre").select("centre", "fan", F.lit(0).alias("leaf"), F.col("centre").alias("key"), "grams")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, held = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for centre, leaf, key, grams in zip(*(batch.column(c) for c in ("centre", "leaf", "key", "grams"))):
                own = np.frombuffer(grams.as_buffer(), np.uint64)
                if not leaf.as_py():
                    middle, held = centre.as_py(), own.copy()
                    continue
                small, large = (own, held) if len(own) < len(held) else (held, own)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                if both * (100 + percent) >= (len(own) + len(held)) * percent:
                    found.append((middle, key.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.binary()), pa.array([max(p) for p in found], pa.binary())], names=["a", "b"])

    fanned = heads.unionAll(leaves).repartition("centre", "fan").sortWithinPartitions("centre", "fan", "leaf")
    return map_batches(fanned, compare, "a binary, b binary")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, key, component_id) for each row of ``docs``.

    Rows whose sets overlap by ``percent`` of their union or more are linked;
    ``component_id`` is the least id reachable by links, the row's own included.
    Null, empty or blank texts have no set and link with nothing. Rows without an
    id link with nothing and have no component. Repeated rows are kept, and texts
    of one id are rows of their own. Whole texts of any length count; other columns
    of ``docs``, whatever their names, are left out.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    tables = Tables(docs.sparkSession)
    try:
        return written(linked(docs, words, percent, tables))
    finally:
        tables.clear()


def linked(docs: DataFrame, words: int, percent: int, tables: Tables) -> DataFrame:
    """``join`` of (doc_id, text), from tables that must stay until its rows are written."""
    rows = tables.cut(digests(docs, words, percent, frequent(docs, words, tables)))
    classes = tables.cut(
        rows.where("n_shingles > 0 and doc_id is not null").groupBy("key")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("head").alias("head"))
    )
    # Columns with one row have nothing to multiply: only the others' entries are dealt out.
    cells = classes.select("key", "n", F.explode("head").alias("gram"))
    shared = tables.cut(shared_columns(cells))
    entries = tables.cut(cells.join(F.broadcast(shared) if shared.count() <= MOST_SENT else shared, "gram").select("gram", "key", "n"))
    least = tables.cut(entries.groupBy("gram").agg(F.min(F.struct("key", "n")).alias("least")))

    # Each row against the least row of its columns: the nearest is verified.
    fitting = F.least("n", "least.n") * 100 >= F.greatest("n", "least.n") * percent
    stars = entries.join(least, "gram").where(fitting & (F.col("key") != F.col("least.key"))).select(F.col("least.key").alias("a"), F.col("key").alias("b")).distinct()
    stars = near(stars, classes, percent).groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a"))
    whole = tables.cut(components(verified(stars, docs, classes, words, percent, tables), tables))

    # What is still apart within a column; columns are done with once all pairs that their blocks told have held.
    for told in ("forest", "closest", "all"):
        placed = tables.cut(entries.join(whole, "key", "left").select("gram", "key", "n", F.coalesce("root", "key").alias("comp")))
        pairs = tables.cut(within_blocks(placed, classes, percent, told, tables))
        if pairs.isEmpty():
            break
        links = tables.cut(verified(pairs, docs, classes, words, percent, tables))
        failed = pairs.join(links, ["a", "b"], "left_anti")
        if not links.isEmpty():
            whole = merged(whole, links, tables)
        failed = tables.cut(failed.select(F.col("a").alias("key")).union(failed.select("b")).distinct())
        if failed.isEmpty():
            break
        again = entries.join(failed, "key", "left_semi").select("gram").distinct()
        entries = tables.cut(entries.join(again, "gram", "left_semi"))

    ids = classes.select("key", "doc_id").join(whole, "key", "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    lowest = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = tables.cut(ids.join(lowest, "root").select("key", "component_id"))
    out = rows.select("doc_id", "n_shingles", "key").join(ids, "key", "left")
    own = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "key", own.alias("component_id"))
