"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The symbols are words, the patterns windows of benchmark words. A shift table on
blocks of two words says how far the search may jump: blocks of no pattern let
it skip almost a whole window. Where the shift is nought, the hashes of the
window's last and first block pick the patterns that end there, and comparing the
words decides. Windows of one length share a table; so the few short items do not
shorten the jumps of others. Equal windows are one pattern, with a list of the items
that have it. Tables are made once, as arrays that hold hashes and places of words,
and sent to the tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import Tables, append, pick

WINDOW = 13
BLOCK_CHARS = 8_000_000
CACHED_WORDS = 50_000
MOST_SHIFT_BITS = 24
PRIME, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def words_of(text: str | None) -> list[str]:
    """Words of a text after lower-casing A to Z alone."""
    return WORD((text or "").encode().lower().decode())  # lower() of bytes knows A to Z only


class Hashes(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: str) -> int:
        out = xxhash.xxh3_64_intdigest(word.encode())
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out
        return out


def mixed(a: int, b: int) -> int:
    """Hash of two hashes."""
    return (a * 31 + b) * PRIME & MASK


def all_mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``mixed``, element by element."""
    return (a * np.uint64(31) + b) * np.uint64(PRIME)


class Table:
    """Shift and bucket tables for the distinct patterns of one length.

    ``starts`` are the places of their first words in the list of hashed words. Equal
    windows are one pattern, with a list of the items that have it: ``posted`` holds
    these lists, one after another, and ``lists`` where each begins.
    """

    def __init__(self, length: int, starts: np.ndarray, hashes: np.ndarray, of: np.ndarray) -> None:
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        block = lambda at: all_mixed(hashes[at - 1] if self.block == 2 else np.zeros(len(at), np.uint64), hashes[at])
        starts, self.lists, self.posted = distinct(starts, length, hashes, of)
        bits = min(MOST_SHIFT_BITS, max(8, (8 * len(starts)).bit_length()))
        self.down = 64 - bits
        shift = np.full(1 << bits, self.jump, np.uint8)
        for end in range(self.block, length + 1):
            np.minimum.at(shift, (block(starts + end - 1) >> np.uint64(self.down)).astype(np.int64), length - end)
        self.shift = shift.tobytes()
        keys = all_mixed(block(starts + length - 1), block(starts + self.block - 1))
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.starts = keys[self.order], starts[self.order]


def distinct(starts: np.ndarray, length: int, hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each distinct window, where its list of items begins (one more at the end), and the lists.

    Windows are told apart by two hashes of all their words, 128 bits together; both
    are rolled over the words, so long windows cost as much as short ones.
    """
    prints = []
    for factor in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
        out = np.zeros(len(starts), np.uint64)
        for k in range(length):
            out = out * factor + hashes[starts + k]
            out ^= out >> np.uint64(31)
        prints.append(out)
    owner = of[starts]
    order = np.lexsort((owner, *prints))
    prints = [p[order] for p in prints]
    new = np.concatenate([[True], (prints[0][1:] != prints[0][:-1]) | (prints[1][1:] != prints[1][:-1])])
    owner = owner[order]
    first_of_item = new | np.concatenate([[True], owner[1:] != owner[:-1]])
    group = np.cumsum(new) - 1
    lists = np.concatenate([[0], np.cumsum(np.bincount(group[first_of_item], minlength=int(new.sum())))])
    return starts[order][new], lists, owner[first_of_item]


class Searcher:
    """The words of a block of benchmark items, and the tables of their windows."""

    def __init__(self, items: list[tuple[int | str, str]], window: int) -> None:
        hashes, self.items, of = Hashes(), [], []
        starts: dict[int, list[int]] = {}
        words: list[str] = []
        for item, text in items:
            own = words_of(text)
            length = min(window, len(own))
            if own:
                starts.setdefault(length, []).extend(range(len(words), len(words) + len(own) - length + 1))
                words += own
                of += [len(self.items)] * len(own)
                self.items.append(item)
        encoded = [w.encode() for w in words]
        self.text = b" ".join(encoded)
        self.places = np.fromiter(accumulate((len(w) + 1 for w in encoded), initial=0), np.int64, len(words) + 1)
        own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        self.tables = [Table(n, np.array(at, np.int64), own, np.array(of, np.int32)) for n, at in sorted(starts.items())]

    def search(self, words: list[str], hashes: Hashes) -> tuple[list[tuple[int, int]], set]:
        """Merged (start, end) runs of hit words, end exclusive, and the items hit.

        Runs grow as occurrences come, and a pattern's list of items counts once for
        a text, so neither memory nor time grows with occurrences times items.
        """
        runs: list[tuple[int, int]] = []
        items: set = set()
        for table in self.tables:
            own: list[list[int]] = []
            patterns: set[int] = set()
            for start, pattern in self.occurrences(table, words, hashes):
                if own and start <= own[-1][1]:
                    own[-1][1] = start + table.length
                else:
                    own.append([start, start + table.length])
                patterns.add(pattern)
            runs += map(tuple, own)
            told: set[int] = set()
            for p in patterns:
                told.update(table.posted[table.lists[p] : table.lists[p + 1]].tolist())
            items.update(self.items[k] for k in told)
        return merged(runs), items

    def occurrences(self, table: Table, words: list[str], hashes: Hashes) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every place where a pattern of a table occurs, by start; one comparison a place and pattern of its bucket."""
        length, shift, down, pairs = table.length, table.shift, table.down, table.block == 2
        at, last = length - 1, len(words)
        while at < last:
            end = mixed(hashes[words[at - 1]] if pairs else 0, hashes[words[at]])
            step = shift[end >> down]
            if step:
                at += step
                continue
            start = at - length + 1
            begin = mixed(hashes[words[start]], hashes[words[start + 1]]) if pairs else end
            key = np.uint64(mixed(end, begin))
            bucket = int(np.searchsorted(table.keys, key))
            own = None
            while bucket < len(table.keys) and table.keys[bucket] == key:
                place = int(table.starts[bucket])
                own = own or " ".join(words[start : at + 1]).encode()
                if self.text[self.places[place] : self.places[place + length] - 1] == own:
                    yield start, int(table.order[bucket])
                    break  # patterns are distinct
                bucket += 1
            at += 1


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (starts and ends of hit word runs, flat) and ``items`` (ids, ascending).

    The benchmark goes to the tasks in blocks of about ``block_chars``
    characters, one at a time: beyond the first, what was found is written to the
    shared folder before the next block is sent, so that driver and workers hold one
    block at any number of items. A text longer than a block is cut into pieces that
    overlap by a window. No shuffle. Null or empty texts have no words; an item
    without words has no window, and rows of one item id count as one item. Items
    without an id are left out; ids that are no whole numbers are told as strings.
    Columns of the input with these names give way.
    """
    tests = pick(benchmark, item=item_col, text=item_text).where("item is not null and text is not null")
    whole = isinstance(tests.schema["item"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    kind = T.LongType() if whole else T.StringType()
    tests = tests.select(F.col("item").cast(kind).alias("item"), "text")
    size = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = size // block_chars + 1
    if blocks > 1:
        tests = cut_texts(tests, window, block_chars)
    tables = Tables(docs.sparkSession)
    out = docs
    for k in range(blocks):
        own = [(r.item, r.text) for r in tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()]
        searcher = docs.sparkSession.sparkContext.broadcast(Searcher(own, window))
        out = scan(tables.cut(out) if k else out, text_col, searcher, kind, first=not k)
    return out


def cut_texts(tests: DataFrame, window: int, block_chars: int) -> DataFrame:
    """Items whose texts are longer than a block in pieces of about that length; each goes on for a window's words more than its own."""
    def make() -> Callable[[pa.Array], list[pa.Array]]:
        def cut(text: str) -> list[str]:
            if len(text) <= block_chars:
                return [text]
            words = words_of(text)
            step = max(window, len(words) * block_chars // len(text))
            return [" ".join(words[i : i + step + window - 1]) for i in range(0, max(1, len(words) - window + 1), step)]

        return lambda column: [pa.array([cut(t.as_py()) for t in column], pa.list_(pa.string()))]

    pieces = append(tests, ["text"], make, [T.StructField("pieces", T.ArrayType(T.StringType()))])
    return pieces.select("item", F.explode("pieces").alias("text"))


def scan(docs: DataFrame, text_col: str, searcher: object, kind: T.DataType, first: bool) -> DataFrame:
    """One pass for one block of items; later passes add to what the earlier ones found."""
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(kind))]
    ids_type = pa.list_(pa.int64() if isinstance(kind, T.LongType) else pa.string())

    def make() -> Callable[..., list[pa.Array]]:
        hashes, known = Hashes(), searcher.value

        def work(column: pa.Array, hits: pa.Array | None = None, found: pa.Array | None = None) -> list[pa.Array]:
            counts, all_hits, all_items = [], [], []
            for i, text in enumerate(column):
                words = words_of(text.as_py())
                runs, ids = known.search(words, hashes)
                if hits is not None:
                    flat = hits[i].as_py()
                    runs = merged(runs + list(zip(flat[::2], flat[1::2])))
                    ids |= set(found[i].as_py())
                counts.append(len(words))
                all_hits.append([x for run in runs for x in run])
                all_items.append(sorted(ids))
            return [pa.array(counts, pa.int64()), pa.array(all_hits, pa.list_(pa.int32())), pa.array(all_items, ids_type)]

        return work

    return append(docs, [text_col] if first else [text_col, "hits", "items"], make, fields)


def judge(found: DataFrame) -> DataFrame:
    """``found`` with ``n_hit``, ``n_items`` and ``contaminated`` (a twentieth or more of the words hit)."""
    n_hit = F.expr("cast(aggregate(hits, 0, (a, x) -> x - a) as long)")  # ends less starts: x1 - x0 + x3 - x2 ...
    return (
        found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    )


def items_digest(ids: list[int]) -> str:
    """sha256 of the ids sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
