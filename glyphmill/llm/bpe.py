"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A merge sequence is determined by its adjacent pairs: ids are the exact result
of the merges if and only if every neighbouring pair is what merging the two
tokens' bytes gives. So the encoder takes the longest vocabulary match at each
position and shortens or takes back matches until each neighbour is compatible;
a position found to be dead is never tried again, which keeps the work linear.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glyphmill.llm.common import append, texts_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHED_PIECES = 200_000
CACHED_PAIRS = 500_000
CACHED_LENGTH = 48
NEVER = 1 << 60

WHITE = r"\p{White_Space}"


def latin_pattern() -> str:
    """The pre-split pattern for texts of U+0000 to U+00FF, with its classes spelled out for ``re``."""
    def chars(test: Callable[[str], bool]) -> str:
        return "".join(re.escape(chr(c)) for c in range(256) if test(chr(c)))

    letter = chars(lambda c: unicodedata.category(c)[0] == "L")
    number = chars(lambda c: unicodedata.category(c)[0] == "N")
    space = chars(lambda c: c in " \t\n\v\f\r\x85\xa0")
    return (
        f" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


class Encoder:
    """Exact byte-pair encoder for the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        any_text = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"(?!\S)", rf"(?!\P{{White_Space}})").replace(r"\s", WHITE)
        self.split_any = regex.compile(any_text).findall
        self.length_of = {i: len(b) for b, i in ranks.items()}
        # The spelled-out twin holds for the standard pattern only.
        self.split_latin = re.compile(latin_pattern()).findall if pattern == public_tokenizers.PATTERN else None
        # Matches that start at a position are matches that end there in the mirrored text.
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter_of: dict[int, int] = {}
        self.edges_of: dict[int, tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]] = {}

    def edges(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """What stands at the right and at the left end of ``token`` while it is merged.

        Each step is (bytes, rank of the merge that takes them in); the last one is
        the whole token, taken in by nothing. Empty if merging its bytes never
        gives the token.
        """
        known = self.edges_of.get(token)
        if known is None:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            right, left = [], []
            while len(parts) > 1:
                best, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best == NEVER:
                    break
                if at == len(parts) - 2:
                    right.append((parts[-1], best))
                if at == 0:
                    left.append((parts[0], best))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            whole = len(parts) == 1
            known = (right + [(data, NEVER)], left + [(data, NEVER)]) if whole else ([], [])
            self.edges_of[token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether merging both tokens' bytes leaves these two tokens; ``left`` -1 stands for the start.

        It does unless some merge across the border comes before the merges that
        take in what stands on its two sides. Of equal ranks the leftmost goes first.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.settled(left, right)
        return known

    def settled(self, left: int, right: int) -> bool:
        heads = self.edges(right)[1]
        if left < 0 or not heads:
            return bool(heads)
        tails = self.edges(left)[0]
        i = j = 0
        while i < len(tails) and j < len(heads):
            (a, a_goes), (b, b_goes) = tails[i], heads[j]
            across = self.ranks.get(a + b, NEVER)
            if across < a_goes and across <= b_goes and across != NEVER:
                return False
            if a_goes == b_goes == NEVER:
                return True
            if a_goes <= b_goes:
                i += 1
            else:
                j += 1
        return False

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        known = self.shorter_of.get(token)
        if known is None:
            data = self.bytes_of[token]
            known = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
            self.shorter_of[token] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, length_of, pairs = len(piece), self.length_of, self.pairs
        longest = [-1] * size
        reach = [0] * size
        last_at = size - 1
        for end, token in self.automaton.iter(piece[::-1].decode("latin-1")):
            if length_of[token] > reach[last_at - end]:
                longest[last_at - end], reach[last_at - end] = token, length_of[token]
        ids: list[int] = []
        dead = bytearray(size + 1)
        at, token, last = 0, longest[0], -1
        while at < size:
            while token >= 0:
                if not dead[at + length_of[token]]:
                    good = pairs.get((last, token))
                    if self.fits(last, token) if good is None else good:
                        break
                token = self.shorter(token)
            if token >= 0:
                ids.append(token)
                at += length_of[token]
                last = token
                token = longest[at] if at < size else -1
            elif ids:
                dead[at] = 1
                token = ids.pop()
                at -= length_of[token]
                token = self.shorter(token)
                last = ids[-1] if ids else -1
            else:
                raise ValueError("the vocabulary lacks a single byte of this text")
        return ids

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if self.split_latin is not None:
            try:
                text.encode("latin-1")
                return self.split_latin(text)
            except UnicodeEncodeError:
                pass
        return self.split_any(text)

    def encode(self, text: str) -> list[int]:
        """Token ids of a text."""
        return [i for p in self.pieces(text) for i in self.encode_piece(p.encode())]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PieceCache(dict):
    """Little-endian ids of pieces; emptied when full, and long pieces are not kept."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoder.encode_piece(piece.encode())
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = out
        return out


@lru_cache(maxsize=4)
def load(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """The encoder for a rank file; once for each worker process."""
    with open(path, "rb") as lines:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, with_ids: bool = True, digests: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens`` (long) and, as asked for, ``ids`` (array of int) and digests.

    A null text counts as empty: no tokens. Texts of any length are encoded
    whole. Columns of the input with the same names give way. ``digests`` adds
    ``ids_sha256`` and ``decoded_sha256``, the latter of the decoded ids. One
    pass without a shuffle; ``path`` is a rank file present on every machine.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    fields = [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    fields += [T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256")] if digests else []

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        encoder = load(path)
        known = PieceCache(encoder)

        def work(column: pa.Array) -> list[pa.Array]:
            ids, counts, own, back = [], [], [], []
            for text in column:
                data = b"".join(map(known.__getitem__, encoder.pieces(text.as_py() or "")))
                counts.append(len(data) // 4)
                numbers = np.frombuffer(data, dtype="<u4")
                if with_ids:
                    ids.append(numbers.astype(np.int32))
                if digests:
                    own.append(hashlib.sha256(data).hexdigest())
                    back.append(hashlib.sha256(encoder.decode(numbers.tolist())).hexdigest())
            out = [pa.array(counts, pa.int64())]
            out += [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            return out + ([pa.array(own, pa.string()), pa.array(back, pa.string())] if digests else [])

        return work

    return append(docs, [text_col], make, fields)


def decode(tokens: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``tokens`` with ``decoded`` (string): the text of the ids; null ids give the empty text.

    Bytes that are not UTF-8 (a cut sequence) become U+FFFD.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        encoder = load(path)
        return lambda column: [pa.array([encoder.decode(x or []).decode("utf-8", "replace") for x in column.to_pylist()], pa.string())]

    return append(tokens, [ids_col], make, [T.StructField("decoded", T.StringType())])
