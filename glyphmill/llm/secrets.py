"""Secrets: fixed patterns, and strings that a tokenizer finds hard to shorten.

Words and names have few tokens for their length under a trained vocabulary;
random strings have many. A run of key-like characters whose characters for each
token fall below a bound counts as a secret, unless it is a known kind of digest
or an identifier.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glyphmill.llm import bpe
from glyphmill.llm.common import append

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
MOST_CHARS_A_TOKEN = 2.0
LEAST_CHARS = 20
LONG_RUN = 1_024

Span = tuple[str, int, int]


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}")
# Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hexadecimal.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
JOINTS = re.compile(r"[/_=+-]+")
IDENTIFIER_PART = re.compile(r"(?:[A-Za-z]?[a-z]+|[A-Z]+)[0-9]{0,3}|[0-9]{1,6}")


def base_spans(text: str) -> list[Span]:
    """Strict matches, leftmost and non-overlapping within a kind, by start and then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


@dataclass(frozen=True)
class Vocabulary:
    """One rank file for tiktoken, and for the exact encoder of linear time that long runs take."""

    encoding: tiktoken.Encoding
    linear: bpe.Encoder

    def size(self, run: str) -> int:
        """Number of a run's tokens, the same either way."""
        return len(self.encoding.encode_ordinary(run) if len(run) <= LONG_RUN else self.linear.encode(run))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary; once for each worker process."""
    linear = bpe.load(path)
    return Vocabulary(tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=linear.ranks, special_tokens={}), linear)


def identifier(run: str) -> bool:
    """Whether a run is words, with up to three digits behind them (``v2``, ``utf8``), and short numbers joined by signs."""
    return all(IDENTIFIER_PART.fullmatch(part) for part in JOINTS.split(run) if part)


def hard_to_shorten(run: str, known: Vocabulary) -> bool:
    """Whether a run has letters and digits, is no digest or identifier, and few characters for each token."""
    if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
        return False
    if (len(run) in DIGEST_LENGTHS and ALL_HEX.fullmatch(run)) or UUID.fullmatch(run) or identifier(run):
        return False
    return len(run) < MOST_CHARS_A_TOKEN * known.size(run)


def spans(text: str, known: Vocabulary) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in order."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    more, at = [], 0
    for m in RUN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        touched = at < len(taken) and taken[at][0] < m.end()
        if not touched and hard_to_shorten(m[0], known):
            more.append(("random", m.start(), m.end()))
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def told(found: Sequence[Span]) -> str:
    """``kind:start:end`` of the spans, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_spans`` and ``n_added``.

    The counts by kind and the digest are of the base spans; ``spans`` and ``n_spans``
    are of all, ``n_added`` of those that the tokens added. Offsets are
    code points, end exclusive. A null text counts as empty: no spans. Columns of
    the input with these names give way. One pass without a shuffle; ``path`` is
    a rank file present on every machine.
    """
    path = path or public_tokenizers.path(bpe.VOCABULARY)
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    fields += [T.StructField(n, T.LongType()) for n in ("n_spans", "n_added")]

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        known = vocabulary(path)

        def work(column: pa.Array) -> list[pa.Array]:
            counts: list[list[int]] = [[] for _ in BASE]
            digests, all_spans, sizes, added = [], [], [], []
            for item in column:
                base, found = spans(item.as_py() or "", known)
                for k, c in zip(BASE, counts):
                    c.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(told(base).encode()).hexdigest())
                all_spans.append(told(found))
                sizes.append(len(found))
                added.append(len(found) - len(base))
            return [pa.array(c, pa.int64()) for c in counts] + [pa.array(x, pa.string()) for x in (digests, all_spans)] + [pa.array(x, pa.int64()) for x in (sizes, added)]

        return work

    return append(docs, [text_col], make, fields)
