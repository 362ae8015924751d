"""Personal data: labelers that vote, their reliabilities by EM, and a span classifier.

Base spans (email, ip, card, phone in their strict forms) always count. Further
candidates, in looser forms or in the strict form without passing its check
(numbers of a card's length, four-part numbers, digits behind a plus), are judged: labelers for form, checksum, gazetteer,
context and surroundings each vote for, against or not at all. Expectation-
maximisation over the counts of vote patterns, with base spans as known cases, estimates how reliable each labeler
is for each kind; its posteriors are the targets of a logistic classifier over the
spans' features, and that decides.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import append, map_batches, pick, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "id", "name")
VOTERS = 5
ROUNDS = 50
STEPS = 60
RIDGE = 1e-3

Span = tuple[str, int, int]

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
LAST = re.compile(r"[A-Za-z0-9-]+(?=[\])]?$)")

LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]+(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "phone": re.compile(r"(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "name": re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? [A-Z][\w'-]+(?: [A-Z][\w'-]+)?"),
}
# What a text must hold for the loose form to occur at all.
HINT = {"email": ("(", "["), "ip": (":",), "phone": ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9"), "id": ("-",), "iban": ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9"), "name": ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr")}

# Gazetteers, of which other ones can be given: top-level domains, given names and lands that have account numbers of this form.
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int io info biz name pro museum app dev cloud online site shop store blog tech ai co me tv cc"
    " ad ae al am ar at au az ba bd be bg bh bo br by ca ch cl cn cr cu cy cz de dk do dz ec ee eg es eu fi fr ge gr gt hk hn hr hu id ie il in iq ir is it jo jp ke kr kw kz"
    " lb li lk lt lu lv ma mc md mk mt mx my ng ni nl no nz om pa pe ph pk pl ps pt py qa ro rs ru sa se sg si sk sm sn sv th tn tr tw ua uk us uy uz ve vn za zw".split()
)
GIVEN_NAMES = frozenset(
    "adam agnes ahmed alan albert alejandro alex alexander alfred alice ana andrea andrew angela anna anne anthony antonio arthur barbara beatrice benjamin bernard brian bruno camille carla carlos carmen caroline"
    " catherine charles charlotte chloe christian christine claire claudia daniel david diana diego dominik edward elena elisabeth elizabeth emil emily emma eric erik eva fatima felix fernando florian francis francisco"
    " frank franz fritz george gerard gustav hanna hannah hans heinrich helen helena henri henry hugo ines ingrid irene isabel jack jacques james jan jane javier jean jennifer jessica joan johann johannes john jonas jorge"
    " jose joseph juan julia julian julie karl karin katharina kevin klaus kurt laura lea lena leo leon linda lisa louis louise lucas lucia luis luisa lukas manuel marc marco maria marie mario mark marta martin mary matthew"
    " max michael michel miguel mohamed monica nadia natalie nicolas nina nora olga oliver olivier oscar otto pablo patricia patrick paul paula pedro peter petra philip pierre rachel ralf ramon raul rebecca richard robert".split()
)
IBAN_LANDS = frozenset(
    "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK".split()
)
# Words that speak for or against personal data nearby.
SPEAKS_FOR = {
    "email": ("mail", "email", "contact", "write to"), "ip": ("ip", "address", "login from", "host"), "card": ("card", "visa", "payment", "credit"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "fax"), "iban": ("iban", "account", "bank"), "id": ("ssn", "social", "id"), "name": ("dear", "name", "by"),
}
SPEAKS_AGAINST = ("version", "isbn", "figure", "page", "order", "invoice", "ref", "build", "chapter", "section")
NEARBY = 30


def any_of(words: Sequence[str]) -> re.Pattern[str]:
    """Pattern of whole words in either case, with or without an s behind them."""
    return re.compile(rf"(?<![^\W\d_])(?:{'|'.join(map(re.escape, words))})s?(?![^\W\d_])", re.IGNORECASE)


FOR = {kind: any_of(words) for kind, words in SPEAKS_FOR.items()}
AGAINST = any_of(SPEAKS_AGAINST)


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


@dataclass(frozen=True)
class Gazetteers:
    """Lists that labelers look in; all lower-case but for lands."""

    domains: frozenset[str] = TOP_DOMAINS
    names: frozenset[str] = GIVEN_NAMES
    lands: frozenset[str] = IBAN_LANDS


def strict_matches(text: str) -> Iterator[tuple[Span, bool]]:
    """Matches of the strict forms, leftmost and non-overlapping within a kind, and whether they pass the form's check."""
    if "@" in text:
        free = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                yield ("email", start, m.end()), True
                free = m.end()
    for m in IP.finditer(text):
        yield ("ip", m.start(), m.end()), all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                yield ("card", m.start(), m.end()), luhn(digits)
    if "+" in text:
        for m in PHONE.finditer(text):
            yield ("phone", m.start(), m.end()), 9 <= len(DIGITS.findall(m[0])) <= 15


def in_order(found: list[Span]) -> list[Span]:
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def base_spans(text: str) -> list[Span]:
    """Strict matches that pass, by start and then kind."""
    return in_order([s for s, good in strict_matches(text) if good])


def candidates(text: str) -> tuple[list[Span], list[tuple[Span, int]]]:
    """Base spans, and what else may be personal data without touching them: with 0 for a loose form, -1 for a strict one that failed."""
    matches = list(strict_matches(text))
    base = in_order([s for s, good in matches if good])
    found = [(s, -1) for s, good in matches if not good]
    for kind, pattern in LOOSE.items():
        if any(h in text for h in HINT[kind]):
            found += [((kind, m.start(), m.end()), 0) for m in pattern.finditer(text)]
    found.sort(key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2], x[1]))
    taken = sorted((a, b) for _, a, b in base)
    out, at, reach, free = [], 0, 0, 0
    for span, form in found:
        _, a, b = span
        while at < len(taken) and taken[at][0] <= a:
            reach = max(reach, taken[at][1])
            at += 1
        if a >= free and a >= reach and not (at < len(taken) and taken[at][0] < b):
            out.append((span, form))
            free = b
    return base, out


def features(text: str, span: Span, form: int, lists: Gazetteers = Gazetteers()) -> tuple[str, tuple[int, ...], int]:
    """Kind, the labelers' votes (form, checksum, gazetteer, context, surroundings) and a length class; ``form`` is 1 for base spans.

    The checksum's voter looks at digits alone: Luhn, the remainder of an account number, parts of an address, how many a
    telephone number has. Clean surroundings are no vote, what is glued to a word is one against.
    """
    kind, a, b = span
    own = text[a:b]
    digits = "".join(DIGITS.findall(own))
    form = form or (1 if kind in ("iban", "id") else 0)
    check = 0
    if kind == "card":
        check = 1 if luhn(digits) else -1
    elif kind == "iban":
        flat = own.replace(" ", "")
        check = 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1
    elif kind == "ip" and "." in own:
        check = 1 if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in own.split(".")) else -1
    elif kind in ("phone", "id") and digits:
        dull = len(set(digits)) == 1 or digits in "01234567890123456789"
        check = -1 if dull else 0 if kind == "id" else 1 if 9 <= len(digits) <= 15 else -1
    known = 0
    if kind == "email":
        known = 1 if LAST.search(own)[0].lower() in lists.domains else -1
    elif kind == "iban":
        known = 1 if own[:2] in lists.lands else -1
    elif kind == "name":
        known = 1 if {w.lower() for w in own.split()[1:]} & lists.names else 0
    elif kind == "card":
        known = 1 if digits[:1] in ("3", "4", "5", "6") else -1
    near = max(0, a - NEARBY)
    context = 1 if FOR[kind].search(text, near, a) else -1 if AGAINST.search(text, near, a) else 0
    around = text[max(0, a - 1) : a] + text[b : b + 1]
    beside = -1 if any(c.isalnum() or c in "_/=|" for c in around) else 0
    return kind, (form, check, known, context, beside), min(b - a, 40) // 8


def reliabilities(counts: list[tuple[str, tuple[int, ...], int]]) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior of each (kind, votes) by EM for labelers that may abstain.

    Every kind has its own prior and accuracies, kept within 0.05 to 0.95 and
    started at 0.7, so that labelers better than chance are presumed. Base spans are
    known to be personal data: they tell how reliable labelers are, and the
    prior is the share among the candidates that are to be judged.
    """
    out = {}
    for kind in sorted({k for k, _, _ in counts}):
        rows = sorted((v, n) for k, v, n in counts if k == kind)
        votes = np.array([v for v, _ in rows], float)
        n = np.array([c for _, c in rows], float)
        given = (votes[:, 0] > 0) & (kind in BASE)
        judged = np.where(given, 0, n)
        right, prior = np.full(votes.shape[1], 0.7), 0.5
        for _ in range(ROUNDS):
            odds = np.log(prior / (1 - prior)) + votes @ np.log(right / (1 - right))
            post = np.where(given, 1, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            prior = float(np.clip((post * judged).sum() / max(judged.sum(), 1), 0.05, 0.95))
            agree = np.where(votes > 0, post[:, None], np.where(votes < 0, 1 - post[:, None], 0)) * n[:, None]
            cast = np.abs(votes) * n[:, None]
            right = np.clip((agree.sum(0) + 7) / (cast.sum(0) + 10), 0.05, 0.95)
        out.update({(kind, v): float(p) for (v, _), p in zip(rows, post)})
    return out


def design(kind: str, votes: tuple[int, ...], length: int) -> np.ndarray:
    """One-hot features of a span, all within its kind: each vote and the length class; and a constant."""
    each = 6 + 3 * len(votes)
    x = np.zeros(len(KINDS) * each + 1)
    x[-1] = 1
    at = KINDS.index(kind) * each
    x[at + min(length, 5)] = 1
    for i, v in enumerate(votes):
        x[at + 6 + i * 3 + v + 1] = 1
    return x


def fit(rows: Sequence[tuple[str, tuple[int, ...], int, int]], chance: dict[tuple[str, tuple[int, ...]], float]) -> np.ndarray:
    """Weights of the logistic classifier for (kind, votes, length, number), whose targets are the chances of (kind, votes).

    A pattern weighs as the logarithm of its number, and each kind as much as
    the next, so that what is rare is not drowned by what is common.
    """
    weights = np.zeros(len(design(KINDS[0], (0,) * VOTERS, 0)))
    if rows:
        x = np.array([design(k, v, length) for k, v, length, _ in rows])
        y = np.array([chance[k, v] for k, v, _, _ in rows])
        n = weigh(rows)
        for _ in range(STEPS):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            slope = x.T @ (n * (p - y)) + RIDGE * weights
            weights -= np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + RIDGE * np.eye(len(weights)), slope)
    return weights


def weigh(rows: Sequence[tuple[str, tuple[int, ...], int, int]]) -> np.ndarray:
    """Shares of the patterns in the fit; one in all."""
    size = np.log2([1 + n for _, _, _, n in rows])
    total: Counter = Counter()
    for (kind, *_), s in zip(rows, size):
        total[kind] += s
    return np.array([s / total[kind] / len(total) for (kind, *_), s in zip(rows, size)])


def learn(docs: DataFrame, text_col: str = "text", lists: Gazetteers = Gazetteers()) -> np.ndarray:
    """Weights of the span classifier, from the vote patterns of all candidates of all documents.

    Tasks count patterns, of which there are a few thousand at most (kinds, votes
    and length classes), so what is shuffled and collected is bounded. Null and
    empty texts have no candidates; without any, all weights are nought.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                base, more = candidates(text)
                seen.update(features(text, s, 1, lists) for s in base)
                seen.update(features(text, s, form, lists) for s, form in more)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in keys], pa.string()), pa.array([list(v) for _, v, _ in keys], pa.list_(pa.int32())), pa.array([x for _, _, x in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())],
            names=["kind", "votes", "length", "n"],
        )

    counted = map_batches(pick(docs, text=text_col), run, "kind string, votes array<int>, length int, n long").groupBy("kind", "votes", "length").agg(F.sum("n").alias("n"))
    rows = sorted((r.kind, tuple(r.votes), r.length, r.n) for r in counted.collect())
    patterns: Counter = Counter()
    for kind, votes, _, n in rows:
        patterns[kind, votes] += n
    chance = reliabilities([(k, v, n) for (k, v), n in patterns.items()])
    return fit(rows, chance)


def spans(text: str, weights: np.ndarray, lists: Gazetteers = Gazetteers()) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in order: the base ones and the candidates that the classifier takes."""
    base, more = candidates(text)
    return base, in_order(base + [s for s, form in more if design(*features(text, s, form, lists)) @ weights >= 0])


def told(found: Sequence[Span]) -> str:
    """``kind:start:end`` of the spans, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def mask(text: str, found: Sequence[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans as one."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def detect(docs: DataFrame, weights: np.ndarray, text_col: str = "text", masked: str | None = None, lists: Gazetteers = Gazetteers()) -> DataFrame:
    """``docs`` with ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``, ``n_spans`` and ``n_added``.

    The counts by kind and the digest are of the base spans; ``spans`` and ``n_spans``
    are of all, ``n_added`` of those that the classifier added. Offsets are
    code points, end exclusive. A null text counts as empty: no spans. With
    ``masked``, a column of that name has the text with its spans replaced (null
    stays null). Columns of the input with these names give way. No shuffle.
    """
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    fields += [T.StructField(n, T.LongType()) for n in ("n_spans", "n_added")]
    fields += [T.StructField(masked, T.StringType())] if masked else []

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        def work(column: pa.Array) -> list[pa.Array]:
            counts: list[list[int]] = [[] for _ in BASE]
            digests, all_spans, sizes, added, clean = [], [], [], [], []
            for item in column:
                text = item.as_py()
                base, found = spans(text or "", weights, lists)
                for k, c in zip(BASE, counts):
                    c.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(told(base).encode()).hexdigest())
                all_spans.append(told(found))
                sizes.append(len(found))
                added.append(len(found) - len(base))
                clean.append(None if text is None else mask(text, found))
            out = [pa.array(c, pa.int64()) for c in counts] + [pa.array(x, pa.string()) for x in (digests, all_spans)] + [pa.array(x, pa.int64()) for x in (sizes, added)]
            return out + ([pa.array(clean, pa.string())] if masked else [])

        return work

    return append(docs, [text_col], make, fields)
