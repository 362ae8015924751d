"""Main text of web pages by deducing the templates of their hosts.

Pages become streams of tokens: start and end tags with their path, and whole text
blocks with theirs. Tokens of one host that occur equally often on each of its
pages form an equivalence class. The largest class whose tokens stand once on
nearly every page, in one order, is the template's frame; classes that repeat are
valid if their tokens alternate in one order and lie within one slot of the frame,
and nest there. The slot with most text of the pages' own tells the article: it is
the innermost element of the frame around it and its like, and the text between
the template's tokens in it is what a page says itself.

Without a template (hosts of few pages, pages of another build) article and main
elements tell, and everywhere elements that are menus, footers, adverts and the
like by their names are no article.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import Tables, append, map_batches, pick, position

LEAST_PAGES = 5
SHARE_OF_PAGES = 0.9
LEAST_CLASS = 2
LEAST_OWN = 0.25
LEAST_FRAME = 0.9
MOST_SENT_HOSTS = 100_000
MOST_SENT_TOKENS = 1_000_000
KEPT_HOSTS = 256
HELD_ROWS = 50_000

OPEN = re.compile(r"<(?:(!--)|[!?]|/(?![A-Za-z])|(/?)([A-Za-z][A-Za-z0-9:-]*))")
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "textarea", "title")}
MARKS = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
NUMBER = re.compile(r"&#(?:([0-9]++)|[xX]([0-9a-fA-F]++));?")
# Fixed values of HTML: elements without an end, elements that are inline, elements that close an open paragraph's like.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd del mark q s samp small span strike strong sub sup time tt u var wbr".split())
SAME_CLOSES = frozenset("p li dt dd tr td th option".split())
# Elements, roles and words of classes and ids that are no article.
ASIDE_TAGS = frozenset("head nav footer aside form noscript template iframe object svg button select option dialog menu canvas audio video".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
# Names that are none wherever they stand, names that are none outside an article's own flow, and words that only say what kind of box a name is on.
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar cookie cookies consent popup modal newsletter"
    " subscribe comment comments disqus reply replies pagination pager".split()
)
OUTSIDE_WORDS = frozenset("promo banner header masthead footer aside notice signup login share sharing social related recommended widget".split())
BOX_WORDS = frozenset(
    "site page main top bottom left right global primary secondary box bar list lists area section block blocks slot unit container wrapper wrap inner outer holder panel row col column item items"
    " link links button buttons icon icons form posts stories".split()
)
MAIN_TAGS = frozenset(("article", "main"))
WORD_CUTS = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
#: How far a block is set aside: not at all, by a name that counts outside the article only, or for good.
OPEN_BLOCK, BY_NAME, FOR_GOOD = 0, 1, 2


@dataclass
class Block:
    """A text block: its place among the page's tokens, its text, and whether it is inside an article or main element or set aside."""

    at: int
    text: str
    main: bool
    aside: int


@dataclass
class Element:
    """An open element: its tag and token, the path to it, and what holds for the blocks in it."""

    tag: str
    token: int
    path: int
    main: bool
    aside: int


@dataclass
class Page:
    """Tokens in page order, what kind of element those are that start one, and the text blocks."""

    tokens: list[int] = field(default_factory=list)
    kinds: dict[int, str] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def end_of(token: int) -> int:
    """The token of the end tag that belongs to a start tag's."""
    return hashed(f"/{token}")


def decoded(text: str) -> str:
    """``text`` with its character references resolved; numbers beyond Unicode, of any length, are U+FFFD."""
    def short(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0")
        return "\ufffd" if len(digits) > 8 else f"&#{'' if m[1] else 'x'}{digits or '0'};"

    return entities.unescape(NUMBER.sub(short, text)) if "&" in text else text


@lru_cache(maxsize=4_096)
def named_aside(value: str, in_main: bool) -> int:
    """How far the names in a class or id set an element aside.

    A name counts if it is one of the words, or is made of them and of words for boxes
    alone: ``ad``, ``ad-box`` and ``cookie-banner`` do, ``ad-hoc``, ``post-header`` and ``notice-of-death`` do not.
    """
    out = OPEN_BLOCK
    for name in value.split():
        words = {w.lower() for w in WORD_CUTS.split(name) if w}
        if words <= NEVER_WORDS | OUTSIDE_WORDS | BOX_WORDS:
            out = max(out, FOR_GOOD if words & NEVER_WORDS else BY_NAME if words & OUTSIDE_WORDS and not in_main else OPEN_BLOCK)
    return out


def set_aside(tag: str, marks: list[tuple[str, str]], in_main: bool) -> int:
    """How far an element is set aside as something else than the article."""
    if tag in ASIDE_TAGS or (tag == "header" and not in_main):
        return FOR_GOOD
    out = OPEN_BLOCK
    for name, value in marks:
        if name == "role":
            out = max(out, FOR_GOOD if value.lower() in ASIDE_ROLES else OPEN_BLOCK)
        elif tag not in ("html", "body", *MAIN_TAGS):
            out = max(out, named_aside(value, in_main))
    return out


def parts(page: str) -> Iterator[tuple[str, str, str]]:
    """(text before, tag with a slash if it ends an element, attributes) of each tag, and the text behind the last; in linear time.

    Comments, declarations and raw text elements have no tag. A tag that the page
    does not end takes the rest with it. Once quotes are found to be open at the
    end of the page, those of later tags count for nothing.
    """
    at, start, quotes = 0, 0, True
    while m := OPEN.search(page, at):
        before, at = page[start : m.start()], m.end()
        tag, attributes = "", ""
        if m[3] is None:
            end = page.find("-->", at) + 3 if m[1] else page.find(">", at) + 1
            at = end if end > at else len(page)
        else:
            rest = REST.match(page, at) if quotes else None
            if rest:
                attributes, at = rest[1], rest.end()
            else:
                quotes = False
                end = page.find(">", at)
                attributes, at = ("", len(page)) if end < 0 else (page[at:end], end + 1)
            name = m[3].lower()
            if name in RAW and not m[2]:
                end = RAW[name].search(page, at)
                at = end.end() if end else len(page)
            elif at < len(page) or page.endswith(">"):
                tag = m[2] + name
        start = at
        yield before, tag, attributes
    yield page[start:], "", ""


def parse(page: str) -> Page:
    """Tokens and text blocks of a page."""
    out = Page()
    root = Element("", 0, 0, False, OPEN_BLOCK)
    stack: list[Element] = [root]
    solid: list[int] = [0]  # places in the stack of what is not inline
    opened: Counter[str] = Counter()
    text: list[str] = []

    def flush() -> None:
        line = "".join(text)
        line = " ".join(("".join(map(decoded, text)) if "&" in line else line).split())  # a reference does not go on behind a tag
        text.clear()
        if line:
            top = stack[-1]
            out.blocks.append(Block(len(out.tokens), line, top.main, top.aside))
            out.tokens.append(hashed(f"{top.path}\0{line}"))

    def close(at: int) -> None:
        if solid[-1] >= at:
            flush()
        for element in reversed(stack[at:]):
            opened[element.tag] -= 1
            if element.tag not in INLINE:
                out.tokens.append(end_of(element.token))
        del stack[at:]
        while solid[-1] >= at:
            solid.pop()

    for before, tag, attributes in parts(page):
        if before:
            text.append(before)
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if opened[tag] > 0:
                at = len(stack) - 1
                while stack[at].tag != tag:
                    at -= 1
                close(at)
            elif tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            # A block ends an open paragraph, whatever inline elements it left open; like items end each other.
            last = stack[solid[-1]].tag
            if last == "p" or (tag in SAME_CLOSES and last == tag):
                close(solid[-1])
        if tag in VOID:
            if tag == "br":
                text.append(" ")
            continue
        top = stack[-1]
        marks = [(m[0].lower(), m[1] or m[2] or m[3]) for m in MARKS.findall(attributes)] if attributes else []
        aside = max(top.aside, set_aside(tag, marks, top.main))
        opened[tag] += 1
        if tag in INLINE:
            stack.append(Element(tag, 0, top.path, top.main, aside))
            continue
        words = sorted({w for name, value in marks if name == "class" for w in value.split() if not any(c.isdigit() for c in w)})
        token = hashed(f"{top.path}<{tag} {' '.join(words)}")
        out.kinds[token] = "main" if tag in MAIN_TAGS else "whole" if tag in ("html", "body") else ""
        out.tokens.append(token)
        solid.append(len(stack))
        stack.append(Element(tag, token, token, top.main or tag in MAIN_TAGS, aside))
    flush()
    return out


@dataclass
class Template:
    """The frame's tokens, the texts that nested classes and the frame fix, and the first and last slot of the article."""

    frame: frozenset[int]
    fixed: frozenset[int]
    first: int
    last: int


def article(page: str, template: Template | None) -> str:
    """The article's blocks joined by line ends; blocks that are set aside for good are none of it.

    With a template: the blocks in the article's slots that the template does not
    fix, whatever names that count outside articles only they have. Where these hold at most ``LEAST_OWN`` of the characters there, the host's
    pages are near copies and their template is the article itself: all of them.
    Without one, or on a page without the template's frame: the blocks in article
    or main elements, or all where there are none.
    """
    read = parse(page)
    open_blocks = [b for b in read.blocks if b.aside == OPEN_BLOCK]
    if template is not None and sum(t in template.frame for t in read.tokens) >= LEAST_FRAME * len(template.frame):
        places = {b.at: b for b in read.blocks if b.aside < FOR_GOOD}
        slot, inside = 0, []
        for at, token in enumerate(read.tokens):
            if at in places and template.first <= slot <= template.last:
                inside.append(at)
            slot += token in template.frame
        own = [places[at].text for at in inside if read.tokens[at] not in template.fixed]
        whole = [places[at].text for at in inside]
        if whole:
            return "\n".join(whole if sum(map(len, own)) <= LEAST_OWN * sum(map(len, whole)) else own)
    marked = [b.text for b in open_blocks if b.main]
    return "\n".join(marked or [b.text for b in open_blocks])


def host_of(url: F.Column) -> F.Column:
    """Lower-case host of a url; empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def sent(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` to be broadcast where they are at most ``most``."""
    return F.broadcast(rows) if rows.count() <= most else rows


def classes(pages: DataFrame, tables: Tables) -> DataFrame:
    """(host, token, frame, class): the tokens of a host's large and frequent classes, and whether the class is the frame.

    Occurrence vectors are compared by a fingerprint that tasks combine with
    exclusive or, so a host with a third of all pages is summed where its pages are.
    Pages of equal texts count once. A class has ``LEAST_CLASS`` tokens on
    ``SHARE_OF_PAGES`` of the host's pages; hosts of fewer than ``LEAST_PAGES``
    different pages have none. The frame is the largest class of tokens that
    stand once on a page.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, tokens, prints, times = [], [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                read = parse(page)
                own = hashed("\0".join(b.text for b in read.blocks))
                for token, n in [*Counter(read.tokens).items(), (0, 1)]:  # token 0 stands for the page
                    hosts.append(host)
                    tokens.append(token)
                    prints.append(hashed(f"{own} {n}"))
                    times.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), pa.array(prints, pa.int64()), pa.array(times, pa.int64())], names=["host", "token", "print", "n"])

    # Repeated contents give the same rows; the first distinct is summed within tasks.
    seen = map_batches(pages, run, "host string, token long, print long, n long").distinct()
    vectors = tables.cut(seen.groupBy("host", "token").agg(F.bit_xor("print").alias("vector"), F.count("*").alias("support"), F.max("n").alias("most")))
    size = tables.cut(vectors.where("token = 0").select("host", F.col("support").alias("pages")).where(F.col("pages") >= LEAST_PAGES))
    found = vectors.where("token <> 0").join(sent(size, MOST_SENT_HOSTS), "host").where(F.col("support") >= F.col("pages") * SHARE_OF_PAGES)
    found = tables.cut(found.select("host", "token", "vector", "support", "most"))
    groups = found.groupBy("host", "vector", "support").agg(F.count("*").alias("size"), F.max("most").alias("most")).where(F.col("size") >= LEAST_CLASS)
    best = groups.where("most = 1").groupBy("host").agg(F.max(F.struct("size", "support", "vector")).alias("best"))
    framed = groups.join(best, "host").select("host", "vector", "support", ((F.col("vector") == F.col("best.vector")) & (F.col("support") == F.col("best.support"))).alias("frame"))
    return tables.cut(found.join(framed, ["host", "vector", "support"]).select("host", "token", "frame", F.col("vector").alias("class")))


class Places:
    """Where a host's tokens stand: rank within their class, slot of the frame, and text of the pages' own in each slot; low and high over pages."""

    def __init__(self) -> None:
        self.rows: dict[tuple[str, int, int], list] = {}

    def add(self, host: str, page: Page, frame: frozenset[int], of: dict[int, int], sizes: Counter[int]) -> None:
        slot = 0
        passed: Counter[int] = Counter()
        blocks = {b.at: b for b in page.blocks}
        for at, token in enumerate(page.tokens):
            own = of.get(token)
            if own is not None:
                rank = passed[own] % sizes[own]
                passed[own] += 1
                row = self.rows.setdefault((host, 0, token), [rank, rank, slot, slot, page.kinds.get(token, "")])
                row[:4] = min(row[0], rank), max(row[1], rank), min(row[2], slot), max(row[3], slot)
                slot += token in frame
            elif at in blocks and not blocks[at].aside:
                row = self.rows.setdefault((host, 1, slot), [0, 0, 0, 0, ""])
                row[0] += len(blocks[at].text)
                row[1] += len(blocks[at].text) * blocks[at].main

    def told(self) -> pa.RecordBatch:
        keys, values = list(self.rows), list(self.rows.values())
        self.rows = {}
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64())]
        columns += [pa.array([v[i] for v in values], pa.int64()) for i in range(4)] + [pa.array([v[4] for v in values], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["host", "slot", "token", "a", "b", "c", "d", "kind"])


def template_of(rows: pd.DataFrame) -> tuple[list[int], list[int], int, int] | None:
    """(frame, fixed tokens, first and last slot of the article) from a host's classes and places."""
    tokens, slots = rows[rows["slot"] == 0], rows[rows["slot"] == 1]
    frame = tokens[tokens["frame"]]
    order = frame[frame["a"] == frame["b"]].sort_values("a")
    texts = slots["b"] if slots["b"].sum() else slots["a"]
    if len(order) < LEAST_CLASS or not texts.sum():
        return None
    best = min(slots["token"], key=lambda x: (-texts[slots["token"] == x].iloc[0], x))
    # Elements of the frame around that slot, the innermost first: (slot after the start tag, slot before the end tag, kind).
    ends = dict(zip(order["token"], order["a"]))
    around = [(a + 1, ends[end_of(t)], kind) for t, a, kind in zip(order["token"], order["a"], order["kind"]) if end_of(t) in ends and a < best <= ends[end_of(t)]]
    around.sort(key=lambda x: x[1] - x[0])
    first, last = 0, int(frame["a"].max()) + 1
    marked = [x for x in around if x[2] == "main"]
    inner = [x for x in around if x[2] != "whole"]
    if marked:
        first, last = marked[-1][:2]
    elif inner:
        # A paragraph's own element is too narrow: the next one around it that is not the whole page, if there is one.
        first, last = inner[min(1, len(inner) - 1)][:2]
    fixed = tokens[(tokens["a"] == tokens["b"]) & (tokens["frame"] | (tokens["c"] == tokens["d"]))]
    return frame["token"].tolist(), fixed["token"].tolist(), int(first), int(last)


def templates(pages: DataFrame, tables: Tables) -> DataFrame:
    """(host, frame, fixed, first, last) of the hosts with a template; ``pages`` has host and html.

    The classes go to the pages while they are at most ``MOST_SENT_TOKENS`` tokens;
    beyond that pages and classes are joined by host. Tasks tell a row for each
    token and slot of a host; tokens that change their rank in their class, or
    repeat in several slots of the frame, are no part of the template.
    """
    pages = pages.select("host", "html").where("html is not null and host <> ''")
    found = classes(pages, tables)
    lists = found.groupBy("host").agg(F.collect_list(F.struct("token", "class", "frame")).alias("tokens"))
    joined = pages.join(F.broadcast(lists) if found.count() <= MOST_SENT_TOKENS else lists, "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[frozenset[int], dict[int, int], Counter[int]]] = {}
        places = Places()
        for batch in batches:
            for i, host in enumerate(batch.column(0).to_pylist()):
                if host not in known:
                    if len(known) >= KEPT_HOSTS:
                        known.clear()
                    tokens = batch.column(2)[i].as_py()
                    known[host] = frozenset(t["token"] for t in tokens if t["frame"]), {t["token"]: t["class"] for t in tokens}, Counter(t["class"] for t in tokens)
                places.add(host, parse(batch.column(1)[i].as_py()), *known[host])
                if len(places.rows) > HELD_ROWS:
                    yield places.told()
        yield places.told()

    fields = "host string, slot int, token long, a long, b long, c long, d long, kind string"
    told = map_batches(joined.select("host", "html", "tokens"), run, fields)
    low, high = (lambda c: F.when(F.col("slot") == 1, F.sum(c)).otherwise(F.min(c)).alias(c)), (lambda c: F.when(F.col("slot") == 1, F.sum(c)).otherwise(F.max(c)).alias(c))
    told = told.groupBy("host", "slot", "token").agg(low("a"), high("b"), low("c"), high("d"), F.max("kind").alias("kind"))
    told = told.join(found.select("host", F.lit(0).alias("slot"), "token", "frame"), ["host", "slot", "token"], "left").withColumn("frame", F.coalesce("frame", F.lit(False)))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = template_of(rows)
        return pd.DataFrame([(rows["host"].iat[0], *made)] if made else [], columns=["host", "frame", "fixed", "first", "last"])

    return tables.cut(told.groupBy("host").applyInPandas(build, "host string, frame array<long>, fixed array<long>, first int, last int"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the article, empty if none) and ``n_chars`` (its code points).

    Null or empty html gives an empty text; a null or odd url is a host without a
    template. Whole pages are parsed, in time linear in their length; repeated rows
    are kept; own columns of these names give way. The templates go to the pages
    while they have at most ``MOST_SENT_TOKENS`` tokens; beyond that both are joined by host.
    """
    tables = Tables(pages.sparkSession)
    flat = pages.toDF(*[f"_{i}" for i in range(len(pages.columns))])
    url, page = (F.col(f"_{position(pages, c)}") for c in (url_col, html_col))
    hosted = pick(pages, url=url_col, html=html_col).select(host_of(F.col("url")).alias("host"), "html")
    known = templates(hosted, tables)
    size = known.agg(F.sum(F.size("frame") + F.size("fixed"))).first()[0] or 0
    known = known.select("host", F.struct("host", "frame", "fixed", "first", "last").alias("template"))
    joined = flat.withColumn("host", host_of(url)).withColumn("html", page).join(F.broadcast(known) if size <= MOST_SENT_TOKENS else known, "host", "left").select(*flat.columns, "html", "template")

    def make() -> Callable[..., list[pa.Array]]:
        held: dict[str, Template] = {}

        def template(found: pa.StructScalar) -> Template | None:
            if not found.is_valid:
                return None
            host = found["host"].as_py()
            if host not in held:
                if len(held) >= KEPT_HOSTS:
                    held.clear()
                own = found.as_py()
                held[host] = Template(frozenset(own["frame"]), frozenset(own["fixed"]), own["first"], own["last"])
            return held[host]

        def work(htmls: pa.Array, found: pa.Array) -> list[pa.Array]:
            texts = [article(h.as_py() or "", template(t)) for h, t in zip(htmls, found)]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    done = append(joined, ["html", "template"], make, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    keep = [i for i, c in enumerate(pages.columns) if c.lower() not in ("text", "n_chars")]
    return done.select(*[F.col(f"_{i}").alias(pages.columns[i]) for i in keep], "text", "n_chars")
