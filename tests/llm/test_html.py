"""Main text of pages: templates, markup by hand, odd pages."""

import random
import re
import time
from collections import Counter, defaultdict

import helpers
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import html
from glyphmill.llm.common import Tables


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def text_of(spark, page):
    return html.extract(pages(spark, [(1, None, page)])).first().text


def test_markup_by_hand(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class='ad-box'>Buy</div>"
        "<article><h1>One &amp; two</h1><p>First  <b>bold</b>\n line<br>next<p>Second &#8212; &eacute;<ul><li>a<li>b</ul><script>x='<p>'</script>"
        "<div id=comments><p>Nice</p></div></article><footer>f</footer></body></html>"
    )
    assert text_of(spark, page) == "One & two\nFirst bold line next\nSecond — é\na\nb"


def test_templates_are_deduced_without_an_article_element(spark):
    shell = "<html><body><div><span>Site name</span></div><table><tr><td>Latest</td></tr></table><section><p>{}</p><p>{}</p></section><div>All rights</div></body></html>"
    rows = [(i, f"http://Example.org/{i}", shell.format(f"words number {i}", f"more of {i}")) for i in range(12)]
    rows += [(99, "http://other.org/", shell.format("x", "y"))]
    got = {r.page_id: r.text for r in html.extract(pages(spark, rows)).collect()}
    assert got[3] == "words number 3\nmore of 3"
    assert got[99] == "Site name\nLatest\nx\ny\nAll rights"  # a host of one page has no template


def test_what_all_pages_of_a_host_say_is_no_article(spark):
    shell = "<html><body><article><h1>{}</h1><p>Subscribe to our letter now.</p><p>{}</p></article></body></html>"
    rows = [(i, f"http://example.org/{i}", shell.format(f"title {i}", f"body {i}")) for i in range(12)] + [(99, "http://example.org/99", shell.format("", ""))]
    got = {r.page_id: r.text for r in html.extract(pages(spark, rows)).collect()}
    assert got[3] == "title 3\nbody 3"
    assert got[99] == "Subscribe to our letter now."


def test_near_copies_on_a_host_keep_their_article(spark):
    shell = "<html><body><nav><a>Home</a></nav><article><h1>One title</h1><p>" + "First paragraph. " * 9 + "</p><p>" + "Second one. " * 9 + "</p><p>Seen on day {}</p></article></body></html>"
    got = {r.page_id: r.text for r in html.extract(pages(spark, [(i, f"http://example.org/{i}", shell.format(i)) for i in range(8)])).collect()}
    assert got[3] == f"One title\n{'First paragraph. ' * 9}".strip() + f"\n{'Second one. ' * 9}".rstrip() + "\nSeen on day 3"


def test_the_pages_of_the_test_data(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = html.extract(table).collect()
    assert len(rows) == table.count() and all(r.n_chars == len(r.text) for r in rows)
    sources = {r.page_id: r.html for r in table.collect()}
    assert sum(bool(r.text) for r in rows) > 0.9 * len(rows)
    for r in rows:
        assert not re.search(r"</?(?:p|div|li|script|article)\b", r.text)
        assert "\n\n" not in r.text and r.text == r.text.strip()
        first = re.search(r"<h1[^>]*>([^<&]+)</h1>", sources[r.page_id])
        if first and "<article" in sources[r.page_id]:
            assert " ".join(first[1].split()) in r.text


def made_pages(seed=3):
    """Hosts whose pages have neither article or main elements nor telling names, with lists that repeat and boxes that vary."""
    rng = random.Random(seed)
    say = lambda n: " ".join(helpers.words(rng, n))
    rows = []
    for host in range(4):
        for k in range(9):
            items = "".join(f"<tr><td><i>{say(2)}</i></td><td>Label {host}</td></tr>" for _ in range(rng.randrange(1, 5)))
            body = "".join(f"<p>{say(rng.randrange(20, 40))}</p>" for _ in range(rng.randrange(1, 4)))
            text = f"<html><body><div class='x1'><span>Site {host}</span></div><table><tr><td>Fixed {host}</td></tr>{items}</table><section class='q post-{k}'><h2>{say(4)}</h2>{body}<p>Written here.</p></section><div class='x2'>{say(3)}</div></body></html>"
            rows.append((len(rows), f"https://h{host}.example.org/{k}", text))
    return rows


def test_classes_against_whole_occurrence_vectors(spark):
    rows = made_pages()
    vectors = defaultdict(lambda: defaultdict(dict))
    for i, url, page in rows:
        for token, n in Counter(html.parse(page).tokens).items():
            vectors[url.split("/")[2]][token][i] = n
    wanted = set()
    for host, tokens in vectors.items():
        pages_of = {i for i, url, _ in rows if url.split("/")[2] == host}
        groups = defaultdict(set)
        for token, counts in tokens.items():
            if len(counts) >= 0.9 * len(pages_of):
                groups[tuple(sorted(counts.items()))].add(token)
        groups = {v: g for v, g in groups.items() if len(g) >= 2}
        frame = max((v for v in groups if max(n for _, n in v) == 1), key=lambda v: len(groups[v]))
        wanted |= {(host, t, v == frame) for v, g in groups.items() for t in g}
    hosted = pages(spark, rows).select(html.host_of(F.col("url")).alias("host"), "html")
    assert {(r.host, r.token, r.frame) for r in html.classes(hosted, Tables(spark)).collect()} == wanted


def test_articles_without_telling_elements_or_names(spark):
    rows = made_pages()
    got = {r.page_id: r.text for r in html.extract(pages(spark, rows)).collect()}
    for i, _, page in rows:
        section = re.search("<section.*</section>", page)[0]
        wanted = [t for t in re.findall(r"<(?:h2|p)>(.*?)</(?:h2|p)>", section) if t != "Written here."]
        assert got[i].split("\n") == wanted
        assert html.article(page, None).split("\n") != wanted


def test_many_hosts_by_the_joined_way(spark, monkeypatch):
    rows = made_pages(5)
    once = sorted(tuple(r) for r in html.extract(pages(spark, rows)).collect())
    for name in ("MOST_SENT_TOKENS", "MOST_SENT_HOSTS", "HELD_ROWS"):
        monkeypatch.setattr(html, name, 0)
    monkeypatch.setattr(html, "KEPT_HOSTS", 1)
    assert sorted(tuple(r) for r in html.extract(pages(spark, rows)).collect()) == once


@pytest.mark.parametrize("page, text", [
    ("<p>a&#" + "9" * 5000 + ";b&#x" + "0" * 5000 + "41;c&#0000065;&#xffffffffff;", "a\ufffdbAcA\ufffd"),
    ("<p>one<b " + 'x="' * 3, "one"), ("<p>one</p><a href=\"x>two</a>\n<p>three", "one\ntwo\nthree"), ("one <b", "one"), ("a < b <i>d", "a < b d"),
    ("<div>" * 3000 + "deep" + "</p>" * 3000, "deep"), ("<b>" * 3000 + "<li>x" * 100, "\n".join("x" * 100)),
])
def test_markup_that_is_odd_or_long(page, text):
    assert html.article(page, None) == text


def test_time_is_linear():
    for unit in ("<a ", "<div></x>", "<b><li>", "<a '> \"<", "<title>", "<!--", "<p class =", "&#9"):
        took = []
        for n in (20_000, 80_000):
            start = time.process_time()
            html.article("<div>" * 2000 + unit * n, None)
            took.append(time.process_time() - start)
        assert took[1] < 10 * took[0] + 1


def test_odd_pages(spark):
    rows = [(1, "http://a/", None), (2, None, ""), (3, "odd url", "plain text"), (3, "odd url", "plain text"), (4, "http://a/", "<p>" + "long " * 100_000), (5, "http://a/", "<<<>>> & &bogus; <b"), (None, "http://a/", "<p>x</p>"), (6, "", "<div " * 2000), (7, "", "<a title='>'>q</a>")]
    out = html.extract(spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, N_chars int"))
    got = out.collect()
    assert len(got) == len(rows) and [c.lower() for c in out.columns] == ["page_id", "url", "html", "text", "n_chars"]
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[3] == "plain text" and len(by[4]) == 499_999 and by[7] == "q"
    assert html.extract(pages(spark, [])).count() == 0


ODD_NAMES = '<article class="{k}"><div class="post-header"><h1>Title {k}</h1></div><p class="notice-of-death">He died {k}</p><div class="ad-hoc">Rules {k}</div><div class="shareholders"><p>Owners {k}</p></div><section id="related_work"><p>Others {k}</p></section><div class="header">Lead {k}</div><div class="ad">Buy {k}</div><div class="comments-list"><p>Nice {k}</p></div><p>Body {k}</p></article>'
ODD_TEXT = "Title {k}\nHe died {k}\nRules {k}\nOwners {k}\nOthers {k}\nLead {k}\nBody {k}"


def test_names_inside_an_article_without_a_template(spark):
    assert text_of(spark, "<body><nav>x</nav>" + ODD_NAMES.format(k="a") + "</body>") == ODD_TEXT.format(k="a")


def test_names_inside_an_article_with_a_template(spark):
    rows = [(i, f"http://example.org/{i}", f"<html><body><nav><a>Home</a></nav>{ODD_NAMES.format(k=f'w{i}')}<footer>End</footer></body></html>") for i in range(9)]
    got = {r.page_id: r.text for r in html.extract(pages(spark, rows)).collect()}
    assert all(got[i] == ODD_TEXT.format(k=f"w{i}") for i in range(9))


def test_slots_decide_before_names(spark):
    """Without article elements, an outside name within the template's article is text, and the same name elsewhere is not."""
    shell = "<html><body><div class='site-header'><span>Site {k}</span></div><section><h2>Title of {k}</h2><p>{body}</p><div class='notice'><p>Notice of {k}</p></div><p>{body}</p></section><div class='social-links'><i>Follow {k}</i></div></body></html>"
    rows = [(i, f"http://example.org/{i}", shell.format(k=f"w{i}", body=f"long words of w{i} " * 12)) for i in range(8)]
    got = {r.page_id: r.text.split("\n") for r in html.extract(pages(spark, rows)).collect()}
    assert all(got[i][0] == f"Title of w{i}" and f"Notice of w{i}" in got[i] and not any("Site" in t or "Follow" in t for t in got[i]) for i in range(8))
    assert text_of(spark, shell.format(k="x", body="y")) == "Title of x\ny\ny"  # no template: names decide


@pytest.mark.parametrize("page, text", [
    ("a &am<b>p;</b> b", "a &am p; b".replace("m p", "mp")), ("1 &lt<i>x</i>", "1 <x"), ("&#77<b>5;</b>", "M5;"), ("<div class='adHoc'>a</div><div class='adBox'>b</div>", "a"), ("<p class='ad ad-hoc'>x<p id=''>y", "y"),
])
def test_references_end_at_tags_and_names_are_whole(page, text):
    assert html.article(page, None) == " ".join(text.split())


@pytest.mark.parametrize("own, wanted", [(24, "both"), (26, "own")])
def test_both_sides_of_the_share_that_tells_near_copies(spark, own, wanted):
    """Blocks of 100 characters in all: what pages say themselves has a quarter of them less or more one."""
    fixed = "f" * (100 - own)
    rows = [(i, f"http://example.org/{i}", f"<html><body><div><i>s</i></div><article><p>{fixed}</p><p>{str(i) * own}</p></article></body></html>") for i in range(8)]
    got = {r.page_id: r.text for r in html.extract(pages(spark, rows)).collect()}
    assert all(got[i] == (f"{fixed}\n{str(i) * own}" if wanted == "both" else str(i) * own) for i in range(8))
