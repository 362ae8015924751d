"""Memory of the Python workers: that of some rows, and not of the thousands in an Arrow batch."""

import threading

import oracle
import psutil
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import binaries, findings
from glyphmill.plans import binary, synthetic, text


def python_mb():
    total = 0
    for p in psutil.Process().children(recursive=True):
        try:
            total += 0 if "java" in p.name() else p.memory_full_info().pss
        except psutil.Error:
            pass
    return total / 1e6


def grown_mb(action):
    """What ``action`` returns, and by how much the workers grew meanwhile."""
    before, peak, done = python_mb(), [0.0], threading.Event()

    def watch():
        while not done.wait(0.05):
            peak[0] = max(peak[0], python_mb())

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        out = action()
    finally:
        done.set()
        watcher.join()
    return out, peak[0] - before


def texts(spark, rows, marks, mark):
    """One partition of ``rows`` texts with ``marks`` marks each."""
    return spark.range(0, rows, 1, 1).select(F.col("id").alias("doc_id"), F.expr(f"repeat('ab{mark} ', {marks})").alias("text"))


@pytest.mark.parametrize("mode, mark", [("strict", "\u00a0"), ("maximum", "\u201c"), ("safe", "\u200b")])
def test_a_ledger_holds_the_changes_of_a_few_texts(spark, mode, mark):
    n, mb = grown_mb(lambda: findings.ledger(texts(spark, 4000, 300, mark), mode).agg(F.count("*"), F.max("source_index")).first())
    assert tuple(n) == (4000 * 300, 4 * 299 + 2)
    assert mb < 200, mb


def test_a_ledger_cut_short_holds_a_few_texts(spark):
    n, mb = grown_mb(lambda: findings.ledger(texts(spark, 9000, 2500, "\u200b"), "maximum", most=5).agg(F.count("*")).first()[0])
    assert n == 9000 * 5
    assert mb < 200, mb


def test_a_whole_ledger_holds_some_changes_of_a_text(spark):
    findings.ledger(texts(spark, 1, 1, "\u200b"), "safe", most=None).count()  # starts the workers, whose own memory does not count
    n, mb = grown_mb(lambda: findings.ledger(texts(spark, 1, 2_000_000, "\u200b"), "safe", most=None).agg(F.count("*"), F.max("source_index"), F.max("output_index")).first())
    assert tuple(n) == (2_000_000, 4 * 1_999_999 + 2, 3 * 1_999_999 + 2)
    assert mb < 200, mb


def test_groups_hold_a_few_texts(spark):
    n, mb = grown_mb(lambda: findings.groups(texts(spark, 9000, 2500, "\U000e0001")).agg(F.sum("count"), F.count("*")).first())
    assert tuple(n) == (9000 * 2500, 9000)
    assert mb < 200, mb


@pytest.mark.parametrize("form", ["pptx", "xlsx", "docx"])
def test_office_files_are_made_and_taken_apart_a_few_at_a_time(spark, form):
    def taken_apart(rows):
        own = binaries.parts(synthetic.files(texts(spark, rows, 5000, ""), form), "doc_id", "content")
        return own.agg(F.count_if(F.expr("seq = -1")), F.count_if(F.expr("error is not null"))).first()

    taken_apart(10)  # starts the workers, whose own memory does not count
    n, mb = grown_mb(lambda: taken_apart(6000))
    assert tuple(n) == (6000, sum(i // 9 % 4 == 3 for i in range(6000)))
    assert mb < 100, mb


@pytest.mark.parametrize("name", ["q_file_batch_status", "q_odt_sanitize", "q_pdf_sanitize", "q_svg_sanitize"])
def test_the_files_of_a_query_are_made_once(spark, monkeypatch, name):
    class Taken(Exception):
        pass

    def take(files, *_):
        raise Taken(files)

    monkeypatch.setattr(binaries, "sanitize_binary", take)
    with pytest.raises(Taken) as taken:
        binary.QUERIES[name](spark, oracle.SMALL)
    files = taken.value.args[0]  # read twice by the operator
    assert "MapInArrow" not in files._jdf.queryExecution().toString() and files.count() == 200


def test_changes_are_counted_once_and_not_before_rows_are_dealt_out(spark):
    plan = text.QUERIES["q_ledger_truncated"](spark, oracle.SMALL)._jdf.queryExecution().optimizedPlan().toString()
    counted = "regexp_extract_all"  # which regexp_count is made of
    assert counted in plan and not [x for x in plan.splitlines() if "Filter" in x and counted in x]
