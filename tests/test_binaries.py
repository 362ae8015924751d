"""The nine formats: ported cases, mutations, and errors as rows."""

import hashlib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import containers, packages, pdf
from glyphmill.operators import binaries
from glyphmill.plans import binary, synthetic

TEXT = "Some wörds & more <than> that."


@pytest.fixture(scope="module")
def cleaned(spark):
    rows = [(f"{f}-{v}", bytearray(synthetic.build(f, v, TEXT))) for f in synthetic.FORMATS for v in range(4)]
    out = binaries.batch_status(binaries.sanitize_binary(spark.createDataFrame(rows, "path string, content binary"))).collect()
    return {r.path: r for r in out}


@pytest.mark.parametrize("form", synthetic.FORMATS)
def test_format(cleaned, form):
    for variant, (n, c2pa) in enumerate(synthetic.COUNTS[form]):
        r = cleaned[f"{form}-{variant}"]
        assert (r.before.format, r.before.metadata_count, r.before.c2pa_detected, r.removed_items) == (form, n, c2pa, n)
        assert r.status == "verified" and r.after.format == form and r.after.metadata_count == 0 and not r.after.c2pa_detected
    broken = cleaned[f"{form}-3"]
    assert broken.status == "error" and broken.output is None and broken.error_code == "broken-file"


def test_kept_bytes(cleaned):
    assert bytes(cleaned["jpeg-2"].output).endswith(b"\x11\x22\xff\xd9")
    for form in ("png", "jpeg", "webp", "pdf"):
        assert TEXT.encode() in bytes(cleaned[f"{form}-1"].output)
    webp = bytes(cleaned["webp-1"].output)
    assert webp[20] & 0x0C == 0 and int.from_bytes(webp[4:8], "little") + 8 == len(webp)
    assert b"<path" in bytes(cleaned["svg-2"].output) and b"c2pa" not in bytes(cleaned["svg-2"].output)
    pdf_out = bytes(cleaned["pdf-2"].output)
    assert b"Stays visible" in pdf_out and b"Renske" not in pdf_out and b"print" not in pdf_out
    assert b"private" not in bytes(cleaned["pdf-1"].output) and b"manifest" not in bytes(cleaned["pdf-1"].output)


def test_clean_images_stay_as_they_are(cleaned):
    for form in ("png", "jpeg", "webp", "svg"):
        assert bytes(cleaned[f"{form}-0"].output) == synthetic.build(form, 0, TEXT)


def error_of(fmt, data):
    return binaries.pieces(fmt, data)[0]["error"]


def test_rejected_files():
    png = bytearray(synthetic.build("png", 1, TEXT))
    png[29] ^= 1
    assert error_of("png", bytes(png)) == "checksum"
    assert error_of("svg", b"<!DOCTYPE svg><svg/>") == "document type declaration"
    assert error_of("svg", b"plain words") == "unknown format"
    assert error_of("svg", b"<svg a='1' a='2'/>") == "repeated attribute"
    docx = [("[Content_Types].xml", b"<t/>", zipfile.ZIP_DEFLATED), ("word/document.xml", b"<d/>", zipfile.ZIP_DEFLATED)]
    assert error_of("zip", synthetic.container([*docx, ("../outside.xml", b"<x/>", zipfile.ZIP_STORED)])) == "entry path"
    assert error_of("zip", b"x" + synthetic.container(docx)) is not None
    assert error_of("zip", synthetic.container([*docx, (packages.PROVENANCE, b"m", zipfile.ZIP_DEFLATED)])) == "compressed provenance"
    assert error_of("pdf", synthetic.build("pdf", 0, TEXT).replace(b"trailer\n<<", b"trailer\n<< /Encrypt 9 0 R")) == "encrypted"


def test_an_open_document_needs_its_first_entry_stored(spark):
    data = synthetic.container([("content.xml", b"<o/>", zipfile.ZIP_DEFLATED), ("mimetype", packages.OPEN_DOCUMENT, zipfile.ZIP_DEFLATED)])
    row = binaries.analyze_binary(spark.createDataFrame([("a", bytearray(data))], "path string, content binary")).first()
    assert row.error_code == "broken-file" and row.metadata_count is None


def test_mutations_are_rows_or_clean_reads():
    rng = random.Random(5)
    for form in synthetic.FORMATS:
        fmt = "zip" if form in ("docx", "xlsx", "pptx", "odt") else form
        data = synthetic.build(form, 2, TEXT)
        for at in range(0, len(data), max(1, len(data) // 60)):
            binaries.pieces(fmt, data[:at] if at else b"\0")
            changed = bytearray(data)
            changed[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
            binaries.pieces(fmt, bytes(changed))
            binaries.pieces(fmt, data[:at] + data[at : at + 8] * 2 + data[at:])


def test_numbers_beyond_all_bounds_are_errors():
    head, tail = b"%PDF-1.5\n1 0 obj << /Type /Catalog ", b">> endobj\ntrailer\n<< /Root 1 0 R >>\n%%EOF"
    assert error_of("pdf", head + b"/N " + b"9" * 5000 + tail) is None
    assert error_of("pdf", head + tail.replace(b"trailer", b"9999999999 0 obj null endobj\ntrailer")) == "object number"
    assert error_of("pdf", head + b"/P 9999999999 0 R" + tail) == "object number"
    packed = b"8 0 obj << /Type /ObjStm /N 1 /First 5010 /Length 5020 >>\nstream\n" + b"7" * 5000 + b" 0" + b" " * 8 + b"null      \nendstream endobj\ntrailer"
    assert error_of("pdf", head + tail.replace(b"trailer", packed)) is not None


def test_the_table_grows_with_the_objects():
    out = pdf.written([(1, 0, b"<< /Type /Catalog >>", None), (3_000_000, 0, b"null", None), (3_000_001, 0, b"null", None)], (1, 0))
    assert len(out) < 500 and b"0 2\n" in out and b"3000000 2\n" in out and b"/Size 3000002" in out
    assert [t.number for t in pdf.read(out)[0]] == [1, 3_000_000, 3_000_001]


def test_digits_changed_in_a_document(spark):
    rng = random.Random(6)
    data = synthetic.build("pdf", 2, TEXT)
    places = [i for i, c in enumerate(data) if chr(c).isdigit()]
    for _ in range(400):
        changed = bytearray(data)
        at = rng.choice(places)
        changed[at : at + 1] = rng.choice([b"9" * rng.randrange(1, 5000), b"0", b"-1", b"2147483648"])
        rows = binaries.pieces("pdf", bytes(changed))
        if not rows[0]["error"]:
            assert all(abs(r["seq"]) < 2**31 for r in rows)


def test_a_direct_info_dictionary_counts_and_goes(spark):
    data = synthetic.build("pdf", 0, TEXT).replace(b"trailer\n<<", b"trailer\n<< /Info << /Author (Renske) >>")
    row = binaries.sanitize_binary(spark.createDataFrame([("a", bytearray(data))], "path string, content binary")).first()
    assert row.before.metadata_count == 1 and row.verification_passed and b"Renske" not in bytes(row.output)


def test_office_parts_may_declare_a_document_type(spark):
    part = b'<?xml version="1.0"?><!DOCTYPE d [<!ENTITY e "x">]><w:d xmlns:w="urn:w" w:author="Renske"/>'
    docx = synthetic.container([("[Content_Types].xml", b"<t/>", zipfile.ZIP_DEFLATED), ("word/document.xml", part, zipfile.ZIP_DEFLATED)])
    row = binaries.sanitize_binary(spark.createDataFrame([("a", bytearray(docx))], "path string, content binary")).first()
    assert row.error_code is None and row.before.metadata_count >= 1 and row.verification_passed
    assert error_of("svg", b"<!DOCTYPE svg><svg/>") == "document type declaration"


def test_object_streams_and_updates():
    import zlib

    inner = b"<< /Type /Annot /T (Renske) >>"
    body = zlib.compress(b"5 0 " + inner)
    data = b"%%PDF-1.5\n1 0 obj << /Type /Catalog >> endobj\n2 0 obj << /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream endobj\n" % (len(body), body)
    data += b"3 0 obj (old) endobj\n3 0 obj << /AA 1 >> endobj\n4 0 obj << /Type /XRef /Root 1 0 R /Length 0 >>\nstream\n\nendstream endobj\nstartxref\n0\n%%EOF"
    assert pdf.read(data.replace(b"/Filter /FlateDecode", b"/Filter [/FlateDecode]"))[0] == pdf.read(data)[0]
    things, trailer = pdf.read(data)
    assert [t.number for t in things] == [1, 3, 5] and trailer["Root"] == (1, 0)
    out = binaries.rebuild("pdf", data, [(5, 0, "strip-notes"), (3, 0, "strip-actions")])
    again, _ = pdf.read(out)
    assert all(not ({"T", "AA"} & {*t.entries}) for t in again)


def test_spans_may_nest():
    assert containers.without(b"0123456789", [(2, 8), (3, 4), (7, 9)]) == b"019"


def test_odd_rows(spark):
    rows = [("null", None), ("empty", bytearray()), ("text", bytearray(b"hello"))]
    got = {r.path: r for r in binaries.analyze_binary(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["null"].error_code is None and got["null"].bytes is None and got["null"].metadata_count is None
    assert got["empty"].error_code == "size-limit" and got["text"].error_code == "unknown-format"
    assert binaries.sanitize_binary(spark.createDataFrame([], "path string, content binary")).count() == 0


def tampered_container():
    """A container whose second entry's header is said to lie in the closing comment, too near the end for one."""
    data = bytearray(synthetic.container([("a", b"x", zipfile.ZIP_STORED), ("b", b"y", zipfile.ZIP_STORED)]))
    end = data.rfind(b"PK\5\6")
    data[end + 20 : end + 22] = (8).to_bytes(2, "little")
    data += b"PK\3\4abcd"
    second = data.rfind(b"PK\1\2", 0, end)
    data[second + 42 : second + 46] = (len(data) - 8).to_bytes(4, "little")
    return bytes(data)


def test_a_header_too_near_the_end_is_an_error(spark):
    data = tampered_container()
    assert error_of("zip", data) == "entry header"
    row = binaries.sanitize_binary(spark.createDataFrame([("a", bytearray(data))], "path string, content binary")).first()
    assert row.error_code == "broken-file" and row.error_detail == "entry header"


def seconds(run):
    import time

    return min(_once(run, time.perf_counter) for _ in range(3))


def _once(run, clock):
    began = clock()
    run()
    return clock() - began


@pytest.mark.parametrize("make", [
    lambda n: ("svg", b"<svg" + b" " * n + b">"), lambda n: ("svg", b"<svg a='1'" + b" " * n + b"=/>"), lambda n: ("svg", b"<svg" + b" a" * n + b"/>"), lambda n: ("svg", b"<svg a='" + b" " * n),
    lambda n: ("svg", b"<svg" + b"\n\t" * n + b"/>"), lambda n: ("svg", b"<svg>" + b"<!-" * n), lambda n: ("svg", b"<svg>" + b"<![CDATA[" * n),
    lambda n: ("pdf", synthetic.build("pdf", 0, TEXT) + b"trailer\n<< /A 1 >>\n" * (n // 16)), lambda n: ("pdf", synthetic.build("pdf", 0, TEXT) + b"trailer\n" * n), lambda n: ("pdf", b"%PDF-1.5\n" + b"1 " * n),
    lambda n: ("pdf", b"%PDF-1.5\n1 0 obj << /A " + b"(" * n), lambda n: ("pdf", b"%PDF-1.5\n1" + b" " * n + b"0" + b" " * n),
])
def test_linear_time(make):
    """Four times the input takes about four times as long, not sixteen."""
    small, large = (seconds(lambda f=make(n): binaries.pieces(*f)) for n in (32_000, 128_000))
    assert large < 9 * max(small, 0.004)


def test_blanks_in_office_parts_take_linear_time():
    def run(n):
        part = b"<w:d" + b" " * n + b"/>"
        data = synthetic.container([("[Content_Types].xml", b"<t/>", zipfile.ZIP_DEFLATED), ("word/document.xml", part, zipfile.ZIP_DEFLATED)])
        return seconds(lambda: binaries.pieces("zip", data))

    assert run(128_000) < 9 * max(run(32_000), 0.004)


def test_mutations_rebuild_or_fail_as_rows(spark):
    """What is read after a mutation is rebuilt, or fails with an error that the job knows."""
    rng = random.Random(8)
    rows = [("zip", tampered_container())]
    for form in synthetic.FORMATS:
        data = synthetic.build(form, 2, TEXT)
        for _ in range(12):
            changed = bytearray(data)
            for _ in range(rng.randrange(1, 4)):
                changed[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
            rows.append((form, bytes(changed)))
    df = spark.createDataFrame([(f"{i}-{f}", bytearray(d)) for i, (f, d) in enumerate(rows)], "path string, content binary").repartition(4)
    out = binaries.batch_status(binaries.sanitize_binary(df)).collect()
    assert len(out) == len(rows)
    assert all((r.output is None) == (r.error_code is not None) and r.status in ("verified", "error") for r in out)


def test_a_fault_between_rebuild_and_verification(spark):
    """A rebuild that leaves everything in place: PDF files have no output then, others have one that did not pass."""
    rows = [(f, bytearray(synthetic.build(f, 1, TEXT))) for f in ("pdf", "png", "docx")]
    faulty = binaries.sanitize_binary(spark.createDataFrame(rows, "path string, content binary"), rebuild=lambda fmt, data, plan: data)
    got = {r.path: r for r in binaries.batch_status(faulty).collect()}
    assert got["pdf"].error_code == "verification-failed" and got["pdf"].output is None and got["pdf"].after is None and got["pdf"].removed_items is None
    for form in ("png", "docx"):
        assert got[form].error_code is None and not got[form].verification_passed and got[form].after.metadata_count > 0
    assert {r.status for r in got.values()} == {"error"}


def test_a_rebuild_that_fails_or_grows_is_an_error(spark):
    def broken(fmt, data, plan):
        if fmt == "png":
            raise ValueError("no space")
        return b"" if fmt == "pdf" else bytes(33 * 1024 * 1024)

    rows = [(f, bytearray(synthetic.build(f, 1, TEXT))) for f in ("pdf", "png", "webp")]
    got = {r.path: r for r in binaries.sanitize_binary(spark.createDataFrame(rows, "path string, content binary"), rebuild=broken).collect()}
    assert {r.error_code for r in got.values()} == {"rebuild-failed"} and got["png"].error_detail == "no space" and all(r.output is None for r in got.values())


def test_no_content_is_shuffled_while_plans_are_few(spark, capsys):
    rows = [(f"{f}-{v}", bytearray(synthetic.build(f, v, TEXT))) for f in synthetic.FORMATS for v in range(4)] + [("null", None), ("empty", bytearray())]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    few = binaries.sanitize_binary(df)
    few.explain("formatted")
    plan = capsys.readouterr().out
    import re

    for block in re.findall(r"\(\d+\) (?:Exchange|BroadcastExchange).*?\n(Input.*?)\n", plan):
        assert "output" not in block and "content" not in block
    many = binaries.sanitize_binary(df, most_plans=0)
    key = lambda r: r.path
    assert sorted(few.collect(), key=key) == sorted(many.collect(), key=key)
    assert few.count() == len(rows)


def test_a_stream_of_known_length_is_not_looked_through(monkeypatch):
    class Counted:
        scans = 0
        search = staticmethod(pdf.HEAD.search)

        def finditer(self, data, own=pdf.HEAD):
            Counted.scans += 1
            return own.finditer(data)

    monkeypatch.setattr(pdf, "HEAD", Counted())
    data = synthetic.build("pdf", 2, "7 0 obj 1 0 obj " * 1000)
    assert len(pdf.read(data)[0]) == 6 and Counted.scans == 0
    named = data.replace(b"/Length 16000", b"/Length 9 0 R").replace(b"xref", b"9 0 obj\n16000\nendobj\nxref", 1)
    assert [t.stream for t in pdf.read(named)[0] if t.number == 3] == [b"7 0 obj 1 0 obj " * 1000] and Counted.scans == 1


@pytest.mark.parametrize("form", ["docx", "xlsx", "odt"])
def test_an_entry_that_keeps_its_attributes_is_not_taken_apart_twice(monkeypatch, form):
    data = synthetic.build(form, 1, TEXT)
    scrubbed = {p.place: "scrub" for p in packages.parts(data) if p.private}
    wanted = packages.rebuilt(data, scrubbed)
    read = []
    monkeypatch.setattr(packages.markup, "tokens", lambda body, declarations=False, own=packages.markup.tokens: read.append(body) or own(body, declarations))
    assert packages.rebuilt(data, scrubbed) == wanted and len(read) == len(scrubbed)
    assert "​".encode() not in b"".join(packages.content(box, e) for box in [packages.checked(wanted)] for e in box.infolist())


def test_files_are_counted_without_their_outputs(spark):
    rows = [(f"{f}-{v}", bytearray(synthetic.build(f, v, TEXT))) for f in ("svg", "pdf") for v in range(4)]
    out = binaries.batch_status(binaries.sanitize_binary(spark.createDataFrame(rows, "path string, content binary"), most_plans=0))
    counted = out.groupBy("before.format", "status").agg(F.count("*").alias("n"))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "output#" in x and "Relation [" not in x]
    assert {tuple(r) for r in counted.collect()} == {("svg", "verified", 3), ("pdf", "verified", 3), (None, "error", 2)}


def test_findings_of_documents_are_told_in_few_passes(spark):
    rows = [(f"pdf-{v}", bytearray(synthetic.build("pdf", v, TEXT))) for v in range(4)]
    own = binaries.parts(spark.createDataFrame(rows, "path string, content binary"), "path", "content")
    hits = binaries.document_hits(own)
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 5
    told = {(r.id, r.kind): r.n for r in hits.where("kind is not null").groupBy("id", "kind").agg(F.sum("n").alias("n")).collect()}
    assert told == {
        ("pdf-1", "pdf-metadata"): 2, ("pdf-1", "c2pa"): 1, ("pdf-2", "pdf-metadata"): 1, ("pdf-2", "pdf-annotation-privacy"): 4, ("pdf-2", "pdf-active-content"): 3,
    }
    acts = {tuple(r) for r in hits.where("what is not null").select("id", "at", "what").collect()}
    assert acts == {("pdf-1", n, "null") for n in (4, 5, 6, 7)} | {("pdf-1", 1, "strip-catalog"), ("pdf-2", 4, "null"), ("pdf-2", 6, "null"), ("pdf-2", 1, "strip-actions"), ("pdf-2", 5, "strip-notes")}


@pytest.mark.parametrize("form", ["svg", "jpeg", "webp"])
def test_digests_of_outputs_are_told_without_the_outputs(spark, form):
    rows = [(f"{form}-{v}", bytearray(synthetic.build(form, v, TEXT))) for v in range(4)]
    out = binaries.sanitize_binary(spark.createDataFrame(rows, "path string, content binary"), most_plans=0)
    assert all(r.output_sha256 == (r.output and hashlib.sha256(r.output).hexdigest()) for r in out.collect()) and out.where("output_sha256 is not null").count() == 3
    plan = binary.QUERIES[f"q_{form}_sanitize"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "output#" in x and "Relation [" not in x]


def test_a_digest_is_told_where_the_output_cannot_be_read_and_not_where_there_is_none(spark):
    rows = [(f, bytearray(synthetic.build(f, 1, TEXT))) for f in ("svg", "png", "pdf")]
    spoilt = binaries.sanitize_binary(spark.createDataFrame(rows, "path string, content binary"), rebuild=lambda fmt, data, plan: data[:-2])
    got = {r.path: r for r in spoilt.collect()}
    for form in ("svg", "png"):
        assert got[form].after is None and not got[form].verification_passed and got[form].output_sha256 == hashlib.sha256(got[form].output).hexdigest()
    assert got["pdf"].error_code == "verification-failed" and got["pdf"].output_sha256 is None


def test_findings_are_dealt_out_by_file_once(spark, capsys):
    rows = [(f"{f}-{v}", bytearray(synthetic.build(f, v, TEXT))) for f in synthetic.FORMATS for v in range(4)]
    binaries.inspected(spark.createDataFrame(rows, "path string, content binary"), "path", "content").explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(id#" in plan and not [x for x in plan.splitlines() if "hashpartitioning(id#" in x and "kind#" in x]
    assert "LocalTableScan" in plan and "Scan ExistingRDD" not in plan
