"""Files in and out, base64, and the streaming variants."""

import base64
import datetime

from pyspark.sql import functions as F

from glyphmill.plans import synthetic
from glyphmill.operators import binaries, findings
from glyphmill.sources import files
from glyphmill.streaming import texts


def test_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes("﻿A​B".encode())
    (tmp_path / "sub" / "b.md").write_bytes(b"bad \xff byte")
    (tmp_path / "big.csv").write_bytes(b"x" * 100)
    (tmp_path / "c.exe").write_bytes(b"no text")
    got = {r.name: r for r in files.read_texts(spark, str(tmp_path), limit=50).collect()}
    assert set(got) == {"a.TXT", "b.md", "big.csv"}
    assert got["a.TXT"].text == "﻿A​B" and got["b.md"].text == "bad � byte"
    assert got["big.csv"].text is None and got["big.csv"].error_code == "text-too-large"
    out = findings.sanitize_text(files.read_texts(spark, str(tmp_path), limit=50).where("error_code is null").drop("error_code"), "safe")
    files.export_texts(out, str(tmp_path / "out"))
    assert {(r.export_name, r.output) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a.sanitized.txt", "AB"), ("b.sanitized.txt", "bad � byte")}


def test_binary_files(spark, tmp_path):
    for form in ("png", "jpeg", "pdf"):
        (tmp_path / f"my file.{form}").write_bytes(synthetic.build(form, 1, "words"))
    own = files.read_binaries(spark, str(tmp_path))
    assert {r.error_code for r in files.read_binaries(spark, str(tmp_path), limit=10).collect()} == {"size-limit"}
    out = binaries.sanitize_binary(own).join(own.select("path", "name"), "path").withColumn("format", F.col("before.format"))
    files.export_binaries(out, str(tmp_path / "out"))
    assert {r.export_name for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"my_file.clean.png", "my_file.clean.jpg", "my_file.clean.pdf"}


def test_base64(spark):
    rows = [(1, base64.b64encode(b"abc" * 40).decode()), (2, "!!"), (3, ""), (4, None), (5, base64.b64encode(b"x" * 400).decode())]
    out = files.from_base64(spark.createDataFrame(rows, "id long, p string"), "p", limit=200)
    got = {r.id: r for r in files.to_base64(out, "content").collect()}
    assert got[1].content_base64 == rows[0][1] and got[1].error_code is None
    assert [got[i].error_code for i in (2, 3, 4, 5)] == ["bad-base64", "size-limit", None, "size-limit"]


def stream(spark, tmp_path, rows):
    spark.createDataFrame(rows, "ts timestamp, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))


def run(df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name).collect()


AT = datetime.datetime(2026, 1, 1, 12)


def test_streams(spark, tmp_path):
    rows = [(AT, "a​b"), (AT, "a​b"), (AT + datetime.timedelta(minutes=25), "plain")]
    own = stream(spark, tmp_path, rows)
    assert sorted(r.output for r in run(texts.sanitized(own, "safe"), "sanitized")) == ["ab", "ab", "plain"]
    assert len(run(texts.first_seen(own, "ts"), "seen")) == 2
    rates = {r.window.start.minute: r for r in run(texts.rates(own, "ts"), "rates", "complete")}
    assert (rates[0].texts, rates[0].marks, rates[0].risk_high, rates[20].marks) == (2, 2, 2, 0)
