"""Whole files as a source and a sink."""

import os

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import binaries, findings
from glyphmill.plans import synthetic
from glyphmill.sources import files, folders


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def contents(path):
    return sorted((os.path.basename(f), open(os.path.join(path, f), "rb").read()) for f in tree(path))


def test_empty_and_large_files_are_rows_and_not_opened(spark, tmp_path):
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "large.png").write_bytes(b"x" * 100)
    os.chmod(tmp_path / "large.png", 0)
    (tmp_path / "good.png").write_bytes(synthetic.build("png", 1, "words")[:90])
    got = {r.name: r for r in files.read_binaries(spark, str(tmp_path), limit=99).collect()}
    assert got["empty.png"].error_code == "size-limit" and got["empty.png"].bytes == 0 and got["empty.png"].content is None
    assert got["large.png"].error_code == "size-limit" and got["large.png"].bytes == 100 and got["large.png"].content is None
    assert got["good.png"].error_code is None and len(got["good.png"].content) == 90
    assert {r.path: r.error_code for r in binaries.analyze_binary(files.read_binaries(spark, str(tmp_path), limit=99).where("error_code is null").drop("error_code")).collect()} == {got["good.png"].path: "broken-file"}
    (tmp_path / "empty.txt").write_bytes(b"")
    assert [(r.name, r.text, r.error_code) for r in files.read_texts(spark, f"file://{tmp_path}").collect()] == [("empty.txt", "", None)]


def test_ten_thousand_files(spark, tmp_path):
    for k in range(10_000):
        if k % 100 == 0:
            (tmp_path / f"d{k // 100}").mkdir()
        (tmp_path / f"d{k // 100}" / f"{k}.{'bin' if k % 7 else 'txt'}").write_bytes(b"x" * (k % 50))
    df = folders.read(spark, str(tmp_path), partitionBytes=50_000)
    assert df.rdd.getNumPartitions() >= 10
    rows = df.groupBy("error_code").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("b")).collect()
    assert {(r.error_code, r.n, r.b) for r in rows} == {(None, 9_800, sum(k % 50 for k in range(10_000))), ("size-limit", 200, None)}
    assert folders.read(spark, str(tmp_path), extensions="txt").count() == len(range(0, 10_000, 7))
    assert folders.read(spark, str(tmp_path / "d3" / "302.bin")).count() == 1


@pytest.mark.parametrize("condition, wanted", [("bytes > 20", 29), ("bytes between 10 and 12", 3), ("name = '7.bin'", 1), ("name in ('7.bin', '8.bin', 'x')", 2), ("error_code is null", 49), ("error_code is not null", 1), ("path like '%9.bin'", 5), ("bytes <> 7 and name <> '8.bin'", 48), ("not (error_code = 'size-limit')", 0), ("error_code = 'size-limit' or bytes = 3", 2)])
def test_filters_reach_the_list(spark, tmp_path, condition, wanted):
    for k in range(50):
        (tmp_path / f"{k}.bin").write_bytes(b"x" * k)
    assert folders.read(spark, str(tmp_path)).where(condition).count() == wanted


def test_a_filtered_file_is_not_opened(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    os.symlink(tmp_path / "nowhere", tmp_path / "gone.bin")
    reader = folders.FolderReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([folders.EqualTo(("name",), "a.bin"), folders.EqualTo(("content",), b"abc")])) == [folders.EqualTo(("content",), b"abc")]
    assert [f[0] for p in reader.partitions() for f in p.files] == [str(tmp_path / "a.bin")]


def test_written_files_read_back_equal(spark, tmp_path):
    rows = [(f"my file {k}.png", bytearray(os.urandom(k * 100))) for k in range(30)] + [("same.name.bin", bytearray(b"1"))] * 5 + [("Same.name.bin", bytearray(b"2")), ("../../etc/x", bytearray(b"3")), ("", bytearray(b"4")), (None, bytearray(b"5")), ("null", None), (".hidden", bytearray(b"6"))]
    df = spark.createDataFrame(rows, "n string, c binary").repartition(3)
    folders.write(df, str(tmp_path / "out"), "n", "c")
    got = contents(tmp_path / "out")
    assert sorted(c for _, c in got) == sorted(bytes(c) for _, c in rows if c is not None)
    assert len(got) == len(rows) - 1 and all(f.count("/") == 1 and f.startswith("part-") for f in tree(tmp_path / "out"))
    assert len({f.lower() for f in tree(tmp_path / "out")}) == len(got)
    back = folders.read(spark, str(tmp_path / "out"), empty="")
    assert sorted(bytes(r.content) for r in back.collect()) == sorted(c for _, c in got)


def test_append_and_overwrite(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a.txt", "first")], "n string, c string")
    folders.write(df, out, "n", "c")
    folders.write(df, out, "n", "c")
    assert contents(out) == [("a.txt", b"first")] * 2
    folders.write(spark.createDataFrame([("b.txt", "sécond")], "n string, c string"), out, "n", "c", mode="overwrite")
    assert contents(out) == [("b.txt", "sécond".encode())]
    folders.write(df.limit(0), out, "n", "c")
    assert contents(out) == [("b.txt", "sécond".encode())]


def attempt(writer, rows, fail_at=None):
    import pyarrow as pa

    def batches():
        for k, (n, c) in enumerate(rows):
            if k == fail_at:
                raise OSError("lost executor")
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([c], pa.binary())], names=["name", "content"])

    return writer.write(batches())


def test_a_task_that_is_tried_again_leaves_no_half_file(tmp_path):
    """The first attempt ends in the middle, a second succeeds, and a third ran beside it; only the message that the driver got counts."""
    writer = folders.FolderWriter({"path": str(tmp_path)}, False)
    rows = [(f"{k}.bin", bytes([k]) * 10) for k in range(5)]
    with pytest.raises(OSError):
        attempt(writer, rows, fail_at=3)
    good, beside = attempt(writer, rows), attempt(writer, rows)
    assert good.folder != beside.folder
    writer.commit([good, None, folders.Written(None, 0)])
    assert contents(tmp_path) == rows and len(os.listdir(tmp_path)) == 1


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    writer = folders.FolderWriter({"path": str(tmp_path / "a")}, True)
    message = attempt(writer, [("a", b"b")])
    writer.abort([message, None])
    assert tree(tmp_path) == []
    folders.write(spark.createDataFrame([("old", "kept")], "n string, c string"), str(tmp_path / "b"), "n", "c")
    bad = spark.range(100, numPartitions=4).selectExpr("cast(id as string) n", "if(id = 77, raise_error('bad row'), 'c') c")
    with pytest.raises(Exception, match="bad row"):
        folders.write(bad, str(tmp_path / "b"), "n", "c", mode="overwrite")
    assert contents(tmp_path / "b") == [("old", b"kept")]


def test_exports_as_files(spark, tmp_path):
    rows = [("a.md", "A​B"), ("a.txt", "plain"), ("b", "x\x07y")]
    out = findings.sanitize_text(spark.createDataFrame(rows, "name string, text string").coalesce(1), "safe")
    files.save_texts(out, str(tmp_path / "texts"))
    assert {n for n, _ in contents(tmp_path / "texts")} == {"a.sanitized.txt", "a-2.sanitized.txt", "b.sanitized.txt"}
    assert {c for _, c in contents(tmp_path / "texts")} == {b"AB", b"plain", b"x\x07y"}
    (tmp_path / "in").mkdir()
    for form in ("png", "jpeg", "pdf"):
        (tmp_path / "in" / f"my file.{form}").write_bytes(synthetic.build(form, 1, "words"))
    (tmp_path / "in" / "broken.png").write_bytes(synthetic.build("png", 3, "words"))
    own = files.read_binaries(spark, str(tmp_path / "in"))
    cleaned = binaries.sanitize_binary(own).join(own.select("path", "name"), "path").withColumn("format", F.col("before.format"))
    files.save_binaries(cleaned, str(tmp_path / "clean"))
    got = dict(contents(tmp_path / "clean"))
    assert set(got) == {"my_file.clean.png", "my_file.clean.jpg", "my_file.clean.pdf"}
    again = binaries.analyze_binary(files.read_binaries(spark, str(tmp_path / "clean"))).collect()
    assert {r.metadata_count for r in again} == {0} and len(again) == 3
