"""Private data in files of nine formats: found, cut out and looked for again.

Small helpers take one file apart and tell its pieces (chunks, segments, entries,
objects, spans); Spark decides what they mean, by joins with tables of tags, by
windows over runs of segments and by joins of objects that name each other. What
goes back to a file is a short plan of what to cut. While plans are few, by a count
of their files and steps, they are broadcast, and no content is shuffled; beyond
that contents and plans meet in a shuffled join.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import containers, markup, packages, pdf
from glyphmill.functions.containers import Broken
from glyphmill.sources.files import BINARY_LIMIT
from glyphmill.sources.shared import SLICE_BYTES, map_batches, written

# The formats and their types.
MIMES = {
    "png": "image/png", "jpeg": "image/jpeg", "webp": "image/webp",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odt": "application/vnd.oasis.opendocument.text", "svg": "image/svg+xml", "pdf": "application/pdf",
}
# Pieces of image files that are findings: format, tag, hint, kind.
TAGS = (
    ("png", "eXIf", "", "exif"), ("png", "tEXt", "", "text"), ("png", "zTXt", "", "text"), ("png", "iTXt", "", "text"), ("png", "tIME", "", "timestamp"), ("png", "caBX", "", "c2pa"),
    ("jpeg", "E1", "exif", "exif"), ("jpeg", "E1", "xmp", "xmp"), ("jpeg", "EC", "", "application"), ("jpeg", "ED", "", "iptc"), ("jpeg", "FE", "", "comment"), ("jpeg", "EB", "c2pa", "c2pa"),
    ("webp", "EXIF", "", "exif"), ("webp", "XMP ", "", "xmp"), ("webp", "C2PA", "", "c2pa"),
    *[("svg", k, "", k) for k in ("svg-metadata", "svg-comments", "active-content", "external-references", "unicode", "c2pa")],
)
# The order in which a report names findings.
ORDER = (
    "exif", "text", "timestamp", "xmp", "application", "iptc", "comment", "document-properties", "author-traces", "svg-metadata", "svg-comments", "active-content",
    "external-references", "unicode", "pdf-metadata", "c2pa", "pdf-annotation-privacy", "pdf-active-content",
)
DESCRIPTIONS = {
    "exif": "Exif block", "text": "Text chunks", "timestamp": "Time of the last change", "xmp": "XMP packet", "application": "Application data", "iptc": "IPTC block", "comment": "Comments",
    "document-properties": "Properties of the document", "author-traces": "Authors and dates of changes", "svg-metadata": "Metadata elements", "svg-comments": "Comments",
    "active-content": "Scripts and event handlers", "external-references": "References to other places", "unicode": "Invisible characters", "pdf-metadata": "Info dictionary and XMP streams",
    "c2pa": "Provenance manifest", "pdf-annotation-privacy": "Authors and times of annotations", "pdf-active-content": "Scripts, launches and automatic actions",
}
#: Files and steps of plans that are broadcast at most.
MOST_PLANS, MOST_STEPS = 500_000, 1_000_000
MOST_ROWS = 8192
PARTS = (
    "bytes long, sha256 string, format string, seq int, start long, stop long, tag string, hint string, private int, marks int, digest string, names array<string>, refs array<int>, files array<int>, error string"
)
HITS = "kind string, n int, at long, to long, what string"
ANNOTATION_KEYS = ("T", "M", "CreationDate", "NM")
ACTION_KEYS = ("JS", "OpenAction", "AA")


def candidate(content: Column) -> Column:
    """The format that a file's first bytes speak for: png, jpeg, webp, zip, pdf, else svg."""
    head = lambda n, at=1: F.substring(content, at, n)
    return (
        F.when(head(8) == F.lit(containers.PNG_START), "png").when(head(2) == F.lit(containers.JPEG_START), "jpeg")
        .when((head(4) == F.lit(b"RIFF")) & (head(4, 9) == F.lit(b"WEBP")), "webp").when(head(4) == F.lit(b"PK\3\4"), "zip").when(head(5) == F.lit(b"%PDF-"), "pdf").otherwise("svg")
    )


def row(fmt: str, seq: int, **more: object) -> dict:
    return {"bytes": None, "sha256": None, "format": fmt, "seq": seq, "start": 0, "stop": 0, "tag": "", "hint": "", "private": 0, "marks": 0, "digest": None, "names": None, "refs": None, "files": None, "error": None} | more


def pieces(fmt: str, data: bytes) -> list[dict]:
    """A file's pieces, after one row (seq -1) for the file itself."""
    head = row(fmt, -1)
    try:
        if fmt == "zip":
            return [head] + [row(fmt, p.place, tag=p.name, hint=p.hint, private=p.private, marks=p.marks, digest=p.digest) for p in packages.parts(data)]
        if fmt == "pdf":
            things, trailer = pdf.read(data)
            head |= {"names": sorted(trailer), "refs": [trailer["Root"][0]] + [trailer[k][0] for k in ("Info",) if k in trailer]}
            return [head, *map(described, things)]
        if fmt == "svg":
            containers.need(data.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n\x0c").startswith(b"<"), "unknown format")
        cut = {"png": containers.png_pieces, "jpeg": containers.jpeg_pieces, "webp": containers.webp_pieces, "svg": markup.svg_pieces}[fmt]
        return [head] + [row(fmt, i, start=a, stop=b, tag=tag, hint=hint) for i, (a, b, tag, hint) in enumerate(cut(data))]
    except Broken as e:
        return [head | {"error": str(e)}]
    except RecursionError:
        return [head | {"error": "nested too deeply"}]
    except (ValueError, OverflowError, LookupError, struct.error):
        return [head | {"error": "malformed file"}]


def described(thing: pdf.Thing) -> dict:
    """A PDF object: its type and kind, its keys, the objects it names and those it embeds."""
    named = lambda entries: sorted({e.value[0] for e in entries.values() if isinstance(e.value, tuple)})
    embeds = thing.entries["EF"].value if "EF" in thing.entries else None
    files = named(embeds) if isinstance(embeds, dict) else [-embeds[0]] if isinstance(embeds, tuple) else []  # below 0: the dictionary with the files
    provenance = thing.name("AFRelationship") == "C2PA_Manifest" and thing.stream is None
    hint = "c2pa" if provenance else "action" if thing.name("S") in ("JavaScript", "Launch") else "stream" if thing.stream is not None else ""
    main = thing.entries["Metadata"].value if "Metadata" in thing.entries else None
    return row(
        "pdf", thing.number, tag=thing.name("Type") or "", hint=hint, names=sorted(k for k in thing.entries if k in (*ANNOTATION_KEYS, *ACTION_KEYS, "Metadata")), refs=named(thing.entries),
        files=files, start=main[0] if isinstance(main, tuple) else 0,
    )


def parts(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, ...): the pieces of every file, after a row (seq -1) with its size and digest. Content beyond the limits is not taken apart. No shuffle."""
    own = F.col(content_col)
    fits = F.octet_length(own).between(1, BINARY_LIMIT)
    taken = files.select(F.col(id_col).alias("id"), F.octet_length(own).cast("long").alias("bytes"), F.sha2(own, 256).alias("sha256"), candidate(own).alias("format"), F.when(fits, own).alias("content"))
    kind = taken.schema["id"].dataType.simpleString()
    names = [c.split()[0] for c in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int32()))] + [pa.array([r[n] for r in out], t) for n, t in zip(names, types)], names=["id", *names])

        for batch in batches:
            out: list[dict] = []
            owners: list[int] = []
            for i in range(batch.num_rows):
                size, digest, fmt, data = (batch.column(c)[i].as_py() for c in range(1, 5))
                rows = pieces(fmt, data) if data is not None else [row(fmt, -1)]
                rows[0] |= {"bytes": size, "sha256": digest}
                out += rows
                owners += [i] * len(rows)
                if len(out) >= MOST_ROWS:
                    yield made()
                    out, owners = [], []
            yield made()

    return map_batches(taken, run, f"id {kind}, {PARTS}")


def tags(spark: SparkSession) -> DataFrame:
    rows = ", ".join(str(t) for t in TAGS)
    return spark.sql(f"select * from values {rows} as t(format, tag, hint, kind)")  # rows of the plan itself, made without a job


def image_hits(own: DataFrame) -> DataFrame:
    """Findings in images and drawings: (id, kind, n, at, to, what).

    Provenance in JPEG files may run over several segments: those that touch one
    another, of which one names it, belong together.
    """
    known = F.broadcast(tags(own.sparkSession))  # as many rows as TAGS
    hits = own.where("format in ('png', 'jpeg', 'webp', 'svg') and seq >= 0")
    plain = hits.where("not (format = 'jpeg' and tag = 'EB')").join(known, ["format", "tag", "hint"]).select("id", "kind", "start", "stop")
    by_place = Window.partitionBy("id").orderBy("seq")
    runs = hits.where("format = 'jpeg' and tag = 'EB'").withColumn("new", (F.col("start") != F.coalesce(F.lag("stop").over(by_place), F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    named = runs.withColumn("named", F.max(F.col("hint") == "c2pa").over(Window.partitionBy("id", "run"))).where("named")
    found = plain.union(named.select("id", F.lit("c2pa").alias("kind"), "start", "stop"))
    return found.select("id", "kind", F.lit(1).alias("n"), F.col("start").alias("at"), F.col("stop").alias("to"), F.lit("cut").alias("what"))


def package_formats(own: DataFrame) -> DataFrame:
    """(id, package): the office format of each container, null if it is none or more than one."""
    main = F.element_at(F.create_map(*[F.lit(x) for kv in packages.MAIN_PARTS.items() for x in kv]), F.col("tag"))
    entries = own.where("format = 'zip' and seq >= 0")
    told = entries.groupBy("id").agg(
        F.bool_or(F.col("hint") == "odt").alias("odt"), F.bool_or(F.col("tag") == "[Content_Types].xml").alias("types"),
        F.count_if(F.col("tag").isin(*packages.MAIN_PARTS)).alias("n"), F.max(F.when(F.col("tag").isin(*packages.MAIN_PARTS), main)).alias("main"),
    )
    return told.select("id", F.when(F.col("odt") & ~F.col("types") & (F.col("n") == 0), "odt").when(~F.col("odt") & F.col("types") & (F.col("n") == 1), F.col("main")).alias("package"))


def package_hits(own: DataFrame, formats: DataFrame) -> DataFrame:
    """Findings in office documents, and a row for each entry that is not kept as it is."""
    digest = lambda body: F.sha2(F.lit(body), 256)
    empty = F.lit(None).cast("string")
    for form, known in (("odt", packages.ODT_EMPTY), ("ooxml", packages.OOXML_EMPTY)):
        for name, body in known.items():
            empty = F.when((F.col("tag") == name) & ((F.col("package") == "odt") == F.lit(form == "odt")), digest(body)).otherwise(empty)
    scope = F.lit(False)
    for form, starts in packages.ATTRIBUTE_SCOPE.items():
        for start in starts:
            scope = scope | ((F.col("package") == form) & F.col("tag").startswith(start))
    scope = scope & F.col("tag").endswith(".xml")
    entries = own.where("format = 'zip' and seq >= 0").join(formats.where("package is not null"), "id").withColumn("empty", empty).withColumn("scope", scope)
    gone = F.col("tag") == packages.PROVENANCE
    what = F.when(gone, "drop").when(F.col("empty").isNotNull(), "empty").when(F.col("scope"), "scrub")
    one = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"))
    told = F.array(
        one("document-properties", F.coalesce(F.col("empty") != F.col("digest"), F.lit(False))), one("author-traces", F.when(F.col("scope"), F.col("private")).otherwise(0)),
        one("unicode", F.when(gone, 0).otherwise(F.col("marks"))), one("c2pa", gone), one("", F.lit(0)),
    )
    each = entries.withColumn("what", what).select("id", "seq", "what", F.explode(told).alias("f"))
    each = each.where("f.n > 0 or (f.kind = '' and what is not null)")
    return each.select("id", F.nullif("f.kind", F.lit("")).alias("kind"), "f.n", F.col("seq").cast("long").alias("at"), F.lit(0).cast("long").alias("to"), F.when(F.col("f.kind") == "", F.col("what")).alias("what"))


def document_hits(own: DataFrame) -> DataFrame:
    """Findings in PDF files, and a row for each object that goes or loses keys.

    What a row tells by itself is told in one pass; only objects that others name are looked up by joins.
    """
    rows = own.where("format = 'pdf' and error is null")
    heads, things = rows.where("seq = -1"), rows.where("seq >= 0")
    has = lambda *keys: F.size(F.array_intersect("names", F.array(*map(F.lit, keys))))
    place = F.col("seq").cast("long")

    def fields(kind: str | None, n: Column, at: Column, what: str | None) -> Column:
        return F.struct(
            F.lit(kind).cast("string").alias("kind"), n.cast("int").alias("n"), at.cast("long").alias("at"), F.lit(0).cast("long").alias("to"), F.lit(what).cast("string").alias("what"),
        )

    hit = lambda when, kind, n=F.lit(1): F.when(when, fields(kind, n, place, None))
    do = lambda when, what, at=place: F.when(when, fields(None, F.lit(0), at, what))
    head, thing = F.col("seq") == -1, F.col("seq") >= 0
    info = head & F.array_contains("names", "Info")
    xmp = thing & (F.col("tag") == "Metadata") & (F.col("hint") == "stream")
    manifest, action = thing & (F.col("hint") == "c2pa"), thing & (F.col("hint") == "action")
    noted = has(*ANNOTATION_KEYS)
    notes = thing & (F.col("tag") == "Annot") & (noted > 0)
    acts = has(*ACTION_KEYS)
    active = acts + action.cast("int")
    told = F.array(
        hit(info, "pdf-metadata"), hit(xmp, "pdf-metadata"), hit(manifest, "c2pa"), hit(notes, "pdf-annotation-privacy", noted), hit(thing & (active > 0), "pdf-active-content", active),
        do(info, "null", F.col("refs")[1]), do(xmp | manifest | action, "null"), do(thing & ~action & (acts > 0), "strip-actions"), do(notes, "strip-notes"),
    )
    # What a manifest's file specification embeds: named by it, or (below 0) by a dictionary that it names.
    direct = F.transform(F.filter(F.when(manifest, F.col("files")), lambda n: n > 0), lambda n: fields(None, F.lit(0), n, "null"))
    own_rows = rows.select("id", F.inline(F.array_compact(F.concat(told, F.coalesce(direct, F.array().cast(f"array<struct<{HITS}>>"))))))
    named = things.where("hint = 'c2pa'").select("id", F.explode("files").alias("number")).where("number < 0").select("id", (-F.col("number")).alias("seq"))
    through = named.join(things.select("id", "seq", F.explode("refs").alias("number")), ["id", "seq"]).select("id", fields(None, F.lit(0), F.col("number"), "null").alias("f"))
    catalog = things.join(heads.select("id", F.col("refs")[0].alias("seq")), ["id", "seq"])
    main = F.array_compact(F.array(do(F.col("start") > 0, "null", F.col("start")), do(F.array_contains("names", "Metadata"), "strip-catalog")))
    return own_rows.union(through.select("id", "f.*")).union(catalog.select("id", F.inline(main)))


def inspected(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, bytes, sha256, format, findings, plan, error): what is in each file, and what to do about it; a row for each file."""
    own = written(parts(files, id_col, content_col))  # small rows; four families of findings read them
    formats = package_formats(own)
    hits = image_hits(own).unionByName(package_hits(own, formats)).unionByName(document_hits(own))
    # Dealt out by file once, for both groupings below and the join with the heads.
    told = hits.repartition("id").groupBy("id", "kind").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("what").isNotNull(), F.struct("at", "to", "what"))).alias("plan"))
    order = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    words = F.element_at(F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv]), F.col("kind"))
    finding = F.struct(order.alias("place"), F.struct("kind", F.col("n").cast("long").alias("count"), words.alias("description")).alias("finding"))
    told = told.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull() & (F.col("n") > 0), finding))), lambda x: x["finding"]).alias("findings"),
        F.flatten(F.collect_list("plan")).alias("plan"),
    )
    heads = own.where("seq = -1").select("id", "bytes", "sha256", "format", "error").join(formats, "id", "left")
    taken = F.coalesce(F.col("bytes").between(1, BINARY_LIMIT), F.lit(False))
    known = F.when(F.col("format") != "zip", F.col("format")).otherwise(F.col("package"))
    error = F.when(taken, F.coalesce("error", F.when(known.isNull(), "no office document")))
    good = taken & error.isNull()
    none = lambda name: F.array().cast(told.schema[name].dataType)
    return heads.join(told, "id", "left").select(
        "id", "bytes", "sha256", F.when(good, known).alias("format"), F.when(good, F.coalesce("findings", none("findings"))).alias("findings"), F.coalesce("plan", none("plan")).alias("plan"), error.alias("error"),
    )


def total(findings: str) -> Column:
    return F.aggregate(findings, F.lit(0).cast("long"), lambda a, x: a + x["count"])


def report(looked: DataFrame, id_col: str) -> DataFrame:
    mime = F.element_at(F.create_map(*[F.lit(x) for kv in MIMES.items() for x in kv]), F.col("format"))
    code = (
        F.when(F.col("bytes").isNull(), None).when(~F.col("bytes").between(1, BINARY_LIMIT), "size-limit")
        .when(F.col("error") == "unknown format", "unknown-format").when(F.col("error").isNotNull(), "broken-file")
    )
    kinds = F.transform("findings", lambda x: x["kind"])
    return looked.select(
        F.col("id").alias(id_col), "format", mime.alias("mime"), "bytes", "sha256", total("findings").alias("metadata_count"), F.array_contains(kinds, "c2pa").alias("c2pa_detected"), "findings",
        code.alias("error_code"), F.col("error").alias("error_detail"),
    )


def analyze_binary(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(id, format, mime, bytes, sha256, metadata_count, c2pa_detected, findings, error_code, error_detail) of every file.

    ``id_col`` names a file. A bad file is a row with an error (``size-limit``,
    ``unknown-format`` or ``broken-file``) and null counts, and never ends the job;
    null content gives nulls.
    """
    return report(inspected(files, id_col, content_col), id_col)


def rebuild(fmt: str, data: bytes, plan: list[tuple[int, int, str]]) -> bytes:
    """The file after its plan."""
    if fmt == "pdf":
        things, trailer = pdf.read(data)
        doing: dict[int, set[str]] = {}
        for at, _, what in plan:
            doing.setdefault(at, set()).add(what)
        keys = {"strip-notes": ANNOTATION_KEYS, "strip-actions": ACTION_KEYS, "strip-catalog": ("Metadata",)}
        out = []
        for t in things:
            what = doing.get(t.number, set())
            if "null" in what:
                out.append((t.number, t.generation, b"null", None))
            else:
                spans = [(t.entries[k].start, t.entries[k].stop) for w in what for k in keys[w] if k in t.entries]
                out.append((t.number, t.generation, containers.without(t.raw, spans), t.stream))
        return pdf.written(out, trailer["Root"])
    if fmt in ("docx", "xlsx", "pptx", "odt"):
        return packages.rebuilt(data, {at: what for at, _, what in plan})
    cut = containers.without(data, [(a, b) for a, b, _ in plan])
    return containers.webp_finished(cut) if fmt == "webp" else cut


def sanitize_binary(files: DataFrame, id_col: str = "path", content_col: str = "content", rebuild: Callable[[str, bytes, list], bytes] = rebuild, most_plans: int = MOST_PLANS, most_steps: int = MOST_STEPS) -> DataFrame:
    """(id, output, removed_items, verification_passed, before, after, error_code, error_detail, output_sha256) of every file.

    ``before`` and ``after`` are reports; the latter is of the output, read anew, as is
    ``output_sha256``: who asks for the digest alone has no output read or shuffled.
    A file that cannot be read, rebuilt within the size limit or (PDF) verified is
    a row with an error and no output. ``rebuild`` makes a file after its plan.

    Each input is taken apart once and rebuilt once. Plans and reports go to the
    contents by broadcast while they are at most ``most_plans`` files and
    ``most_steps`` steps, else both sides are shuffled.
    """
    looked = written(inspected(files, id_col, content_col))
    n, steps = looked.agg(F.count("*"), F.sum(F.size("plan"))).first()
    send = F.broadcast if n <= most_plans and (steps or 0) <= most_steps else lambda rows: rows.hint("merge")
    plans = looked.where("error is null and format is not null").select("id", "format", "plan")
    joined = files.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")).join(send(plans), "id")
    kind = joined.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            own = batch.column("id").slice(first, len(out))
            return pa.RecordBatch.from_arrays([own, pa.array([o for o, _ in out], pa.binary()), pa.array([e for _, e in out], pa.string())], names=["id", "output", "failed"])

        for batch in batches:
            out: list[tuple[bytes | None, str | None]] = []
            first = held = 0
            for i in range(batch.num_rows):
                fmt, data = batch.column("format")[i].as_py(), batch.column("content")[i].as_py()
                plan = [(p["at"], p["to"], p["what"]) for p in batch.column("plan")[i].as_py()]
                try:
                    new = rebuild(fmt, data, plan)
                    containers.need(1 <= len(new) <= BINARY_LIMIT, "output size")
                    out.append((new, None))
                    held += len(new)
                except (Broken, RecursionError, ValueError, OverflowError, LookupError, struct.error) as e:
                    out.append((None, str(e)))
                if held >= SLICE_BYTES:
                    yield made()
                    out, first, held = [], i + 1, 0
            yield made()

    made = written(map_batches(joined.select("id", "format", "content", "plan"), run, f"id {kind}, output binary, failed string"))
    fields = ["format", "mime", "bytes", "sha256", "metadata_count", "c2pa_detected", "findings"]
    side = lambda r, name, *more: r.select("id", F.when(F.col("error_code").isNull() & F.col("sha256").isNotNull(), F.struct(*fields)).alias(name), *more)
    before = side(report(looked, "id"), "before", "error_code", "error_detail")
    reports = written(before.join(side(analyze_binary(made, "id", "output"), "after", F.col("sha256").alias("fresh_sha256")), "id", "left"))  # no content in them
    rest = reports.join(made.select("id"), "id", "left_anti").withColumns({"output": F.lit(None).cast("binary"), "failed": F.lit(None).cast("string"), "kept": F.lit(False)})
    # Whether there is an output is told without it, so that who asks for no outputs has none read or shuffled.
    out = made.withColumn("kept", F.col("failed").isNull()).join(send(reports), "id").unionByName(rest)
    passed = F.coalesce((F.col("after.metadata_count") == 0) & ~F.col("after.c2pa_detected"), F.lit(False))
    left = F.col("kept") & (F.col("before.format") == "pdf") & ~passed
    code = F.coalesce("error_code", F.when(F.col("failed").isNotNull(), "rebuild-failed"), F.when(left, "verification-failed"))
    good = code.isNull() & F.col("kept")
    return out.select(
        F.col("id").alias(id_col), F.when(good, F.col("output")).alias("output"), F.when(good, F.col("before.metadata_count")).alias("removed_items"), F.when(good, passed).alias("verification_passed"),
        "before", F.when(good, F.col("after")).alias("after"), code.alias("error_code"), F.coalesce("error_detail", "failed").alias("error_detail"),
        F.when(good, F.col("fresh_sha256")).alias("output_sha256"),
    )


def batch_status(results: DataFrame) -> DataFrame:
    """``results`` of ``sanitize_binary`` with ``status``: verified, or error, be it that a file failed or that its output did not pass."""
    return results.withColumn("status", F.when(F.coalesce("verification_passed", F.lit(False)), "verified").otherwise("error"))
