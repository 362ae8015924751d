"""Queries of the file operators over files made from the documents, each with its SQL.

SQL cannot read such files, but what is in them is known by the id. What a JPEG, WebP
or SVG file must be after cleaning SQL puts together byte by byte from the text, and
holds against the digest of the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import binaries
from glyphmill.plans import synthetic
from glyphmill.plans.text import Query, read
from glyphmill.sources.shared import spread, written

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KNOWN = (
    "known(format, mime, variant, n, c2pa) as (values "
    + ", ".join(f"('{f}', '{binaries.MIMES[f]}', {v}, {n}, {str(c).lower()})" for f, rows in synthetic.COUNTS.items() for v, (n, c) in enumerate(rows))
    + ")"
)
MIXED = f"{KNOWN}, made as (select doc_id, ([{', '.join(repr(f) for f in synthetic.FORMATS)}])[doc_id % 9 + 1] as form, doc_id // 9 % 4 as variant from documents)"


def files(spark: SparkSession, sf_dir: str, form: str | None = None) -> DataFrame:
    return synthetic.files(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), form)


def little(size: str) -> str:
    """DuckDB's expression of a size as four bytes, the least first."""
    return "unhex(" + " || ".join(f"substr(printf('%08x', {size}), {k}, 2)" for k in (7, 5, 3, 1)) + ")"


def raw(data: bytes) -> str:
    return f"unhex('{data.hex()}')"


PICTURE = f"({raw(b'VP8 ')} || {little('octet_length(body)')} || body || case when octet_length(body) % 2 = 1 then {raw(bytes(1))} else {raw(b'')} end)"
#: DuckDB's expression of the bytes of a clean file around ``body``, the text's bytes.
CLEAN = {
    "jpeg": f"{raw(bytes.fromhex('ffd8ffda0008010100000000'))} || body || {raw(bytes.fromhex('ff00ffd01122ffd9'))}",
    "webp": f"{raw(b'RIFF')} || {little(f'22 + octet_length({PICTURE})')} || {raw(b'WEBPVP8X' + bytes([10]) + bytes(13))} || {PICTURE}",
    "svg": "encode('<svg xmlns=\"http://www.w3.org/2000/svg\">' || case when made.variant > 0 then '<a><rect width=''1''/></a><text>AB</text>' else '' end || '<path d=\"M0 0\"/><desc>'"
    " || replace(replace(replace(decode(body), '&', '&amp;'), '>', '&gt;'), '<', '&lt;') || '</desc></svg>')",
}


def _one(form: str) -> None:
    """One format's files, made from every document: report before, cleaning, report after."""
    name = f"q_{form}_sanitize"

    def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = binaries.sanitize_binary(written(files(spark, sf_dir, form)), "doc_id")  # read twice, made once
        return out.select(
            "doc_id", "before.format", "before.metadata_count", "before.c2pa_detected", "removed_items", "verification_passed",
            F.col("after.metadata_count").alias("after_count"), "error_code", *["output_sha256"] * (form in CLEAN),
        )

    QUERIES[name] = clean
    output = f", case when n is not null then sha256({CLEAN[form]}) end as output_sha256" if form in CLEAN else ""
    SQL[name] = (
        f"with {KNOWN}, made as (select doc_id, '{form}' as form, doc_id // 9 % 4 as variant, encode(coalesce(text, '')) as body from documents) select doc_id, format, cast(n as bigint) as metadata_count, c2pa as c2pa_detected, cast(n as bigint) as removed_items, case when n is not null then true end as verification_passed,"
        f" case when n is not null then cast(0 as bigint) end as after_count, case when n is null then 'broken-file' end as error_code{output} from made left join known on form = format and made.variant = known.variant"
    )


for _form in synthetic.FORMATS:
    _one(_form)


def q_detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format and type of every file."""
    return binaries.analyze_binary(files(spark, sf_dir), "doc_id").select("doc_id", "format", "mime", "metadata_count", "c2pa_detected", "error_code")


SQL["q_detect_format"] = (
    f"with {MIXED} select doc_id, format, mime, cast(n as bigint) as metadata_count, c2pa as c2pa_detected, case when n is null then 'broken-file' end as error_code"
    " from made left join known on form = format and made.variant = known.variant"
)


def q_file_batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by format and status, and the findings left in them."""
    out = binaries.batch_status(binaries.sanitize_binary(written(files(spark, sf_dir)), "doc_id"))
    left = F.coalesce("after.metadata_count", "before.metadata_count", F.lit(0))
    return out.groupBy(F.col("before.format").alias("format"), "status").agg(F.count("*").alias("files"), F.sum("removed_items").alias("removed"), F.sum(left).alias("left_over"))


SQL["q_file_batch_status"] = (
    f"with {MIXED} select format, case when n is null then 'error' else 'verified' end as status, count(*) as files, cast(sum(n) as bigint) as removed, cast(0 as bigint) as left_over"
    " from made left join known on form = format and made.variant = known.variant group by 1, 2"
)
QUERIES |= {f.__name__: f for f in (q_detect_format, q_file_batch_status)}
