"""Byte-level BPE against the tiktoken library, and the round trip."""

import base64
import hashlib
import struct

import helpers
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)
ENCODER = bpe.load(PATH)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
WANTED = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="abcdefghij éß'  \n\t0123", max_size=200) | st.text(alphabet="ab", min_size=50, max_size=300))
def test_any_text(text):
    ids = ENCODER.encode(text)
    assert ids == WANTED.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "\x85\xa0 　 x", "<|endoftext|>", "'s't're", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 50, "日本語のテキスト" * 20, "x1²³½ Ⅷ", "\r\n\r\n  a  ", "\x1c\x1d\x1e\x1f a", "İıſK"])
def test_edges(text):
    assert ENCODER.encode(text) == WANTED.encode_ordinary(text)


def test_one_long_piece_takes_linear_time():
    text = "z" * 30_000 + "qj" * 20_000
    assert ENCODER.decode(ENCODER.encode(text)) == text.encode()


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = bpe.encode(docs, digests=True)
    for r in out.collect():
        ids = WANTED.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.decode(out).where("decoded <> coalesce(text, '')").count() == 0


def test_odd_rows(spark):
    rows = bpe.encode(helpers.odd_docs(spark)).collect()
    assert len(rows) == helpers.odd_docs(spark).count() and rows[0].n_tokens == 0 and rows[0].ids == []
    assert bpe.encode(helpers.empty_docs(spark)).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).where("decoded = ''").count() == 2
