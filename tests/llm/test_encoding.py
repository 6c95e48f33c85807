"""BPE and token files against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest
from millrace.llm import bpe, token_files
from millrace.llm.queries import END_ID, tokenizer_path
from tokenizers import Tokenizer

TEXTS = [
    "", "   ", "Hello World's 12 <|endoftext|> ÀÉ ΣΑΣ\x1cx\x85y z <|start", "a" * 300 + "!!!!....''''s", "x" * 5000, "İstanbul ﬁ é 日本語 🎉👍🏽",
    "a\x1d\x1eb c　d<|startoftext|><|endoftext|>e it's'll é ́x Å", "The the THE", "tab\tand\nline", "1234567 3.14 50%",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def expected(library, text):
    ids = np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")
    decoded = library.decode(ids.tolist(), skip_special_tokens=False)
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_round_trip_equals_the_library(spark, library):
    rows = [*enumerate(TEXTS), (100, None), (101, "The the THE"), (101, "The the THE"), (None, "no id")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, ids string")
    got = bpe.round_trip(docs, tokenizer_path()).collect()
    want = sorted((str(k), *expected(library, t)) for k, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_driver_table_equals_the_library(spark, library, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, tokenizer_path()).collect()}
    assert got == {r.doc_id: expected(library, r.text) for r in docs.collect()}


def test_cache_starts_afresh_without_changing_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    model = bpe.WordBPE(bpe.read_spec(tokenizer_path()))
    for text in TEXTS * 2:
        flat, counts = model.encode([text, text])
        assert counts.tolist() == [len(flat) // 2] * 2
        assert flat[: counts[0]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_keep_columns(spark, library):
    docs = spark.createDataFrame([(1, "hello there", "kept"), (2, None, None)], "doc_id int, text string, decoded string")
    out = bpe.decode(bpe.encode(docs, tokenizer_path(), end_id=7), tokenizer_path())
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].ids == [*library.encode("hello there", add_special_tokens=False).ids, 7]
    assert rows[2].ids == [7]
    assert rows[1].decoded.startswith("hello</w> there</w> ")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.round_trip(docs, tokenizer_path()).count() == 0
    assert token_files.stored(docs, tokenizer_path(), END_ID).count() == 0


def test_token_files_in_order(spark, library, tmp_path):
    rows = [(5, "five five"), (1, "one"), (3, None), (2, ""), (9, "nine " * 500), (4, "tie b"), (4, "tie a"), (None, "null id")]
    docs = spark.createDataFrame([(k, t, 0, 0) for k, t in rows], "doc_id bigint, text string, start int, tokens int")
    path = str(tmp_path / "ids")
    token_files.write(docs, path, tokenizer_path(), END_ID, files=3)
    got = sorted(token_files.index(token_files.read(spark, path)).collect(), key=lambda r: r.start)
    start = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for row, (key, text) in zip(got, order, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, END_ID], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (key, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.read(spark, path).where("doc_id = 9").head().tokens[-1] == END_ID
