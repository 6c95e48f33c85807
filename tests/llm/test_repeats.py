import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from millrace.llm import repeats


def expected(rows, length):
    seen = Counter()
    raws = [(k, (t or "").encode()) for k, t in rows]
    for _, raw in raws:
        seen.update(raw[p : p + length] for p in range(len(raw) - length + 1))
    out = []
    for key, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((key, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, 0, 0) for k, t in rows], "doc_id bigint, text string, spans int, rid int")
    out = repeats.remove_repeats(docs, **options)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abcdefghij é") for _ in range(n))

    passages = [noise(n) for n in (40, 41, 60, 130, 300)]
    rows = []
    for k in range(60):
        text = noise(rng.randrange(0, 150))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 15)
            text += p[cut:] + noise(rng.randrange(0, 60))
        rows.append((k, text))
    rows += [(100, "x" * 500), (101, "ab" * 300), (102, None), (103, ""), (104, "short"), (105, rows[0][1]), (105, rows[0][1]), (None, passages[4])]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("crowd", [1, 3, 10**6])
def test_brute_force(spark, seed, crowd):
    rows = corpus(seed)
    assert run(spark, rows, length=40, gram=10, crowd=crowd) == expected(rows, 40)


@pytest.mark.parametrize("digit", [8, 13, 40])
def test_digits(spark, digit):
    rows = corpus(5)
    assert run(spark, rows, length=40, gram=10, digit=digit) == expected(rows, 40)


def test_equal_hashes_do_not_decide():
    """With a hash that takes all windows for equal, the bytes still tell them apart."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(14)) + "same" + "".join(rng.choice("ab") for _ in range(14)) for _ in range(200)]
    length, gram, wide = 8, 4, 4
    grid = np.array([list(t[14 - wide : 14 + length].encode()) for t in texts], np.uint8)
    real = repeats._hashes
    ends = np.zeros(len(texts), np.int64), np.full(len(texts), wide)
    want = np.array([[sum(u[14 - o : 22 - o] == t[14 - o : 22 - o] for u in texts) > 1 for o in range(wide + 1)] for t in texts])
    for weak in (False, True):
        repeats._hashes = (lambda through, width: np.zeros((len(through), through.shape[-1] - width), np.uint64)) if weak else real
        try:
            got = repeats._marks(grid, np.ones(len(texts), np.uint64), *ends, length, gram, 3)
        finally:
            repeats._hashes = real
        assert (got == want).all()


@pytest.mark.parametrize(("length", "gram", "digit"), [(224, 56, 112), (400, 100, 200)])
def test_a_large_group_is_compared_in_little_memory(length, gram, digit):
    rng = np.random.default_rng(7)
    n, wide = repeats.CROWD + repeats.BLOCK, length - gram
    kinds = rng.integers(97, 123, (n // 40, wide + length), dtype=np.uint8)
    pick = rng.integers(0, len(kinds), n)
    alone = rng.random(n) < 0.5
    grid = kinds[pick]
    grid[alone, :: digit // 4] = rng.integers(0, 97, (int(alone.sum()), len(range(0, wide + length, digit // 4))), dtype=np.uint8)
    tracemalloc.start()
    try:
        got = repeats._marks(grid, np.zeros(n, np.uint64), np.zeros(n, np.int64), np.full(n, wide), length, gram, digit)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    twice = np.bincount(pick[~alone], minlength=len(kinds)) > 1
    assert (got == (~alone & twice[pick])[:, None]).all()
    assert peak < 10 * grid.nbytes


def test_production_length(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert run(spark, rows) == expected(rows, 400)


def test_crowded_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 16)
    rows = corpus(4) + [(k, "p" * 3 + f"{k}" + "the same passage stands in all of these texts and is long enough" + f"{k}") for k in range(200, 300)]
    assert run(spark, rows, length=40, gram=10) == expected(rows, 40)


def test_text_is_cut_at_characters(spark):
    passage = "é" * 50
    docs = spark.createDataFrame([(1, "a" + passage + "b"), (2, "c" + passage + "d")], "doc_id bigint, text string")
    out = repeats.remove_repeats(docs, length=99, gram=20, with_text=True).collect()
    assert sorted((r.doc_id, r.kept) for r in out) == [(1, "ab"), (2, "cd")]
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
