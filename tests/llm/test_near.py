"""The similarity join and the vector join against all pairs."""

import random

import numpy as np
import pytest
from millrace.llm import near_join, near_vectors


def shingles(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                root[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for a, (key, _) in enumerate(rows):
        group = [rows[b][0] for b in range(len(rows)) if find(b) == find(a)] if sets[a] else [key]
        out.append((key, len(sets[a]), min((x for x in group if x is not None), default=None)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, 0, 0) for k, t in rows], "doc_id bigint, text string, rid int, n int")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_join.near_join(docs, **options).collect()), key=str)


def variants(seed, n, length, edits, vocabulary=400):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(length)] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_edge_cases(spark):
    rows = [(1, "one two three four"), (2, "One  TWO three\nfour"), (3, None), (4, ""), (5, " \t"), (6, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (8, "É a b c d"), (9, "é a b c d"), (10, "x")]
    assert run(spark, rows) == expected(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = variants(seed, 60, 60, 14) + variants(seed + 10, 40, 200, 30) + variants(seed + 20, 20, 9, 3)
    texts += [" ".join(f"r{rng.randrange(500)}" for _ in range(rng.randrange(1, 80))) for _ in range(40)]
    texts += rng.sample(texts, 20)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert run(spark, rows) == expected(rows)


def test_blocks_and_salts_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK", 8)
    monkeypatch.setattr(near_join, "SALT", 4)
    rows = list(enumerate(variants(5, 90, 50, 16)))
    assert run(spark, rows) == expected(rows)


def test_every_order_alone_is_exact(spark):
    rows = list(enumerate(variants(6, 50, 40, 12)))
    assert run(spark, rows, orders=1) == run(spark, rows, orders=4) == expected(rows)


@pytest.mark.parametrize("block", [8, near_join.BLOCK])
def test_links_are_all_pairs_of_sets(spark, monkeypatch, block):
    monkeypatch.setattr(near_join, "BLOCK", block)
    texts = variants(7, 60, 300, 8) + variants(8, 20, 9, 3)
    rows = [*enumerate(texts + texts[:15] + ["", None, "a b", "A  b"]), (None, "nobody's text"), (None, texts[3])]
    ids = {}
    for key, text in rows:
        if shingles(text):
            ids.setdefault(frozenset(shingles(text)), []).append(key)
    sets = list(ids)
    least = [min((x for x in ids[s] if x is not None), default=None) for s in sets]
    want = []
    for a in range(len(sets)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((least[c], len(ids[sets[c]])) for c in (a, b))
                want.append((x[0], y[0], x[1], y[1]))
    got = near_join.near_links(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.columns == ["class_a", "class_b", "rows_a", "rows_b"]
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == sorted(want)
    assert near_join.near_links(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_empty_table_and_keep_one(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_join.near_join(docs).count() == 0
    docs = spark.createDataFrame([(2, "a b c d e f", "s"), (1, "A b c d e f", "t"), (3, "", None), (4, None, None)], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r.source) for r in near_join.keep_one(docs).collect()) == [(1, "t"), (3, None), (4, None)]


def vectors(seed, n, dim=32):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dim))
    noise = 0.12 * rng.standard_normal((n, dim)) * rng.random((n, 1))
    return base[rng.integers(0, n // 4, n)] + noise


def test_vectors_against_all_pairs(spark):
    x = vectors(3, 600).astype(np.float32)
    label = np.arange(600) % 3
    rows = [(k, v.tolist(), int(c), "r") for k, (v, c) in enumerate(zip(x, label, strict=True))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, rid string")
    got = {r.vec_id: r for r in near_vectors.near_vectors(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    true, found = links.sum(), sum(r.n_links for r in got.values())
    assert true > 300 and 0.97 * true <= found <= true
    assert all(got[k].n_links <= links[k].sum() for k in got)
    assert all(label[got[k].component_id] == label[k] and got[k].component_id <= k and got[k].kept == (got[k].component_id == k) for k in got)


def test_vector_blocks_are_exact_too(spark, monkeypatch):
    x = np.repeat(np.random.default_rng(1).standard_normal((1, 16)), 70, axis=0) + 0.001 * np.random.default_rng(2).standard_normal((70, 16))
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    assert {(r.vec_id, r.n_links, r.component_id) for r in near_vectors.near_vectors(df).collect()} == {(k, 69, 0) for k in range(70)}


def test_copies_of_a_vector_stand_in_no_cell(spark, monkeypatch):
    x = np.random.default_rng(4).standard_normal(8)
    rows = [(k, x.tolist(), 1) for k in range(300)] + [(300 + k, (x + 0.001 * (1 + k)).tolist(), 1) for k in range(3)] + [(400 + k, (-x).tolist(), 1) for k in range(2)] + [(500, x.tolist(), 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    seen = []
    links = near_vectors._links
    monkeypatch.setattr(near_vectors, "_links", lambda groups, *rest: seen.append(groups.select("rid").distinct().count()) or links(groups, *rest))
    out = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(df).collect()}
    assert out == {**{k: (302, 0) for k in range(303)}, 400: (1, 400), 401: (1, 400), 500: (0, 500)}
    assert seen[0] <= 4


def test_unsound_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 0.0], 1), (8, [1.0, None], 1), (9, [1.0], 1), (10, [], 1), (11, [1.0, 0.0], 2), (2, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect())
    assert out == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *[(k, 0, k, True) for k in range(3, 12)]]
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_calibration():
    assert near_vectors.least_count(24, 1.25, 0.995) >= 10
    keys, tables = near_vectors.plan(10**9, 0.98, 0.995)
    assert 1 - (1 - near_vectors.same_cell(near_vectors.CELL) ** keys) ** tables >= 0.995


def test_filters_of_all_orders_lose_no_similar_pair():
    rng = np.random.default_rng(8)
    dropped = 0
    for _ in range(2000):
        base = rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64)
        other = np.unique(np.r_[base[rng.random(len(base)) < rng.choice([0.3, 0.8, 0.95])], rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)])
        base = np.unique(base)
        if not len(other):
            continue
        heads, others = ([near_join.prefix(x, k, None) for k in range(3)] for x in (base, other))
        passes = near_join.meets(base, other, heads, others)
        assert passes or not near_join.similar(base, other)
        dropped += not passes
    assert dropped > 500
