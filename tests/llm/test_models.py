"""Quality grades by held-out accuracy, scores against a plain computation."""

import math
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from millrace.llm import quality, scoring
from pyspark.sql import functions as F


def test_fit_orders_grades():
    rng = np.random.default_rng(0)
    found, grades = [], []
    for k in range(600):
        g = k % 3
        found.append(np.unique(np.r_[rng.integers(100, 400, 20), [g] if rng.random() < 0.9 else []]).astype(np.int32))
        grades.append(g)
    model = quality.fit(found[:400], np.array(grades[:400]))
    assert model.thresholds[0] < model.thresholds[1]
    tails = model.tails(found[400:])
    assert (tails[:, 0] >= tails[:, 1]).all()
    expected = tails.sum(axis=1)
    means = [expected[np.array(grades[400:]) == g].mean() for g in range(3)]
    assert means[0] < means[1] < means[2]


def test_texts_without_spaces_get_weights():
    """Good and poor texts of one long word each, which only runs of characters inside them tell apart."""
    rng = np.random.default_rng(3)
    kinds = ["".join(map(chr, range(0x4E00 + 100 * k, 0x4E00 + 100 * k + 40))) for k in range(2)]
    for alphabets in (kinds, ["abcdefghij", "klmnopqrst"]):
        texts = ["".join(rng.choice(list(alphabets[k % 2]), 60)) for k in range(400)]
        found = quality.features(texts)
        model = quality.fit(found[:300], np.array([2 if k % 2 else 0 for k in range(300)]))
        top = model.tails(found[300:])[:, -1]
        assert top[1::2].min() > top[0::2].max()


def test_shapes_read_the_whole_word():
    assert quality.shape("a" * 50 + "!") == "a!" and quality.shape("x1" * 30) == "a0" * 30
    assert quality.shape("AND!!") == "A!" and quality.shape("Then,") == "Aa,"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = F.xxhash64("doc_id") % 3 == 0
    model = quality.train(docs, labels.where(~held))
    judged = quality.grade(docs, model).join(labels.where(held), "doc_id")
    counts = {(r.quality, r.toxic, r.keep): r["count"] for r in judged.groupBy("quality", "toxic", "keep").count().collect()}
    clean = counts.get((1, 0, True), 0), counts.get((1, 0, False), 0)
    poor = counts.get((0, 0, True), 0), counts.get((0, 0, False), 0)
    assert clean[0] >= 0.97 * sum(clean)
    assert poor[1] >= 0.9 * sum(poor)


def test_grade_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, True), (2, "", None), (3, "word " * 30000, None), (3, "ok", None), (None, "x", None)], "doc_id bigint, text string, keep boolean")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (3, None, 0), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    out = quality.grade(docs, quality.train(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r.p_top <= 1 and 0 <= r.expected_grade <= 2 for r in out)
    assert all(r.keep for r in quality.grade(docs, quality.train(docs, labels.limit(0))).collect())
    assert quality.grade(docs.limit(0), None).count() == 0


def plain_scores(rows, support=scoring.SUPPORT, discount=scoring.DISCOUNT):
    texts = [(k, zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0, [*(t or "").encode().lower().split(), b""]) for k, t in rows]

    def grams(w):
        """Of each token its n-grams of all lengths; the first one follows the end token alone."""
        w = [b"", *w]
        return [[tuple(w[k - n : k + 1]) for n in range(min(k, 2) + 1)] for k in range(1, len(w))]

    c = Counter(g for _, held, w in texts if not held for own in grams(w) for g in own)
    n, v = sum(k for g, k in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    mass = Counter()
    for g, k in c.items():
        if len(g) > 1 and k >= support:
            mass[g[:-1]] += k - discount

    def p(context, w):
        if not context:
            return (c[(w,)] + 0.1) / (n + 0.1 * (v + 1))
        below = p(context[1:], w)
        if c[context] < support:
            return below
        return below * (1 - mass[context] / c[context]) + ((c[*context, w] - discount) / c[context] if c[*context, w] >= support else 0)

    words = [g[0] for g in c if len(g) == 1]
    frequent = [g for g, k in c.most_common(400) if len(g) < 3 and (len(g) == 1 or g[1])]
    for context in frequent[:3] + [g for g in frequent if len(g) == 2][:3]:
        assert sum(p(context, w) for w in words) + p(context, "never seen") == pytest.approx(1)
    for key, held, w in texts:
        yield key, held, len(w), sum(c[(x,)] > 0 for x in w), n, sum(math.log10(p((), x)) for x in w), sum(math.log10(p(own[-1][:-1], x)) for own, x in zip(grams(w), w, strict=True))


@pytest.mark.parametrize("chunk", [1, 2000, scoring.CHUNK])
def test_scores_equal_a_plain_computation(spark, small, chunk):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    rows += [(500, None), (501, ""), (502, "the " * 3000), (502, "the the"), (None, "no id at all"), (503, "É é\x1c")]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id bigint, text string, n_tokens int, chunk int")
    got = sorted(scoring.score(docs, chunk=chunk).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    for g, w in zip(got, sorted(plain_scores(rows), key=lambda r: (str(r[0]), r[2])), strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5]) and g.score == pytest.approx(w[6])


def test_scores_of_a_larger_corpus(spark, small):
    """Over 100,000 tokens in several chunks; every pair and triple that occurs twice has its arc."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(k, "the " * 3000) for k in range(5000, 5020)]
    rows += [(k, f"common{k % 2} rare{k // 2} end") for k in range(6000, 6040)]
    want = sorted(plain_scores(rows), key=lambda r: (str(r[0]), r[2]))
    assert want[0][4] > 100_000
    got = scoring.score(spark.createDataFrame(rows, "doc_id bigint, text string"), chunk=50_000).collect()
    for g, w in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens)), want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5]) and g.score == pytest.approx(w[6])


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = scoring.score(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).head()
    assert row.s > row.b


def test_texts_that_occur_twice_stand_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    texts = docs.dropDuplicates(["text"])
    more = texts.where("doc_id % 10 = 3").withColumn("doc_id", F.col("doc_id") + 100_000)
    rows = scoring.score(texts.unionByName(more)).where("NOT held_out").withColumn("mean", F.col("score") / F.col("n_tokens"))
    twice = rows.withColumn("twice", F.col("doc_id") % 10 == 3).groupBy("twice").agg(F.percentile("mean", 0.5).alias("m")).collect()
    found = {r.twice: r.m for r in twice}
    assert found[True] > found[False] + 0.5


def test_no_training_texts_and_empty(spark):
    key = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    docs = spark.createDataFrame([(key, "a b")], "doc_id bigint, text string")
    row = scoring.score(docs).head()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and row.base_score == pytest.approx(0)
    assert scoring.score(docs.limit(0)).count() == 0


def test_no_exchange_leaves_its_shuffle_files(spark):
    def shuffles():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p.name.split("_")[1] for folder in folders for p in Path(folder.getPath()).glob("*/shuffle_*")}

    before = shuffles()
    docs = spark.createDataFrame([(k, f"one two word{k % 7} three") for k in range(100)], "doc_id bigint, text string")
    out = scoring.score(docs, chunk=500)
    end = time.monotonic() + 10
    while (left := shuffles() - before) and time.monotonic() < end:
        time.sleep(0.2)
    assert not left
    assert out.count() == 100
