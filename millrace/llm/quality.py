"""Quality grades by ordinal regression on hashed text (cumulative logits, proportional odds).

P(grade >= k) = sigmoid(w . x - theta_k): all grades share the weights w of the hashed text and differ only in
their ordered thresholds. x marks which words, word shapes and repetition levels a text has: lower-cased
words by presence, and so the character 2- and 3-grams of words of scripts without spaces and of very long ones; shapes (capitals, letters, digits, other marks in runs) and repetitions by presence at a coarse level of
their share. Grades come from ratings: 0 poor, 1 fair writing that is abusive, 2 good.

The fit uses at most `sample` labelled rows, those of least hash of doc_id, and runs on the driver; the rest
is one pass over the documents. Every word of every text counts.

Defined cases: null and empty texts have no features and get the grade of the thresholds alone; they and all others are kept
if nothing is labelled; labels with null ids or ratings are left out, and of several labels of a document the lowest
grade counts; rows with equal texts get equal grades; further columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, column, slices, texts

DIM = 1 << 18
#: Labelled rows that the fit sees at most.
SAMPLE = 6000
GRADES = 3
#: Least tail probability P(grade = 2) of a text that is kept.
TAIL = 0.1
#: A bucket needs this many texts of the sample to get a weight.
SUPPORT = 3
LEVELS = np.array([0.01, 0.05, 0.15, 0.4, 0.75])
#: Words of more characters than LONG, or with any of scripts that put no spaces between words, also count by their runs of GRAMS characters.
LONG, GRAMS = 40, (2, 3)
_spaceless = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Characters of words that a worker remembers.
HELD = 1 << 24
_edge = re.compile(r"^\W+|\W+$")


def bucket(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) & (DIM - 1)


def shape(word: str) -> str:
    """"AND!!" -> "A!", "Then," -> "Aa,", "x***" -> "a*"."""
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", out)


def grams(word: str) -> np.ndarray:
    """The buckets of a word's runs of GRAMS characters."""
    word = word.lower()
    return np.array([bucket("g:" + x) for x in {word[k : k + n] for n in GRAMS for k in range(len(word) - n + 1)}], np.int32)


class _Words(dict):
    """word -> number; the word's bucket and its shape's number stand under that number."""

    def __init__(self):
        super().__init__()
        self.buckets: list[int] = []
        self.shapes: list[int] = []
        self.names: dict[str, int] = {}
        self.grams: dict[int, np.ndarray] = {}
        self.size = 0

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self.buckets)
        self.buckets.append(bucket("w:" + _edge.sub("", word).lower()))
        self.shapes.append(self.names.setdefault(shape(word), len(self.names)))
        if len(word) > LONG or not word.isascii() and _spaceless.search(word):
            self.grams[number] = grams(word)
        self.size += len(word)
        return number


_seen = _Words()


def _level(share: float) -> int:
    return int(np.searchsorted(LEVELS, share, "right"))


def features(batch: list[str]) -> list[np.ndarray]:
    """The buckets that each text has, sorted and distinct."""
    global _seen
    if len(_seen) > 300_000 or _seen.size > HELD:
        _seen = _Words()
    numbers = [np.fromiter(map(_seen.__getitem__, found), np.int64, len(found)) for found in map(str.split, batch)]
    buckets, shapes = np.array(_seen.buckets, np.int64), np.array(_seen.shapes, np.int64)
    names, long = list(_seen.names), np.zeros(len(buckets), bool)
    long[list(_seen.grams)] = True
    out = []
    for text, own in zip(batch, numbers, strict=True):
        n = len(own)
        if not n:
            out.append(np.empty(0, np.int32))
            continue
        distinct = np.unique(own)
        extra = [f"s:{names[k]}:{_level(count / n)}" for k, count in zip(*np.unique(shapes[own], return_counts=True), strict=True)]
        extra.append(f"again:{_level(float((own[1:] == own[:-1]).mean()) if n > 1 else 0)}")
        extra.append(f"fresh:{int(8 * len(distinct) / n) if n >= 20 else 9}")
        lines = [x for x in text.split("\n") if x.strip()]
        extra.append(f"lines:{_level(1 - len(set(lines)) / len(lines)) if lines else 0}")
        out.append(np.unique(np.concatenate([buckets[distinct], [bucket(x) for x in extra], *[_seen.grams[k] for k in distinct[long[distinct]].tolist()]])).astype(np.int32))
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, found: list[np.ndarray]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, … (text x threshold)."""
        score = np.array([self.weights[x].sum() for x in found])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(found: list[np.ndarray], grades: np.ndarray, *, grades_n: int = GRADES, steps: int = 300, prior: float = 1.2) -> Model:
    """Penalised likelihood of the cumulative logit model by full-batch Adam; deterministic. `prior` is the weights'
    precision, so its pull fades as the sample grows."""
    rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
    cols = np.concatenate(found) if found else np.empty(0, np.int32)
    support = np.bincount(cols, minlength=DIM)
    live = (support >= SUPPORT)[cols]
    rows, cols = rows[live], cols[live]
    ids, cols = np.unique(cols, return_inverse=True)
    n, k = len(grades), grades_n - 1
    # parameters: weights, first threshold, logs of the gaps between thresholds
    p = np.zeros(len(ids) + k)
    m, v = np.zeros_like(p), np.zeros_like(p)

    def cut(q: np.ndarray) -> np.ndarray:
        return q[0] + np.r_[0, np.cumsum(np.exp(q[1:]))]

    for step in range(1, steps + 1):
        score = np.bincount(rows, p[: len(ids)][cols], n)
        theta = cut(p[len(ids) :])
        tail = np.c_[np.ones(n), 1 / (1 + np.exp(np.clip(theta - score[:, None], -60, 60))), np.zeros(n)]
        at = np.arange(n)
        mass = np.maximum(tail[at, grades] - tail[at, grades + 1], 1e-9)
        slope = tail * (1 - tail)
        by_score = (slope[at, grades] - slope[at, grades + 1]) / mass
        by_theta = np.zeros(k)
        for j in range(1, grades_n):
            by_theta[j - 1] = (-slope[grades == j, j] / mass[grades == j]).sum() + (slope[grades == j - 1, j] / mass[grades == j - 1]).sum()
        chain = np.r_[by_theta.sum(), [by_theta[j:].sum() * np.exp(p[len(ids) + j]) for j in range(1, k)]]
        g = np.r_[np.bincount(cols, by_score[rows], len(ids)), chain] / n
        g[: len(ids)] -= prior / n * p[: len(ids)]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(DIM, np.float32)
    weights[ids] = p[: len(ids)]
    return Model(weights, cut(p[len(ids) :]))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    """The model of documents (doc_id, text) rated in labels (doc_id, quality, toxic); None without labels."""
    bounded_batches(docs.sparkSession)
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` narrow rows
    # one text of each rated id, however many rows share it: at most `sample` texts come to the driver as numbers
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rated), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            found = pa.array([x.tolist() for x in features(texts(batch))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), column(batch, "grade"), found], ["doc_id", "grade", "found"])

    table = rows.mapInArrow(run, "doc_id bigint, grade int, found array<int>").toArrow().sort_by("doc_id")
    if not table.num_rows:
        return None
    lists = table["found"].combine_chunks()
    bounds = np.asarray(lists.offsets)
    flat = lists.values.to_numpy(zero_copy_only=False)
    return fit([flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], table["grade"].to_numpy().astype(int))


def grade(docs: DataFrame, model: Model | None, *, tail: float = TAIL) -> DataFrame:
    """docs with expected_grade, p_top (probability of the highest grade) and keep, which replace columns of these names."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.select(*[c for c in docs.columns if c not in ("expected_grade", "p_top", "keep")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            n = batch.num_rows
            tails = shared.value.tails(features(texts(batch))) if shared.value else np.ones((n, GRADES - 1))
            out = [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= tail)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "expected_grade", "p_top", "keep"])

    return docs.mapInArrow(run, f"{schema}, expected_grade double, p_top double, keep boolean")
