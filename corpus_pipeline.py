"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

Every stage works on all that its predecessor kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, near_join, quality, repeats
from millrace.llm.common import load, shielded, written
from millrace.llm.queries import tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(docs, load(spark, sf_dir, "labels"))
    hidden, restored = shielded(docs, ["doc_id", "text"])
    return restored(quality.grade(hidden, model).where("keep"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest doc_id."""
    return near_join.keep_one(docs)


#: Bytes of the shortest passage that is cut. Passages of over 50 words are meant: 51 words with their blanks are longer than this
#: unless the words have under 3.4 letters on average. The operator's own query has its 400 bytes by contract.
PASSAGE, GRAM, DIGIT = 224, 56, 112


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that occur more than once; n_chars follows the text."""
    hidden, restored = shielded(docs, ["text", "n_chars"])
    columns = [c for c in hidden.columns if c not in ("text", "n_chars")]
    out = repeats.remove_repeats(hidden, length=PASSAGE, gram=GRAM, digit=DIGIT, columns=columns, with_text=True)
    return restored(out.select(*columns, F.col("kept").alias("text"), F.length("kept").cast("bigint").alias("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights ask for."""
    return mixing.mixture(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of every document."""
    return bpe.round_trip(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("suffix-array dedup", without_repeats),
    ("mixing", mixed),
    ("BPE encoding", encoded),
]
#: Neither the classifier nor the tokenizer can be written in SQL; a test holds the rows of each stage and of run() against plain
#: computations on a small fixture, with the classifier's weights as fitted.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
