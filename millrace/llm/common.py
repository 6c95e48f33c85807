"""What the training-data operators share: written tables, bounded Arrow batches, words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import BATCH_BYTES, bounded_batches, bucket_count, bucketed, components, freed, shared_folder, slices, spread, swept, written

__all__ = ["BATCH_BYTES", "bounded_batches", "bucket_count", "bucketed", "column", "components", "count_words", "freed", "load", "mix64", "numbered", "raw_texts", "shared_folder", "shielded", "slices", "spread", "swept", "texts", "words_of", "written"]

#: A word is a run without ASCII white space; lower-casing touches A-Z only.
WORD = r"[^\x20\x09-\x0D]+"


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a text in UTF-8; bytes.lower and bytes.split know ASCII alone, as the definition does."""
    return text.lower().split()


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8; null is the empty text."""
    return [x or b"" for x in column(batch, name).cast(pa.binary()).to_pylist()]


def count_words(text: Column) -> Column:
    """Words of a text column as a bigint, null counting as none (JVM side)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table; a small one is spread over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df if table == "labels" else spread(df)


def shielded(docs: DataFrame, needed: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the needed ones under names that no operator uses, and what names them back."""
    names = {c: c if c in needed else f"__kept_{k}" for k, c in enumerate(docs.columns)}
    hidden = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return hidden, lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


def numbered(docs: DataFrame, columns: list[str], *, buckets: int | None = None) -> DataFrame:
    """docs with a row number `rid`, written once and bucketed by it: what later joins on rid is shuffled,
    the texts are not. Rows stay apart even if their ids are null or repeat."""
    buckets = buckets or bucket_count(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), *columns)
    return bucketed(rows.repartition(buckets, "rid"), "rid", buckets)
