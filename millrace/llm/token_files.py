"""Token ids in ORC files: written in document order, read back stripe by stripe.

Documents are range-partitioned and sorted by id as *texts*, then encoded in place, so the shuffle carries
texts once and ids go straight to the files. ORC stores the ids run-length encoded as integers; row indexes and a
Bloom filter on doc_id let a reader that wants a few documents skip stripes and row groups.

Defined cases: a null or empty text is a document of the end id alone; null ids come first; rows that share
a doc_id follow each other, ordered by text; an empty table gives no rows; further columns are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import bounded_batches, column, shared_folder, slices, texts, written

#: Bytes of text to a file at least; the number of files grows with the table.
FILE_BYTES = 64 << 20
SCHEMA = "shard int, position bigint, doc_id bigint, tokens array<int>"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, files: int | None = None) -> None:
    """Encode docs (doc_id, text), append end_id to each, write ORC to `path` in ascending doc_id order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    spec = spark.sparkContext.broadcast(bpe.read_spec(tokenizer))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    files = files or max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = docs.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = placed.select(F.spark_partition_id().alias("shard"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = bpe.encoder(spec.value), 0
        for batch in slices(batches, "text", 4 << 20):
            flat, counts = model.encode(texts(batch))
            flat, counts = np.insert(flat, np.cumsum(counts), end_id).astype(np.int32), counts + 1
            offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            rows = pa.array(np.arange(seen, seen + len(counts), dtype=np.int64))
            seen += len(counts)
            yield pa.RecordBatch.from_arrays([column(batch, "shard"), rows, column(batch, "doc_id"), tokens], ["shard", "position", "doc_id", "tokens"])

    out = placed.mapInArrow(run, SCHEMA)
    out.write.option("compression", "zstd").option("orc.row.index.stride", 2000).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents' token ids; filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def _checksums(tokens: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "tokens")
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4").tobytes())
            bounds = np.asarray(lists.offsets)
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            lengths = pa.array(np.diff(bounds).astype(np.int64))
            yield pa.RecordBatch.from_arrays([column(batch, "shard"), column(batch, "position"), column(batch, "doc_id"), lengths, pa.array(sums, pa.int64())], ["shard", "position", "doc_id", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "shard int, position bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")


def index(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of files that `write` made: offsets are a prefix sum in two
    levels, inside each shard and over the shards' totals (one row a file)."""
    bounded_batches(tokens.sparkSession)
    rows = written(_checksums(tokens))
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    inside = Window.partitionBy("shard").orderBy("position")
    placed = rows.withColumn("inside", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return placed.join(before, "shard").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def stored(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write to a folder that the cluster shares and return the index that reading gives."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens"
    write(docs, path, tokenizer, end_id)
    return index(read(spark, path))
