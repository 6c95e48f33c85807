"""Tables that cut a plan's lineage, and components of a graph built with them."""

from __future__ import annotations

import atexit
import gc
import math
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MillraceError

_made: dict[str, SparkSession] = {}
_named: dict[str, SparkSession] = {}
#: Bytes that a bucket should hold, by the planner's estimate of a table's size.
BUCKET_BYTES = 256 << 20
#: Spark's estimate for what it cannot measure is larger than this.
UNKNOWN_BYTES = 1 << 60
#: Bytes and rows that one Arrow batch to or from a Python worker holds; keeps workers small when texts are long or many.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096
#: Rounds of `swept`, and in each the longest wait for py4j to tell the JVM what Python has let go.
SWEEPS, SWEEP_SECONDS = 6, 3


def _delete(root: str) -> None:
    spark = _made.pop(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _drop(name: str) -> None:
    _named.pop(name).sql(f"DROP TABLE IF EXISTS {name}")


def _clean_up() -> None:
    for names, remove in ((_named, _drop), (_made, _delete)):
        for name in list(names):
            try:
                remove(name)
            except Exception:  # noqa: BLE001  the session has ended: nothing can be reached any more
                break


atexit.register(_clean_up)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the cluster's spark.checkpoint.dir, deleted when the driver ends.

    Only on a single machine a temporary folder stands in for a missing setting; executors elsewhere would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "") or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise MillraceError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.gettempdir()
    root = f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"
    _made[root] = spark
    return root


def written(df: DataFrame, *, partitions_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: the lineage ends there,
    and neither a lost executor nor a retried task can change what later steps see."""
    spark = df.sparkSession
    root = shared_folder(spark)
    writer = df.write.option("compression", "zstd")
    if partitions_by:
        writer = writer.partitionBy(*partitions_by)
    writer.parquet(root)
    out = spark.read.schema(df.schema).parquet(root)
    out._millrace = (root, None)
    return out


def bucket_count(df: DataFrame) -> int:
    """Buckets for df: the session's shuffle partitions, or more where these would hold too much each.

    A bucket is read by one task, and adaptive execution cannot split it, so the number follows the size of the tables that
    df reads; frames without a known size, as of local rows, count for nothing.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    size = sum(n for n in sizes if n < UNKNOWN_BYTES)
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES)))


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write df in buckets of a key and read it again: joins on the key shuffle the other side alone."""
    spark = df.sparkSession
    name, root = f"millrace_{uuid.uuid4().hex}", shared_folder(spark)
    _named[name] = spark
    writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{root}/rows")
    writer.bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    out._millrace = (root, name)
    return out


def freed(*frames: DataFrame) -> None:
    """Delete tables made by `written` or `bucketed`. No plan that has still to run may read them."""
    for frame in frames:
        root, name = getattr(frame, "_millrace", (None, None))
        if name in _named:
            _drop(name)
        if root in _made:
            _delete(root)


def swept(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of plans that nothing refers to any more, as those whose result `written` has stored.

    Its cleaner does so when the driver's JVM collects garbage, which otherwise may be long after the disks are full. The JVM keeps
    what Python refers to, be it from a cycle or from the list that py4j sends off now and then, so both go first; and
    one collection can leave what only the next one finds, so it is repeated until no shuffle is left, or some rounds later,
    as when plans that go on hold theirs.
    """
    leaving = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    shuffles = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    for _ in range(SWEEPS):
        gc.collect()
        end = time.monotonic() + SWEEP_SECONDS
        while leaving and time.monotonic() < end:
            time.sleep(0.05)
        spark._jvm.System.gc()
        time.sleep(0.2)  # the cleaner works beside
        if not shuffles.size():
            break


def bounded_batches(spark: SparkSession) -> None:
    """Bound what an Arrow batch holds, unless the session's owner has chosen bounds."""
    for key, value in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{key}"
        current = spark.conf.get(name, None)
        if current in (None, "10000", "-1", str(2**31 - 1), str(2**63 - 1)):
            spark.conf.set(name, str(value))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that `column` holds about `limit` bytes in each; a longer value stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        array = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(array), 0).to_numpy(zero_copy_only=False))
        done, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > limit:
                yield batch.slice(done, i - done)
                done, total = i, 0
            total += n
        yield batch.slice(done)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it has fewer partitions than the cluster has cores, as small files do; else df itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) for every node, component being the
    smallest node that can be reached.

    Alternates large-star and small-star steps until the edges no longer change; every step is a partial
    aggregation and a join, and is written to the shared folder. Minima are written before they are joined, so both sides of
    a join are plain shuffles and a node with very many edges can be split. Duplicates of an edge do no harm.
    """
    star = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).cast("string"), F.lit(""))
    seen = None
    while True:
        both = star.unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        freed(star, least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        star = written(small.where("u <> v").distinct())
        freed(large, least)
        now = star.agg(F.count("*"), mark).head()
        if now == seen:
            break
        seen = now
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
