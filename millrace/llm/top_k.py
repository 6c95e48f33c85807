"""Exact top-k search by inner product, pruned by segment statistics from coarse to fine.

For vectors cut into segments of length l with means m and deviations s,
|q - x|**2 >= sum l * ((m_q - m_x)**2 + (s_q - s_x)**2), so with |q|**2 and |x|**2 known the inner product is at most
sum l * (m_q * m_x + s_q * s_x). That bound is itself an inner product of short vectors. A block of rows is
bounded with few segments, the pairs that can still enter a query's list with more, and the rest is computed exactly. Every level
is taken for every block; queries and rows without a live pair leave after each.

The query set is a stated share of the rows; it is taken in slabs of bounded size, each sent to all executors while all
rows stream by. Lists start from a bound that a sample of rows gives; every row is then compared.

Defined cases: vectors that are null or hold null or non-finite components, and rows of null vec_id, take no part; rows with equal
vec_ids are different rows, and a query leaves out its own row alone; vectors of different lengths do not
meet; empty vectors score 0 with one another; an empty table gives no rows; further columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, column, written

K, EVERY, SCALE = 20, 20, 64
#: Queries in a slab, rows in a block, rows that give the first bounds.
SLAB, BLOCK, SAMPLE = 4096, 1024, 4096
#: Segments by level.
LEVELS = (16, 32, 48)
#: Share of live pairs up to which they are computed one by one, else by a product of the rows and queries that have any.
SPARSE = 0.02


def summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Segment means and deviations, scaled so that their inner product bounds that of the vectors."""
    parts = np.array_split(x, min(segments, max(1, x.shape[1])), axis=1)
    means = np.stack([p.mean(axis=1) if p.shape[1] else np.zeros(len(x)) for p in parts], axis=1)
    roots = np.sqrt([p.shape[1] for p in parts])
    spread = np.stack([np.sqrt(np.maximum(0, ((p - m[:, None]) ** 2).sum(axis=1))) for p, m in zip(parts, means.T, strict=True)], axis=1)
    return np.concatenate([means * roots, spread], axis=1)


def _numbers(lists: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: positions and the vectors with each component turned into floor(scale * x)."""
    sizes = np.asarray(pa.compute.list_value_length(lists))
    out = {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[size] = at, np.floor(scale * flat).reshape(len(at), size)
    return out


def _exact(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether sums of products stay whole numbers in double precision."""
    return not q.size or not x.size or float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0**53


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if _exact(q, x):
        return q @ x.T
    whole = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return whole.astype(np.int64)  # raises where a score leaves 64 bits


def top_k(vectors: DataFrame, *, k: int = K, every: int = EVERY, scale: int = SCALE, slab: int = SLAB) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) whose vec_id is divisible by
    `every` its k best other rows, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = written(rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("bigint").alias("vec_id"), "embedding"))
    queries = rows.where(F.col("vec_id") % every == 0)
    slabs = -(-queries.count() // slab)
    sample = rows.orderBy(F.xxhash64("rid")).limit(SAMPLE).toArrow()  # SAMPLE rows
    known = _numbers(sample["embedding"].combine_chunks(), scale)
    sample_rid = np.asarray(sample["rid"])

    def search(part: pa.Table) -> DataFrame:
        """part: one slab of queries, at most about `slab` rows."""
        ids = np.asarray(part["rid"])
        by_size = {}
        for size, (at, q) in _numbers(part["embedding"].combine_chunks(), scale).items():
            floor = np.full(len(at), -np.inf)
            if size in known and len(known[size][0]) > k:
                own, x = known[size]
                for low in range(0, len(at), 512):
                    score = _product(q[low : low + 512], x).astype(np.float64)
                    score[ids[at[low : low + 512], None] == sample_rid[own][None, :]] = -np.inf
                    floor[low : low + 512] = np.partition(score, -k, axis=1)[:, -k]
            by_size[size] = ids[at], q, [summary(q, s) for s in LEVELS], floor
        shared = spark.sparkContext.broadcast(by_size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[np.ndarray]] = {}
            floors = {size: x[3].copy() for size, x in shared.value.items()}
            for batch in batches:
                rids, names = column(batch, "rid").to_numpy(), column(batch, "vec_id").to_numpy()
                for size, (at, x) in _numbers(column(batch, "embedding"), scale).items():
                    if size not in shared.value:
                        continue
                    for low in range(0, len(at), BLOCK):
                        some = at[low : low + BLOCK]
                        _step(shared.value[size], floors[size], best, size, x[low : low + BLOCK], rids[some], names[some], k)
            for size, (q, score, name, _) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[size][0][q]), pa.array(name), pa.array(score.astype(np.int64))], ["query", "vec_id", "score"])

        return rows.mapInArrow(run, "query bigint, vec_id bigint, score bigint")

    found = None
    for number in range(slabs):
        part = search(queries.where(F.pmod(F.xxhash64("rid"), F.lit(slabs)) == number).toArrow())
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = queries.select(F.col("rid").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")


def _step(slab: tuple, floor: np.ndarray, best: dict, size: int, x: np.ndarray, rids: np.ndarray, names: np.ndarray, k: int) -> None:
    """Bring the pairs of a block of rows that can enter into the lists of a slab's queries."""
    ids, q, levels, _ = slab
    exact = _exact(q, x)
    # bounds are computed in floating point: leave room for their rounding
    room = floor - 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0))) - 1e-6
    live = np.arange(len(q)), np.arange(len(x))
    able = np.ones((len(q), len(x)), bool)
    for level, segments in enumerate(LEVELS if exact else ()):
        mine = summary(x[live[1]], segments)
        able &= levels[level][live[0]] @ mine.T >= room[live[0], None]
        kept = able.any(axis=1), able.any(axis=0)
        able = able[kept[0]][:, kept[1]]
        live = live[0][kept[0]], live[1][kept[1]]
    if exact and able.size and able.mean() <= SPARSE:
        a, b = np.nonzero(able)
        score = np.einsum("ij,ij->i", q[live[0][a]], x[live[1][b]])
        keep = score >= floor[live[0][a]]
    else:
        score = _product(q[live[0]], x[live[1]])
        a, b = np.nonzero(able & (score >= floor[live[0], None]))
        score = score[a, b]
        keep = np.ones(len(a), bool)
    a, b, score = live[0][a[keep]], live[1][b[keep]], score[keep]
    other = ids[a] != rids[b]
    a, b, score = a[other], b[other], score[other].astype(np.int64)
    own = [a, score, names[b], rids[b]]
    if size in best:
        own = [np.concatenate(z) for z in zip(best[size], own, strict=True)]
    order = np.lexsort((own[2], -own[1], own[0]))
    own = [z[order] for z in own]
    starts = np.flatnonzero(np.r_[True, own[0][1:] != own[0][:-1]]) if len(own[0]) else np.empty(0, np.int64)
    spans = np.diff(np.r_[starts, len(own[0])])
    place = np.arange(len(own[0])) - np.repeat(starts, spans)
    own = [z[place < k] for z in own]
    best[size] = own
    last = np.flatnonzero(place[place < k] == k - 1)
    floor[own[0][last]] = np.maximum(floor[own[0][last]], own[1][last])
