"""Near copies among vectors by counting collisions of one-dimensional projections.

Two vectors of cosine c or more, scaled to length one, are at most d = sqrt(2 - 2c) apart, so their projections on a
random direction differ by a normal variable of deviation d. Each vector opens a window of half-width `window` around
its own projection on each of `projections` directions; a pair is verified if it falls into each other's window
often enough: the least count is the one that a pair at distance d reaches with probability `recall`.

Windows over a whole label would hold a fixed share of it, so projections are first sorted into cells: in each of several
tables a key of a few projections, rounded at a random offset, names a cell, and windows are opened inside cells alone.
The number of tables follows from the same calibration; the number of projections in a key grows with the
logarithm of the label's size, so a cell's expected size does not. A pair that shares cells of several tables is taken
in the first of them. Cells that are larger than a block are compared block by block, in separate tasks.

Equal vectors of a label are one class, which takes part once: a link counts for all members of both classes, and the members
link with one another. So copies, however many, make no pairs and never stand in rows of one cell.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows of null
label; vectors of different lengths do not link; rows with equal vec_ids stay rows of their own; an
empty table gives no rows; further columns are left behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, column, components, written

COSINE, RECALL = 0.98, 0.995
#: Collision counting: directions, half-width of a window in multiples of d.
DIRECTIONS, WINDOW = 24, 1.25
#: Cells: width in multiples of d; vectors that a cell should hold; vectors in a block.
CELL, LOAD, BLOCK = 4.0, 32, 1024
SEED = 23


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def least_count(directions: int, half: float, recall: float) -> int:
    """The largest count that a pair at distance d reaches in `directions` windows with probability `recall`."""
    p = 2 * _phi(half) - 1
    tail, k = 1.0, 0
    while True:
        tail -= math.comb(directions, k) * p**k * (1 - p) ** (directions - k)
        if tail < recall:
            return k
        k += 1


def same_cell(width: float) -> float:
    """Probability that two values a standard normal apart are rounded alike at a random offset."""
    return 2 * _phi(width) - 1 - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Projections in a key and tables for a label of n vectors."""
    d = math.sqrt(2 - 2 * cosine)
    far = same_cell(CELL * d / math.sqrt(2))
    keys = max(1, math.ceil(math.log(max(n / LOAD, 1.0001)) / -math.log(far)))
    hit = same_cell(CELL) ** keys
    return keys, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def _directions(n: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((n, dim))


def _units(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as rows, scaled to length one in double precision; and as they are, unless
    their squares could leave the range of doubles."""
    x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(lists), -1)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = np.where((top > 1e100) | (top < 1e-100), x / top, x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), x


def _keys(part: DataFrame, keys: int, tables: int, cosine: float) -> DataFrame:
    """Each vector with its cell in every table."""
    d = math.sqrt(2 - 2 * cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "vector")
            sizes = np.asarray(pa.compute.list_value_length(lists))
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                unit, _ = _units(lists.take(pa.array(rows)))
                n = len(rows)
                along = unit @ _directions(tables * keys, size, SEED + 1).T
                offset = np.random.default_rng(SEED + 2).random(tables * keys)
                cells = np.floor(along / (CELL * d) + offset).astype(np.int64).reshape(n, tables, keys)
                mixed = np.zeros((n, tables), np.int64)
                for k in range(keys):
                    mixed = mixed * np.int64(1_000_003) + cells[:, :, k]
                mixed = mixed * np.int64(8191) + size
                out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * tables), pa.array(mixed.ravel()))
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([column(own, "rid"), column(own, "label"), column(own, "copies"), column(own, "vector"), out], ["rid", "label", "copies", "vector", "cells"])

    return part.mapInArrow(run, f"rid bigint, label bigint, copies bigint, vector {part.schema['vector'].dataType.simpleString()}, cells array<bigint>")


def _collide(p: np.ndarray, half: float, least: int, split: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) that fall into each other's windows on `least` directions; with split > 0 only
    pairs of one row before and one row from there on."""
    n = len(p)
    counts = np.zeros((n, n), np.uint8)
    for k in range(p.shape[1]):
        order = np.argsort(p[:, k], kind="stable")
        line = p[order, k]
        stop = np.searchsorted(line, line + half, "right")
        spans = stop - np.arange(1, n + 1)
        i = np.repeat(np.arange(n), spans)
        j = np.arange(len(i)) - np.repeat(np.cumsum(spans) - spans, spans) + i + 1
        a, b = order[i], order[j]
        counts[np.minimum(a, b), np.maximum(a, b)] += 1
    if split:
        counts[:split, :split] = 0
        counts[split:, split:] = 0
    return np.nonzero(counts >= least)


def _links(groups: DataFrame, cosine: float, recall: float) -> DataFrame:
    """For each block pair of a cell: how many links each vector of a class has there, and a forest that joins the classes."""
    d = math.sqrt(2 - 2 * cosine)
    least = max(1, least_count(DIRECTIONS, WINDOW, recall))

    def judge(rid: np.ndarray, copies: np.ndarray, table: int, block: np.ndarray, left: int, right: int, cells: np.ndarray, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(block != left, kind="stable")
        rid, copies, cells = rid[order], copies[order], cells[order]
        unit, raw = _units(vectors.take(pa.array(order)))
        split = int((block == left).sum()) if left != right else 0
        a, b = _collide(unit @ _directions(DIRECTIONS, unit.shape[1], SEED).T, WINDOW * d, least, split)
        keep = ~(cells[a, :table] == cells[b, :table]).any(axis=1) if table else np.ones(len(a), bool)
        a, b = a[keep], b[keep]
        hit = np.zeros(len(a), bool)
        for at in range(0, len(a), 65536):
            x, y = raw[a[at : at + 65536]], raw[b[at : at + 65536]]
            dot = (x * y).sum(axis=1)
            hit[at : at + 65536] = dot / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)) >= cosine
        a, b = a[hit], b[hit]
        # sums of whole numbers below 2**53 are exact
        n = np.bincount(np.r_[a, b], copies[np.r_[b, a]], len(rid)).astype(np.int64)
        root = np.arange(len(rid))
        while len(a):
            # labels flow along links until nothing changes
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return rid[n > 0], n[n > 0], rid[root[n > 0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups_of(table: pa.Table, last: bool) -> tuple[list[tuple[int, int]], int]:
            marks = np.stack([np.asarray(table[c]) for c in ("label", "t", "cell", "left", "right")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            cuts = np.r_[0, cuts, table.num_rows].tolist()
            pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
            return (pairs, table.num_rows) if last else (pairs[:-1], pairs[-1][0])

        def out(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            pairs, done = groups_of(table, last)
            rids, ns, roots = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            rid, copies, cells, vectors = np.asarray(table["rid"]), np.asarray(table["copies"]), table["cells"].combine_chunks(), table["vector"].combine_chunks()
            tables = len(cells[0]) if len(cells) else 0
            grid = np.asarray(cells.flatten()).reshape(len(cells), tables)
            head = {c: np.asarray(table[c]) for c in ("t", "block", "left", "right")}
            for a, b in pairs:
                if b - a > 1:
                    x = judge(rid[a:b], copies[a:b], int(head["t"][a]), head["block"][a:b], int(head["left"][a]), int(head["right"][a]), grid[a:b], vectors.slice(a, b - a))
                    for into, part in zip((rids, ns, roots), x, strict=True):
                        into.append(part)
            arrays = [pa.array(np.concatenate(x).astype(np.int64)) for x in (rids, ns, roots)]
            return pa.RecordBatch.from_arrays(arrays, ["rid", "n", "root"]), table.slice(done)

        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, part]) if held is not None and held.num_rows else part
            if held.num_rows >= 4 * BLOCK:
                found, held = out(held, False)
                yield found
        if held is not None and held.num_rows:
            yield out(held, True)[0]

    return groups.mapInArrow(run, "rid bigint, n bigint, root bigint")


def near_vectors(vectors: DataFrame, *, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = written(vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.col("embedding").alias("vector"), F.col("label").cast("bigint").alias("label")))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    classes = written(sound.groupBy("label", "vector").agg(F.min("rid").alias("rid"), F.count("*").alias("copies")))
    sizes = classes.groupBy("label").count()
    largest = sizes.agg(F.max("count")).head()[0] or 1
    keys, tables = plan(largest, cosine, recall)
    keyed = written(_keys(classes.select("rid", "label", "copies", "vector"), keys, tables, cosine))

    places = keyed.select("rid", "label", F.posexplode("cells").alias("t", "cell"))
    crowds = places.groupBy("label", "t", "cell").agg(F.count("*").alias("n")).where("n > 1")
    blocks = written(crowds.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    full = keyed.select("rid", "label", "copies", "vector", "cells", F.posexplode("cells").alias("t", "cell")).join(blocks, ["label", "t", "cell"])
    full = full.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = full.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    groups = full.select("label", "t", "cell", "left", "right", "block", "rid", "copies", "cells", "vector").repartition("label", "t", "cell", "left", "right")
    found = written(_links(groups.sortWithinPartitions("label", "t", "cell", "left", "right"), cosine, recall))

    joined = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rid").agg(F.sum("n").alias("n_links"))
    # one row for each class, written, so that the join with all rows is one of two shuffles and a hot class can be split
    known = classes.join(counts, "rid", "left").join(joined.withColumnRenamed("node", "rid"), "rid", "left")
    known = written(known.select("label", "vector", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "rid").alias("comp")))
    out = rows.join(known, ["label", "vector"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("comp", "rid").alias("comp"))
    out = written(out)
    least = written(out.groupBy("comp").agg(F.min("vec_id").alias("component_id")))
    out = out.join(least, "comp")
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
