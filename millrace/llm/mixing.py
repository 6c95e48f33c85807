"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Each source's documents are shuffled by a hash. A copy of a document gets its virtual finish time: the
source's tokens up to and with it, divided by the source's target. All copies are ordered by that time and cut
at the total budget, so at any cut the sources stand near their targets.

No window runs over a whole source or over all documents: running sums are made in two levels, inside
hash cells of a source and over the cells' totals, and likewise inside narrow intervals of finish time and over
the intervals' totals. A source with a third of all rows is spread over all its cells. Intervals are made only up to the power
of two of finish time at which the budget is met, so that a source of very small target does not open millions of them.

Defined cases: null text has size 0; the null source is a source of its own, last in order; null doc_ids
and repeated rows are mixed like others (rows equal in every way share the order by text); an empty table gives
no rows; further columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, numbered, shielded, written

#: Copies of one document at most, so no source gets more than this many times its size.
COPIES = 3
#: Hash cells of a source and intervals in a unit of finish time.
CELLS, TICKS = 4096, 4096


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """60 bits of an md5; the same on every run and in any engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def targets(sized: DataFrame, weights: list[float] = (1, 2, 3), copies: int = COPIES) -> DataFrame:
    """source, rank, source_size, target of a table (source, size): all tokens shared by weight; shares above
    `copies` times a source's size stop there and the excess is shared again, until none is above.

    With sources sorted by (copies * size / weight) the ones that stop come first, so one running sum
    finds the level at which the rest stand. One row for each source.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    rows = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    rows = rows.withColumn("rank", F.row_number().over(by_code)).withColumn("weight", weight)
    rows = rows.withColumn("cap", (copies * F.col("source_size")).cast("double"))
    rows = rows.withColumn("fill", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    upto = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("fill", "rank").rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every).cast("double")
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(onward))
    # a source stops if the level that would hold with it among the rest is above its own
    rows = rows.withColumn("stops", F.col("fill") < F.col("level"))
    level = F.min(F.when(~F.col("stops"), F.struct("fill", "rank", "level"))).over(every)["level"]
    target = F.when(F.col("stops"), F.col("cap")).otherwise(level * F.col("weight"))
    return rows.select("source", "rank", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, weights: list[float] = (1, 2, 3), copies: int = COPIES, seed: int = 17, number: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken and n_copies of each document of docs (doc_id, source, text),
    and the column `number` of docs, if one is named."""
    number = [number] if number else []
    key = shuffle_key(F.col("doc_id"), seed)
    sized = docs.select(*number, "doc_id", "source", F.xxhash64("text").alias("text_key"), count_words(F.col("text")).alias("size"), key.alias("key"))
    sized = written(sized.withColumn("cell", (F.col("key") % CELLS).cast("int")))
    goal = written(targets(sized, weights, copies))

    in_cell = Window.partitionBy("rank", "cell").orderBy("key", "doc_id", "text_key", "size")
    placed = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).drop("source")
    cells = placed.groupBy("rank", "cell").agg(F.sum("size").alias("cell_size"))
    upto = Window.partitionBy("rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("rank", "cell", F.coalesce(F.sum("cell_size").over(upto), F.lit(0)).alias("before"))
    placed = placed.withColumn("inside", F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, 0))).withColumn("row", F.row_number().over(in_cell))
    placed = written(placed.join(cells, ["rank", "cell"]).withColumn("through", F.col("before") + F.col("inside")))

    queue = placed.where("size > 0 AND target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    queue = queue.withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("through")).cast("double") / F.col("target"))
    queue = queue.select("rank", "cell", "row", "copy", "size", "finish", F.floor(F.col("finish") * TICKS).alias("tick"))
    budget = goal.agg(F.sum("source_size").alias("budget"))
    # a row for each power of two of finish time: doubles have some two thousand
    powers = queue.groupBy(F.ceil(F.log2("finish")).alias("power")).agg(F.sum("size").alias("power_size"))
    powers = powers.withColumn("power_through", F.sum("power_size").over(Window.orderBy("power"))).crossJoin(budget)
    last = powers.agg(F.coalesce(F.min(F.when(F.col("power_through") >= F.col("budget"), F.col("power"))), F.max("power")).alias("last"))
    queue = queue.crossJoin(F.broadcast(written(last))).where(F.ceil(F.log2("finish")) <= F.col("last")).drop("last")  # last is one row
    ticks = queue.groupBy("tick").agg(F.sum("size").alias("tick_size"))
    # one row for each interval that has copies
    ticks = ticks.withColumn("tick_before", F.coalesce(F.sum("tick_size").over(Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ticks = written(ticks.crossJoin(budget))  # budget is one row
    whole = queue.join(ticks.where("tick_before + tick_size <= budget"), "tick", "left_semi")
    cut = queue.join(ticks.where("tick_before <= budget AND tick_before + tick_size > budget"), "tick")
    in_tick = Window.partitionBy("tick").orderBy("finish", "rank", "cell", "row", "copy").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("total", F.col("tick_before") + F.sum("size").over(in_tick)).where("total <= budget")
    names = ["rank", "cell", "row"]
    taken = whole.select(*names).unionAll(cut.select(*names)).groupBy(*names).agg(F.count("*").cast("int").alias("n_copies"))
    out = placed.join(taken, names, "left").withColumn("n_copies", F.coalesce("n_copies", F.lit(0)))
    return out.select(*number, "doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies")


def mixture(docs: DataFrame, *, weights: list[float] = (1, 2, 3), copies: int = COPIES, seed: int = 17) -> DataFrame:
    """The mixed documents: rows of docs (doc_id, source, text and others), each as often as it is taken."""
    hidden, restored = shielded(docs, ["doc_id", "source", "text"])
    rows = numbered(hidden, hidden.columns)
    taken = mix(rows, weights=weights, copies=copies, seed=seed, number="rid").where("n_copies > 0").select("rid", "n_copies")
    out = rows.join(taken, "rid").withColumn("rid", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    return restored(out)
