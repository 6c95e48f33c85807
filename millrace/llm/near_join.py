"""Join of texts whose word-shingle sets have a Jaccard similarity of at least a threshold; exact.

Texts with equal shingle sets become one class, kept by its first row. Two sets A, B of similarity t or more
share, under any global order of the shingles, one of the first ``n - ceil(t * n) + 1`` of each (the
prefix). Several orders are used: frequent shingles last and the rest by a different hash in each. What
counts as frequent comes from a counting sketch of fixed size over all shingles; it moves shingles inside
the orders and cannot lose a pair.

1. Prefix shingles under the first order go to one row each; those in one class alone are left out.
2. In every group of classes that share a prefix shingle the first is the pivot, and the others are candidates with it if they
   have met often enough to be similar. A candidate must meet its pivot often enough under each of the further orders
   too, whatever order found it; only what passes all of them is verified on the whole sets. Links found so form components.
3. Shingles whose classes still lie in different components are taken again. The classes that share shingles with a pivot
   are its cluster; in clusters, block by block, pairs across components that have met often enough are candidates,
   those that have not under a further order leave, and the rest is verified. A group of copies costs a comparison each,
   pairs never become rows, and no link that could join two components is left out: the components are those of all links.

`near_join` gives components alone; `near_links` gives every link, by step 3 without the components.

Verification sends a text to the pairs of its pivot; pivots with many partners are split by salt.

Defined cases: a text without words (or null) has an empty set and links with nothing; fewer words than a
shingle give one shingle of all words; rows with null or equal doc_ids stay rows of their own, and
component_id is the smallest doc_id that is not null; an empty table gives no rows; further columns are left behind.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, column, components, mix64, numbered, raw_texts, shielded, slices, words_of, written

WORDS, PERCENT, ORDERS = 5, 80, 3
#: Sets in a block of a cluster.
BLOCK = 512
#: Cells of the frequency sketch (one byte each in a task; one bit each once summed) and its slices.
CELLS, SLICES = 1 << 24, 64
#: Partners of a pivot that one salt holds.
SALT = 128
BASE = np.uint64(0x9E3779B97F4A7C15)
SEEDS = [np.uint64(k * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF) for k in range(16)]


class _Words(dict):
    """word -> number; hashes holds the words' hashes by number."""

    def __init__(self):
        super().__init__()
        self.new: list[int] = []
        self.hashes = np.empty(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(xxhash.xxh3_64_intdigest(word))
        return number


_words = _Words()


def shingle_sets(batch: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    global _words
    if len(_words) > 400_000:
        _words = _Words()
    get = _words.__getitem__
    found = [words_of(text) for text in batch]
    lengths = [len(x) for x in found]
    numbers = np.fromiter(map(get, itertools.chain.from_iterable(found)), np.int64, sum(lengths))
    if _words.new:
        _words.hashes = np.r_[_words.hashes, np.array(_words.new, np.uint64)]
        _words.new = []
    h = _words.hashes[numbers]
    total = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        total = total * BASE + h[k : k + len(total)]
    total = mix64(total + np.uint64(words))
    out, start = [], 0
    for n in lengths:
        if n >= words:
            own = np.sort(total[start : start + n - words + 1])
            own = own[np.r_[True, own[1:] != own[:-1]]]
        elif n:
            own = np.zeros(1, np.uint64)
            for k in range(start, start + n):
                own = own * BASE + h[k : k + 1]
            own = mix64(own + np.uint64(n))
        else:
            own = np.empty(0, np.uint64)
        out.append(own)
        start += n
    return out


def prefix(tokens: np.ndarray, order: int, hot: np.ndarray | None, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The tokens of a set that come first under one of the global orders, as many as the threshold needs,
    and the place of the last of them in the order."""
    n = len(tokens)
    if not n:
        return tokens, 0
    length = n - -(-percent * n // 100) + 1
    place = mix64(tokens ^ SEEDS[order]) >> np.uint64(2)
    if hot is not None:
        cell = (tokens & np.uint64(CELLS - 1)).astype(np.int64)
        place |= ((hot[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(62)
    at = np.argpartition(place, length - 1)[:length] if length < n else np.arange(n)
    return tokens[at], int(place[at].max())


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return bool(common) and 100 * common >= percent * (len(a) + len(b) - common)


def _summaries(rows: DataFrame) -> DataFrame:
    """kind 0: rid, n_shingles and a key equal for equal sets; kind 1: a task's slices of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(CELLS, np.uint8)
        names = ["kind", "rid", "n", "key", "blob"]
        for batch in slices(batches, "text"):
            sets = shingle_sets(raw_texts(batch))
            keys = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            if sets:
                cells, counts = np.unique(np.concatenate(sets) & np.uint64(CELLS - 1), return_counts=True)
                cells = cells.astype(np.int64)
                sketch[cells] = np.minimum(sketch[cells] + np.minimum(counts, 255), 255)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), column(batch, "rid"), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.nulls(n, pa.binary())], names)
        if sketch.any():
            blobs = [zlib.compress(x.tobytes(), 1) for x in np.split(sketch, SLICES)]
            nothing = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(SLICES, np.int32)), pa.array(np.arange(SLICES)), nothing, pa.nulls(SLICES, pa.binary()), pa.array(blobs, pa.binary())], names)

    return rows.select("rid", "text").mapInArrow(run, "kind int, rid bigint, n bigint, key binary, blob binary")


def _frequent(found: DataFrame) -> bytes:
    """One bit for each cell: it holds clearly more than the mean. CELLS / 8 bytes, whatever the table's size."""
    width = CELLS // SLICES
    limit = 16 + 3 * (found.agg(F.sum("n")).head()[0] or 0) / CELLS

    def add(left: pd.DataFrame) -> np.ndarray:
        total = np.zeros(width, np.uint32)
        for blob in left["blob"]:
            total += np.frombuffer(zlib.decompress(blob), np.uint8 if left.columns[-1] == "salt" else np.uint32)
        return total

    def part(left: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"rid": [left["rid"].iloc[0]], "blob": [zlib.compress(add(left).astype("<u4").tobytes(), 1)]})

    def bits(left: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"rid": [left["rid"].iloc[0]], "blob": [np.packbits(add(left) >= limit, bitorder="little").tobytes()]})

    # two rounds of about as many sketches, so that no task opens the slices of all tasks
    salts = max(8, math.isqrt(found.where("kind = 1 AND rid = 0").count()))
    sketches = found.where("kind = 1").select("rid", "blob", F.pmod(F.xxhash64("blob"), F.lit(salts)).alias("salt"))
    whole = sketches.groupBy("rid", "salt").applyInPandas(part, "rid bigint, blob binary").groupBy("rid").applyInPandas(bits, "rid bigint, blob binary")
    slices_of = dict(whole.collect())
    return b"".join(bytes(slices_of.get(k, bytes(width // 8))) for k in range(SLICES))


def _prefixes(rows: DataFrame, order: int, hot, percent: int) -> DataFrame:
    """token, rid, n, last for the prefix of each text under one order; last is the prefix's end in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(hot.value, np.uint8)
        for batch in slices(batches, "text", 2 << 20):
            sets = shingle_sets(raw_texts(batch))
            found = [prefix(x, order, bits, percent) for x in sets]
            lengths = np.fromiter((len(x) for x, _ in found), np.int64, len(found))
            rid = np.repeat(column(batch, "rid").to_numpy(), lengths)
            n = np.repeat(np.fromiter(map(len, sets), np.int32, len(sets)), lengths)
            last = np.repeat(np.fromiter((x for _, x in found), np.int64, len(found)), lengths)
            tokens = np.concatenate([x for x, _ in found])
            cell = (tokens & np.uint64(CELLS - 1)).astype(np.int64)
            often = ((bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(rid), pa.array(n), pa.array(last), pa.array(often)], ["token", "rid", "n", "last", "often"])

    return rows.select("rid", "text").mapInArrow(run, "token bigint, rid bigint, n int, last bigint, often boolean")


def _shared(prefixes: DataFrame) -> DataFrame:
    """The prefix rows whose token occurs in two sets at least.

    Frequent tokens are taken as they come: the sketch has counted them, and none of them may gather in a task.
    """
    own = Window.partitionBy("token", F.when(F.col("often"), F.col("rid")))
    rows = prefixes.withColumns({"low": F.min("rid").over(own), "high": F.max("rid").over(own)})
    return written(rows.where("low <> high OR often").drop("low", "high", "often"))


def _possible(percent: int) -> Column:
    """Whether sets a and b with `met` common prefix tokens can be similar. Of two prefixes, the one that ends first in
    the order holds no common token that the other lacks, so further ones lie in the rest of its set."""

    def rest(n: Column) -> Column:
        return F.ceil(percent * n / 100) - 1

    a, b = F.col("na"), F.col("nb")
    need = F.ceil(percent * (a + b) / (100 + percent))
    sizes = (100 * a >= percent * b) & (100 * b >= percent * a)
    return sizes & (F.col("met") + F.when(F.col("la") <= F.col("lb"), rest(a)).otherwise(rest(b)) >= need)


def meets(a: np.ndarray, b: np.ndarray, heads: list[tuple], others: list[tuple], percent: int = PERCENT) -> bool:
    """Whether sets a and b share enough prefix tokens under every order to be similar; heads: prefixes and their ends, by order."""
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    for (x, end), (y, stop) in zip(heads, others, strict=True):
        met = len(np.intersect1d(x, y, assume_unique=True))
        if not met or met + -(-percent * len(a if end <= stop else b) // 100) - 1 < need:
            return False
    return True


def _verify(pairs: DataFrame, rows: DataFrame, hot, percent: int, orders: int) -> DataFrame:
    """Of pairs (a, b), candidates under the first order, those that are candidates under all others and whose sets are similar. Each
    text goes to its pairs once, and the pivot's text once to every salt of at most about SALT pairs."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    wanted = pairs.join(many, "a").select(F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("rid"))
    pivots = many.select(F.col("a").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("rid"))
    sent = wanted.unionAll(pivots).join(rows.select("rid", "text"), "rid")
    sent = sent.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(hot.value, np.uint8)
        first, heads = np.empty(0, np.uint64), []
        for batch in slices(batches, "text", 2 << 20):
            a, b = [], []
            sets = shingle_sets(raw_texts(batch))
            for pivot, role, rid, own in zip(*[column(batch, c).to_pylist() for c in ("pivot", "role", "rid")], sets, strict=True):
                mine = [prefix(own, k, bits, percent) for k in range(1, orders)]
                if role == 0:
                    first, heads = own, mine
                elif meets(first, own, heads, mine, percent) and similar(first, own, percent):
                    a.append(pivot)
                    b.append(rid)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return written(sent.mapInArrow(run, "a bigint, b bigint"))


def _unsettled(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of tokens whose sets lie in different components, with the component."""
    placed = written(shared.join(comps, F.col("rid") == F.col("node"), "left").select("token", "rid", "n", "last", F.coalesce("component", "rid").alias("comp")))
    mixed = placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    return written(placed.join(written(mixed), "token", "left_semi"))


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each set with its tokens' pivots, where they can be similar."""
    pivots = written(rows.groupBy("token").agg(F.min("rid").alias("a")))
    met = rows.join(pivots, "token").where("rid <> a").groupBy("a", F.col("rid").alias("b"))
    met = met.agg(F.count("*").alias("met"), F.first("n").alias("nb"), F.first("last").alias("lb"))
    ends = rows.groupBy(F.col("rid").alias("a")).agg(F.first("n").alias("na"), F.first("last").alias("la"))
    return written(met.join(ends, "a").where(_possible(percent)).select("a", "b"))


def _can(met: np.ndarray, n: np.ndarray, last: np.ndarray, percent: int) -> np.ndarray:
    """`_possible` for all pairs of a block."""
    need = -(-percent * (n[:, None] + n[None, :]) // (100 + percent))
    rest = -(-percent * n // 100) - 1
    rest = np.where(last[:, None] <= last[None, :], rest[:, None], rest[None, :])
    return (met > 0) & (100 * n[:, None] >= percent * n[None, :]) & (100 * n[None, :] >= percent * n[:, None]) & (met + rest >= need)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two sets of a block share."""
    n = len(sets)
    out = np.zeros((n, n), np.int32)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(n), list(map(len, sets)))
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    stops = np.r_[starts[1:], len(tokens)]
    pairs = stops - starts == 2
    np.add.at(out, (owner[starts[pairs]], owner[starts[pairs] + 1]), 1)
    out += out.T
    for a, b in zip(starts[stops - starts > 2].tolist(), stops[stops - starts > 2].tolist(), strict=True):
        out[np.ix_(owner[a:b], owner[a:b])] += 1
    np.fill_diagonal(out, 0)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of a sorted stream."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([column(batch, k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = pa.Table.from_batches([batch.slice(a, b - a)])
            if held and any(held[-1][k][0].as_py() != part[k][0].as_py() for k in keys):
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def _remaining(rows: DataFrame, percent: int) -> DataFrame:
    """Blocks with the sets of which some pair across components can be similar: p, i, j, rid and, on one row of each block,
    those pairs as places in the block's list of rids.

    A pivot's cluster is all sets that share one of its tokens, so any two sets that share a token meet in a cluster.
    """
    pivots = written(rows.groupBy("token").agg(F.min("rid").alias("p")))
    member = rows.join(pivots, "token").select("p", "rid").distinct()
    sizes = member.groupBy("p").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sets = rows.groupBy("rid").agg(F.first("n").alias("n"), F.first("last").alias("last"), F.first("comp").alias("comp"), F.collect_list("token").alias("tokens"))
    placed = member.join(sizes, "p").join(sets, "rid").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    placed = placed.select("p", "i", "j", "rid", "n", "last", "comp", "tokens").repartition("p", "i", "j").sortWithinPartitions("p", "i", "j", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["p", "i", "j"]):
            if t.num_rows < 2:
                continue
            rid, n, last, comp = (t[c].to_numpy() for c in ("rid", "n", "last", "comp"))
            lists = t["tokens"].combine_chunks()
            flat, bounds = np.asarray(lists.values), np.asarray(lists.offsets)
            met = _common([flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            able = np.triu(_can(met, n.astype(np.int64), last, percent) & (comp[:, None] != comp[None, :]))
            if not able.any():
                continue
            kept = np.flatnonzero(able.any(axis=0) | able.any(axis=1))
            able = able[np.ix_(kept, kept)]
            m = len(kept)
            blob = [zlib.compress(np.packbits(able).tobytes(), 1), *[None] * (m - 1)]
            heads = [pa.array(np.full(m, t[c][0].as_py(), np.int64)) for c in ("p", "i", "j")]
            yield pa.RecordBatch.from_arrays([*heads, pa.array(rid[kept]), pa.array(blob, pa.binary())], ["p", "i", "j", "rid", "pairs"])

    return written(placed.mapInArrow(run, "p bigint, i bigint, j bigint, rid bigint, pairs binary"))


def _settle(blocks: DataFrame, rows: DataFrame, hot, percent: int, orders: int, *, forest: bool = True) -> DataFrame:
    """A forest (a, b) of the similar pairs of each block, or all of them. Pairs leave when they cannot be similar under one
    of the further orders; what is left is verified on the whole sets."""
    sent = blocks.join(rows.select("rid", "text"), "rid").repartition("p", "i", "j").sortWithinPartitions("p", "i", "j", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(hot.value, np.uint8)
        for t in _groups(batches, ["p", "i", "j"]):
            rid, m = t["rid"].to_numpy(), t.num_rows
            blob = next(x for x in t["pairs"].to_pylist() if x is not None)
            able = np.unpackbits(np.frombuffer(zlib.decompress(blob), np.uint8), count=m * m).reshape(m, m).astype(bool)
            sets = shingle_sets([x or b"" for x in t["text"].cast(pa.binary()).to_pylist()])
            n = np.array([len(x) for x in sets], np.int64)
            for order in range(1, orders):
                heads = [prefix(x, order, bits, percent) for x in sets]
                able &= _can(_common([x for x, _ in heads]), n, np.array([x for _, x in heads]), percent)
            left = np.flatnonzero(able.any(axis=0) | able.any(axis=1))
            if not len(left):
                continue
            both = _common([sets[k] for k in left])
            size = n[left]
            able = able[np.ix_(left, left)] & (100 * both >= percent * (size[:, None] + size[None, :] - both))
            a, b = np.nonzero(able)
            at = rid[left]
            if not forest:
                yield pa.RecordBatch.from_arrays([pa.array(at[a]), pa.array(at[b])], ["a", "b"])
                continue
            root = np.arange(len(left))
            edges = []
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                if root[x] != root[y]:
                    edges.append((x, y))
                    root[root == root[y]] = root[x]
            yield pa.RecordBatch.from_arrays([pa.array([int(at[x]) for x, _ in edges], pa.int64()), pa.array([int(at[y]) for _, y in edges], pa.int64())], ["a", "b"])

    return written(sent.mapInArrow(run, "a bigint, b bigint"))


def _prepared(docs: DataFrame, columns: list[str], percent: int) -> tuple:
    """The numbered rows of docs; of each the set's size n and key; of each key the first rid; the classes' shared prefix
    tokens; the frequent cells."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = numbered(docs, columns)
    found = written(_summaries(rows))
    hot = spark.sparkContext.broadcast(_frequent(found))
    sets = found.where("kind = 0").select("rid", "n", "key")
    classes = written(sets.where("n > 0").groupBy("key").agg(F.min("rid").alias("rid")))
    return rows, sets, classes, _shared(_prefixes(rows.join(classes.select("rid"), "rid"), 0, hot, percent)), hot


def classify(docs: DataFrame, columns: list[str], *, percent: int = PERCENT, orders: int = ORDERS) -> tuple[DataFrame, DataFrame]:
    """The numbered rows of docs (rid, `columns`, text) and for each rid its doc_id, set size n, the set's
    key and the component's smallest rid, comp.

    Texts link if 100 * |A & B| >= percent * |A | B|.
    """
    rows, sets, classes, shared, hot = _prepared(docs, columns, percent)
    links = _verify(_stars(shared, percent), rows, hot, percent, orders)
    blocks = _remaining(_unsettled(shared, components(links)), percent)
    joined = components(links.unionAll(_settle(blocks, rows, hot, percent, orders)))

    members = classes.join(joined, F.col("rid") == F.col("node"), "left").select("key", F.coalesce("component", "rid").alias("comp"))
    ids = rows.select("rid", "doc_id").join(sets, "rid").join(members, "key", "left")
    return rows, written(ids.select("rid", "doc_id", "n", "key", F.coalesce("comp", F.col("rid")).alias("comp")))


def near_join(docs: DataFrame, *, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, class_id the smallest with the same shingle set.
    """
    _, ids = classify(docs, ["doc_id", "text"], percent=percent, orders=orders)
    least = written(ids.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    alike = written(ids.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("class_id")))
    out = ids.join(least, "comp").join(alike, "key", "left")
    empty = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def near_links(docs: DataFrame, *, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """class_a, class_b, rows_a, rows_b of every two different shingle sets of docs (doc_id, text) that link, once: the smallest
    doc_id and the number of rows with each set, class_a being the smaller one.

    Rows of one class link as well: a row has rows - 1 links in its class and those of the classes linked with it. Near copies of n
    sets have n² / 2 links; they become rows here, block by block.
    """
    rows, sets, classes, shared, hot = _prepared(docs, ["doc_id", "text"], percent)
    alone = shared.select("token", "rid", "n", "last", F.col("rid").alias("comp"))
    links = _settle(_remaining(alone, percent), rows, hot, percent, orders, forest=False).distinct()
    sizes = rows.select("rid", "doc_id").join(sets.where("n > 0"), "rid").groupBy("key").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"))
    ends = written(classes.join(sizes, "key").select("rid", F.struct(F.col("id").isNull(), "id", "rows").alias("end")))
    links = links.join(ends.select(F.col("rid").alias("a"), F.col("end").alias("x")), "a").join(ends.select(F.col("rid").alias("b"), F.col("end").alias("y")), "b")
    links = links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return links.select(F.col("x.id").alias("class_a"), F.col("y.id").alias("class_b"), F.col("x.rows").alias("rows_a"), F.col("y.rows").alias("rows_b"))


def keep_one(docs: DataFrame, *, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """docs without the rows that link, directly or through others, to one of smaller doc_id.

    Rows without words link with nothing and stay; of rows with equal doc_ids the first stays.
    """
    hidden, restored = shielded(docs, ["doc_id", "text"])
    rows, ids = classify(hidden, hidden.columns, percent=percent, orders=orders)
    kept = ids.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("rid"))
    return restored(rows.join(kept.select("rid"), "rid"))
