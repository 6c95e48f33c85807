"""Near duplicates of texts: min-hash bands propose pairs, exact Jaccard similarity of word 3-grams decides.

Texts with equal sets are one class. A band's bucket proposes pairs of its first member with the others; after the
components of what was confirmed are known, pairs of different components in a bucket follow. So a bucket of copies
costs one comparison each and none is skipped for its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import RID, stable_hash
from ..plans.tables import bounded_batches, components, slices, written

HASHES, WORDS = 128, 3
_word = re.compile(r"[^\W_]+", re.U)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def bands(threshold: float) -> int:
    return 16 if threshold >= 0.9 else 32 if threshold >= 0.7 else 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int = WORDS) -> list[str]:
    words = _word.findall(text.lower())
    if len(words) >= size:
        return list(dict.fromkeys(" ".join(words[k : k + size]) for k in range(len(words) - size + 1)))
    return [" ".join(words)] if words else []


def signature(hashes: np.ndarray) -> np.ndarray:
    """128 minima; the i-th hash of x is the i-th number of a SplitMix64 stream seeded with x."""
    if not len(hashes):
        return np.full(HASHES, np.uint64(2**64 - 1))
    steps = GOLDEN * np.arange(1, HASHES + 1, dtype=np.uint64)
    least = np.full(HASHES, np.uint64(2**64 - 1))
    for low in range(0, len(hashes), 4096):
        least = np.minimum(least, _mix(hashes[low : low + 4096, None] + steps[None, :]).min(axis=0))
    return least


def simhash(text: str) -> int:
    """64 votes over the words' hashes."""
    words = _word.findall(text.lower())
    if not words:
        return 0
    h = np.array([stable_hash(w) for w in words], np.uint64)
    bits = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
    votes = 2 * bits.sum(axis=0) - len(words)
    return int(sum(1 << k for k in range(64) if votes[k] > 0))


def hamming(a: int, b: int) -> int:
    return (a ^ b).bit_count()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit numbers as one column, without an object for each number."""
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def _sets(texts: DataFrame, n_bands: int) -> DataFrame:
    """rid, grams (sorted 64-bit hashes) and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        width = HASHES // n_bands
        for batch in slices(batches, "text"):
            grams, keys = [], []
            for text in batch.column(1):
                h = np.unique(np.array([xxhash.xxh3_64_intdigest(x) for x in shingles(text.as_py() or "")], np.uint64))
                s = signature(h)
                key = np.zeros(n_bands, np.uint64)
                for k in range(width):
                    key = _mix(key ^ s[k::width]) + GOLDEN
                grams.append(h.view(np.int64))
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(grams), _lists(keys)], ["rid", "grams", "keys"])

    bounded_batches(texts.sparkSession)
    return texts.select(F.col(RID).alias("rid"), "text").mapInArrow(run, "rid bigint, grams array<bigint>, keys array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    a, b = sets.select(F.col("rid").alias("a"), F.col("grams").alias("x")), sets.select(F.col("rid").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(a, "a").join(b, "b").withColumn("met", F.size(F.array_intersect("x", "y")))
    share = F.col("met") / (F.size("x") + F.size("y") - F.col("met"))
    return written(both.where(share >= threshold).select("a", "b"))


def near_duplicates(texts: DataFrame, threshold: float) -> DataFrame:
    """rid and component (the smallest rid that confirmed pairs reach) of texts (_rid, text)."""
    sets = written(_sets(texts, bands(threshold)))
    key = F.sha2(F.to_json("grams"), 256)
    classes = written(sets.groupBy(key.alias("set")).agg(F.min("rid").alias("class")))
    member = written(sets.select("rid", key.alias("set")).join(classes, "set").select("rid", "class"))
    first = written(sets.join(classes.select(F.col("class").alias("rid")), "rid", "left_semi").where(F.size("grams") > 0))
    places = first.select("rid", F.posexplode("keys").alias("band", "key"))
    pivots = written(places.groupBy("band", "key").agg(F.min("rid").alias("a"), F.max("rid").alias("z")).where("a <> z").drop("z"))
    buckets = written(places.join(pivots, ["band", "key"]))
    links = _confirmed(buckets.where("rid <> a").select("a", F.col("rid").alias("b")).distinct(), first, threshold)
    comps = components(links)
    placed = buckets.join(comps, F.col("rid") == F.col("node"), "left").select("band", "key", "rid", F.coalesce("component", "rid").alias("comp"))
    mixed = placed.groupBy("band", "key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band", "key")
    placed = written(placed.join(written(mixed), ["band", "key"], "left_semi"))
    one = placed.select("band", "key", F.col("rid").alias("a"), F.col("comp").alias("ca"))
    two = placed.select("band", "key", F.col("rid").alias("b"), F.col("comp").alias("cb"))
    pairs = one.join(two, ["band", "key"]).where("a < b AND ca <> cb").select("a", "b").distinct()
    joined = components(links.unionAll(_confirmed(pairs, first, threshold)))
    out = member.join(joined, F.col("class") == F.col("node"), "left").select("rid", F.coalesce("component", "class").alias("component"))
    return out
