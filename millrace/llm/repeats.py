"""Bytes inside windows of a given length that occur again anywhere; exact, without a suffix array of the corpus.

A suffix array read to depth L groups equal windows of L bytes. Suffixes are ordered here digit by digit and
never deeper than L, and groups of one leave after each digit:

1. First digit. Of all runs of `gram` bytes inside a window the one with the least hash is the window's anchor: equal
   windows have equal anchors at equal offsets, and neighbouring windows mostly share one, so windows travel by anchor (about
   one in (L - gram) / 2 bytes). Anchors are counted over the corpus; one that occurs once can lie in no repeated window.
2. Second digit. Whatever the window, at least half of the bytes it has beside its anchor lie on one side of it. So an occurrence
   stays only if the anchor with that half before it, or with that half behind it, occurs twice in the corpus.
3. Further digits. What is left carries the bytes of its windows. Among occurrences of an anchor, windows at the same
   offset are ordered by digits of `digit` bytes; those alone leave after each, and after the last the windows of a
   group are compared byte by byte, so no hash decides.
   The windows around an anchor with very many occurrences are instead keyed by a hash of all L bytes one by one, taken once
   from each batch of texts and counted by a partial aggregation, so that such a group never stands in one task.

Copies of whole texts are found first, and one text of each class takes part.

Defined cases: null is the empty text; texts shorter than a window keep all bytes; windows never cross
texts; rows with null or equal doc_ids stay rows of their own; an empty table gives no rows; further columns are
left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, column, freed, mix64, numbered, raw_texts, slices, written

LENGTH, GRAM, DIGIT = 400, 100, 200
#: Occurrences of an anchor that one task may hold; more are split by digits.
CROWD = 20_000
#: Rows that are compared at a time, and of these, rows that are hashed at a time.
BLOCK, HASHED = 8192, 512
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.full(size, np.uint64(base))
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def _through(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any run of data (uint8; the last axis) follows."""
    n = data.shape[-1]
    through = np.zeros((*data.shape[:-1], n + 1), np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(n + 1)[0][:n], axis=-1, out=through[..., 1:])
    return through


def _hashes(through: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` bytes."""
    many = through.shape[-1] - width
    return mix64((through[..., width:] - through[..., :many]) * _power(many)[1])


def _grid_hashes(grid: np.ndarray, width: int) -> np.ndarray:
    """_hashes of every row; running sums, eight times the rows' size and several at once, are held for a few rows alone."""
    out = np.empty((len(grid), grid.shape[1] + 1 - width), np.uint64)
    for a in range(0, len(grid), HASHED):
        out[a : a + HASHED] = _hashes(_through(grid[a : a + HASHED]), width)
    return out


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    return _hashes(_through(data), width)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, in blocks (van Herk, Gil and Werman)."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.uint64(MASK))
    padded[:n] = x
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The anchors of data's windows: place and hash, the first and last start of the windows that are theirs, and the second
    digits before and behind, 0 where data ends."""
    if len(data) < length:
        return {k: np.empty(0, t) for k, t in (("at", np.int64), ("anchor", np.uint64), ("low", np.int64), ("high", np.int64), ("before", np.uint64), ("behind", np.uint64))}
    half = (length - gram + 1) // 2
    through = _through(data)
    h = _hashes(through, gram)
    # by half of the hash, then by place: ties go to the first, wherever the window lies
    places = np.arange(len(h), dtype=np.uint64)
    owner = (_least((h & np.uint64(MASK ^ 0xFFFFFFFF)) | places, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    low = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    at = owner[low]
    wide = _hashes(through, gram + half)
    before, behind = np.zeros((2, len(at)), np.uint64)
    back, on = at >= half, at < len(wide)
    before[back] = mix64(wide[at[back] - half] ^ np.uint64(1)) | np.uint64(1)
    behind[on] = wide[at[on]] | np.uint64(1)
    return {"at": at, "anchor": h[at], "low": low, "high": np.r_[low[1:], len(owner)] - 1, "before": before, "behind": behind}


def _anchor_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    kinds = {"anchor": np.int64, "rid": np.int64, "at": np.int32, "low": np.int32, "high": np.int32, "before": np.int64, "behind": np.int64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = []
            for r, raw in zip(column(batch, "rid").to_pylist(), raw_texts(batch), strict=True):
                own = anchors(np.frombuffer(raw, np.uint8), length, gram)
                found.append(own | {"rid": np.full(len(own["at"]), r, np.int64)})
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found]).astype(t)) for k, t in kinds.items()], list(kinds))

    return rows.select("rid", "text").mapInArrow(run, "anchor bigint, rid bigint, at int, low int, high int, before bigint, behind bigint")


def _spans(flags: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each run of flagged windows; offset o starts o bytes before the anchor."""
    wide = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    step = np.diff(wide, axis=1)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    return row, at[row] - (high - 1), at[row] - low + length


CONTEXT, ASK, SHOW, KNOWN = range(4)


def _runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged spans of windows at sorted starts."""
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + length


def _contexts(shared: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Each occurrence of a shared anchor with the bytes of its windows. Around crowded anchors single windows stand
    instead, each distinct one once a batch: to ASK whether it occurs elsewhere or, where the batch itself
    repeats it, to SHOW it to others, its spans being KNOWN."""
    places = shared.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("at", "anchor", "low", "high", "crowded"))).alias("places"))
    joined = rows.select("rid", "text").join(places, "rid")
    kinds = {"kind": pa.int32(), "key": pa.int64(), "rid": pa.int64(), "at": pa.int32(), "stop": pa.int32(), "left": pa.int32(), "bytes": pa.binary()}

    def windows(crowd: list[tuple[int, bytes, list[dict]]], out: dict[str, list]) -> None:
        """crowd: rid, text and places of its crowded anchors."""
        hashes, rids, starts = [], [], []
        for rid, raw, at in crowd:
            h = rolling(np.frombuffer(raw, np.uint8), length)
            own = np.concatenate([np.arange(p["low"], p["high"] + 1) for p in at])
            hashes.append(h[own])
            starts.append(own)
            rids.append(np.full(len(own), rid))
        h, rid, start = map(np.concatenate, (hashes, rids, starts))
        _, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        known = count[back] > 1
        for r in np.unique(rid[known]).tolist():
            low, high = _runs(start[known & (rid == r)], length)
            for name, values in (("kind", [KNOWN] * len(low)), ("key", [None] * len(low)), ("rid", [r] * len(low)), ("at", low.tolist()), ("stop", high.tolist())):
                out[name] += values
        out["kind"] += np.where(count > 1, SHOW, ASK).tolist()
        out["key"] += h[first].view(np.int64).tolist()
        out["rid"] += rid[first].tolist()
        out["at"] += start[first].tolist()
        out["stop"] += (start[first] + length).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            out: dict[str, list] = {k: [] for k in kinds}
            crowd = []
            for rid, raw, places in zip(column(batch, "rid").to_pylist(), raw_texts(batch), column(batch, "places").to_pylist(), strict=True):
                dense = [p for p in places if p["crowded"]]
                if dense:
                    crowd.append((rid, raw, dense))
                for p in places:
                    if not p["crowded"]:
                        out["kind"].append(CONTEXT)
                        out["key"].append(p["anchor"])
                        out["rid"].append(rid)
                        out["at"].append(p["at"])
                        out["stop"].append(0)
                        out["left"].append(p["at"] - p["low"])
                        out["bytes"].append(raw[p["low"] : p["high"] + length])
            if crowd:
                windows(crowd, out)
            for name in ("left", "bytes"):
                out[name] += [None] * (len(out["key"]) - len(out[name]))
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))

    return joined.mapInArrow(run, "kind int, key bigint, rid bigint, at int, stop int, left int, bytes binary")


def _alike(group: np.ndarray, digits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Members that agree with an earlier one in group and all digits, and that earlier one. Most significant digit first;
    who stands alone after a digit leaves."""
    live, own = np.arange(len(group)), group
    for digit in digits:
        own = mix64(own) ^ digit[live]
        order = np.argsort(own, kind="stable")
        own = own[order]
        same = own[1:] == own[:-1]
        kept = np.r_[False, same] | np.r_[same, False] if len(own) else same
        live, own = live[order][kept], own[kept]
    same = own[1:] == own[:-1]
    first = np.flatnonzero(np.r_[True, ~same]) if len(own) else np.empty(0, np.int64)
    leader = np.repeat(live[first], np.diff(np.r_[first, len(live)]))
    later = leader != live
    return live[later], leader[later]


def _marks(grid: np.ndarray, group: np.ndarray, least: np.ndarray, most: np.ndarray, length: int, gram: int, digit: int) -> np.ndarray:
    """Whether the window of occurrence i (rows of the grid, anchors in one column) that starts o bytes before its anchor,
    least[i] <= o <= most[i], equals one of another occurrence of its group."""
    n, wide = len(grid), length - gram
    digit = min(digit, length)
    starts = [*range(0, length - digit, digit), length - digit]
    partner = np.full((n, wide + 1), -1, np.int32)
    # blocks of offsets keep the hashes of a crowded anchor small
    step = max(1, min(wide + 1, (BLOCK * (wide + 1)) // max(n, 1)))
    for low in range(0, wide + 1, step):
        high = min(wide + 1, low + step)
        # offset o starts at column wide - o; columns first .. wide - low + length are needed
        first = wide - (high - 1)
        h = _grid_hashes(grid[:, first : wide - low + length], digit)
        for o in range(low, high):
            live = np.flatnonzero((least <= o) & (o <= most))
            later, leader = _alike(group[live], [h[live, wide - o - first + k] for k in starts])
            partner[live[later], o] = live[leader]
        del h
    # equal hashes propose; runs of offsets with one partner are compared byte by byte at once
    edge = np.full((n, 1), -1, np.int32)
    changed = np.hstack([partner[:, :1] != edge, partner[:, 1:] != partner[:, :-1], partner[:, -1:] != edge])
    row, low = np.nonzero(changed[:, :-1] & (partner >= 0))
    _, high = np.nonzero(changed[:, 1:] & (partner >= 0))
    other = partner[row, low]
    marks = np.zeros((n, wide + 2), np.int32)
    for a in range(0, len(row), BLOCK):
        i, j, lo, hi = (x[a : a + BLOCK] for x in (row, other, low, high))
        at = np.arange(grid.shape[1])
        inside = (at >= (wide - hi)[:, None]) & (at < (wide - lo + length)[:, None])
        unlike = ((grid[i] != grid[j]) & inside).any(axis=1)
        for k in (i, j):
            np.add.at(marks, (k[~unlike], lo[~unlike]), 1)
            np.add.at(marks, (k[~unlike], hi[~unlike] + 1), -1)
        for k in np.flatnonzero(unlike).tolist():  # different bytes with equal hashes: by the bytes themselves
            mates = np.flatnonzero(group == group[i[k]])
            for o in range(lo[k], hi[k] + 1):
                seen: dict[bytes, list[int]] = {}
                for m in mates[(least[mates] <= o) & (o <= most[mates])].tolist():
                    seen.setdefault(grid[m, wide - o : wide - o + length].tobytes(), []).append(m)
                for found in seen.values():
                    if len(found) > 1:
                        np.add.at(marks, (found, [o] * len(found)), 1)
                        np.add.at(marks, (found, [o + 1] * len(found)), -1)
    return np.cumsum(marks, axis=1, out=marks)[:, :-1] > 0


def _compare(contexts: DataFrame, length: int, gram: int, digit: int) -> DataFrame:
    """rid, start, end of the repeated windows around shared anchors; contexts come sorted by anchor."""
    wide = length - gram

    def judge(keys: list[int], rids: list[int], ats: list[int], lefts: list[int], raws: list[bytes]) -> pa.RecordBatch:
        n = len(keys)
        grid = np.zeros((n, wide + length), np.uint8)
        most, size = np.array(lefts, np.int64), np.fromiter(map(len, raws), np.int64, n)
        for i, raw in enumerate(raws):
            grid[i, wide - lefts[i] : wide - lefts[i] + len(raw)] = np.frombuffer(raw, np.uint8)
        at, rid = np.array(ats, np.int64), np.array(rids, np.int64)
        group = np.array(keys, np.int64).view(np.uint64)
        flags = _marks(grid, group, most - (size - length), most, length, gram, digit)
        row, start, end = _spans(flags, at, length)
        return pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["rid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(5)]
        for batch in batches:
            for into, name in zip(held, ("key", "rid", "at", "left", "bytes"), strict=True):
                into += column(batch, name).to_pylist()
            if len(held[0]) >= BLOCK:
                # the last anchor may go on in the next batch
                cut = len(held[0])
                while cut and held[0][cut - 1] == held[0][-1]:
                    cut -= 1
                if cut:
                    yield judge(*[x[:cut] for x in held])
                    held = [x[cut:] for x in held]
        if held[0]:
            yield judge(*held)

    return contexts.mapInArrow(run, "rid bigint, start int, end int")


def marked(rows: DataFrame, *, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, digit: int = DIGIT) -> DataFrame:
    """rows (rid, text) -> rid, spans (array of start, end; in bytes, not merged) of texts that have repeated windows."""
    bounded_batches(rows.sparkSession)
    found = written(_anchor_rows(rows, length, gram))
    counts = written(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (F.col("n") > crowd).alias("crowded")))
    # counts are written before each join, so that it is one of two shuffles and a hot digit can be split
    first = written(found.join(counts, "anchor").withColumn("digit", F.explode(F.array("before", "behind"))).drop("before", "behind").where("digit <> 0"))
    freed(found, counts)
    counts = written(first.groupBy("digit").agg(F.count("*").alias("n")).where("n > 1").select("digit"))
    shared = written(first.join(counts, "digit").drop("digit"))
    freed(first, counts)
    contexts = written(_contexts(shared, rows, length))
    sparse = contexts.where(F.col("kind") == CONTEXT).select("key", "rid", "at", "left", "bytes")
    spans = _compare(sparse.repartition("key").sortWithinPartitions("key", "rid", "at"), length, gram, digit)
    if not shared.where("crowded").isEmpty():
        single = contexts.where(F.col("kind").isin(ASK, SHOW))
        twice = written(single.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
        again = single.where(F.col("kind") == ASK).join(twice, "key").unionByName(contexts.where(F.col("kind") == KNOWN))
        spans = spans.unionAll(again.select("rid", F.col("at").alias("start"), F.col("stop").alias("end")))
    out = written(spans.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    freed(shared, contexts)
    return out


def _cut(rows: DataFrame, length: int, *, with_text: bool) -> DataFrame:
    """rows (…, text, whole, spans) -> what is left of each text."""
    keep = [c for c in rows.columns if c not in ("text", "whole", "spans")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sizes, removed, runs, sha, left = [], [], [], [], []
            for raw, whole, spans in zip(raw_texts(batch), column(batch, "whole").to_pylist(), column(batch, "spans").to_pylist(), strict=True):
                merged = []
                if whole and len(raw) >= length:
                    merged = [[0, len(raw)]]
                elif spans:
                    for x in sorted((s["start"], s["end"]) for s in spans):
                        if merged and x[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], x[1])
                        else:
                            merged.append(list(x))
                kept, done = [], 0
                for start, end in merged:
                    kept.append(raw[done:start])
                    done = end
                kept = b"".join([*kept, raw[done:]])
                sizes.append(len(raw))
                removed.append(len(raw) - len(kept))
                runs.append(len(merged))
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    left.append(kept.decode("utf-8", "ignore"))
            out = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                out.append(pa.array(left, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in keep], *out], [*keep, *names])

    return rows.mapInArrow(run, f"{kinds}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept string" * with_text)


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, digit: int = DIGIT, columns: list[str] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """`columns` of docs, n_bytes, n_removed, n_spans, kept_sha256 and, if `with_text`, the kept text.

    A byte goes if a window of `length` bytes that covers it starts anywhere else too. Where a cut leaves
    part of a character, `kept` leaves that part out; kept_sha256 is of the bytes themselves.
    """
    bounded_batches(docs.sparkSession)
    given = list(columns)
    hidden = docs.select("text", *[F.col(f"`{c}`").alias(f"__kept_{k}") for k, c in enumerate(given)])
    rows = numbered(hidden, hidden.columns)
    columns = [c for c in hidden.columns if c != "text"]
    shas = rows.where(F.octet_length("text") >= length).select("rid", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    alike = written(shas.groupBy("sha").agg(F.min("rid").alias("first"), F.count("*").alias("copies")).where("copies > 1"))
    classes = written(shas.join(alike, "sha").select("rid", (F.col("rid") == F.col("first")).alias("first"), F.lit(True).alias("whole")))
    freed(alike)
    part = rows.where(F.octet_length("text") >= length).select("rid", "text").join(classes.where("NOT first").select("rid"), "rid", "left_anti")
    spans = marked(part, length=length, gram=gram, crowd=crowd, digit=digit)
    out = rows.join(classes.select("rid", "whole"), "rid", "left").join(spans, "rid", "left")
    found = _cut(out.select(*columns, "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans"), length, with_text=with_text)
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    return found.select(*[F.col(c).alias(name) for c, name in zip(columns, given, strict=True)], *made)
