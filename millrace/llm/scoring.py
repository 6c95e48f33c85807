"""Scores of texts under a trigram model of the corpus, read by a weighted backoff automaton.

States are the empty context, every word and every pair of words seen often enough (`support`) to have a follower. From the state
h arcs lead on each follower seen often enough, weighing (c(hw) - discount) / c(h) + back(h) * p(w | h'), h' being h without its
first word; any other word takes the failure arc to h', weighing back(h). The empty context's arcs weigh
p(w) = (c + 0.1) / (N + 0.1 * (V + 1)). back(h) is the mass that the discount and the followers left out set free, so each state's
weights sum to one. A text is read once from left to right, starting in the state of the end token, and the logarithms are
added up. The limit is a count, not a share of the corpus, so states and arcs grow with it.

Texts are read and cut into words once, into chunks of bounded size: a chunk keeps its texts as word numbers of its own.
A chunk's distinct words and pairs, as sorted 62-bit hashes with their counts in training texts, are cut by hash
into parts; a part sums those of all chunks and sends each chunk the totals of its own, in their order. A second exchange of the same kind
counts the triples both of whose pairs occur often enough (no other triple can), and sums what the followers of each word keep, a
follower being counted by the first chunk that has it; a third does so for the followers of pairs. What is common is
thus summed by parts in packed arrays and never stands in rows of one key. Two sums reach the driver, nothing all executors.

Defined cases: null and empty texts are the end token alone; a null doc_id is drawn like the empty string; rows with equal
doc_ids stay rows of their own; without training texts every count is 0; an empty table gives no rows; further columns
are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bucket_count, bucketed, column, mix64, raw_texts, slices, swept, words_of, written

#: Bytes of text in a chunk; a longer text stands alone.
CHUNK = 4 << 20
#: Times that a follower must occur to have an arc; discount.
SUPPORT, DISCOUNT = 2, 0.75
#: Parts of the hashes: so many at least, and of about so many tokens.
PARTS, PART = 1024, 1_000_000
#: Kinds of n-grams, in the lowest bits of their hashes.
WORD, PAIR, TRIPLE = 1, 2, 3
SPREAD = np.uint64(0x9E3779B97F4A7C15)
END = b""
ADDED = 0.1


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _pack(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(raw: bytes, dtype: str) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], decompressed_size=size, codec="zstd"), dtype)


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on: those that are all zero compress to nothing."""
    return x.view("u1").reshape(-1, x.itemsize).T.tobytes()


def _from_planes(raw: bytes, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(np.dtype(dtype).itemsize, -1).T).view(dtype)[:, 0]


def _chunks(docs: DataFrame, chunk: int) -> DataFrame:
    """A chunk's ids, flags, lengths, word numbers and words, the number of the end token and that of all tokens."""
    names = ["chunk", "end", "size", "ids", "missing", "held", "lengths", "tokens", "words"]
    schema = pa.schema([(k, pa.int64() if k in names[:3] else pa.binary()) for k in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        words, parts, size = _Numbers(), [], 0

        def out() -> pa.RecordBatch:
            ids, missing, held, lengths, tokens = (np.concatenate(x) for x in zip(*parts, strict=True))
            spelt = np.frombuffer(b"\n".join(words), np.uint8)  # words hold no white space
            row = {"chunk": number, "end": words[END], "size": len(tokens), "ids": _pack(ids), "missing": _pack(missing), "held": _pack(held), "lengths": _pack(lengths), "tokens": _pack(tokens), "words": _pack(spelt)}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in slices(batches, "text", 4 << 20):
            raw = raw_texts(batch)
            found = [words_of(x) for x in raw]
            for x in found:
                x.append(END)
            lengths = np.fromiter(map(len, found), np.int32, len(found))
            tokens = np.fromiter(map(words.__getitem__, chain.from_iterable(found)), np.int32, int(lengths.sum()))
            ids = column(batch, "doc_id")
            parts.append((ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()), np.asarray(column(batch, "held_out")), lengths, tokens))
            size += sum(map(len, raw))
            if size >= chunk:
                yield out()
                words, parts, size, number = _Numbers(), [], 0, number + 1
        if parts:
            yield out()

    return docs.mapInArrow(run, "chunk bigint, end bigint, size bigint, ids binary, missing binary, held binary, lengths binary, tokens binary, words binary")


def _before(tokens: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The word before each token; texts start after an end."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(lengths) - lengths] = end
    return out


class _Grams:
    """The distinct n-grams of one length of a chunk: sorted `keys`, `n` (their counts in training texts), `which` of them ends at
    each of the positions `at`, and the number of their `context` among the n-grams one shorter. hashes: of each position, or of
    what `of` numbers for each, all of which must occur."""

    def __init__(self, hashes: np.ndarray, kind: int, at: np.ndarray, train: np.ndarray, before: np.ndarray | None, of: np.ndarray | None = None):
        keys = (mix64(hashes) & ~np.uint64(3)) | np.uint64(kind)
        order = np.argsort(keys).astype(np.int32)
        keys = keys[order]
        new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
        self.keys, self.at = keys[new], at
        self.which = np.empty(len(keys), np.int32)
        self.which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        if of is not None:
            self.which = self.which[of]
        self.n = np.bincount(self.which[train[at]], minlength=len(self.keys))
        self.context = np.empty(len(self.keys), np.int32)
        if before is not None:
            self.context[self.which] = before


class _Order:
    """Sorted keys of several kinds, and the way back."""

    def __init__(self, kinds: list[np.ndarray]):
        self.bounds = np.cumsum([0, *map(len, kinds)])
        joined = np.concatenate(kinds)
        self.order = np.argsort(joined, kind="stable")  # merges the kinds, each of which is sorted
        self.keys = joined[self.order]

    def put(self, values: list[np.ndarray]) -> np.ndarray:
        """Values (fields x keys) of each kind, in the order of the keys."""
        return np.concatenate(values, axis=1)[:, self.order]

    def back(self, values: np.ndarray) -> list[np.ndarray]:
        out = np.empty_like(values)
        out[:, self.order] = values
        return [out[:, a:b] for a, b in zip(self.bounds, self.bounds[1:], strict=False)]


class _Chunk:
    """A chunk's row unpacked, with its distinct words and pairs; `learn` adds what the exchanges have told about them."""

    def __init__(self, row: dict):
        self.number, self.held, self.lengths = row["chunk"], _unpack(row["held"], "?"), _unpack(row["lengths"], "<i4")
        tokens, end = _unpack(row["tokens"], "<i4"), row["end"]
        self.train = np.repeat(~self.held, self.lengths)
        spelt = _unpack(row["words"], "u1").tobytes().split(b"\n")
        keys = np.fromiter(map(xxhash.xxh64_intdigest, spelt), np.uint64, len(spelt))
        everywhere = np.arange(len(tokens), dtype=np.int32)
        self.words = _Grams(keys, WORD, everywhere, self.train, None, tokens)
        # the word before each token; texts start after an end
        previous = _before(tokens, self.lengths, end)
        number = np.zeros(len(keys), np.int32)
        number[tokens] = self.words.which  # every text holds the end token
        self.last = keys[tokens]
        self.hashes = keys[previous] * SPREAD + self.last
        self.pairs = _Grams(self.hashes, PAIR, everywhere, self.train, number[previous])
        self.first = _Order([self.words.keys, self.pairs.keys])

    def learn(self, sums: list[pa.Table], support: int) -> None:
        """sums: the answers to as many exchanges as are done. Triples are those whose pairs both occur often enough."""
        (_, self.c1), (new, self.c2) = self.first.back(_received(sums[0], 1))
        self.new = new > 0
        often = (self.c2 >= support)[self.pairs.which]
        often[1:] &= often[:-1]
        often[np.cumsum(self.lengths) - self.lengths] = False
        at = np.flatnonzero(often).astype(np.int32)
        self.triples = _Grams(mix64(self.hashes[at - 1]) * SPREAD + self.last[at], TRIPLE, at, self.train, self.pairs.which[at - 1])
        self.known, self.met = self.c1 >= support, self.c2 >= support
        self.second = _Order([self.words.keys[self.known], self.triples.keys])
        if len(sums) > 1:
            followers, (new, self.c3, _) = self.second.back(_received(sums[1], 2))
            self.newer, self.after1 = new > 0, followers[1:]
            self.third = _Order([self.pairs.keys[self.met]])
        if len(sums) > 2:
            self.after2 = self.third.back(_received(sums[2], 2))[0][1:]


def _kept(grams: _Grams, arc: np.ndarray, c: np.ndarray, contexts: int) -> np.ndarray:
    """Of each context the counts and the number of those followers."""
    context = grams.context[arc]
    # sums of whole numbers below 2**53 are exact
    return np.stack([np.bincount(context, c[arc], contexts).astype(np.int64), np.bincount(context, minlength=contexts)])


SENT = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])
SUMS = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("total", pa.int64()), ("distinct", pa.int64()), ("sums", pa.binary())])
SENT_TYPE, SUMS_TYPE = "chunk bigint, part bigint, keys binary, values binary", "chunk bigint, part bigint, total bigint, distinct bigint, sums binary"


def _sent(number: int, keys: np.ndarray, values: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """A chunk's sorted keys and their values (fields x keys), cut by hash into parts."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    found, low = np.unique(part, return_index=True)
    bounds = [*low.tolist(), len(part)]
    rows, size = [], 0
    for p, a, b in zip(found.tolist(), bounds, bounds[1:], strict=False):
        rows.append({"chunk": number, "part": p, "keys": _planes(np.diff(keys[a:b], prepend=np.uint64(0))), "values": _planes(np.ascontiguousarray(values[:, a:b]).ravel())})
        size += b - a
        if size >= 200_000:
            yield pa.RecordBatch.from_pylist(rows, SENT)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, SENT)


def _summed(sent: DataFrame) -> DataFrame:
    """For each chunk and part the sums over all chunks of its keys' values, in order, below a row that says whether the chunk is the
    first that has the key; total and distinct: on one row of a part, of the words' first value the sum, and how many have one."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.sort_by("chunk").to_pylist()
        keys = [np.cumsum(_from_planes(x["keys"], "<u8"), dtype=np.uint64) for x in rows]
        bounds = np.cumsum([0, *map(len, keys)]).tolist()
        values = np.concatenate([_from_planes(x["values"], "<i8").reshape(-1, len(k)) for x, k in zip(rows, keys, strict=True)], axis=1)
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sums = np.add.reduceat(values[:, order], starts, axis=1)
        out = np.zeros((len(values) + 1, len(keys)), np.int64)
        out[0, order[starts]] = 1
        out[1:, order] = np.repeat(sums, np.diff(np.r_[starts, len(keys)]), axis=1)
        words = sums[0, (keys[starts] & np.uint64(3)) == WORD]
        seen = [(int(words.sum()), int((words > 0).sum())), *[(0, 0)] * (len(rows) - 1)]
        found = [{"chunk": x["chunk"], "part": x["part"], "total": t, "distinct": d, "sums": _pack(np.frombuffer(_planes(np.ascontiguousarray(out[:, a:b]).ravel()), "u1"))} for x, (t, d), a, b in zip(rows, seen, bounds, bounds[1:], strict=False)]
        return pa.Table.from_pylist(found, SUMS)

    return sent.groupBy("part").applyInArrow(add, SUMS_TYPE)


def _received(table: pa.Table, fields: int) -> np.ndarray:
    """A chunk's sums in the order of its keys: first and `fields` more rows."""
    parts = [_from_planes(_unpack(x, "u1").tobytes(), "<i8").reshape(fields + 1, -1) for x in table.sort_by("part")["sums"].to_pylist()]
    return np.concatenate(parts, axis=1) if parts else np.zeros((fields + 1, 0), np.int64)


def _counted(chunks: DataFrame, parts: int) -> DataFrame:
    """Each chunk's words and pairs with their counts in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = _Chunk(batch.slice(k, 1).to_pylist()[0])
                yield from _sent(own.number, own.first.keys, own.first.put([own.words.n[None, :], own.pairs.n[None, :]]), parts)

    return chunks.select("chunk", "end", "held", "lengths", "tokens", "words").mapInArrow(run, SENT_TYPE)


def _answers(right: pa.Table, kinds: int) -> list[pa.Table]:
    return [right.filter(pa.compute.field("kind") == k) for k in range(1, kinds + 1)]


def _followed(chunks: DataFrame, answers: DataFrame, support: int, parts: int, done: int) -> DataFrame:
    """After one exchange, each chunk's triples with their counts, and its words with what their followers keep that have an arc and
    that no earlier chunk has; after two, its pairs with that of theirs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return SENT.empty_table()
        own = _Chunk(left.to_pylist()[0])
        own.learn(_answers(right, done), support)
        if done == 1:
            counts = np.stack([own.triples.n, np.zeros_like(own.triples.n)])
            order = own.second
            values = order.put([_kept(own.pairs, own.new & own.met, own.c2, len(own.known))[:, own.known], counts])
        else:
            order = own.third
            values = order.put([_kept(own.triples, own.newer & (own.c3 >= support), own.c3, len(own.met))[:, own.met]])
        return pa.Table.from_batches(_sent(own.number, order.keys, values, parts), SENT)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, SENT_TYPE)


def _scores(chunks: DataFrame, sums: DataFrame, total: int, distinct: int, support: int, discount: float) -> DataFrame:
    """sums: the answers to the three exchanges, by kind."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        row = left.to_pylist()[0]
        own = _Chunk(row)
        own.learn(_answers(right, 3), support)
        single = ((own.c1 + ADDED) / (total + ADDED * (distinct + 1)))[own.words.which]
        p = single.copy()
        # from each word's state, then from each pair's: its failure arc or, where there is one, the arc on the token
        before = own.pairs.context[own.pairs.which]
        further = np.zeros(len(p), bool)
        further[1:] = own.met[own.pairs.which[:-1]]
        further[np.cumsum(own.lengths) - own.lengths] = False
        back = np.ones(len(own.c1))
        back[own.known] = 1 - (own.after1[0] - discount * own.after1[1]) / own.c1[own.known]
        p *= back[before]
        p += np.where(own.met, (own.c2 - discount) / np.maximum(own.c1[own.pairs.context], 1), 0)[own.pairs.which]
        back = np.ones(len(own.c2))
        back[own.met] = 1 - (own.after2[0] - discount * own.after2[1]) / own.c2[own.met]
        at = np.flatnonzero(further)
        p[at] *= back[own.pairs.which[at - 1]]
        arc = own.c3 >= support
        p[own.triples.at] += np.where(arc, (own.c3 - discount) / np.maximum(own.c2[own.triples.context], 1), 0)[own.triples.which]
        lengths = own.lengths
        starts = np.cumsum(lengths) - lengths
        base = np.add.reduceat(np.log10(single), starts)
        known = np.add.reduceat((own.c1 > 0)[own.words.which].astype(np.int64), starts)
        whole = np.add.reduceat(np.log10(p), starts)
        ids = pa.array(_unpack(row["ids"], "<i8"), mask=_unpack(row["missing"], "?"))
        return pa.table([ids, pa.array(own.held), pa.array(lengths.astype(np.int64)), pa.array(known), pa.array(np.full(len(lengths), total)), pa.array(base), pa.array(whole)], schema=schema)

    spark_schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(score, spark_schema)


def score(docs: DataFrame, *, support: int = SUPPORT, discount: float = DISCOUNT, folds: int = 10, chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text); texts with
    crc32(doc_id) % folds = 0 are held out, the rest trains."""
    spark = docs.sparkSession
    bounded_batches(spark)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (fold == 0).alias("held_out"))
    whole = bucketed(_chunks(docs, chunk), "chunk", bucket_count(docs))
    parts = max(PARTS, (whole.agg(F.sum("size")).head()[0] or 0) // PART)
    counts = written(_summed(_counted(whole, parts)))
    seen = counts.agg(F.sum("total"), F.sum("distinct")).head()
    answers = counts.select("chunk", "part", F.lit(1).alias("kind"), "sums")
    for done in (1, 2):
        swept(spark)  # what the last exchange has shuffled is stored
        more = written(_summed(_followed(whole, answers, support, parts, done)))
        answers = answers.unionAll(more.select("chunk", "part", F.lit(done + 1).alias("kind"), "sums"))
    swept(spark)
    return _scores(whole, answers, seen[0] or 0, seen[1] or 0, support, discount)
