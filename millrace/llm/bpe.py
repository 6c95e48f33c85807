"""Byte-pair encoding and decoding with a public vocabulary.

Texts are cut at white space, distinct words are cut into pieces by the tokenizer's own pattern, and pieces not yet
known are encoded together: the symbols of many pieces stand in one flat array, and each round merges, in
every piece, its pair of lowest rank. A pair's rank is found by binary search over the sorted pair keys
``left * V + right``. Only pairs next to a merge are looked up again, and finished pieces leave the array.

Defined cases: null and empty texts have no tokens; a text of any length is encoded whole; rows with equal
ids or texts are encoded alike; further columns pass through ``encode`` untouched.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, column, slices, texts

NONE = np.int32(2**31 - 1)
_separators, _space = re.compile("[\x1c-\x1f]"), regex.compile(r"\s+")
#: Words that a worker remembers before it starts afresh; bounds memory, not the result.
REMEMBERED = 500_000


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, the other bytes follow from code point 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Remembered(dict):
    """string -> its number; strings not seen before gather in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, string: str) -> int:
        number = self[string] = len(self)
        self.new.append(string)
        return number


class _Lists:
    """Lists of ids by number, in one flat array."""

    def __init__(self):
        self.flat, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, count: np.ndarray, numbers: np.ndarray) -> None:
        more = max(0, int(numbers.max(initial=-1)) + 1 - len(self.start))
        if more:
            self.start = np.r_[self.start, np.zeros(more, np.int64)]
            self.count = np.r_[self.count, np.zeros(more, np.int64)]
        self.start[numbers] = len(self.flat) + np.cumsum(count) - count
        self.count[numbers] = count
        self.flat = np.r_[self.flat, flat]

    def take(self, numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs of `lengths` numbers, flat, and how many each run has."""
        counts = self.count[numbers]
        through = np.cumsum(counts)
        place = np.repeat(self.start[numbers] - through + counts, counts)
        place += np.arange(len(place))
        return self.flat[place], np.diff(np.r_[0, through][np.r_[0, np.cumsum(lengths)]])


class WordBPE:
    """Encoder and decoder for a `tokenizers` BPE file with an end-of-word suffix."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        known = vocab | self.special
        self.size = max(known.values()) + 1
        self.tokens = [""] * self.size
        for token, number in known.items():
            self.tokens[number] = token
        suffix = model["end_of_word_suffix"] or ""
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._start_afresh()

    def _start_afresh(self) -> None:
        self.words = _Remembered()
        self.lists = _Lists()
        for content, number in self.special.items():
            self.words[content] = len(self.words)
            self.lists.add(np.array([number], np.int32), np.ones(1, np.int64), np.array([len(self.words) - 1]))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many non-empty pieces, flat, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        sym[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            same = np.flatnonzero(owner[1:] == owner[:-1])
            rank[same] = self._rank(sym[same], sym[same + 1])
        out_sym, out_owner = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.r_[starts, len(sym)])
            best = np.repeat(best, spans)
            over = best == NONE
            if over.any():
                out_sym.append(sym[over])
                out_owner.append(owner[over])
                live = ~over
                sym, owner, rank, best = sym[live], owner[live], rank[live], best[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            if len(at) > 1 and (close := np.diff(at) == 1).any():
                # "aaa": of pairs that overlap, the leftmost goes first, then every second one
                run = np.r_[True, ~close]
                first = np.flatnonzero(run)
                place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
                at = at[place % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            now = np.cumsum(keep)[at] - 1
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            near = np.zeros(len(sym), bool)
            near[now] = True
            near[now[now > 0] - 1] = True
            again = np.flatnonzero(near)
            inside = again[again + 1 < len(sym)]
            joined = owner[inside] == owner[inside + 1]
            rank[again] = NONE
            inside = inside[joined]
            rank[inside] = self._rank(sym[inside], sym[inside + 1])
        if not out_sym:
            return np.empty(0, np.int32), np.zeros(len(pieces), np.int64)
        owner = np.concatenate(out_owner)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(out_sym)[order], np.bincount(owner, minlength=len(pieces))

    def _words_of(self, text: str) -> list[str]:
        """The text without white space; no piece of the pattern crosses any."""
        if "<|" in text:
            out: list[str] = []
            for k, part in enumerate(self.specials.split(text)):
                out += [part] if k % 2 else self._split(part)
            return out
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        plain = self._plain(text)
        # str.split() also cuts at four control characters that the vocabulary encodes
        return plain.split() if not _separators.search(plain) else [w for w in _space.split(plain) if w]

    @staticmethod
    def _plain(text: str) -> str:
        if text.isascii():
            return text.lower()
        # lower-cased character by character: no final sigma
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _learn(self) -> None:
        """Encode the words not seen before; those of several pieces are put together from their pieces,
        which are words like others."""
        new, first = self.words.new, len(self.lists.start)
        whole, parts = [], []
        for at, word in enumerate(new):  # grows as pieces are met
            if word.isalpha():
                whole.append(at)
            elif len(found := self.pattern.findall(word)) == 1 and found[0] == word:
                whole.append(at)
            else:
                parts.append((at, [self.words[p] for p in found]))
        self.words.new = []
        flat, count = self.merge([new[at].encode() for at in whole])
        self.lists.add(flat, count, first + np.array(whole, np.int64))
        if parts:
            lengths = np.fromiter((len(x) for _, x in parts), np.int64, len(parts))
            numbers = np.fromiter(chain.from_iterable(x for _, x in parts), np.int64, int(lengths.sum()))
            self.lists.add(*self.lists.take(numbers, lengths), first + np.fromiter((x for x, _ in parts), np.int64, len(parts)))

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the number of ids of each."""
        if len(self.words) > REMEMBERED:
            self._start_afresh()
        found = list(map(self._words_of, batch))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        numbers = np.fromiter(map(self.words.__getitem__, chain.from_iterable(found)), np.int64, int(lengths.sum()))
        if self.words.new:
            self._learn()
        return self.lists.take(numbers, lengths)

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings joined by blanks: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


_built: dict[str, WordBPE] = {}


def encoder(spec: str) -> WordBPE:
    """One encoder for each vocabulary in a worker process."""
    key = hashlib.sha1(spec.encode()).hexdigest()
    if key not in _built:
        _built[key] = WordBPE(spec)
    return _built[key]


def read_spec(path: str) -> str:
    """The tokenizer file, read once by the driver; its size does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", end_id: int | None = None) -> DataFrame:
    """docs with a column `ids` (array<int>); `end_id`, if given, closes every text. Row order is kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))
    kept = [c for c in docs.columns if c != ids]
    docs = docs.select(*kept)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, `{ids}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(spec.value)
        for batch in slices(batches, text, 4 << 20):
            flat, counts = model.encode(texts(batch, text))
            if end_id is not None:
                stops = np.cumsum(counts)
                flat, counts = np.insert(flat, stops, end_id), counts + 1
            offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
            array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, array], [*batch.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens with a column `text`: the decoded ids; a null list decodes to the empty text."""
    spark = tokens.sparkSession
    bounded_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))
    tokens = tokens.select(*[c for c in tokens.columns if c != text])
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in tokens.schema)}, `{text}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(spec.value)
        for batch in batches:
            out = [model.decode(x or []) for x in column(batch, ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, text])

    return tokens.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding of every text in one pass,
    so that neither ids nor decoded texts leave the worker unless `with_ids` asks for the ids."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(spec.value)
        sha = hashlib.sha256
        for batch in slices(batches, "text", 4 << 20):
            flat, counts = model.encode(texts(batch))
            stops = np.cumsum(counts).tolist()
            raw, start, ids_sha, text_sha = flat.astype("<u4"), 0, [], []
            for stop in stops:
                own = raw[start:stop]
                ids_sha.append(sha(own.tobytes()).hexdigest())
                text_sha.append(sha(model.decode(own.tolist()).encode()).hexdigest())
                start = stop
            out = [column(batch, "doc_id").cast(pa.int64()), pa.array(counts.astype(np.int64)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32))))
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
