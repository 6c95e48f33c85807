"""Token counts: a native estimate, or byte-pair encoding with a given vocabulary file."""

from __future__ import annotations

import base64
import math
import re
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ParseFailure

#: Classes that the estimate counts by.
CJK = r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"
PIECES = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


class Tokenizer(Protocol):
    name: str

    def encode(self, text: str) -> list[int]: ...

    def count(self, text: str) -> int: ...

    def column(self, text: Column) -> Column: ...


def estimate(text: Column) -> Column:
    """About four letters or two digits and signs a token; one for each CJK character; spaces add a little.

    Spaces and signs are counted, being few; letters are what is left.
    """
    wide = F.when(text.rlike(f"[{CJK}]"), F.regexp_count(text, F.lit(f"[{CJK}]"))).otherwise(F.lit(0))
    plain = text
    for c in " \t\n\r":
        plain = F.replace(plain, F.lit(c))
    spaces = F.octet_length(text) - F.octet_length(plain)
    signs = F.regexp_count(text, F.lit(rf"[^\p{{IsAlphabetic}} \t\n\r{CJK}]|[0-9]"))
    letters = F.length(text) - wide - spaces - signs
    total = letters / 4.0 + spaces * 0.08 + wide + signs / 2.0
    count = F.greatest(F.lit(1), F.floor(total + 0.5)).cast("bigint")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(count)


class Estimator:
    name = "estimator"
    _wide = re.compile("[一-鿿぀-ヿ가-힯]")
    _space = re.compile("[ \t\n\r]")

    def encode(self, text: str) -> list[int]:
        return [0] * self.count(text)

    def count(self, text: str) -> int:
        if not text:
            return 0
        wide, spaces = len(self._wide.findall(text)), len(self._space.findall(text))
        letters = sum(map(str.isalpha, text)) - wide
        total = letters / 4.0 + spaces * 0.08 + wide + (len(text) - wide - spaces - letters) / 2.0
        return max(1, math.floor(total + 0.5))

    def column(self, text: Column) -> Column:
        return estimate(text)


class Ranked:
    """Byte-pair encoding from a file of lines "base64 rank"."""

    name = "bpe"

    def __init__(self, path: str, pattern: str = PIECES):
        self.path, self.pattern = path, pattern
        with open(path, "rb") as f:
            lines = f.read().split(b"\n")
        self.ranks = {}
        for line in lines:
            parts = line.split()
            if len(parts) == 2:
                self.ranks[base64.b64decode(parts[0])] = int(parts[1])
        if len(self.ranks) < 1001:
            raise ParseFailure(f"no vocabulary in {path}")
        self._encoding = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoding": None}

    def _ready(self):
        if self._encoding is None:
            import tiktoken

            self._encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self._encoding

    def encode(self, text: str) -> list[int]:
        return self._ready().encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def column(self, text: Column) -> Column:
        @F.pandas_udf("bigint")
        def counts(values: pd.Series) -> pd.Series:
            return values.fillna("").map(self.count)

        return counts(text)


def provider(vocabulary: str | None = None) -> Tokenizer:
    """Encoding where a vocabulary file is named, else the estimate."""
    return Ranked(vocabulary) if vocabulary else Estimator()
