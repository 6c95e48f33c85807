"""Personal data and secrets: detection by pattern and checksum, and redaction.

Patterns claim spans in order of priority; a later match that meets a claimed span is passed over. That needs
arithmetic on spans over all patterns, so a text goes once through Python (Arrow), and only if it could hold a match.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import stable_hash

MODES = ("tag", "hash", "remove")
#: The patterns, in order of priority.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}",
    "url_credentials": r"[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/:@]+:[^\s/@]+@[^\s]+",
    "apiKey": r"(sk-[A-Za-z0-9_-]{20,}|sk-ant-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|gho_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|ya29\.[0-9A-Za-z_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})",
    "iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
    "creditCard": r"\b(?:\d[ -]?){13,19}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ipAddress": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\b|\b(?:[0-9a-fA-F]{1,4}:){4,7}[0-9a-fA-F]{1,4}\b",
    "phone": r"(?<![\d.\w])(\+?[0-9]{1,3}[ .-]?)?(\(?\d{2,4}\)?[ .-]?)\d{3,4}[ .-]?\d{3,5}(?![\d.])",
}
KINDS = tuple(PATTERNS)
#: Addresses of the own machine.
LOCAL = ("0.0.0.0", "127.0.0.1", "::1")
#: Without one of these no pattern matches: an at sign, a digit of any script (or a sign that the JVM does not know, as it may be one),
#: the start of a key, a group of an IPv6 address of letters alone.
ABLE = r"[@\p{Nd}\p{Cn}]|sk-|AKIA|gh[po]_|github_pat_|xox[baprs]-|AIza|eyJ|:[a-fA-F]{1,4}:"
_compiled = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}


def luhn(digits: str) -> bool:
    if not 13 <= len(digits) <= 19 or len(set(digits)) < 2:
        return False
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    if not 15 <= len(text) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdecimal())


def _phone(text: str) -> bool:
    return 8 <= len(_digits(text)) <= 15 and any(c in "+- .()" for c in text)


CHECKS = {
    "iban": iban,
    "creditCard": lambda s: luhn(_digits(s)),
    "ssn": lambda s: not s.startswith(("000", "666", "9")),
    "ipAddress": lambda s: s not in LOCAL,
    "phone": _phone,
}


def detect(text: str, kinds: tuple[str, ...] = ()) -> list[tuple[int, int, str]]:
    """start, end, kind of each match, in the order of the text."""
    found: list[tuple[int, int, str]] = []
    for kind in KINDS:
        if kinds and kind not in kinds:
            continue
        for m in _compiled[kind].finditer(text):
            start, end = m.span()
            if end > start and not any(a < end and start < b for a, b, _ in found) and CHECKS.get(kind, lambda s: True)(m[0]):
                found.append((start, end, kind))
    return sorted(found)


def redact_text(text: str, kinds: tuple[str, ...] = (), mode: str = "tag") -> tuple[str, Counter]:
    out, done, counts = [], 0, Counter()
    for start, end, kind in detect(text, kinds):
        counts[kind] += 1
        mark = {"tag": f"[{kind.upper()}]", "remove": ""}.get(mark_of := mode)
        if mark is None:
            mark = f"[{kind.upper()}:{stable_hash(text[start:end]) & 0xFFFFFFFF:08x}]" if mark_of == "hash" else ""
        out += [text[done:start], mark]
        done = end
    return "".join([*out, text[done:]]), counts


def redact(c: Column, kinds: tuple[str, ...] = (), mode: str = "tag") -> Column:
    """struct(text, counts map<string,int>); null for null."""
    kinds = tuple(kinds)

    @F.pandas_udf("text string, counts map<string,int>")
    def run(values: pd.Series) -> pd.DataFrame:
        done = [(None, None) if x is None else redact_text(x, kinds, mode) for x in values]
        return pd.DataFrame({"text": [a for a, _ in done], "counts": [None if b is None else dict(b) for _, b in done]})

    able = F.when(c.rlike(ABLE), c)
    found = run(able)
    return F.when(found["text"].isNotNull(), found).otherwise(F.when(c.isNotNull(), F.struct(c.alias("text"), F.create_map().cast("map<string,int>").alias("counts"))))
