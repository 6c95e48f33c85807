"""Bytes to text: byte-order marks, UTF-16 without one, UTF-8, Windows-1252, and repair of text decoded twice."""

from __future__ import annotations

from dataclasses import dataclass

#: Traces of UTF-8 that was read as Windows-1252.
ARTIFACTS = ("Ã©", "Ã¨", "Ã¼", "Ã¶", "Ã¤", "Ã±", "Ã§", "Ã ", "â€™", "â€œ", "â€\x9d", "â€“", "â€”", "â€¦", "Â«", "Â»", "Â°", "Ã‰")
MOST = 200
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))


@dataclass(frozen=True)
class Decoded:
    text: str
    encoding: str = "utf-8"
    had_mark: bool = False
    repairs: int = 0


def _strict(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def _zeros(data: bytes, parity: int) -> float:
    part = data[:512][parity::2]
    return part.count(0) / len(part) if len(data) >= 8 else 0.0


def artifacts(text: str) -> int:
    total = 0
    for trace in ARTIFACTS:
        total += text.count(trace)
        if total > MOST:
            return MOST + 1
    return total


def decode(data: bytes) -> Decoded:
    """The text of a file, whatever it was written in; never fails."""
    mark = next(((m, e) for m, e in MARKS if data.startswith(m)), None)
    body = data[len(mark[0]) :] if mark else data
    text, encoding = (_strict(body, mark[1]), mark[1]) if mark else (None, "utf-8")
    if text is None:
        for encoding, fits in (("utf-16le", _zeros(body, 1) > 0.7), ("utf-16be", _zeros(body, 0) > 0.7), ("utf-8", True), ("windows-1252", True)):
            text = _strict(body, "cp1252" if encoding == "windows-1252" else encoding) if fits else None
            if text is not None:
                break
        else:
            text, encoding = body.decode("latin-1"), "iso-8859-1"
    repairs, before = 0, artifacts(text)
    if before:
        try:
            repaired = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            repaired = text
        if (after := artifacts(repaired)) < before:
            text, repairs = repaired, before - after
    return Decoded(text.replace("﻿", ""), encoding, mark is not None, repairs)
