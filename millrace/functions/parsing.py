"""Types of text cells: inference from a sample and deterministic conversion, the same for every locale."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import show, trim_blanks

#: What counts as missing, as true and false; how many cells of a sample must fit a type.
SENTINELS = ("", "na", "n/a", "nan", "null", "none", "nil", "-", "--", "?", "missing", "#n/a", "#null!", "(null)", "undefined")
TRUE, FALSE = ("true", "yes", "y", "t", "1️⃣"), ("false", "no", "n", "f")
SHARE, SAMPLE = 0.95, 500
TYPES = ("int", "double", "bool", "date", "string")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_months = {name: k for k, name in enumerate(MONTHS, 1)} | {name[:3]: k for k, name in enumerate(MONTHS, 1)} | {"sept": 9}
_blanks = re.compile(r"^[^\S\n\r\x0b\x0c\x85  \x1c-\x1f]+|[^\S\n\r\x0b\x0c\x85  \x1c-\x1f]+$")
_iso = re.compile(r"(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(\.\d+)?(Z|[+-]\d{2}:?\d{2})")
_whole = re.compile(r"[+-]?\d+")
_decimal = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def strip_blanks(text: str) -> str:
    return _blanks.sub("", text)


def is_sentinel(text: str) -> bool:
    return strip_blanks(text).lower() in SENTINELS


def parse_int(t: str) -> int | None:
    if "," in t:
        head, *groups = [x for x in t.split(",") if x]
        if not groups or not all(len(g) == 3 and g.isdigit() for g in groups):
            return None
        t = t.replace(",", "")
    if not t or len(t) > 20 or not _whole.fullmatch(t):
        return None
    value = int(t)
    return value if -(2**63) <= value < 2**63 else None


def parse_double(t: str) -> float | None:
    if t.endswith("%"):
        inner = parse_double(t[:-1])
        return None if inner is None else inner / 100
    if "," in t and "." in t:
        t = t.replace(".", "").replace(",", ".") if t.rindex(",") > t.rindex(".") else t.replace(",", "")
    elif "," in t:
        parts = [x for x in t.split(",") if x]
        t = t.replace(",", "." if len(parts) == 2 and len(parts[1]) != 3 else "")
    if t.lower() in ("nan", "+nan", "-nan"):
        return float("nan")
    return float(t) if _decimal.fullmatch(t) else None


def parse_bool(t: str) -> bool | None:
    t = t.lower()
    return True if t in TRUE else False if t in FALSE else None


def _number(t: str) -> int | None:
    return int(t) if _whole.fullmatch(t) and t.isascii() else None


def _date(y: int, m: int, d: int) -> datetime | None:
    try:
        return datetime(y, m, d)
    except ValueError:
        return None


def parse_date(text: str) -> datetime | None:
    """A moment in UTC. Which of two numbers is the day follows from their size; where both could be, a dot
    means day first, a slash or dash month first."""
    t = strip_blanks(text)
    if not 6 <= len(t) <= 40:
        return None
    if "T" in t or (len(t) > 10 and ":" in t):
        if m := _iso.fullmatch(t):
            day = _date(int(m[1]), int(m[2]), int(m[3]))
            hour, minute, second = int(m[4]), int(m[5]), int(m[6])
            if day and hour < 24 and minute < 60 and second < 60:
                zone = m[8].replace(":", "")
                shift = 0 if zone == "Z" else (int(zone[1:3]) * 60 + int(zone[3:5])) * (1 if zone[0] == "+" else -1)
                return day + timedelta(hours=hour, minutes=minute - shift, seconds=second, microseconds=int(round(float(m[7] or 0) * 1e6)))
        found = _date_time(t)
        if found:
            return found
    if t.isnumeric():
        if not t.isascii():
            return None
        if len(t) == 10 and int(t) > 631_152_000:
            return datetime.fromtimestamp(int(t), UTC).replace(tzinfo=None)
        if len(t) == 13:
            return datetime(1970, 1, 1) + timedelta(milliseconds=int(t))
        y, m, d = (int(t[:4]), int(t[4:6]), int(t[6:])) if len(t) == 8 else (0, 0, 0)
        return _date(y, m, d) if 1900 <= y <= 2100 else None
    return _year_first(t) or _day_or_month_first(t) or _month_name(t)


def _date_time(t: str) -> datetime | None:
    parts = [x for x in t.split(" ", 1) if x]
    base = parse_date(parts[0]) if len(parts) == 2 else None
    if base is None:
        return None
    time = [x for x in parts[1].split(":") if x]
    numbers = [_number(x) for x in time[:2]]
    if len(numbers) < 2 or None in numbers:
        return base
    second = (_number(time[2][:2]) or 0) if len(time) > 2 else 0
    return base + timedelta(hours=numbers[0], minutes=numbers[1], seconds=second)


def _three(t: str, sep: str) -> list[int] | None:
    parts = [_number(x) for x in t.split(sep) if x]
    return parts if len(parts) == 3 and None not in parts else None


def _year_first(t: str) -> datetime | None:
    for sep in "-/":
        found = _three(t, sep)
        if found and 1000 <= found[0] <= 9999 and 1 <= found[1] <= 12 and 1 <= found[2] <= 31:
            return _date(*found)
    return None


def _day_or_month_first(t: str) -> datetime | None:
    for sep in "/.-":
        found = _three(t, sep)
        if not found:
            continue
        a, b, y = found
        if y < 100:
            y += 2000 if y < 50 else 1900
        if not 1900 <= y <= 2100 or (a > 12 and b > 12):
            continue
        day_first = a > 12 or (b <= 12 and sep == ".")
        return _date(y, b, a) if day_first else _date(y, a, b)
    return None


def _month_name(t: str) -> datetime | None:
    month = day = year = None
    words = [w.lower() for w in t.replace(",", " ").split(" ") if w]
    for word in words:
        if word in _months:
            month = _months[word]
        elif (n := _number(word.strip("stndrh"))) is not None:
            if n > 31:
                year = n
            elif day is None:
                day = n
            elif year is None:
                year = n
    if len(words) < 3 or None in (month, day, year) or not (1 <= day <= 31 and 1000 <= year <= 9999):
        return None
    return _date(year, month, day)


def infer_type(samples: list[str]) -> str:
    """The first type, of bool, int, double and date, that 95 % of the cells fit; else string."""
    cells = [strip_blanks(x) for x in samples if not is_sentinel(x)][:SAMPLE]
    if not cells:
        return "string"
    bools = sum(parse_bool(x) is not None for x in cells)
    ints = [parse_int(x) is not None for x in cells]
    doubles = [not i and parse_double(x) is not None for i, x in zip(ints, cells, strict=True)]
    dates = [not i and not d and parse_date(x) is not None for i, d, x in zip(ints, doubles, cells, strict=True)]
    least = SHARE * len(cells)
    for name, count in (("bool", bools), ("int", sum(ints)), ("double", sum(ints) + sum(doubles)), ("date", sum(dates))):
        if count / len(cells) >= SHARE and count >= least - 1e-9:
            return name
    return "string"


def missing(c: Column) -> Column:
    """Whether a string cell is one of the ways to write that nothing is there."""
    return F.lower(trim_blanks(c)).isin(*SENTINELS)


def to_int(t: Column) -> Column:
    plain = F.when(t.rlike(r"^[^,]*(,\d{3})+$"), F.replace(t, F.lit(","))).when(~F.contains(t, F.lit(",")), t)
    return F.when((F.length(plain) <= 20) & plain.rlike(r"^[+-]?\d+$"), plain).try_cast("bigint")


def to_double(t: Column) -> Column:
    share = t.endswith("%")
    t = F.regexp_replace(t, "%$", "")
    comma, dot = F.length(t) - F.instr(F.reverse(t), ","), F.length(t) - F.instr(F.reverse(t), ".")
    has_comma, has_dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    european = F.replace(F.replace(t, F.lit(".")), F.lit(","), F.lit("."))
    without = F.replace(t, F.lit(","))
    parts = F.filter(F.split(t, ","), lambda x: x != "")
    lone = F.when((F.size(parts) == 2) & (F.length(F.try_element_at(parts, F.lit(2))) != 3), F.replace(t, F.lit(","), F.lit("."))).otherwise(without)
    plain = F.when(has_comma & has_dot, F.when(comma > dot, european).otherwise(without)).when(has_comma, lone).otherwise(t)
    value = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain).try_cast("double")
    return F.when(share, value / 100.0).otherwise(value)


def to_bool(t: Column) -> Column:
    low = F.lower(t)
    return F.when(low.isin(*TRUE), F.lit(True)).when(low.isin(*FALSE), F.lit(False))


@F.pandas_udf(T.TimestampNTZType())
def _dates(values: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else parse_date(x) for x in values], dtype="datetime64[us]")


def coerce(c: Column, kind: str, target: str) -> Column:
    """A column of one kind as another type; what does not convert is null, and so is any way to write "missing"."""
    if target not in TYPES:
        raise ValueError(f"no type {target!r}")
    if kind in ("string", "null"):
        text = c.cast("string")
        t = F.when(~missing(text), trim_blanks(text))
        if target == "date":
            return _dates(t).cast("timestamp")
        return {"int": to_int, "double": to_double, "bool": to_bool, "string": lambda x: F.when(x.isNotNull(), text)}[target](t)
    if target == "string":
        return F.when(c.isNotNull(), show(c, kind))
    as_double = c.cast("int").cast("double") if kind == "bool" else c.cast("double") if kind in ("int", "double") else F.lit(None).cast("double")
    if target == "double":
        return as_double
    if target == "int":
        return c.cast("bigint") if kind == "int" else F.when(as_double == F.round(as_double, 0), as_double).try_cast("bigint")
    same = {"bool": "boolean", "date": "timestamp"}[target]
    return c.cast(same) if kind == target else F.lit(None).cast(same)
