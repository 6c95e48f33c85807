"""Text cleaning: tags, entities, Unicode forms, invisible characters, quotes, dashes, runs and white space.

Everything is native but entity decoding and Unicode forms, which go through Arrow; where only one of them is asked for, only for rows that need it.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import trim

#: Invisible characters, replacements, entities.
ZERO_WIDTH = "​‌‍⁠﻿­᠎"
QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "«": '"', "»": '"', "‹": "'", "›": "'", "`": "'", "´": "'"}
DASHES = "—–‒―−"
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™",
    "mdash": "—", "ndash": "–", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "eacute": "é", "egrave": "è", "agrave": "à", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß", "ccedil": "ç", "ntilde": "ñ",
    "deg": "°", "euro": "€", "pound": "£", "yen": "¥", "sect": "§", "para": "¶", "middot": "·", "laquo": "«", "raquo": "»",
    "times": "×", "divide": "÷", "plusmn": "±", "frac12": "½", "frac14": "¼",
}
#: Elements that leave with what they hold; elements that leave a line end.
DROPPED = ("script", "style", "head", "noscript", "svg")
BLOCKS = "p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|blockquote|pre"
#: What is replaced by what, in this order, to strip tags. The patterns mean the same to the JVM, to Python and to RE2.
TAG_STEPS = (
    *((rf"(?i)<{tag}[^>]*>[\s\S]*?</{tag}>", " ") for tag in DROPPED),
    (r"<!--[\s\S]*?-->", " "),
    (rf"(?i)</?({BLOCKS})[^>]*>", "\n"),
    (r"<[^>]+>", ""),
    (r"[ \t]+", " "),
    (r" ?\n ?", "\n"),
    (r"\n{3,}", "\n\n"),
)

_entity = re.compile(r"&([^;]{0,10});")


@dataclass(frozen=True)
class NormalizeOptions:
    unicode_form: str = "nfc"  # none, nfc, nfkc
    trim_whitespace: bool = True
    collapse_inner_whitespace: bool = False
    strip_control_characters: bool = True
    strip_zero_width: bool = True
    canonicalize_quotes: bool = False
    canonicalize_dashes: bool = False
    decode_html_entities: bool = False
    strip_html_tags: bool = False
    collapse_repeated_punctuation: bool = False
    normalize_newlines: bool = True
    lowercase: bool = False


STANDARD = NormalizeOptions()
AGGRESSIVE = NormalizeOptions(unicode_form="nfkc", collapse_inner_whitespace=True, canonicalize_quotes=True, canonicalize_dashes=True, decode_html_entities=True, strip_html_tags=True, collapse_repeated_punctuation=True)


def strip_tags(c: Column) -> Column:
    """Without tags; block elements leave line ends, scripts and the like leave with what they hold."""
    for pattern, instead in TAG_STEPS:
        c = F.regexp_replace(c, pattern, instead)
    return trim(c)


def decode_entity(body: str) -> str | None:
    try:
        if body[:2] in ("#x", "#X"):
            code = int(body[2:], 16) if re.fullmatch(r"\+?[0-9a-fA-F]+", body[2:]) else -1
        elif body[:1] == "#":
            code = int(body[1:]) if re.fullmatch(r"\+?[0-9]+", body[1:]) else -1
        else:
            return ENTITIES.get(body)
        return None if code < 0 or 0xD800 <= code <= 0xDFFF else chr(code)
    except (ValueError, OverflowError):
        return None


def decode_entities_text(text: str) -> str:
    """&name; from a short list, &#n; and &#xh;, in one pass; a semicolon must follow within twelve characters."""
    out, at = [], 0
    while (start := text.find("&", at)) >= 0:
        out.append(text[at:start])
        m = _entity.match(text, start)
        decoded = decode_entity(m[1]) if m else None
        if decoded is None:
            out.append("&")
            at = start + 1
        else:
            out.append(decoded)
            at = m.end()
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _entities(values: pd.Series) -> pd.Series:
    return values.map(decode_entities_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _entities_nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unicodedata.normalize("NFC", decode_entities_text(x)) if "&" in x or not x.isascii() else x, na_action="ignore")


@F.pandas_udf(T.StringType())
def _entities_nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unicodedata.normalize("NFKC", decode_entities_text(x)) if "&" in x or not x.isascii() else x, na_action="ignore")


def decode_entities(c: Column) -> Column:
    return F.coalesce(_entities(F.when(F.contains(c, F.lit("&")), c)), c)


def unicode_form(c: Column, form: str) -> Column:
    if form == "none":
        return c
    return F.coalesce((_nfc if form == "nfc" else _nfkc)(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def decoded_form(c: Column, form: str) -> Column:
    """`decode_entities`, then `unicode_form`, in one Python worker instead of one for each. All rows go there: to choose them
    would compute c, such as stripped tags, once more for each time it is named."""
    if form == "none":
        return decode_entities(c)
    both = _entities_nfc if form == "nfc" else _entities_nfkc
    return both(c)


def normalize(c: Column, options: NormalizeOptions = STANDARD) -> Column:
    """A string column cleaned in a fixed order; null stays null."""
    if options.strip_html_tags:
        c = strip_tags(c)
    c = decoded_form(c, options.unicode_form) if options.decode_html_entities else unicode_form(c, options.unicode_form)
    if options.strip_zero_width:
        c = F.translate(c, ZERO_WIDTH, "")
    if options.strip_control_characters:
        c = F.regexp_replace(c, r"[\p{Cc}&&[^\n\t\r]]", "")
    if options.normalize_newlines:
        c = F.regexp_replace(c, r"\r\n?", "\n")
    if options.canonicalize_quotes:
        c = F.translate(c, "".join(QUOTES), "".join(QUOTES.values()))
    if options.canonicalize_dashes:
        c = F.translate(c, DASHES, "-" * len(DASHES))
    if options.collapse_repeated_punctuation:
        c = F.regexp_replace(F.regexp_replace(c, r"\.{4,}", "..."), r"([!?,;:])\1+", "$1")
    if options.collapse_inner_whitespace:
        c = F.regexp_replace(F.regexp_replace(c, r"[ \t\x{00A0}]+", " "), r"\n{3,}", "\n\n")
    if options.trim_whitespace:
        c = trim(c)
    return F.lower(c) if options.lowercase else c
