"""Cells: their kinds, how they are shown, compared and trimmed. All of it native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Row identity and order; readers assign it, operators keep it, outputs hide it.
RID = "_rid"
#: Character classes as Java and RE2 both read them: any white space or line end, and white space within a line.
SPACE, BLANK = r"\p{Z}\t-\r\x{85}", r"\p{Zs}\t"
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def kind_of(data_type: T.DataType) -> str:
    """null, bool, int, double, string or date."""
    if isinstance(data_type, T.NullType):
        return "null"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "double"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    return "string"


SPARK_TYPES = {"null": "string", "bool": "boolean", "int": "bigint", "double": "double", "string": "string", "date": "timestamp"}


def show_double(c: Column) -> Column:
    """1.0, 0.25, 12345678.9, 1.5e+20: whole numbers below 1e15 with one decimal, else the shortest digits."""
    text = c.cast("string")
    mantissa, power = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1).try_cast("int")
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"[-.]", ""), r"(?<=.)0+$", "")
    long = F.concat(sign, F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.lit("."), F.when(F.length(digits) > power + 1, F.substring(digits, power + 2, F.length(digits))).otherwise(F.lit("0")))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    exponent = F.concat(F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), 2, "0"))
    scientific = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), exponent)
    whole = F.concat(c.try_cast("bigint").cast("string"), F.lit(".0"))
    odd = F.when(F.isnan(c), F.lit("nan")).when(c == float("inf"), F.lit("inf")).when(c == float("-inf"), F.lit("-inf"))
    shown = F.when((c == 0) & text.startswith("-"), F.lit("-0.0")).when((c == F.floor(c)) & (F.abs(c) < 1e15), whole)
    shown = shown.when(~F.contains(text, F.lit("E")), text).when((power >= 7) & (F.abs(c) <= 2.0**53), long).when((power < 0) & (power >= -4), small)
    return F.coalesce(odd, shown.otherwise(scientific))


def show(c: Column, kind: str) -> Column:
    """The text of a cell; null shows as the empty string."""
    if kind == "null":
        return F.lit("")
    if kind == "string":
        shown = c.cast("string")
    elif kind == "date":
        shown = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    elif kind == "double":
        shown = show_double(c.cast("double"))
    else:
        shown = c.cast("string")
    return F.coalesce(shown, F.lit(""))


def number(c: Column, kind: str) -> Column:
    """The cell as a double; strings are never numbers."""
    if kind == "bool":
        return c.cast("int").cast("double")
    return c.cast("double") if kind in ("int", "double") else F.lit(None).cast("double")


def truthy(c: Column, kind: str) -> Column:
    """A two-valued reading of any cell."""
    if kind == "null":
        return F.lit(False)
    if kind == "bool":
        return F.coalesce(c, F.lit(False))
    if kind in ("int", "double"):
        return F.coalesce(c != 0, F.lit(False))
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    return c.isNotNull()


def trim(c: Column) -> Column:
    """Without white space and line ends at either side."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def trim_blanks(c: Column) -> Column:
    """Without blanks and tabs at either side."""
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def stable_hash(text: str) -> int:
    """FNV-1a, 64 bits, over UTF-8."""
    h = FNV_OFFSET
    for byte in text.encode():
        h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def unique_name(base: str, taken: list[str]) -> str:
    """base, base_2, base_3, … whichever is free."""
    name, n = base, 2
    while name in taken:
        name, n = f"{base}_{n}", n + 1
    return name
