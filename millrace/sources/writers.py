"""Writers: delimited text, JSON lines, a JSON list, Parquet; distributed, and as one text for small results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ExportFailure
from ..functions.values import RID, kind_of, show
from ..operators.shaping import natural


def _shown(df: DataFrame) -> list[Column]:
    return [show(F.col(f"`{f.name}`"), kind_of(f.dataType)).alias(f.name) for f in df.schema.fields if f.name != RID]


def _quoted(c: Column, delimiter: str) -> Column:
    special = F.contains(c, F.lit('"')) | F.contains(c, F.lit(delimiter)) | F.contains(c, F.lit("\n")) | F.contains(c, F.lit("\r"))
    return F.when(special, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def delimited_lines(df: DataFrame, delimiter: str = ",") -> Column:
    """Each row as a line; fields are quoted only if they must be."""
    names = [f.name for f in df.schema.fields if f.name != RID]
    return F.concat_ws(delimiter, *[_quoted(c, delimiter) for c in _shown(df)]) if names else F.lit("")


def header_line(df: DataFrame, delimiter: str = ",") -> str:
    def quoted(x: str) -> str:
        return '"' + x.replace('"', '""') + '"' if any(c in x for c in ('"', delimiter, "\n", "\r")) else x

    return delimiter.join(quoted(c) for c in df.columns if c != RID)


def json_lines(df: DataFrame) -> Column:
    """Each row as JSON, keys sorted, nulls written out."""
    fields = sorted((f for f in df.schema.fields if f.name != RID), key=lambda f: f.name)
    return F.to_json(F.struct(*[natural(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def write(df: DataFrame, path: str, format: str, *, split: str | None = None) -> None:
    """Write in parallel below `path`: csv, tsv, jsonl or parquet; only one split if it is named.

    Delimited text keeps white space at either side of a cell, and quotes the cells of a single column, where an empty one would be a blank line.
    """
    if split and "split" in df.columns:
        df = df.where(F.col("split") == split)
    try:
        if format in ("csv", "tsv"):
            mark = "," if format == "csv" else "\t"
            cells = _shown(df)
            kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "quoteAll": len(cells) == 1}
            df.select(*cells).write.options(header=True, sep=mark, quote='"', escape='"', emptyValue="", nullValue="", **kept).csv(path)
        elif format == "jsonl":
            df.select(json_lines(df).alias("value")).write.text(path)
        elif format == "parquet":
            df.drop(RID).write.parquet(path)
        else:
            raise ExportFailure(f"no format {format!r}")
    except ExportFailure:
        raise
    except Exception as e:
        raise ExportFailure(str(e).splitlines()[0]) from e


def to_text(df: DataFrame, format: str) -> str:
    """A small result as one text: csv, tsv, jsonl or json (a list), in row order."""
    ordered = df.orderBy(RID) if RID in df.columns else df
    if format in ("csv", "tsv"):
        mark = "," if format == "csv" else "\t"
        lines = [r[0] for r in ordered.select(delimited_lines(df, mark)).collect()]
        return "\n".join([header_line(df, mark), *lines]) + "\n"
    lines = [r[0] for r in ordered.select(json_lines(df)).collect()]
    if format == "jsonl":
        return "".join(f"{x}\n" for x in lines)
    if format == "json":
        return "[\n" + ",\n".join(lines) + "\n]\n"
    raise ExportFailure(f"no format {format!r}")
