"""Readers: files of any supported kind to DataFrames with row ids.

Formats are told by extension or by the first bytes. Large inputs are read by Spark: JSON lines, delimited text and text
files line by line, folders file by file, with decoding and cutting in Arrow. What a small look at the file
decides (delimiter, header, names) is decided on the driver from its head.
"""

from __future__ import annotations

import os
import re
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import ParseFailure, UnreadableFile, UnsupportedFormat
from ..functions import chunks, text
from ..functions.values import RID
from ..plans.tables import bounded_batches, written
from . import encoding, parsers

#: Extensions and what they stand for.
EXTENSIONS = {
    "csv": "csv", "tsv": "tsv", "tab": "tsv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "md": "markdown", "markdown": "markdown",
    "html": "html", "htm": "html", "xhtml": "html", "db": "sqlite", "sqlite": "sqlite", "sqlite3": "sqlite", "txt": "text", "text": "text", "log": "text",
    "parquet": "parquet", "orc": "orc",
} | dict.fromkeys("swift py js ts rs go java c cpp h rb sh css yaml yml toml xml".split(), "code")
MODES = ("wholeFile", "paragraphs", "lines", "markdownSections")
HEAD = 1 << 20


@dataclass
class Imported:
    frame: DataFrame
    format: str
    details: dict[str, str] = field(default_factory=dict)


def detect_format(path: str, head: bytes = b"") -> str:
    extension = os.path.splitext(path)[1].lower().lstrip(".")
    if extension in EXTENSIONS:
        return EXTENSIONS[extension]
    start = head[:2048].decode("utf-8", "ignore").strip(chunks.SPACES)
    if start[:1] in ("{", "["):
        return "json"
    return "tsv" if "\t" in start and "\n" in start else "csv" if "," in start and "\n" in start else "text"


def _bytes(spark: SparkSession, path: str, most: int | None = None) -> bytes:
    """A file's bytes, or its head, through Spark's file systems."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    try:
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        size = files.getFileStatus(where).getLen()
        stream = files.open(where)
        try:
            return bytes(stream.readNBytes(min(size, most) if most is not None else size))
        finally:
            stream.close()
    except Exception as e:
        raise UnreadableFile(os.path.basename(path)) from e


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Dense ids from 0 in the frame's order, or that of columns: rows of each partition are counted, and a
    row's id is the count before its partition plus its place inside. The counts are joined, one row a partition."""
    sorted_ = df.orderBy(*order) if order else df
    rows = written(sorted_.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    starts = counts.select("__part", (before - F.shiftleft("__part", 33)).alias("__shift"))
    out = rows.withColumn("__part", part).join(starts, "__part")
    return out.select((F.col("__at") + F.col("__shift")).alias(RID), *[F.col(f"`{c}`") for c in df.columns])


def _kind(values: list) -> str:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {int} and all(-(2**63) <= v < 2**63 for v in values if v is not None) and kinds:
        return "bigint"
    if kinds and kinds <= {int, float}:
        return "double"
    return "boolean" if kinds == {bool} else "string"


def from_table(spark: SparkSession, table: parsers.Table) -> DataFrame:
    """A parsed file as a frame; columns of mixed kinds become text."""
    if not table.columns:
        return spark.createDataFrame([], f"{RID} bigint")
    kinds = [_kind([row[k] for row in table.rows]) for k in range(len(table.columns))]
    cast = {"string": lambda v: ("true" if v else "false") if isinstance(v, bool) else str(v), "double": float}
    rows = [(n, *[v if v is None or kind not in cast else cast[kind](v) for v, kind in zip(row, kinds, strict=True)]) for n, row in enumerate(table.rows)]
    schema = ", ".join(f"`{c.replace('`', '``')}` {k}" for c, k in zip(table.columns, kinds, strict=True))
    return spark.createDataFrame(rows, f"{RID} bigint, {schema}")


def split_text(content: str, mode: str) -> list[dict]:
    """The rows that a text gives in a mode."""
    if mode == "wholeFile":
        return [{"text": content}]
    if mode == "markdownSections":
        return [{"text": s.body, "heading": s.heading or None, "level": s.level, "position": k} for k, s in enumerate(chunks.sections(content))]
    parts = chunks.paragraphs(content) if mode == "paragraphs" else [x for line in re.split(r"\r\n|\n", content) if (x := chunks.strip_blanks(line))]
    return [{"text": x, "position": k} for k, x in enumerate(parts)]


def read_text(spark: SparkSession, content: str, source: str, mode: str) -> DataFrame:
    if mode not in MODES:
        raise UnsupportedFormat(mode)
    fields = {"wholeFile": "text string, source string", "markdownSections": "text string, heading string, level bigint, source string, position bigint"}.get(mode, "text string, source string, position bigint")
    names = [x.split()[0] for x in fields.split(", ")]
    rows = [(k, *[(row | {"source": source}).get(c) for c in names]) for k, row in enumerate(split_text(content, mode))]
    return spark.createDataFrame(rows, f"{RID} bigint, {fields}")


def _page(content: str) -> str:
    """The text of an HTML file: tags stripped, entities decoded. The same steps as the native columns."""
    for pattern, instead in text.TAG_STEPS:
        content = re.sub(pattern, instead, content)
    return text.decode_entities_text(content.strip(chunks.SPACES))


def read_file(spark: SparkSession, path: str, *, mode: str = "wholeFile", table: str | None = None) -> Imported:
    """One file of any supported format."""
    extension = os.path.splitext(path)[1].lower().lstrip(".")
    kind = detect_format(path, b"" if extension in EXTENSIONS else _bytes(spark, path, 2048))
    name = os.path.basename(path)
    if kind in ("parquet", "orc"):
        return Imported(numbered(spark.read.format(kind).load(path)), kind)
    if kind == "sqlite":
        return _read_sqlite(spark, path, table)
    decoded = encoding.decode(_bytes(spark, path))
    if kind in ("csv", "tsv"):
        found = parsers.read_delimited(decoded.text, "\t" if kind == "tsv" else None)
        return Imported(from_table(spark, found), kind, found.details | {"encoding": decoded.encoding})
    if kind in ("json", "jsonl"):
        found = parsers.read_json(decoded.text)
        return Imported(from_table(spark, found), kind, found.details)
    if kind == "markdown":
        return Imported(read_text(spark, decoded.text, name, "markdownSections" if mode == "wholeFile" else mode), kind)
    if kind == "html":
        return Imported(read_text(spark, _page(decoded.text), name, "paragraphs" if mode == "wholeFile" else mode), kind, {"stripped": "tags+entities"})
    return Imported(read_text(spark, decoded.text, name, mode), kind)


def scan_delimited(spark: SparkSession, path: str, *, delimiter: str | None = None, header: bool | None = None) -> DataFrame:
    """A large delimited file or folder, read in parallel; separator, header and names come from the head.

    Spark fixes the width by the header; use read_file for files whose rows are wider.
    """
    head = encoding.decode(_bytes(spark, path, HEAD)).text if not _is_folder(spark, path) else ""
    lines = head.rsplit("\n", 1)[0] if len(head) >= HEAD // 2 else head
    delimiter = delimiter or parsers.sniff_delimiter(lines)
    rows = parsers.parse_delimited(lines, delimiter)
    named = parsers.has_header(rows) if header is None and rows else bool(header)
    reader = spark.read.options(sep=delimiter, quote='"', escape='"', multiLine=True, header=named, inferSchema=False, mode="PERMISSIVE")
    df = reader.csv(path)
    names = parsers.header_names(rows[0] if rows else df.columns, len(df.columns)) if named else [f"column_{k + 1}" for k in range(len(df.columns))]
    return numbered(df.toDF(*names))


def scan_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Large JSON lines, read in parallel, nested objects as dotted names; lines that are not JSON are left out."""
    df = spark.read.json(path, mode="DROPMALFORMED")

    def leaves(schema: T.StructType, prefix: str) -> Iterator[F.Column]:
        for f in schema.fields:
            at = f"{prefix}.`{f.name}`" if prefix else f"`{f.name}`"
            name = at.replace("`", "")
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, at)
            elif isinstance(f.dataType, T.ArrayType):
                plain = not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType))
                yield (F.array_join(F.col(at).cast("array<string>"), "; ") if plain else F.to_json(F.col(at))).alias(name)
            else:
                yield F.col(at).alias(name)

    return numbered(df.select(*leaves(df.schema, "")))


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def read_folder(spark: SparkSession, path: str, *, mode: str = "wholeFile") -> Imported:
    """All text, Markdown, code and HTML files below a folder as rows of text and relative path.

    Files are opened and cut by the executors; hidden ones are skipped. There is no limit on their number.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for where, content in zip(part["path"], part["content"], strict=True):
                relative = where.split(":", 1)[-1].lstrip("/")[len(root) :].lstrip("/")
                kind = detect_format(where, content)
                if kind not in ("text", "markdown", "code", "html") or any(x.startswith(".") for x in relative.split("/")):
                    continue
                found = encoding.decode(content).text
                as_is = mode == "wholeFile"
                how = "markdownSections" if as_is and kind == "markdown" else "paragraphs" if as_is and kind == "html" else mode
                out += [(relative, k, row["text"]) for k, row in enumerate(split_text(_page(found) if kind == "html" else found, how))]
            yield pd.DataFrame(out, columns=["source", "place", "text"])

    bounded_batches(spark)
    rows = files.mapInPandas(run, "source string, place bigint, text string")
    return Imported(numbered(rows, "source", "place").select(RID, "text", "source"), "text")


# -- SQLite ----------------------------------------------------------------------------------------------------------


def _quoted(name: str) -> str:
    escaped = name.replace('"', '""')
    return f'"{escaped}"'


def sqlite_tables(path: str) -> list[str]:
    """Tables and views, by name."""
    try:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            found = db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")
            return [x for (x,) in found]
    except sqlite3.Error as e:
        raise UnreadableFile(os.path.basename(path)) from e


class SqliteSource(DataSource):
    """Spark data source "sqlite": options path, table, and optionally partitions (row id ranges)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            table = _quoted(self.options["table"])
            names = [x[0] for x in db.execute(f"SELECT * FROM {table} LIMIT 0").description]
            kinds = []
            for name in names:
                c = _quoted(name)
                found = {x for (x,) in db.execute(f"SELECT DISTINCT typeof({c}) FROM {table}")} - {"null"}
                kinds.append("bigint" if found == {"integer"} else "double" if found and found <= {"integer", "real"} else "string")
        return ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in zip(names, kinds, strict=True))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.limit = int(options["limit"]) if options.get("limit") else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            db.text_factory = lambda raw: raw.decode("utf-8", "replace")
            end = f" LIMIT {max(0, self.limit)}" if self.limit is not None else ""
            for row in db.execute(f"SELECT * FROM {_quoted(self.table)}{end}"):
                yield tuple(self._cell(v, f.dataType) for v, f in zip(row, self.schema.fields, strict=True))

    @staticmethod
    def _cell(v: object, kind: T.DataType) -> object:
        if isinstance(v, bytes):
            return f"<blob {len(v)} bytes>"
        if v is None or isinstance(kind, T.LongType):
            return v
        return float(v) if isinstance(kind, T.DoubleType) else str(v)


def _read_sqlite(spark: SparkSession, path: str, table: str | None, limit: int | None = None) -> Imported:
    tables = sqlite_tables(path)
    chosen = table or next(iter(tables), None)
    if chosen is None or chosen not in tables:
        raise ParseFailure("no tables in the database" if chosen is None else f"no table {chosen!r}")
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").options(path=path, table=chosen)
    df = (reader.option("limit", limit) if limit is not None else reader).load()
    return Imported(numbered(df), "sqlite", {"table": chosen, "availableTables": ", ".join(tables)})


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, limit: int | None = None) -> DataFrame:
    return _read_sqlite(spark, path, table, limit).frame


