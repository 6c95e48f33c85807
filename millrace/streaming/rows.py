"""Recipes on streams: operators that look at one row at a time run unchanged on a streaming frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRecipe
from ..functions.values import RID
from ..operators import ops
from ..plans.executor import run

ROW_WISE = (ops.SelectColumns, ops.DropColumns, ops.RenameColumn, ops.AddColumn, ops.FilterRows, ops.NormalizeText, ops.UnifyNulls, ops.CoerceType, ops.RedactPII, ops.QualityFilter, ops.LanguageFilter, ops.AddTokenCount, ops.AddLanguage, ops.AddQualityScore)


def streamed(df: DataFrame, steps: Sequence[ops.Op], *, context: ops.Context | None = None) -> DataFrame:
    """The steps on a streaming frame. A stream has no row order, so ids are a hash of the row if it has none."""
    for op in steps:
        if not isinstance(op, ROW_WISE):
            raise InvalidRecipe(f"{type(op).__name__} needs the whole dataset")
    if RID not in df.columns:
        df = df.withColumn(RID, F.xxhash64(*df.columns))
    return run(df, steps, context=context, measure=False).output


def dedupe_exact(df: DataFrame, columns: Sequence[str], time: str, within: str) -> DataFrame:
    """Exact duplicates of a stream, remembered for a span of event time."""
    return df.withWatermark(time, within).dropDuplicatesWithinWatermark(list(columns))


def counts(df: DataFrame, key: str, time: str, *, window: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows by key in windows of event time; rows later than `late` are left out."""
    return df.withWatermark(time, late).groupBy(F.window(time, window, slide), key).agg(F.count("*").alias("rows"))
