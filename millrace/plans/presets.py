"""Starter pipelines, defaults, and a guess at which column holds the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import RID
from ..operators import ops


def preset(name: str, text_column: str) -> list[ops.Op]:
    """training, rag, privacy or dedupe."""
    clean = ops.NormalizeText()
    return {
        "training": [clean, ops.UnifyNulls(), ops.AutoType(), ops.DedupeExact(), ops.DedupeFuzzy(text_column, 0.85), ops.QualityFilter(text_column), ops.Split(0.9, 0.05, 0.05, 42)],
        "rag": [clean, ops.ChunkText(text_column), ops.AddTokenCount(text_column), ops.AddLanguage(text_column)],
        "privacy": [clean, ops.RedactPII(mode="hash")],
        "dedupe": [clean, ops.DedupeExact(), ops.DedupeFuzzy(text_column, 0.75)],
    }[name]


def defaults(mode: str, text_column: str) -> list[ops.Op]:
    """curate or retrieve."""
    if mode == "curate":
        return [ops.NormalizeText(), ops.UnifyNulls(), ops.AutoType(), ops.DedupeExact()]
    return [ops.NormalizeText(), ops.ChunkText(text_column), ops.AddTokenCount(text_column)]


def guess_text_column(df: DataFrame) -> str | None:
    """The string column with most characters in the first 50 rows."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != RID]
    if not names:
        return None
    head = (df.orderBy(RID) if RID in df.columns else df).limit(50)
    row = head.agg(*[F.coalesce(F.sum(F.length(F.col(f"`{n}`"))), F.lit(0)).alias(f"c{k}") for k, n in enumerate(names)]).head()
    best = max(range(len(names)), key=lambda k: (row[k], -k))
    return names[best] if row[best] else None
