"""Column profiles, dataset cards, differences between two states of a dataset, and the grid's queries."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import language
from ..functions.tokens import Estimator, Tokenizer
from ..functions.values import RID, kind_of, number, show

#: Upper ends and names of the token histogram's buckets.
BUCKETS = ((64, "0–64"), (128, "64–128"), (256, "128–256"), (512, "256–512"), (1024, "512–1k"), (2048, "1k–2k"), (4096, "2k–4k"), (8192, "4k–8k"), (None, "8k+"))
TOP_VALUES, TOP_LANGUAGES = 10, 8


def _cell(df: DataFrame, name: str) -> tuple[Column, str]:
    return F.col(f"`{name}`"), kind_of(df.schema[name].dataType)


def profile(df: DataFrame, name: str, tokenizer: Tokenizer | None = None) -> DataFrame:
    """One row: counts, null share, type, distinct values, and numeric or token summaries where they apply."""
    c, kind = _cell(df, name)
    value = number(c, kind)
    tokens = (tokenizer or Estimator()).column(c) if kind == "string" else F.lit(None).cast("bigint")
    tokens = F.when(c.isNotNull(), tokens)
    return df.select(c.alias("c"), show(c, kind).alias("shown"), value.alias("v"), tokens.alias("t")).agg(
        F.count("*").alias("rows"),
        F.count("c").alias("non_null"),
        F.when(F.count("*") > 0, F.count(F.when(F.col("c").isNull(), 1)) / F.count("*")).otherwise(F.lit(0.0)).alias("null_fraction"),
        F.when(F.count("c") > 0, F.lit(kind)).otherwise(F.lit("null")).alias("type"),
        F.count_distinct(F.when(F.col("c").isNotNull(), F.col("shown"))).alias("distinct_values"),
        F.min("v").alias("numeric_min"),
        F.max("v").alias("numeric_max"),
        F.avg("v").alias("numeric_mean"),
        F.min("t").alias("token_min"),
        F.max("t").alias("token_max"),
        F.avg("t").alias("token_mean"),
        F.sum("t").alias("token_total"),
    )


def top_values(df: DataFrame, name: str, n: int = TOP_VALUES) -> DataFrame:
    """The most frequent values as shown, most frequent first, ties by value."""
    c, kind = _cell(df, name)
    counts = df.where(c.isNotNull()).groupBy(show(c, kind).alias("value")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(n)


def token_stats(df: DataFrame, name: str, tokenizer: Tokenizer | None = None) -> DataFrame:
    """One row over all rows: min, max, mean, p50 (the value at place n/2), p95 and total of token counts.

    Counts are few distinct numbers, so places are found in their cumulated frequencies.
    """
    c, kind = _cell(df, name)
    counts = df.select((tokenizer or Estimator()).column(show(c, kind)).alias("t")).groupBy("t").agg(F.count("*").alias("k"))
    upto = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("k").over(upto), "n": F.sum("k").over(Window.partitionBy())})

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col("t")))

    middle, high = F.floor(F.col("n") / 2), F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    return placed.agg(F.min("t").alias("min"), F.max("t").alias("max"), (F.sum(F.col("t") * F.col("k")) / F.max("n")).alias("mean"), at(middle).alias("p50"), at(high).alias("p95"), F.sum(F.col("t") * F.col("k")).alias("total"))


def token_histogram(df: DataFrame, name: str, tokenizer: Tokenizer | None = None) -> DataFrame:
    """bucket, place, rows; buckets without rows are left out."""
    c, kind = _cell(df, name)
    t = (tokenizer or Estimator()).column(show(c, kind))
    place = F.lit(len(BUCKETS) - 1)
    for k in range(len(BUCKETS) - 2, -1, -1):
        place = F.when(F.col("t") < BUCKETS[k][0], F.lit(k)).otherwise(place)
    names = F.array(*[F.lit(b) for _, b in BUCKETS])
    out = df.select(t.alias("t")).groupBy(place.alias("place")).agg(F.count("*").alias("rows"), F.max("t").alias("most"))
    return out.select(F.element_at(names, F.col("place") + 1).alias("bucket"), "place", "rows")


def language_mix(df: DataFrame, name: str, n: int = TOP_LANGUAGES) -> DataFrame:
    """code, fraction: the most frequent languages, ties by code."""
    c, kind = _cell(df, name)
    counts = df.groupBy(language.detect(show(c, kind))["code"].alias("code")).agg(F.count("*").alias("k"))
    share = counts.withColumn("fraction", F.col("k") / F.sum("k").over(Window.partitionBy()))
    return share.orderBy(F.desc("k"), "code").limit(n).select("code", "fraction")


@dataclass
class ColumnStats:
    name: str
    type: str
    null_fraction: float
    unique_count: int
    tokens: dict | None = None


@dataclass
class DatasetCard:
    rows: int
    columns: list[ColumnStats]
    languages: list[tuple[str, float]]
    histogram: list[tuple[str, int]]
    tokenizer: str
    pipeline: list = field(default_factory=list)
    generated_at: datetime = field(default_factory=lambda: datetime.now(UTC).replace(microsecond=0))

    def to_json(self) -> str:
        columns = [{"name": c.name, "type": c.type, "nullFraction": c.null_fraction, "uniqueCount": c.unique_count} | ({"tokens": c.tokens} if c.tokens else {}) for c in self.columns]
        steps = [{"op": m.op, "rowsIn": m.rows_in, "rowsOut": m.rows_out, "cellsChanged": m.cells_changed, "notes": m.notes} for m in self.pipeline]
        out = {"rowCount": self.rows, "columnCount": len(self.columns), "tokenizer": self.tokenizer, "generatedAt": f"{self.generated_at:%Y-%m-%dT%H:%M:%SZ}", "columns": columns, "languageMix": [{"code": c, "fraction": f} for c, f in self.languages], "pipeline": steps}
        return json.dumps(out, indent=2, sort_keys=True, ensure_ascii=False)

    def markdown(self) -> str:
        lines = ["# Dataset Card", "", f"Generated {self.generated_at:%Y-%m-%dT%H:%M:%SZ} by millrace. Tokenizer: `{self.tokenizer}`.", "", f"**{self.rows} rows × {len(self.columns)} columns**", ""]
        lines += ["## Columns", "", "| Column | Type | Nulls | Unique |", "|---|---|---|---|"]
        lines += [f"| {c.name} | {c.type} | {100 * c.null_fraction:.1f}% | {c.unique_count} |" for c in self.columns]
        if t := next((c.tokens for c in self.columns if c.tokens), None):
            lines += ["", "## Token distribution", "", f"Total ≈ **{t['total']:,}** tokens. Mean {t['mean']:.0f}, median {t['p50']}, p95 {t['p95']}, range {t['min']}–{t['max']}.", ""]
            if self.histogram:
                lines += ["| Bucket | Rows |", "|---|---|", *[f"| {b} | {n} |" for b, n in self.histogram]]
        if self.languages:
            lines += ["", "## Language mix", "", *[f"- **{c}**: {100 * f:.1f}%" for c, f in self.languages]]
        if self.pipeline:
            lines += ["", "## Pipeline provenance", "", "| Step | Rows in | Rows out | Cells changed | Notes |", "|---|---|---|---|---|"]
            for m in self.pipeline:
                notes = ", ".join(f"{k}={v}" for k, v in sorted(m.notes.items()))
                lines.append(f"| {m.op} | {m.rows_in} | {m.rows_out} | {m.cells_changed} | {notes} |")
        return "\n".join(lines) + "\n"


def card(df: DataFrame, metrics: list = (), tokenizer: Tokenizer | None = None) -> DatasetCard:
    """Over all rows: one aggregation for the columns, and one each for tokens and languages of the text column."""
    tokenizer = tokenizer or Estimator()
    names = [c for c in df.columns if c != RID]
    parts = [F.count("*").alias("n")]
    for k, name in enumerate(names):
        c, kind = _cell(df, name)
        shown = F.when(c.isNotNull(), show(c, kind))
        parts += [F.count(c).alias(f"k{k}"), F.count_distinct(shown).alias(f"d{k}"), F.coalesce(F.sum(F.length(shown)) if kind == "string" else F.lit(0), F.lit(0)).alias(f"l{k}")]
    row = df.agg(*parts).head()
    n = row["n"]
    stats = [ColumnStats(name, kind_of(df.schema[name].dataType) if row[f"k{k}"] else "null", (n - row[f"k{k}"]) / max(1, n), row[f"d{k}"]) for k, name in enumerate(names)]
    longest = max(range(len(names)), key=lambda k: (row[f"l{k}"], -k), default=None)
    if longest is None or not row[f"l{longest}"]:
        return DatasetCard(n, stats, [], [], tokenizer.name, list(metrics))
    text = names[longest]
    stats[longest].tokens = token_stats(df, text, tokenizer).head().asDict()
    bars = [(r["bucket"], r["rows"]) for r in token_histogram(df, text, tokenizer).orderBy("place").collect()] if stats[longest].tokens["max"] else []
    mix = [(r["code"], r["fraction"]) for r in language_mix(df, text).collect()]
    return DatasetCard(n, stats, mix, bars, tokenizer.name, list(metrics))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """_rid, change (unchanged, modified, added, dropped) and the changed columns, over the columns of both."""
    shared = [c for c in before.columns if c in after.columns and c != RID]
    old = before.select(RID, F.lit(True).alias("__old"), *[F.col(f"`{c}`").alias(f"__o{k}") for k, c in enumerate(shared)])
    new = after.select(RID, F.lit(True).alias("__new"), *[F.col(f"`{c}`").alias(f"__n{k}") for k, c in enumerate(shared)])

    def unlike(k: int, name: str) -> Column:
        same_type = before.schema[name].dataType == after.schema[name].dataType
        a, b = F.col(f"__o{k}"), F.col(f"__n{k}")
        same = a.eqNullSafe(b) if same_type else a.isNull() & b.isNull()
        return F.when(~same, F.lit(name))

    changed = F.array_sort(F.array_compact(F.array(*[unlike(k, c) for k, c in enumerate(shared)]).cast("array<string>")))
    both = old.join(new, RID, "full_outer").withColumn("changed", changed)
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "dropped").when(F.size("changed") > 0, "modified").otherwise("unchanged")
    return both.select(RID, change.alias("change"), F.when(change == "modified", F.col("changed")).otherwise(F.array().cast("array<string>")).alias("changed"))


def column_changes(before: DataFrame, after: DataFrame) -> tuple[set[str], set[str]]:
    """Columns added and removed."""
    return set(after.columns) - set(before.columns) - {RID}, set(before.columns) - set(after.columns) - {RID}


def search(df: DataFrame, needle: str) -> DataFrame:
    """Rows of which some cell, as shown, contains the needle, whatever the case."""
    names = [c for c in df.columns if c != RID]
    hits = [F.contains(F.lower(show(*_cell(df, c))), F.lit(needle.lower())) for c in names]
    return df.where(F.array_contains(F.array(*hits), True)) if needle and hits else df


def ordered(df: DataFrame, name: str, *, descending: bool = False) -> DataFrame:
    c = F.col(f"`{name}`")
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), RID)


def impact(metrics: list) -> dict[str, int]:
    """What cleaning did, from the metrics of a run."""
    kinds = {"email", "phone", "ipAddress", "creditCard", "iban", "ssn", "apiKey", "url_credentials"}
    return {
        "rows_removed": (metrics[0].rows_in - metrics[-1].rows_out) if metrics else 0,
        "duplicates": sum(m.rows_dropped for m in metrics if m.op in ("DedupeExact", "DedupeFuzzy")),
        "pii": sum(int(v) for m in metrics if m.op == "RedactPII" for k, v in m.notes.items() if k in kinds),
        "contaminated": sum(int(m.notes.get("contaminated", 0)) for m in metrics if m.op == "Decontaminate"),
    }
