"""The operators of a recipe. Each is a small value with parameters; `apply` turns a lazy DataFrame into another.

Every DataFrame carries `_rid`, a bigint that identifies a row and gives its order. Operators return the frame and
what an `Observation` on it should measure, so a whole recipe is measured by the one job that runs it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExpressionError, InvalidRecipe, MissingColumn
from ..functions import chunks, language, parsing, pii, quality, text
from ..functions.expressions import compile_condition, compile_node, parse
from ..functions.tokens import Estimator, Tokenizer
from ..functions.values import RID, SPARK_TYPES, kind_of, show, unique_name
from ..plans.tables import written
from . import augment, fuzzy


@dataclass
class Step:
    """A frame after an operator: the frame, aggregates to observe on `observed` (before it is `finish`ed), fixed notes."""

    frame: DataFrame
    measures: dict[str, Column] = field(default_factory=dict)
    finish: Callable[[DataFrame], DataFrame] = lambda df: df
    notes: dict[str, str] = field(default_factory=dict)


@dataclass
class Context:
    tokenizer: Tokenizer = field(default_factory=Estimator)
    client: augment.Client | None = None


def columns_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != RID]


def kind(df: DataFrame, name: str) -> str:
    return kind_of(df.schema[name].dataType)


def shown(df: DataFrame, name: str) -> Column:
    return show(F.col(f"`{name}`"), kind(df, name))


def need(df: DataFrame, name: str) -> None:
    if name not in columns_of(df):
        raise MissingColumn(name)


def _changed(df: DataFrame, new: dict[str, Column]) -> Step:
    """Columns replaced, with the number of cells that differ."""
    if not new:
        return Step(df, {"cells": F.lit(0)})
    beside = {f"__{k}": c for k, c in enumerate(new.values())}
    wide = df.withColumns(beside)
    cells = sum((~F.col(f"`{name}`").eqNullSafe(F.col(b))).cast("bigint") for name, b in zip(new, beside, strict=True))
    back = dict(zip(new, beside, strict=True))
    return Step(wide, {"cells": F.coalesce(F.sum(cells), F.lit(0))}, lambda x: x.select(*[F.col(back[c]).alias(c) if c in back else F.col(f"`{c}`") for c in df.columns]))


@dataclass(frozen=True)
class SelectColumns:
    columns: tuple[str, ...]

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        return Step(df.select(RID, *[F.col(f"`{c}`") for c in dict.fromkeys(self.columns) if c in columns_of(df)]))


@dataclass(frozen=True)
class DropColumns:
    columns: tuple[str, ...]

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        return Step(df.drop(*[c for c in self.columns if c != RID]))


@dataclass(frozen=True)
class RenameColumn:
    source: str
    to: str

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        if self.source not in columns_of(df) or self.source == self.to:
            return Step(df)
        if self.to in df.columns:
            raise InvalidRecipe(f"column {self.to!r} is already there")
        return Step(df.withColumnRenamed(self.source, self.to))


@dataclass(frozen=True)
class AddColumn:
    """A column computed by an expression; one that names unknown columns or functions gives nulls."""

    name: str
    expression: str

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        tree = parse(self.expression)
        if self.name in df.columns:
            raise InvalidRecipe(f"column {self.name!r} is already there")
        try:
            made = compile_node(tree, df.drop(RID).schema, ctx.tokenizer)
            value = made.column.cast(SPARK_TYPES[made.kind])
        except ExpressionError:
            value = F.lit(None).cast("string")
        return Step(df.withColumn(self.name, value), {"cells": F.count("*")})


@dataclass(frozen=True)
class FilterRows:
    expression: str

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        return Step(df.where(compile_condition(self.expression, df.drop(RID).schema, ctx.tokenizer)))


def _targets(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [c for c in (dict.fromkeys(names) if names else columns_of(df)) if c in columns_of(df) and isinstance(df.schema[c].dataType, T.StringType)]


@dataclass(frozen=True)
class NormalizeText:
    """Cells that a change leaves empty become null; cells that were empty stay so."""

    columns: tuple[str, ...] = ()
    options: text.NormalizeOptions = text.STANDARD

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        def clean(name: str) -> Column:
            old = F.col(f"`{name}`")
            new = text.normalize(old, self.options)
            return F.when((new == "") & (old != ""), F.lit(None)).otherwise(new)

        return _changed(df, {c: clean(c) for c in _targets(df, self.columns)})


@dataclass(frozen=True)
class UnifyNulls:
    columns: tuple[str, ...] = ()

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        return _changed(df, {c: F.when(~parsing.missing(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in _targets(df, self.columns)})


@dataclass(frozen=True)
class AutoType:
    """Types of string columns by the first 500 rows (one small job), then the whole columns are converted."""

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        names = _targets(df, ())
        head = df.select(RID, *[F.col(f"`{c}`") for c in names]).orderBy(RID).limit(parsing.SAMPLE).collect() if names else []
        types = {c: parsing.infer_type([row[c] for row in head if row[c] is not None]) for c in names}
        new = {c: parsing.coerce(F.col(f"`{c}`"), "string", t) for c, t in types.items() if t != "string"}
        beside = {f"__{k}": F.col(f"`{c}`") for k, c in enumerate(new)}
        wide = df.withColumns(beside).withColumns(new) if new else df
        cells = sum(F.col(b).isNotNull().cast("bigint") for b in beside) if new else F.lit(0)
        out = Step(wide, {"cells": F.coalesce(F.sum(cells), F.lit(0))}, lambda x: x.drop(*beside))
        out.notes = {c: t for c, t in types.items() if t != "string"}
        return out


@dataclass(frozen=True)
class CoerceType:
    column: str
    type: str

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        need(df, self.column)
        if self.type not in parsing.TYPES:
            raise InvalidRecipe(f"no type {self.type!r}")
        old = F.col(f"`{self.column}`")
        wide = df.withColumn("__new", parsing.coerce(old, kind(df, self.column), self.type))
        differs = ~shown(df, self.column).eqNullSafe(show(F.col("__new"), kind_of(wide.schema["__new"].dataType)))
        names = df.columns
        return Step(wide, {"cells": F.coalesce(F.sum(differs.cast("bigint")), F.lit(0))}, lambda x: x.select(*[F.col("__new").alias(c) if c == self.column else F.col(f"`{c}`") for c in names]))


@dataclass(frozen=True)
class DedupeExact:
    """The first row of those that show alike in the columns stays.

    The first row is carried through a partial aggregation, so the frame is computed once and a key that most
    rows share reaches its task as one row from each partition.
    """

    columns: tuple[str, ...] = ()

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        names = [c for c in (self.columns or columns_of(df)) if c in columns_of(df)]
        key = F.sha2(F.concat_ws("\x1f", F.lit(""), *[shown(df, c) for c in names]), 256)
        row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)])
        first = df.groupBy(key.alias("__key")).agg(F.min_by(row, RID).alias("__row"), F.count("*").alias("__copies"))
        copies = F.coalesce(F.sum((F.col("__copies") > 1).cast("bigint")), F.lit(0))
        return Step(first, {"clusters": copies}, lambda x: x.select(*[F.col("__row")[f"c{k}"].alias(c) for k, c in enumerate(df.columns)]))


@dataclass(frozen=True)
class DedupeFuzzy:
    column: str
    threshold: float = 0.85

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        if self.column not in columns_of(df):
            return Step(df)
        dropped = written(fuzzy.near_duplicates(df.select(RID, shown(df, self.column).alias("text")), self.threshold).where("rid <> component"))
        clusters = dropped.select("component").distinct().count()
        return Step(df.join(dropped.select(F.col("rid").alias(RID)), RID, "left_anti").select(*df.columns), notes={"clusters": str(clusters)})


@dataclass(frozen=True)
class RedactPII:
    columns: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    mode: str = "tag"

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        if self.mode not in pii.MODES or set(self.kinds) - set(pii.KINDS):
            raise InvalidRecipe(f"no such mode or kind: {self.mode}, {self.kinds}")
        names = _targets(df, self.columns)
        beside = {f"__{k}": pii.redact(F.col(f"`{c}`"), self.kinds, self.mode) for k, c in enumerate(names)}
        wide = df.withColumns(beside) if beside else df
        back = dict(zip(names, beside, strict=True))

        def total(name: str) -> Column:
            return F.coalesce(F.sum(sum((F.coalesce(F.col(b)["counts"][name], F.lit(0)) for b in beside), F.lit(0))), F.lit(0)).cast("bigint")

        cells = sum((F.coalesce(F.size(F.map_keys(F.col(b)["counts"])), F.lit(0)) > 0).cast("bigint") for b in beside) if beside else F.lit(0)
        measures = {"cells": F.coalesce(F.sum(cells), F.lit(0))} | {f"note:{k}": total(k) for k in (self.kinds or pii.KINDS)}
        return Step(wide, measures, lambda x: x.select(*[F.col(back[c])["text"].alias(c) if c in back else F.col(f"`{c}`") for c in df.columns]))


@dataclass(frozen=True)
class QualityFilter:
    column: str
    rules: quality.QualityRules = quality.STANDARD

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        need(df, self.column)
        wide = df.withColumn("__why", quality.reasons(shown(df, self.column), self.rules))
        names = F.transform("__why", quality.reason_name)
        measures = {f"note:{r}": F.coalesce(F.sum(F.array_contains(names, r).cast("bigint")), F.lit(0)) for r in quality.REASONS}
        return Step(wide, measures, lambda x: x.where(F.size("__why") == 0).drop("__why"))


@dataclass(frozen=True)
class LanguageFilter:
    column: str
    allowed: tuple[str, ...]
    min_confidence: float = 0.0

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        need(df, self.column)
        found = language.detect(shown(df, self.column))
        wide = df.withColumn("__lang", found)
        return Step(wide.where(F.col("__lang")["code"].isin(*self.allowed) & (F.col("__lang")["confidence"] >= self.min_confidence)).drop("__lang"))


def word_grams(c: Column, n: int) -> Column:
    """Distinct runs of n lower-cased words."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))

    return F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, F.array_distinct(grams(w))).otherwise(F.array().cast("array<string>"))), 1)


@dataclass(frozen=True)
class Decontaminate:
    """Rows that share a run of words with a text for evaluation leave. Those texts are part of the recipe."""

    column: str
    eval_texts: tuple[str, ...]
    ngram_size: int = 8

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        if self.column not in columns_of(df):
            return Step(df)
        spark = df.sparkSession
        texts = spark.createDataFrame([(t,) for t in self.eval_texts], "text string")
        return Step(decontaminated(df, self.column, texts, self.ngram_size))


def decontaminated(df: DataFrame, column: str, texts: DataFrame, ngram_size: int = 8) -> DataFrame:
    """df without rows that share a run of words with `texts` (text), which may be a table of any size."""
    grams = texts.select(F.explode(word_grams(F.col("text"), ngram_size)).alias("gram")).distinct()
    hits = df.select(RID, F.explode(word_grams(shown(df, column), ngram_size)).alias("gram")).join(grams, "gram", "left_semi").select(RID).distinct()
    return df.join(hits, RID, "left_anti").select(*df.columns)


@dataclass(frozen=True)
class AddTokenCount:
    column: str

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        need(df, self.column)
        name = unique_name("token_count", df.columns)
        return Step(df.withColumn(name, ctx.tokenizer.column(shown(df, self.column))), {"cells": F.count("*")}, notes={"tokenizer": ctx.tokenizer.name})


@dataclass(frozen=True)
class AddLanguage:
    column: str

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        need(df, self.column)
        return Step(df.withColumn(unique_name("lang", df.columns), language.detect(shown(df, self.column))["code"]), {"cells": F.count("*")})


@dataclass(frozen=True)
class AddQualityScore:
    column: str

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        need(df, self.column)
        return Step(df.withColumn(unique_name("quality_score", df.columns), quality.score(shown(df, self.column))), {"cells": F.count("*")})


#: Ids that a cell of the prefix sums over rows spans, as a power of two.
CELL_BITS = 16


@dataclass(frozen=True)
class ChunkText:
    """One row for each chunk. First chunks keep their row's id; the others get the ids above the largest, in the order of rows and chunks.

    The chunks are written once. How many of them come before a row's is a sum over cells of ids and one over the rows of a
    cell, so no task sees all rows.
    """

    column: str
    config: chunks.ChunkerConfig = chunks.ChunkerConfig()

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        need(df, self.column)
        made = ["chunk_index", "chunk_tokens", "heading_path"]
        taken = list(df.columns)
        names = [taken.append(name := unique_name(m, taken)) or name for m in made]
        wide = written(df.withColumn("__chunks", chunks.chunk(shown(df, self.column), self.config, ctx.tokenizer)))
        more = wide.select(F.col(RID).alias("__row"), F.shiftright(RID, CELL_BITS).alias("__cell"), (F.size("__chunks") - 1).alias("__more")).where("__more > 0")
        earlier = (Window.unboundedPreceding, -1)
        cells = more.groupBy("__cell").agg(F.sum("__more").alias("__all")).select("__cell", F.coalesce(F.sum("__all").over(Window.orderBy("__cell").rowsBetween(*earlier)), F.lit(0)).alias("__lower"))
        inside = more.withColumn("__inside", F.coalesce(F.sum("__more").over(Window.partitionBy("__cell").orderBy("__row").rowsBetween(*earlier)), F.lit(0)))
        before = inside.join(cells, "__cell").select("__row", (F.col("__lower") + F.col("__inside")).alias("__before"))
        most = wide.agg(F.coalesce(F.max(RID), F.lit(-1)).alias("__most"))
        placed = wide.join(before, wide[RID] == before["__row"], "left").crossJoin(F.broadcast(most))  # one row
        part = F.col("__chunk")
        out = placed.withColumn("__chunk", F.explode("__chunks")).select(
            F.when(part["index"] == 0, F.col(RID)).otherwise(F.col("__most") + F.col("__before") + part["index"]).alias(RID),
            *[part["text"].alias(c) if c == self.column else F.col(f"`{c}`") for c in columns_of(df)],
            part["index"].alias(names[0]), part["tokens"].alias(names[1]), F.nullif(part["heading_path"], F.lit("")).alias(names[2]),
        )
        return Step(out)


@dataclass(frozen=True)
class Split:
    """train, validation and test by a seeded shuffle, in each stratum by itself; what the first two leave is test.

    The shuffle is the order of md5(seed : id). Ranks come from two levels, hash cells of a stratum and rows
    of a cell, so that no stratum has to fit one task.
    """

    train: float = 0.9
    validation: float = 0.05
    test: float = 0.05
    seed: int = 42
    stratify_by: str | None = None

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        if "split" in df.columns:
            raise InvalidRecipe("column 'split' is already there")
        by = shown(df, self.stratify_by) if self.stratify_by in columns_of(df) else F.lit("")
        order = F.md5(F.concat(F.lit(f"{self.seed}:"), F.col(RID).cast("string")))
        keyed = df.select(RID, by.alias("s"), order.alias("o"), F.substring(order, 1, 3).alias("cell"))
        cells = keyed.groupBy("s", "cell").agg(F.count("*").alias("k"))
        upto = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumns({"before": F.coalesce(F.sum("k").over(upto), F.lit(0)), "n": F.sum("k").over(Window.partitionBy("s"))})
        place = F.row_number().over(Window.partitionBy("s", "cell").orderBy("o", RID))
        placed = keyed.withColumn("place", place).join(cells, ["s", "cell"]).withColumn("place", F.col("before") + F.col("place"))
        first = F.round(F.lit(float(self.train)) * F.col("n"), 0)
        second = first + F.round(F.lit(float(self.validation)) * F.col("n"), 0)
        name = F.when(F.col("place") <= first, "train").when(F.col("place") <= second, "validation").otherwise("test")
        return Step(df.join(placed.select(RID, name.alias("split")), RID).select(*df.columns, "split"))


@dataclass(frozen=True)
class Augment:
    config: augment.AugmentConfig

    def apply(self, df: DataFrame, ctx: Context) -> Step:
        need(df, self.config.column)
        out, finish, measures = augment.augmented(df, self.config, ctx.client, ctx.tokenizer)
        return Step(out, measures, finish)


#: Operators that join rows with what was found out about them by id.
BY_ID = (DedupeFuzzy, Decontaminate, ChunkText, Split)
Op = SelectColumns | DropColumns | RenameColumn | AddColumn | FilterRows | NormalizeText | UnifyNulls | AutoType | CoerceType | DedupeExact | DedupeFuzzy | RedactPII | QualityFilter | LanguageFilter | Decontaminate | AddTokenCount | AddLanguage | AddQualityScore | ChunkText | Split | Augment
