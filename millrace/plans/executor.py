"""Runs a recipe: folds its operators over a frame into one lazy plan, and measures each with an Observation.

Nothing runs until the result is used. Metrics are those of the first action on the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import MillraceError
from ..functions.values import RID
from ..operators import ops
from .tables import bounded_batches, written

TOP_NOTES = 8


@dataclass
class OpMetrics:
    op: str
    rows_in: int
    rows_out: int
    cells_changed: int = 0
    notes: dict[str, str] = field(default_factory=dict)

    @property
    def rows_dropped(self) -> int:
        return max(0, self.rows_in - self.rows_out)


@dataclass
class _Watched:
    name: str
    before: Observation
    inside: Observation | None
    after: Observation
    notes: dict[str, str]


@dataclass
class Result:
    frame: DataFrame
    watched: list[_Watched]

    @property
    def output(self) -> DataFrame:
        """The frame without the hidden row id."""
        return self.frame.drop(RID)

    def metrics(self) -> list[OpMetrics]:
        """Rows in and out, cells changed and notes of each step; waits for the first action on the result."""
        out = []
        for w in self.watched:
            inside = w.inside.get if w.inside else {}
            notes = dict(w.notes)
            counts = {k[5:]: v for k, v in inside.items() if k.startswith("note:") and v}
            if w.name == "QualityFilter":
                counts = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TOP_NOTES])
            notes |= {k: str(v) for k, v in counts.items()}
            rows_in, rows_out = w.before.get["rows"], w.after.get["rows"]
            if "clusters" in inside:
                notes["clusters"] = str(inside["clusters"])
            if w.name == "Decontaminate":
                notes["contaminated"] = str(rows_in - rows_out)
            out.append(OpMetrics(w.name, rows_in, rows_out, int(inside.get("cells") or 0), notes))
        return out


def with_ids(df: DataFrame, steps: Sequence[ops.Op] = ()) -> DataFrame:
    """df with row ids in its order, for frames that no reader of this library made.

    Steps that join on the ids would compute them on either side of the join, where they might differ; the frame is written first then.
    """
    if RID in df.columns:
        return df
    df = df.withColumn(RID, F.monotonically_increasing_id())
    return written(df) if any(isinstance(op, ops.BY_ID) for op in steps) else df


def run(df: DataFrame, steps: Sequence[ops.Op], *, context: ops.Context | None = None, measure: bool = True) -> Result:
    """The plan of all steps over df (with `_rid`)."""
    context = context or ops.Context()
    bounded_batches(df.sparkSession)
    watched: list[_Watched] = []
    df = with_ids(df, steps)
    rows = F.count("*").alias("rows")
    before = Observation()
    if measure:
        df = df.observe(before, rows)
    for op in steps:
        step = op.apply(df, context)
        frame, inside = step.frame, None
        if measure and step.measures:
            inside = Observation()
            frame = frame.observe(inside, *[c.cast("bigint").alias(k) for k, c in step.measures.items()])
        frame = step.finish(frame)
        after = Observation()
        if measure:
            frame = frame.observe(after, rows)
            watched.append(_Watched(type(op).__name__, before, inside, after, step.notes))
        df, before = frame, after
    return Result(df, watched)


def sample(df: DataFrame, head: int = 100, spread: int = 100) -> DataFrame:
    """The first rows and rows spread evenly over the rest; for dense row ids."""
    n = df.count()
    if n <= head + spread:
        return df
    stride = max(1, (n - head) // max(1, spread))
    place = F.col(RID) - head
    return df.where((F.col(RID) < head) | ((place % stride == 0) & (place / stride < spread)))


@dataclass
class Preview:
    frame: DataFrame
    failed_step: int | None = None
    error: str | None = None


def preview(df: DataFrame, steps: Sequence[ops.Op], *, head: int = 100, spread: int = 100, context: ops.Context | None = None) -> Preview:
    """The steps on a small sample, without augmentation; stops at the first step that fails and names it."""
    part = sample(with_ids(df), head, spread)
    for k, op in enumerate(steps):
        if isinstance(op, ops.Augment):
            continue
        try:
            part = run(part, [op], context=context, measure=False).frame
        except MillraceError as e:
            return Preview(part, k, f"{type(op).__name__}: {e}")
    return Preview(part)
