"""Rows shaped into the records that training frameworks read, with what is unfit set aside and a reason given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRecipe
from ..functions.values import RID, kind_of, show

#: schema: required fields, optional fields
SCHEMAS = {
    "alpaca": (("instruction", "output"), ("input",)),
    "openaiMessages": (("user", "assistant"), ("system",)),
    "anthropicTurns": (("user", "assistant"), ("system",)),
    "chatml": (("user", "assistant"), ("system",)),
    "dpo": (("prompt", "chosen", "rejected"), ()),
    "completion": (("prompt", "completion"), ()),
    "corpus": (("text",), ()),
    "ragChunks": (("text",), ("source", "heading")),
}
#: Column names that stand for a field, best first.
SYNONYMS = {
    "instruction": "instruction question prompt query task q",
    "input": "input context passage",
    "output": "output answer response completion a",
    "system": "system system_prompt",
    "user": "user question prompt instruction human q input",
    "assistant": "assistant answer response output completion a bot",
    "prompt": "prompt question instruction query input",
    "chosen": "chosen preferred good winner",
    "rejected": "rejected dispreferred bad loser",
    "completion": "completion output answer response text",
    "text": "text content body document passage",
    "source": "source file url origin doc",
    "heading": "heading title section heading_path",
}


def auto_map(schema: str, columns: list[str]) -> dict[str, str]:
    """field: column, by common names."""
    lower = {c.lower(): c for c in reversed(columns)}
    out = {}
    for name in (*SCHEMAS[schema][0], *SCHEMAS[schema][1]):
        found = next((lower[s] for s in SYNONYMS[name].split() if s in lower), None)
        if found:
            out[name] = found
    return out


@dataclass
class Shaped:
    """valid: `_rid`, json; quarantine: `_rid`, reason."""

    valid: DataFrame
    quarantine: DataFrame


def natural(c: Column, data_type: T.DataType) -> Column:
    """A cell as it stands in JSON: dates as text, numbers that JSON lacks as null."""
    kind = kind_of(data_type)
    if kind == "date":
        return F.when(c.isNotNull(), show(c, kind))
    if kind == "double":
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c.cast("double"))
    return c


def shape(df: DataFrame, schema: str, mapping: dict[str, str] | None = None) -> Shaped:
    """df (with `_rid`) as JSON lines of a schema. Rows that lack a required field are set aside."""
    if schema not in SCHEMAS:
        raise InvalidRecipe(f"no schema {schema!r}")
    names = [c for c in df.columns if c != RID]
    mapping = auto_map(schema, names) if mapping is None else mapping
    required, optional = SCHEMAS[schema]

    def cell(name: str) -> Column:
        source = mapping.get(name)
        if source not in names:
            return F.lit(None).cast("string")
        c = F.col(f"`{source}`")
        return F.when(c.isNotNull(), show(c, kind_of(df.schema[source].dataType)))

    lacking = F.array_compact(F.array(*[F.when(F.coalesce(cell(f), F.lit("")) == "", F.lit(f)) for f in required]))
    reason = F.when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", ")))
    if schema == "dpo":
        reason = reason.when(cell("chosen") == cell("rejected"), F.lit("chosen == rejected"))
    text = {f: F.coalesce(cell(f), F.lit("")) for f in (*required, *optional)}
    judged = df.withColumn("__reason", reason)
    record = _record(schema, text, cell, df, names, mapping)
    valid = judged.where(F.col("__reason").isNull()).select(RID, record.alias("json"))
    return Shaped(valid, judged.where(F.col("__reason").isNotNull()).select(RID, F.col("__reason").alias("reason")))


def _turns(text: dict[str, Column], with_system: bool) -> Column:
    def turn(role: str) -> Column:
        return F.struct(text[role].alias("content"), F.lit(role).alias("role"))

    turns = F.array(turn("user"), turn("assistant"))
    return F.when(text["system"] != "", F.concat(F.array(turn("system")), turns)).otherwise(turns) if with_system else turns


def _record(schema: str, text: dict[str, Column], cell, df: DataFrame, names: list[str], mapping: dict[str, str]) -> Column:
    """The row's JSON, keys sorted."""
    if schema == "openaiMessages":
        return F.to_json(F.struct(_turns(text, True).alias("messages")))
    if schema == "anthropicTurns":
        return F.to_json(F.struct(_turns(text, False).alias("messages"), F.when(text["system"] != "", text["system"]).alias("system")))
    if schema == "chatml":

        def turn(role: str) -> Column:
            return F.concat(F.lit(f"<|im_start|>{role}\n"), text[role], F.lit("<|im_end|>"))

        system = F.when(text["system"] != "", F.concat(turn("system"), F.lit("\n"))).otherwise(F.lit(""))
        return F.to_json(F.struct(F.concat(system, turn("user"), F.lit("\n"), turn("assistant")).alias("text")))
    if schema == "ragChunks":
        free = [c for c in names if c not in mapping.values()]
        parts = {"source": cell("source"), "heading": cell("heading")} | {c: natural(F.col(f"`{c}`"), df.schema[c].dataType) for c in free}
        meta = F.struct(*[parts[k].alias(k) for k in sorted(parts)])
        return F.to_json(F.struct(F.col(RID).alias("id"), meta.alias("metadata"), text["text"].alias("text")))
    return F.to_json(F.struct(*[text[k].alias(k) for k in sorted(text)]))
