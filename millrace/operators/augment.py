"""Enrichment of rows by a language model, with a deterministic client that needs no network.

Rows whose first output column is filled are skipped, so an interrupted run can go on. Calls run in `mapInPandas` with a
small thread pool in each task; materialise the result once, for a task that is retried repeats its calls.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRecipe, ProviderError
from ..functions.chunks import SPACES
from ..functions.tokens import Tokenizer
from ..functions.values import kind_of, show, stable_hash

OUTPUTS = {"generateQA": ("gen_question", "gen_answer"), "judgeScore": ("judge_score", "judge_rationale"), "rewrite": ("rewritten",), "classify": ("label",), "preferencePair": ("rejected",)}
PROMPT_CHARS, ATTEMPTS = 24_000, 4
STOP_WORDS = frozenset("the and that this with from have which there their about would these other into than then them were been".split())
#: Marks of text that was decoded with the wrong encoding, and what they stand for.
ARTIFACTS = {"â€™": "’", "â€œ": "“", "â€\x9d": "”", "â€“": "–", "â€”": "—", "Â ": " ", "﻿": ""}


@dataclass(frozen=True)
class AugmentConfig:
    kind: str
    column: str
    instruction: str = ""
    labels: tuple[str, ...] = ()
    concurrency: int = 4
    max_tokens: int = 1024


class Client(Protocol):
    name: str

    def complete(self, system: str, user: str, max_tokens: int) -> str: ...


def system_prompt(config: AugmentConfig) -> str:
    labels = ", ".join(config.labels) or "appropriate topical labels"
    task = {
        "generateQA": 'Write training data from a passage: ONE question that the passage answers and the best answer, from the passage alone. Answer with JSON only: {"question": "...", "answer": "..."}',
        "judgeScore": 'Judge how good the text is as training data, from 1 to 10 (10 is best), for coherence, information and use. Answer with JSON only: {"score": N, "rationale": "one sentence"}',
        "rewrite": "Correct grammar, spelling and encoding damage of the text. Keep meaning, facts, tone and language; add and drop nothing. Answer with the rewritten text only.",
        "classify": f'Give the text one label, exactly one of: {labels}. Respond with JSON only: {{"label": "..."}}',
        "preferencePair": "Write a clearly worse answer to the given text, on its topic but less accurate, helpful or ordered. Answer with the worse response only.",
    }
    if config.kind not in task:
        raise InvalidRecipe(f"no augmentation {config.kind!r}")
    return task[config.kind] + (f"\nAdditional guidance: {config.instruction}" if config.instruction else "")


# -- the client without network ------------------------------------------------------------------------------


def _sentences(text: str) -> list[str]:
    return [f"{x}." for part in re.split(r"[.!?\n]", text) if (x := part.strip(SPACES))]


def _subject(text: str) -> str:
    words = [w for w in re.findall(r"[^\W\d_]+", text.lower()) if len(w) > 3 and w not in STOP_WORDS]
    top = sorted(Counter(words).items(), key=lambda x: (-x[1], x[0]))[:2]
    return " and ".join(w for w, _ in top) or "this topic"


def judge_score(text: str) -> tuple[int, str]:
    words = text.split()
    variety = len({w.lower() for w in words}) / len(words) if words else 0.0
    n = len(_sentences(text))
    score = 4 + (len(words) >= 12) + (len(words) >= 40) + (n >= 2) + (variety >= 0.6) + any(c.isnumeric() for c in text)
    verdict = "coherent and informative enough for training data." if score >= 7 else "usable but thin; consider filtering or enriching."
    return min(10, score), f"{len(words)} words across {n} sentence(s), lexical variety {variety:.2f} — {verdict}"


def _labels(system: str) -> list[str]:
    _, found, tail = system.partition("exactly one of: ")
    parts = [x for part in tail.partition(". Respond")[0].split(",") if (x := part.strip())] if found else []
    return [] if len(parts) == 1 and " " in parts[0] and parts[0].endswith("labels") else parts


def _rewrite(text: str) -> str:
    for bad, good in ARTIFACTS.items():
        text = text.replace(bad, good)
    text = re.sub(r"[ \t]+", " ", text.replace("\r\n", "\n"))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" +([,.;:!?])", r"\1", text)).strip(SPACES)


class DemoClient:
    """Answers made from the text itself; the same on every run."""

    name = "demo"

    def complete(self, system: str, user: str, max_tokens: int) -> str:
        text = user.strip(SPACES)
        if '"question"' in system:
            found = _sentences(text)
            question = f"What does this passage explain about {_subject(text)}?" if found else "What does this passage describe?"
            return json.dumps({"question": question, "answer": " ".join(found[:2]) or text})
        if '"score"' in system:
            score, why = judge_score(text)
            return json.dumps({"score": score, "rationale": why})
        if '"label"' in system:
            labels = _labels(system)
            if not labels:
                return json.dumps({"label": _subject(text)})
            hit = next((x for x in labels if x.lower() in text.lower()), None)
            return json.dumps({"label": hit or labels[stable_hash(text) % len(labels)]})
        if "rewritten text only" in system:
            return _rewrite(text)
        if "worse response only" in system:
            first = next(iter(_sentences(text)), text[:120])
            first = first[:90] + "…" if len(first) > 90 else first
            return f"Basically, {first[:1].lower()}{first[1:]} That's pretty much all there is to it."
        return "ready"


@dataclass(frozen=True)
class HttpClient:
    """A chat service over HTTP. The key is read from the environment where the call is made, never stored."""

    name: str
    url: str
    model: str
    key_variable: str
    temperature: float = 0.2
    style: str = "chat"  # or "messages"

    def request(self, system: str, user: str, max_tokens: int) -> tuple[dict, dict]:
        key = os.environ.get(self.key_variable, "")
        body = {"model": self.model, "max_tokens": max_tokens, "temperature": self.temperature}
        if self.style == "messages":
            return {"x-api-key": key, "anthropic-version": "2023-06-01"}, body | {"system": system, "messages": [{"role": "user", "content": user}]}
        return {"Authorization": f"Bearer {key}"}, body | {"messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}

    def complete(self, system: str, user: str, max_tokens: int) -> str:
        headers, body = self.request(system, user, max_tokens)
        call = urllib.request.Request(self.url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(call, timeout=120) as answer:
                found = json.load(answer)
        except urllib.error.HTTPError as e:
            raise ProviderError(f"{e.code} {e.reason}") from e
        except OSError as e:
            raise ProviderError(f"timeout or connection: {e}") from e
        return found["content"][0]["text"] if self.style == "messages" else found["choices"][0]["message"]["content"]


#: Services: address, style of request, environment variable of the key.
SERVICES = {
    "anthropic": ("https://api.anthropic.com/v1/messages", "messages", "ANTHROPIC_API_KEY"),
    "openai": ("https://api.openai.com/v1/chat/completions", "chat", "OPENAI_API_KEY"),
    "compatible": ("http://localhost:11434/v1/chat/completions", "chat", "COMPATIBLE_API_KEY"),
}


def client(service: str, model: str = "", *, base_url: str = "", temperature: float = 0.2) -> Client:
    """demo, or one of SERVICES; `base_url` replaces the address up to the path of the call."""
    if service == "demo":
        return DemoClient()
    if service not in SERVICES:
        raise InvalidRecipe(f"no service {service!r}")
    url, style, key = SERVICES[service]
    if base_url:
        url = base_url.rstrip("/") + ("/messages" if style == "messages" else "/chat/completions")
    return HttpClient(service, url, model, key, temperature, style)


TRANSIENT = re.compile(r"\b(408|409|429|500|502|503|504|529)\b|timeout|connection|overloaded", re.I)


def with_retries(client: Client, system: str, user: str, max_tokens: int, *, wait: Callable[[float], None] = time.sleep) -> str:
    """Up to four attempts, waiting 1, 2, 4 seconds, while the failure looks transient."""
    for attempt in range(ATTEMPTS):
        try:
            return client.complete(system, user, max_tokens)
        except ProviderError as e:
            if attempt == ATTEMPTS - 1 or not TRANSIENT.search(str(e)):
                raise
            wait(2.0**attempt)
    raise ProviderError("no attempt left")


# -- answers ---------------------------------------------------------------------------------------------------


def _unfenced(text: str) -> str:
    text = text.strip(SPACES)
    if text.startswith("```"):
        if "\n" in text:
            text = text.split("\n", 1)[1]
        if "```" in text:
            text = text[: text.rindex("```")]
    return text.strip(SPACES)


def _object(text: str) -> dict | None:
    for part in (text, text[text.find("{") : text.rfind("}") + 1] if "{" in text else ""):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def _text(x: object) -> str:
    return x if isinstance(x, str) else ""


def parse_answer(config: AugmentConfig, answer: str) -> list:
    """The values for the output columns; answers that are not the JSON asked for are used as text."""
    cleaned = _unfenced(answer)
    found = _object(cleaned) if config.kind in ("generateQA", "judgeScore", "classify") else None
    if config.kind == "generateQA":
        return [_text(found.get("question")), _text(found.get("answer"))] if found else ["", cleaned]
    if config.kind == "judgeScore":
        if not found:
            digits = "".join(c for c in cleaned[:20] if c.isdigit())[:2]
            return [int(digits or 0), cleaned]
        score = found.get("score")
        whole = int(score) if isinstance(score, (int, float)) else int(score) if isinstance(score, str) and re.fullmatch(r"[+-]?\d+", score) else 0
        return [whole, _text(found.get("rationale"))]
    if config.kind == "classify" and found:
        return [_text(found.get("label"))]
    return [cleaned]


def augmented(df: DataFrame, config: AugmentConfig, client: Client | None, tokenizer: Tokenizer) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], dict[str, Column]]:
    """The frame with answers beside it, how to fold them into the output columns, and what to measure."""
    if client is None:
        raise ProviderError("augmentation needs a client")
    system = system_prompt(config)
    names = OUTPUTS[config.kind]
    types = {n: "bigint" if n == "judge_score" else "string" for n in names}
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(None).cast(types[n]))
    source = show(F.col(f"`{config.column}`"), kind_of(df.schema[config.column].dataType))
    wide = df.withColumn("__ask", F.when(F.col(names[0]).isNull() & (F.regexp_replace(source, r"[\s\p{Z}]+", "") != ""), F.substring(source, 1, PROMPT_CHARS)))
    answers = ", ".join(f"__{n} {t}" for n, t in types.items())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = failed = 0

        def ask(text: str | None) -> list | Exception | None:
            if text is None:
                return None
            try:
                answer = with_retries(client, system, text, config.max_tokens)
                return [*parse_answer(config, answer), tokenizer.count(system) + tokenizer.count(text), tokenizer.count(answer)]
            except Exception as e:  # noqa: BLE001  a failed row is counted and left for the next run
                return e

        with ThreadPoolExecutor(max(1, config.concurrency)) as pool:
            for part in parts:
                found = []
                asked = part["__ask"].tolist()
                for low in range(0, len(asked), max(1, config.concurrency)):
                    for x in pool.map(ask, asked[low : low + max(1, config.concurrency)]):
                        failed += isinstance(x, Exception)
                        done += isinstance(x, list)
                        found.append(x)
                    if failed >= 5 and not done:
                        raise ProviderError(f"every call fails: {next(x for x in found if isinstance(x, Exception))}")
                empty = [None] * (len(names) + 2)
                rows = [x if isinstance(x, list) else empty for x in found]
                for k, n in enumerate(names):
                    part[f"__{n}"] = pd.Series([r[k] for r in rows], index=part.index, dtype="Int64" if types[n] == "bigint" else object)
                part["__in"] = pd.Series([r[-2] for r in rows], index=part.index, dtype="Int64")
                part["__out"] = pd.Series([r[-1] for r in rows], index=part.index, dtype="Int64")
                yield part

    asked = wide.mapInPandas(run, f"{schema}, {answers}, __in bigint, __out bigint")
    made = F.col("__in").isNotNull()

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("bigint")), F.lit(0))

    measures = {
        "cells": total(made) * len(names),
        "note:processed": total(made),
        "note:skipped": total(F.col("__ask").isNull()),
        "note:failed": total(F.col("__ask").isNotNull() & ~made),
        "note:tokens_in": total(F.col("__in")),
        "note:tokens_out": total(F.col("__out")),
    }

    def finish(x: DataFrame) -> DataFrame:
        return x.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])

    return asked, finish, measures


@dataclass(frozen=True)
class CostEstimate:
    calls: int
    input_tokens: int
    output_tokens: int

    def cost(self, input_per_million: float, output_per_million: float) -> float:
        return self.input_tokens / 1e6 * input_per_million + self.output_tokens / 1e6 * output_per_million


def estimate(df: DataFrame, config: AugmentConfig, tokenizer: Tokenizer) -> CostEstimate:
    """Calls and tokens that a run would take: one pass, one row."""
    if config.column not in df.columns:
        return CostEstimate(0, 0, 0)
    overhead = tokenizer.count(system_prompt(config)) + 64
    source = show(F.col(f"`{config.column}`"), kind_of(df.schema[config.column].dataType))
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(tokenizer.column(source) + overhead), F.lit(0)).alias("tokens")).head()
    return CostEstimate(row["n"], row["tokens"], row["n"] * min(config.max_tokens, 512))
