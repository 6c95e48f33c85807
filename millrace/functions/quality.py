"""Rules that a text for training must pass, each with its own reason. Native columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import trim, trim_blanks

#: How a finished text ends, and words that it does not end with.
TERMINALS = '.!?"”。！？):'
DANGLERS = "the a an and or but of to in with for is was der die das und le la et de"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 3
    max_words: int = 100_000
    min_mean_word_length: float = 2.0
    max_mean_word_length: float = 12.0
    max_symbol_ratio: float = 0.3
    max_digit_ratio: float = 0.5
    max_uppercase_ratio: float = 0.6
    max_duplicate_line_ratio: float = 0.4
    max_top_bigram_ratio: float = 0.25
    require_terminal_punctuation: bool = False
    min_alpha_ratio: float = 0.5
    flag_truncated: bool = True


STANDARD = QualityRules()
#: Every reason that a rule can give, without its value.
REASONS = ("empty", "too_few_words", "too_many_words", "mean_word_length_low", "mean_word_length_high", "symbol_ratio", "digit_ratio", "alpha_ratio_low", "uppercase_ratio", "duplicate_lines", "repetitive_bigram", "no_terminal_punctuation", "truncated_ending")


def _bind(value: Column, body) -> Column:
    """body(x) with x standing for a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def top_bigram(words: Column) -> Column:
    """How often the most frequent pair of neighbouring words occurs: runs in the sorted pairs."""
    pairs = F.array_sort(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, pair: Column) -> Column:
        run = F.when(s["last"] == pair, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(pair.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(pairs, start, step, lambda s: s["best"])


def reasons(text: Column, rules: QualityRules = STANDARD) -> Column:
    """array<string>: why a text is rejected, "reason(value)"; empty if it passes."""

    def judge(t: Column) -> Column:
        words = F.filter(F.split(t, r"[ \n\t]+"), lambda w: w != "")
        lines = F.filter(F.transform(F.split(t, "\n"), trim_blanks), lambda x: x != "")
        state = F.struct(
            words.alias("words"),
            lines.alias("lines"),
            # letters are most of a text: they are what is left of it
            (F.length(t) - F.regexp_count(t, F.lit(r"[\s\p{Z}\x{85}]"))).alias("signs"),
            F.regexp_count(t, F.lit(r"[^\p{L}\p{M}\p{N}\s\p{Z}\x{85}]")).alias("symbols"),
            F.regexp_count(t, F.lit(r"\p{N}")).alias("digits"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).alias("uppers"),
        )
        return _bind(state, lambda s: _rules(t, s, rules))

    return _bind(trim(F.coalesce(text, F.lit(""))), lambda t: F.when(t == "", F.array(F.lit("empty"))).otherwise(judge(t)))


def _rules(t: Column, s: Column, rules: QualityRules) -> Column:
    n = F.size(s["words"])
    letters_of_words = F.aggregate(s["words"], F.lit(0), lambda a, w: a + F.length(w))
    mean = letters_of_words / F.when(n > 0, n)
    signs, letters = F.when(s["signs"] > 0, s["signs"]), s["signs"] - s["symbols"] - s["digits"]
    symbol, digit, alpha = s["symbols"] / signs, s["digits"] / signs, letters / signs
    upper = s["uppers"] / F.when(letters > 20, letters)
    duplicate = F.when(F.size(s["lines"]) >= 4, F.lit(1.0) - F.size(F.array_distinct(s["lines"])) / F.size(s["lines"]))
    lower = F.transform(s["words"], lambda w: F.lower(w))
    bigram = F.when(n >= 20, top_bigram(lower) / (n - 1))

    def told(name: str, holds: Column, value: Column | None = None, form: str = "%.2f") -> Column:
        reason = F.lit(name) if value is None else F.concat(F.lit(f"{name}("), F.format_string(form, value), F.lit(")"))
        return F.when(holds, reason)

    found = [
        told("too_few_words", n < rules.min_words, n, "%d"),
        told("too_many_words", n > rules.max_words, n, "%d"),
        told("mean_word_length_low", mean < rules.min_mean_word_length, mean, "%.1f"),
        told("mean_word_length_high", mean > rules.max_mean_word_length, mean, "%.1f"),
        told("symbol_ratio", symbol > rules.max_symbol_ratio, symbol),
        told("digit_ratio", digit > rules.max_digit_ratio, digit),
        told("alpha_ratio_low", alpha < rules.min_alpha_ratio, alpha),
        told("uppercase_ratio", upper > rules.max_uppercase_ratio, upper),
        told("duplicate_lines", duplicate > rules.max_duplicate_line_ratio, duplicate),
        told("repetitive_bigram", bigram > rules.max_top_bigram_ratio, bigram),
    ]
    if rules.require_terminal_punctuation:
        found.append(told("no_terminal_punctuation", ~F.right(t, F.lit(1)).isin(*TERMINALS)))
    if rules.flag_truncated:
        last = F.lower(F.element_at(s["words"], -1))
        open_end = last.isin(*DANGLERS.split()) | t.endswith("...") | t.endswith("…") | t.endswith(",") | t.endswith("-")
        found.append(told("truncated_ending", (n >= 10) & open_end))
    return F.array_compact(F.array(*found))


def score(text: Column) -> Column:
    """1 for a clean text, a quarter less for each reason of the standard rules, 0 for an empty one."""
    return _bind(reasons(text), lambda r: F.when(F.array_contains(r, "empty"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.size(r) * 0.25)))


def reason_name(reason: Column) -> Column:
    return F.substring_index(reason, "(", 1)
