"""Language of a text: by script, or by stop words for languages in Latin script. Native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first characters that are read, code ranges of scripts, stop words.
SAMPLE = 4000
SCRIPTS = {
    "han": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}",
    "kana": r"\x{3040}-\x{30FF}",
    "ko": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}",
    "ru": r"\x{0400}-\x{04FF}",
    "ar": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}",
    "hi": r"\x{0900}-\x{097F}",
    "th": r"\x{0E00}-\x{0E7F}",
    "el": r"\x{0370}-\x{03FF}",
    "he": r"\x{0590}-\x{05FF}",
    "latin": r"\x{0041}-\x{024F}",
}
STOP_WORDS = {
    "de": "der die das und ist von zu den mit nicht auf für ein eine im sich des dem auch werden aus bei wird sind einer über nach als wie oder",
    "en": "the and is of to in that it was for on are with as this be at have not you from they his her which will would there their what",
    "es": "el la los las y es de que en un una por con para del se no su al lo como más pero sus le ya o este ha son",
    "fr": "le la les et est de des un une que qui dans pour sur pas avec au ce il elle sont mais nous vous par plus ou son aux être",
    "it": "il la le e è di che in un una per con del non si sono da come anche più ma nel alla gli dei questo essere della hanno al",
    "nl": "de het een en is van in op dat die met voor niet aan er om ook als maar bij of uit naar dan worden wordt door over zijn deze",
    "pl": "i w z na do to że się nie jest o jak po co tak za od przez przy ale czy dla być był tym jego które który już tylko",
    "pt": "o a os as e é de que em um uma por com para do da não se no na mais como mas foi ao ele das dos sua seu",
    "sv": "och det att i en är som för på med av den till inte har de om ett man var vid kan från eller efter men sig så vi under",
    "tr": "ve bir bu da de için ile olarak çok daha en gibi kadar sonra ama ancak olan olduğu her ne ise veya diğer bin yıl göre iki kendi aynı onun",
}


def _result(code: str | Column, confidence: float | Column) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    confidence = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.struct(code.alias("code"), confidence.cast("double").alias("confidence"))


def detect(text: Column) -> Column:
    """struct(code, confidence). Equal scores go to the language first in the alphabet."""
    sample = F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE)
    other = sample.rlike(r"[^\x{00}-\x{24F}]")
    some = F.when(sample.rlike(r"\p{IsAlphabetic}"), F.lit(1.0)).otherwise(F.lit(0.0))

    def count(pattern: str) -> Column:
        return F.regexp_count(sample, F.lit(pattern)).cast("double")

    # in a text without other scripts every letter is Latin: only shares matter
    state = F.struct(
        F.when(other, count(r"\p{IsAlphabetic}")).otherwise(some).alias("letters"),
        *[F.when(other, count(rf"[\p{{IsAlphabetic}}&&[{chars}]]")).otherwise(some if name == "latin" else F.lit(0.0)).alias(name) for name, chars in SCRIPTS.items()],
        F.filter(F.split(F.lower(sample), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "").alias("words"),
    )
    return F.element_at(F.transform(F.array(state), _judge), 1)


def _judge(s: Column) -> Column:
    def part(name: str) -> Column:
        return s[name] / F.when(s["letters"] > 0, s["letters"])

    n = F.size(s["words"])

    def share(stops: list[str]) -> Column:
        return (F.size(F.filter(s["words"], lambda w: w.isin(stops))) / F.when(n > 0, n)).cast("double")

    scores = F.array(*[share(words.split()) for words in STOP_WORDS.values()])
    by_words = F.element_at(F.transform(F.array(F.struct(scores.alias("all"), F.sort_array(scores, asc=False).alias("down"))), _best), 1)
    out = F.when(s["letters"] == 0, _result("und", 0.0))
    out = out.when(part("kana") > 0.1, _result("ja", F.least(F.lit(1.0), part("kana") + part("han") + 0.3)))
    out = out.when(part("han") > 0.5, _result("zh", part("han")))
    for code in ("ko", "ru", "ar", "hi", "th", "el", "he"):
        out = out.when(part(code) > 0.5, _result(code, part(code)))
    out = out.when(~(part("latin") > 0.5), _result("und", 0.2)).when(n < 3, _result("und", 0.1))
    return out.otherwise(by_words)


def _best(x: Column) -> Column:
    best, second = F.element_at(x["down"], 1), F.element_at(x["down"], 2)
    code = F.element_at(F.array(*map(F.lit, STOP_WORDS)), F.array_position(x["all"], best).cast("int"))
    sure = _result(code, F.least(F.lit(1.0), best * 3 + (best - second) * 2))
    return F.when(best > 0.03, sure).otherwise(_result("und", 0.1))
