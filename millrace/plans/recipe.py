"""Recipes: ordered operators as versioned JSON.

An operator is written as {"name": {its parameters}}; names and parameters are in camel case. Parameters that
are left out have their defaults; unknown operators and newer versions are refused.
"""

from __future__ import annotations

import json
import re
import typing
from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from datetime import UTC, datetime

from ..errors import InvalidRecipe
from ..functions.chunks import ChunkerConfig
from ..functions.quality import QualityRules
from ..functions.text import NormalizeOptions
from ..operators import ops
from ..operators.augment import AugmentConfig

VERSION = 1
NAMES = {cls.__name__[0].lower() + cls.__name__[1:]: cls for cls in typing.get_args(ops.Op)}
#: Parameters whose written name is not the field's own.
WRITTEN = {"ngram_size": "nGramSize", "source": "from", "strip_html_tags": "stripHTMLTags", "decode_html_entities": "decodeHTMLEntities"}
NESTED = {"options": NormalizeOptions, "rules": QualityRules, ops.ChunkText: ChunkerConfig, ops.Augment: AugmentConfig}


def camel(name: str) -> str:
    return WRITTEN.get(name) or re.sub(r"_(\w)", lambda m: m[1].upper(), name)


def _encode(value: object) -> object:
    if is_dataclass(value):
        return {camel(f.name): _encode(getattr(value, f.name)) for f in fields(value) if getattr(value, f.name) is not None}
    return [_encode(x) for x in value] if isinstance(value, tuple) else value


def _decode(cls: type, given: object) -> object:
    if not isinstance(given, dict):
        raise InvalidRecipe(f"{cls.__name__} takes named parameters")
    out = {}
    for f in fields(cls):
        name = camel(f.name)
        if name not in given:
            if f.default is MISSING and f.default_factory is MISSING:
                raise InvalidRecipe(f"{cls.__name__} lacks {name}")
            continue
        value = given[name]
        inner = NESTED.get(cls) if f.name == "config" else NESTED.get(f.name)
        out[f.name] = _decode(inner, value) if inner else tuple(value) if isinstance(value, list) else value
    return cls(**out)


@dataclass
class Recipe:
    name: str
    ops: list[ops.Op]
    created_at: datetime = field(default_factory=lambda: datetime.now(UTC).replace(microsecond=0))
    version: int = VERSION

    def to_json(self) -> str:
        steps = [{type(op).__name__[0].lower() + type(op).__name__[1:]: _encode(op)} for op in self.ops]
        at = self.created_at.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        return json.dumps({"version": self.version, "name": self.name, "createdAt": at, "ops": steps}, indent=2, sort_keys=True, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Recipe:
        try:
            found = json.loads(text)
            if found["version"] > VERSION:
                raise InvalidRecipe(f"version {found['version']} is newer than {VERSION}")
            steps = []
            for step in found["ops"]:
                ((name, given),) = step.items()
                if name not in NAMES:
                    raise InvalidRecipe(f"no operator {name!r}")
                steps.append(_decode(NAMES[name], given))
            at = datetime.strptime(found["createdAt"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
            return Recipe(found["name"], steps, at, found["version"])
        except (KeyError, TypeError, ValueError, AttributeError) as e:
            raise InvalidRecipe(f"not a recipe: {e}") from e
