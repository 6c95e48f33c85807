"""The row expression language, compiled to native columns.

Cells are dynamically typed in the language; here each column has one kind, and rules that depend on a
cell's kind become conditions on its being null. Evaluation is total: what cannot be computed is null, so the order
in which Spark evaluates conditions does not matter. Whole-number overflow gives null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExpressionError
from . import language, tokens
from .values import SPACE, kind_of, number, show, trim, truthy

POWERS = {"or": 1, "and": 2, "==": 3, "!=": 3, "<": 4, ">": 4, "<=": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}
ALIASES = {"&&": "and", "||": "or"}
_lexeme = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<name>[^\W\d]\w*)|(?P<quote>['\"])|(?P<op>==|!=|<=|>=|&&|\|\||[-+*/%<>!(),]))")
_escapes = {"n": "\n", "t": "\t"}


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = field(default_factory=tuple)


Node = Literal | Name | Call


def lex(text: str) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    at = 0
    while text[at:].strip():
        m = _lexeme.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at}: {text[at:].strip()[:1]!r}")
        at = m.end()
        if m["number"]:
            out.append(("literal", float(m["number"]) if "." in m["number"] else int(m["number"])))
        elif m["name"]:
            word = m["name"]
            if word in ("true", "false", "null"):
                out.append(("literal", {"true": True, "false": False, "null": None}[word]))
            else:
                out.append(("op", word) if word in ("and", "or", "not") else ("name", word))
        elif m["quote"]:
            value = []
            while True:
                if at >= len(text):
                    raise ExpressionError("a string is not closed")
                c = text[at]
                at += 1
                if c == m["quote"]:
                    break
                if c == "\\" and at < len(text):
                    c = _escapes.get(text[at], text[at])
                    at += 1
                value.append(c)
            out.append(("literal", "".join(value)))
        else:
            out.append(("op", ALIASES.get(m["op"], m["op"])))
    return out


def parse(text: str) -> Node:
    """The expression as a tree; raises ExpressionError."""
    found = [*lex(text), ("end", None)]
    at = 0

    def take(op: str) -> None:
        nonlocal at
        if found[at] != ("op", op):
            raise ExpressionError(f"expected {op!r}, found {found[at][1]!r}")
        at += 1

    def primary() -> Node:
        nonlocal at
        kind, value = found[at]
        at += 1
        if kind == "literal":
            return Literal(value)
        if kind == "name":
            if found[at] != ("op", "("):
                return Name(value)
            at += 1
            args = []
            if found[at] != ("op", ")"):
                args.append(expression(0))
                while found[at] == ("op", ","):
                    at += 1
                    args.append(expression(0))
            take(")")
            return Call(value, tuple(args))
        if (kind, value) == ("op", "("):
            inner = expression(0)
            take(")")
            return inner
        if (kind, value) == ("op", "-"):
            return Call("negate", (primary(),))
        if kind == "op" and value in ("not", "!"):
            return Call("not", (expression(3),))
        raise ExpressionError("the expression ends early" if kind == "end" else f"unexpected {value!r}")

    def expression(least: int) -> Node:
        nonlocal at
        left = primary()
        while found[at][0] == "op" and POWERS.get(found[at][1], 0) > 0 and POWERS[found[at][1]] >= max(least, 1):
            op = found[at][1]
            at += 1
            left = Call(op, (left, expression(POWERS[op] + 1)))
        return left

    out = expression(0)
    if found[at][0] != "end":
        raise ExpressionError(f"unexpected {found[at][1]!r}")
    return out


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str

    @property
    def text(self) -> Column:
        return show(self.column, self.kind)

    @property
    def value(self) -> Column:
        return number(self.column, self.kind)

    @property
    def holds(self) -> Column:
        return truthy(self.column, self.kind)


NUMERIC = ("int", "double", "bool")


def _literal(value: object) -> Typed:
    if value is None:
        return Typed(F.lit(None).cast("string"), "null")
    if isinstance(value, bool):
        return Typed(F.lit(value), "bool")
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint"), "int")
    return Typed(F.lit(value), "double" if isinstance(value, float) else "string")


def _unify(parts: list[Typed]) -> tuple[list[Column], str]:
    """The columns under one kind: numbers as doubles, anything else mixed as text (nulls stay null)."""
    kinds = {p.kind for p in parts} - {"null"}
    if len(kinds) <= 1:
        kind = next(iter(kinds), "null")
        cast = {"int": "bigint", "double": "double", "date": "timestamp", "bool": "boolean"}.get(kind, "string")
        return [p.column.cast(cast) if p.kind != "null" else F.lit(None).cast(cast) for p in parts], kind
    if kinds == {"int", "double"}:
        return [p.column.cast("double") for p in parts], "double"
    return [F.when(p.column.isNotNull(), p.text) for p in parts], "string"


def _arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if op == "+" and "string" in (a.kind, b.kind):
        some = [x.column.isNotNull() for x in (a, b) if x.kind == "string"]
        joined = F.concat(a.text, b.text)
        # without a string in the row, null and a number are added: null
        return Typed(F.when(some[0] if len(some) == 1 else some[0] | some[1], joined), "string")
    if op == "%":
        if (a.kind, b.kind) == ("int", "int"):
            return Typed(F.when(b.column != 0, a.column % F.when(b.column != 0, b.column)), "int")
        return Typed(F.lit(None).cast("bigint"), "int")
    if op != "/" and (a.kind, b.kind) == ("int", "int"):
        return Typed({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.column, b.column), "int")
    if a.kind not in NUMERIC or b.kind not in NUMERIC:
        return Typed(F.lit(None).cast("double"), "double")
    if op == "/":
        return Typed(F.when(b.value != 0, a.value / F.when(b.value != 0, b.value)), "double")
    return Typed({"+": a.value + b.value, "-": a.value - b.value, "*": a.value * b.value}[op], "double")


def _equal(a: Typed, b: Typed) -> Column:
    if "null" in (a.kind, b.kind) or a.kind == b.kind:
        return a.column.eqNullSafe(b.column) if a.kind == b.kind else a.column.isNull() & b.column.isNull()
    if {a.kind, b.kind} == {"int", "double"}:
        return a.value.eqNullSafe(b.value)
    return a.column.isNull() & b.column.isNull()


def _order(op: str, a: Typed, b: Typed) -> Column:
    def compare(x: Column, y: Column) -> Column:
        return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]

    shown = compare(a.text, b.text)
    if (a.kind, b.kind) == ("int", "int"):
        typed = compare(a.column, b.column)
    elif a.kind in NUMERIC and b.kind in NUMERIC:
        typed = compare(a.value, b.value)
    elif (a.kind, b.kind) == ("date", "date"):
        typed = compare(a.column, b.column)
    else:
        return shown
    return F.when(a.column.isNotNull() & b.column.isNotNull(), typed).otherwise(shown)


def _substr(args: list[Typed]) -> Column:
    text, start = args[0].text, args[1].value.try_cast("int")
    size = F.length(text)
    count = args[2].value.try_cast("int") if len(args) > 2 else size
    able = (start >= 0) & (start < size) & (count > 0)
    return F.when(able, F.substring(text, start + 1, count)).otherwise(F.lit(""))


def _pair(args: list[Typed], pick) -> Typed:
    a, b = args[0].value, args[1].value
    return Typed(F.when(a.isNotNull() & b.isNotNull(), pick(a, b)), "double")


#: name: (least and most arguments, compilation of typed arguments)
FUNCTIONS = {
    "len": (1, 1, lambda a: Typed(F.length(a[0].text).cast("bigint"), "int")),
    "lower": (1, 1, lambda a: Typed(F.lower(a[0].text), "string")),
    "upper": (1, 1, lambda a: Typed(F.upper(a[0].text), "string")),
    "trim": (1, 1, lambda a: Typed(trim(a[0].text), "string")),
    "contains": (2, 2, lambda a: Typed(F.contains(a[0].text, a[1].text), "bool")),
    "starts_with": (2, 2, lambda a: Typed(F.startswith(a[0].text, a[1].text), "bool")),
    "ends_with": (2, 2, lambda a: Typed(F.endswith(a[0].text, a[1].text), "bool")),
    "replace": (3, 3, lambda a: Typed(F.replace(a[0].text, a[1].text, a[2].text), "string")),
    "substr": (2, 3, lambda a: Typed(_substr(a), "string")),
    "concat": (0, 99, lambda a: Typed(F.concat(F.lit(""), *[x.text for x in a]), "string")),
    "coalesce": (0, 99, lambda a: _coalesce(a)),
    "words": (1, 1, lambda a: Typed(F.regexp_count(a[0].text, F.lit(f"[^{SPACE}]+")).cast("bigint"), "int")),
    "lang": (1, 1, lambda a: Typed(language.detect(a[0].text)["code"], "string")),
    "is_null": (0, 1, lambda a: Typed(a[0].column.isNull() if a else F.lit(True), "bool")),
    "abs": (1, 1, lambda a: Typed(F.abs(a[0].column), a[0].kind) if a[0].kind in ("int", "double") else Typed(F.lit(None).cast("double"), "double")),
    "round": (1, 1, lambda a: Typed(F.round(a[0].value, 0).try_cast("bigint"), "int")),
    "min": (2, 2, lambda a: _pair(a, F.least)),
    "max": (2, 2, lambda a: _pair(a, F.greatest)),
    "if": (3, 3, lambda a: _if(a)),
}


def _coalesce(args: list[Typed]) -> Typed:
    if not args:
        return _literal(None)
    columns, kind = _unify(args)
    return Typed(F.coalesce(*columns), kind)


def _if(args: list[Typed]) -> Typed:
    (yes, no), kind = _unify(args[1:])
    return Typed(F.when(args[0].holds, yes).otherwise(no), kind)


def compile_node(node: Node, schema: T.StructType, tokenizer: tokens.Tokenizer | None = None) -> Typed:
    """The tree as a typed column; `tokenizer` is what tokens() counts with."""
    if isinstance(node, Literal):
        return _literal(node.value)
    if isinstance(node, Name):
        return _column(node.name, schema)
    if node.name == "col":
        if len(node.args) != 1 or not isinstance(node.args[0], Literal) or not isinstance(node.args[0].value, str):
            raise ExpressionError("col() takes one name in quotes")
        return _column(node.args[0].value, schema)
    args = [compile_node(x, schema, tokenizer) for x in node.args]
    if node.name == "tokens" and len(args) == 1:
        return Typed((tokenizer or tokens.Estimator()).column(args[0].text), "int")
    if node.name in POWERS or node.name in ("not", "negate"):
        return _operator(node.name, args)
    if node.name not in FUNCTIONS:
        raise ExpressionError("tokens() takes one argument" if node.name == "tokens" else f"no function {node.name!r}")
    least, most, build = FUNCTIONS[node.name]
    if not least <= len(args) <= most:
        raise ExpressionError(f"{node.name}() takes {least} to {most} arguments, not {len(args)}")
    return build(args)


def _operator(op: str, args: list[Typed]) -> Typed:
    if op == "not":
        return Typed(~args[0].holds, "bool")
    if op == "negate":
        a = args[0]
        return Typed(-a.column, a.kind) if a.kind in ("int", "double") else Typed(F.lit(None).cast("double"), "double")
    a, b = args
    if op in ("and", "or"):
        return Typed(a.holds & b.holds if op == "and" else a.holds | b.holds, "bool")
    if op in ("==", "!="):
        return Typed(_equal(a, b) if op == "==" else ~_equal(a, b), "bool")
    if op in ("<", ">", "<=", ">="):
        return Typed(_order(op, a, b), "bool")
    return _arithmetic(op, a, b)


def _column(name: str, schema: T.StructType) -> Typed:
    if name not in schema.names:
        raise ExpressionError(f"no column {name!r}")
    kind = kind_of(schema[name].dataType)
    c = F.col(f"`{name}`")
    if kind == "int":
        c = c.cast("bigint")
    elif kind == "double":
        c = c.cast("double")
    elif kind == "date":
        c = c.cast("timestamp")
    elif kind == "string" and not isinstance(schema[name].dataType, T.StringType):
        c = F.to_json(c) if isinstance(schema[name].dataType, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
    return Typed(c, kind)


def _plain_condition(node: Call, schema: T.StructType, tokenizer: tokens.Tokenizer | None) -> Column | None:
    """A comparison of a column with a literal as sources understand it, where a null column would not hold anyway."""
    sides = dict(zip(("a", "b"), node.args, strict=True))
    literal = next((k for k, x in sides.items() if isinstance(x, Literal) and x.value is not None), None)
    if literal is None or node.name not in ("==", "<", ">", "<=", ">="):
        return None
    a, b = (compile_node(x, schema, tokenizer) for x in node.args)
    numbers = {a.kind, b.kind} <= {"int", "double"}
    if not numbers and not (a.kind == b.kind == "string"):
        return None
    # a null shows as the empty text, which sorts before any other
    first_holds = {"a": (">", ">="), "b": ("<", "<=")}[literal]
    if node.name in first_holds or (sides[literal].value == "" and node.name in ("<=", ">=")):
        return None
    x, y = (a.column, b.column) if a.kind == b.kind else (a.value, b.value)
    return {"==": x == y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[node.name]


def _condition(node: Node, schema: T.StructType, tokenizer: tokens.Tokenizer | None) -> Column:
    if isinstance(node, Call) and node.name in ("and", "or"):
        a, b = (_condition(x, schema, tokenizer) for x in node.args)
        return a & b if node.name == "and" else a | b
    plain = _plain_condition(node, schema, tokenizer) if isinstance(node, Call) and len(node.args) == 2 else None
    return compile_node(node, schema, tokenizer).holds if plain is None else plain


def compile_condition(text: str, schema: T.StructType, tokenizer: tokens.Tokenizer | None = None) -> Column:
    """The expression as a filter, in which null counts as false; plain comparisons can be pushed to the source."""
    return _condition(parse(text), schema, tokenizer)


def compile_expression(text: str, schema: T.StructType, tokenizer: tokens.Tokenizer | None = None) -> Typed:
    """Parse and compile; raises ExpressionError for bad syntax, unknown names and wrong arguments."""
    return compile_node(parse(text), schema, tokenizer)
