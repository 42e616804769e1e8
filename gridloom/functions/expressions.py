"""Scalar expressions over attributes: a small grammar that becomes Spark columns.

Operands are doubles; comparisons and logic give 1.0 or 0.0.  From loosest to
tightest: ``||``, ``&&``, comparisons (``== != > < >= <=``), ``+ -``,
``* / %``.  A sign is part of a number only; there are no unary operators.
Division follows IEEE (x/0 is an infinity or NaN), ``%`` takes both sides as
64-bit integers and is null for a zero divisor, NaN compares as false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ArraySchema, SchemaError

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(&&|\|\||==|!=|>=|<=|[-+*/%<>()]))")
_LEVELS = [["||"], ["&&"], ["==", "!=", ">", "<", ">=", "<="], ["+", "-"], ["*", "/", "%"]]

#: The fixed bounds of the compatibility preset.
PRESET_LO, PRESET_HI = 250000, 300000


@dataclass(frozen=True)
class Expression:
    """A parsed expression: its value, its truth and the attributes that it reads."""

    value: Column
    truth: Column
    attributes: tuple[str, ...]


class _Parser:
    def __init__(self, text: str, attributes: list[str]):
        self.tokens: list[tuple[str, str]] = []
        self.attributes, self.used, self.i = attributes, [], 0
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SchemaError(f"can't read the expression at {text[at:]!r}")
            self.tokens.append(("number", m[1]) if m[1] else ("name", m[2]) if m[2] else ("op", m[3]))
            at = m.end()

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.i += 1
        return token

    def binary(self, level: int = 0):
        if level == len(_LEVELS):
            return self.operand()
        left = self.binary(level + 1)
        while self.peek()[0] == "op" and self.peek()[1] in _LEVELS[level]:
            op = self.take()[1]
            left = _apply(op, left, self.binary(level + 1))
        return left

    def operand(self):
        kind, text = self.take()
        if kind == "op" and text in "+-" and self.peek()[0] == "number":
            return "number", F.lit(float(text + self.take()[1]))
        if kind == "number":
            return "number", F.lit(float(text))
        if kind == "name":
            if text not in self.attributes:
                raise SchemaError(f"{text} is no attribute")
            self.used.append(text)
            return "number", F.col(text).cast("double")
        if kind == "op" and text == "(":
            inner = self.binary()
            if self.take() != ("op", ")"):
                raise SchemaError("a parenthesis isn't closed")
            return inner
        raise SchemaError(f"an operand is missing before {text or 'the end'!r}")


def _number(x) -> Column:
    return x[1].cast("double") if x[0] == "truth" else x[1]


def _truth(x) -> Column:
    return x[1] if x[0] == "truth" else x[1] != 0


def divide(a: Column, b: Column) -> Column:
    """IEEE division of doubles, whatever the ANSI setting is."""
    limit = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b == 0, F.when(a.isNotNull(), limit)).otherwise(a / b)


def remainder(a: Column, b: Column) -> Column:
    """Remainder of the integer parts, with the dividend's sign; null for a zero divisor."""
    p, q = a.cast("long"), b.cast("long")
    return F.when(q != 0, p % q).cast("double")


def _apply(op: str, left, right):
    a, b = _number(left), _number(right)
    if op in ("&&", "||"):
        p, q = _truth(left), _truth(right)
        return "truth", p & q if op == "&&" else p | q
    if op in _LEVELS[2]:
        known = ~F.isnan(a) & ~F.isnan(b)
        if op == "!=":  # NaN differs from all
            return "truth", ~((a == b) & known)
        return "truth", {"==": a == b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op] & known
    return "number", {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divide(a, b), "%": lambda: remainder(a, b)}[op]()


def parse(text: str, schema: ArraySchema) -> Expression:
    """An expression over a subset of the array's attributes, one at least; dimensions can't be named."""
    parser = _Parser(text, schema.attribute_names)
    found = parser.binary()
    if parser.peek()[0] != "end":
        raise SchemaError(f"the expression goes on with {parser.peek()[1]!r}")
    if not parser.used:
        raise SchemaError("the expression names no attribute")
    return Expression(_number(found), _truth(found), tuple(dict.fromkeys(parser.used)))


_OPERATORS = {"LT": "<", "LE": "<=", "EQ": "==", "GE": ">=", "GT": ">", "NE": "!="}


def predicate(attribute: str, op: str, operand: float, schema: ArraySchema) -> Column:
    """``attribute op operand`` in the attribute's own type; op is LT, LE, EQ, GE, GT or NE."""
    kinds = dict(schema.attributes)
    if attribute not in kinds or op not in _OPERATORS:
        raise SchemaError(f"no predicate {attribute} {op}")
    if kinds[attribute] == "char":
        raise SchemaError("predicates are over numbers")
    a, b = F.col(attribute), F.lit(operand).cast(schema.struct()[attribute].dataType)
    return {"<": a < b, "<=": a <= b, "==": a == b, ">=": a >= b, ">": a > b, "!=": a != b}[_OPERATORS[op]]


def preset(attribute: str) -> Column:
    """The fixed-range filter on one attribute, for compatibility."""
    return F.col(attribute).cast("double").between(PRESET_LO, PRESET_HI)
