"""The formula language: statements ``NAME:=expr;`` (a variable) and ``NAME:expr;`` (an output).

Precedence from loose to tight: OR, AND, NOT, comparisons, + and -, * and /, sign. Names are case-insensitive;
truth is 1 and 0. References to the future are errors.
"""

import re
from dataclasses import dataclass

# Field names and their aliases, output names in order of preference, functions of the future.
FIELDS = {"CLOSE": "close", "C": "close", "OPEN": "open", "O": "open", "HIGH": "high", "H": "high", "LOW": "low", "L": "low", "VOLUME": "vol", "VOL": "vol", "V": "vol", "AMOUNT": "amount", "AMO": "amount"}
PREFERRED = ("XG", "选股", "SELECT", "选股条件")
FUTURE = ("REFX", "REFXV", "BACKSET", "ZIG")
#: Functions: number of arguments, and the place of the one that counts bars (None if none does).
FUNCTIONS = {"MA": (2, 1), "REF": (2, 1), "CROSS": (2, None), "COUNT": (2, 1), "HHV": (2, 1), "LLV": (2, 1), "SUM": (2, 1), "STD": (2, 1), "EVERY": (2, 1), "EXIST": (2, 1), "ABS": (1, None), "BARSCOUNT": (1, None), "BARSLAST": (1, None), "MAX": (2, None), "MIN": (2, None), "IF": (3, None), "NOT": (1, None), "LN": (1, None), "SQRT": (1, None)}

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_一-鿿][\w一-鿿]*)|(:=|>=|<=|<>|!=|&&|\|\||[-+*/(),;:<>=]))")
_COMPARE = (">", "<", ">=", "<=", "=", "<>")


class FormulaError(ValueError):
    """The formula cannot be parsed or refers to the future."""


@dataclass(frozen=True)
class Node:
    """``kind``: number, field, name, unary, binary or call; ``value`` is its number, name or operator."""

    kind: str
    value: object
    args: tuple = ()


@dataclass(frozen=True)
class Statement:
    name: str
    node: Node
    output: bool


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = re.sub(r"\{[^}]*\}", " ", text).rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise FormulaError(f"unexpected {text[at:at + 10]!r}")
            number, name, sign = m.groups()
            self.tokens.append(("number", float(number)) if number else ("name", name.upper()) if name else ("sign", {"&&": "AND", "||": "OR", "!=": "<>"}.get(sign, sign)))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def peek(self, ahead: int = 0):
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][1]

    def take(self, *values: str) -> str | None:
        if self.peek() in values and self.tokens[self.at][0] != "number":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if self.take(value) is None:
            raise FormulaError(f"{value!r} expected before {self.peek()!r}")

    def left(self, deeper, *operators: str) -> Node:
        node = deeper()
        while op := self.take(*operators):
            node = Node("binary", op, (node, deeper()))
        return node

    def expression(self) -> Node:
        return self.left(lambda: self.left(self.negation, "AND"), "OR")

    def negation(self) -> Node:
        if self.peek() == "NOT" and self.peek(1) != "(":
            self.take("NOT")
            return Node("call", "NOT", (self.negation(),))
        return self.left(lambda: self.left(lambda: self.left(self.factor, "*", "/"), "+", "-"), *_COMPARE)

    def factor(self) -> Node:
        if self.take("-"):
            return Node("unary", "-", (self.factor(),))
        if self.take("+"):
            return self.factor()
        if self.take("("):
            node = self.expression()
            self.need(")")
            return node
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Node("number", value)
        if kind != "name" or value in ("AND", "OR"):
            raise FormulaError(f"unexpected {value!r}")
        if self.take("("):
            return self.call(value)
        return Node("field", FIELDS[value]) if value in FIELDS else Node("name", value)

    def call(self, name: str) -> Node:
        if name in FUTURE:
            raise FormulaError(f"{name} refers to the future")
        if name not in FUNCTIONS:
            raise FormulaError(f"unknown function {name}")
        args = [self.expression()]
        while self.take(","):
            args.append(self.expression())
        self.need(")")
        count, bars = FUNCTIONS[name]
        if len(args) != count:
            raise FormulaError(f"{name} takes {count} arguments")
        if bars is not None and (args[bars].kind != "number" or args[bars].value != int(args[bars].value)):
            raise FormulaError(f"{name} needs a whole number of bars")
        return Node("call", name, tuple(args))


def parse(text: str) -> list[Statement]:
    """Statements in order; every name is known before it is used; a bare expression is an output."""
    reader, out, known = _Reader(text), [], set()
    while reader.peek() != "":
        if reader.take(";"):
            continue
        name, output = f"OUT{len(out)}", True
        if reader.tokens[reader.at][0] == "name" and reader.peek(1) in (":=", ":"):
            name = reader.tokens[reader.at][1]
            output = reader.peek(1) == ":"
            reader.at += 2
        node = reader.expression()
        for used in names(node):
            if used not in known:
                raise FormulaError(f"{used} is not known")
        out.append(Statement(name, node, output))
        known.add(name)
        if reader.peek() != "":
            reader.need(";")
    if not out:
        raise FormulaError("the formula is empty")
    return out


def names(node: Node) -> set[str]:
    return {node.value} if node.kind == "name" else set().union(*map(names, node.args)) if node.args else set()


def chosen(statements: list[Statement]) -> str:
    """The output that decides: the first with a preferred name, else a variable with one, else the last output."""
    for s in statements:
        if s.output and s.name in PREFERRED:
            return s.name
    for name in PREFERRED:
        if any(s.name == name for s in statements):
            return name
    outputs = [s.name for s in statements if s.output]
    if not outputs:
        raise FormulaError("the formula has no output")
    return outputs[-1]


def lookback(statements: list[Statement]) -> int | None:
    """Bars before the current one that decide its value; None if the whole history does."""
    depth: dict[str, int | None] = {}

    def of(node: Node) -> int | None:
        if node.kind in ("number", "field"):
            return 0
        if node.kind == "name":
            return depth[node.value]
        if node.value in ("BARSCOUNT", "BARSLAST"):
            return None
        below = [of(a) for a in node.args]
        if None in below:
            return None
        bars = FUNCTIONS.get(node.value, (0, None))[1] if node.kind == "call" else None
        own = 0 if bars is None else int(node.args[bars].value) - (node.value != "REF")
        if own < 0:
            return None
        return max(below, default=0) + (1 if node.value == "CROSS" else own)

    for s in statements:
        depth[s.name] = of(s.node)
    return depth[chosen(statements)]
