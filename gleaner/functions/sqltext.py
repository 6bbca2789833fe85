"""Expressions written as in PySpark and kept as SQL text.

A page's rules have some ten thousand nodes; as columns each node would be a call to the JVM, as text a whole stage is one.
Functions are those of Spark SQL by name; a Python function becomes a lambda; text is a literal, columns are named by ``col``.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

_number = count()


def text_of(x: object) -> str:
    if isinstance(x, Expr):
        return x.text
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return f"{x!r}D"
    if isinstance(x, int):
        return str(x) if abs(x) < 1 << 31 else f"{x}L"
    return "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"


class Expr:
    def __init__(self, text: str, name: str = "", open_case: bool = False):
        self.text, self.name, self.open_case = text, name, open_case

    def _with(self, sign: str, other: object, turned: bool = False) -> Expr:
        a, b = self.text, text_of(other)
        return Expr(f"({b} {sign} {a})" if turned else f"({a} {sign} {b})")

    __add__, __sub__, __mul__, __truediv__, __mod__ = (lambda self, o, s=s: self._with(s, o) for s in "+-*/%")
    __radd__, __rsub__, __rmul__ = (lambda self, o, s=s: self._with(s, o, True) for s in "+-*")
    __lt__, __le__, __gt__, __ge__, __eq__, __ne__ = (lambda self, o, s=s: self._with(s, o) for s in ("<", "<=", ">", ">=", "=", "<>"))  # type: ignore[assignment]
    __and__, __or__ = (lambda self, o, s=s: self._with(s, o) for s in ("AND", "OR"))
    __hash__ = None  # type: ignore[assignment]

    def __invert__(self) -> Expr:
        return Expr(f"(NOT {self.text})")

    def __neg__(self) -> Expr:
        return Expr(f"(- {self.text})")

    def __getitem__(self, key: str | int) -> Expr:
        return Expr(f"{self.text}.`{key}`") if isinstance(key, str) else Expr(f"{self.text}[{key}]")

    def alias(self, name: str) -> Expr:
        return Expr(self.text, name)

    def cast(self, kind: str) -> Expr:
        return Expr(f"CAST({self.text} AS {kind})")

    def isin(self, *items: object) -> Expr:
        listed = items[0] if len(items) == 1 and isinstance(items[0], list | tuple) else items
        return Expr(f"({self.text} IN ({', '.join(map(text_of, listed))}))")

    def rlike(self, pattern: str) -> Expr:
        return self._with("RLIKE", pattern)

    def endswith(self, other: object) -> Expr:
        return call("endswith", self, other)

    def between(self, a: object, b: object) -> Expr:
        return Expr(f"({self.text} BETWEEN {text_of(a)} AND {text_of(b)})")

    def isNull(self) -> Expr:
        return Expr(f"({self.text} IS NULL)")

    def isNotNull(self) -> Expr:
        return Expr(f"({self.text} IS NOT NULL)")

    def bitwiseXOR(self, other: object) -> Expr:
        return self._with("^", other)

    def bitwiseAND(self, other: object) -> Expr:
        return self._with("&", other)

    def when(self, test: Expr, value: object) -> Expr:
        return Expr(f"{self.text[:-5]} WHEN {test.text} THEN {text_of(value)} END)", open_case=True)

    def otherwise(self, value: object) -> Expr:
        return Expr(f"{self.text[:-5]} ELSE {text_of(value)} END)")

    def column(self) -> Column:
        return F.expr(self.text)


def col(name: str) -> Expr:
    return Expr(f"`{name}`")


def lit(x: object) -> Expr:
    return Expr(text_of(x))


def when(test: Expr, value: object) -> Expr:
    return Expr(f"(CASE WHEN {test.text} THEN {text_of(value)} END)", open_case=True)


def struct(*fields: Expr) -> Expr:
    return call("named_struct", *(part for x in fields for part in (x.name, x)))


def trim(x: Expr, characters: str = " ", side: str = "BOTH") -> Expr:
    return Expr(f"trim({side} {text_of(characters)} FROM {x.text})")


def function(f: Callable) -> str:
    names = [f"v{next(_number)}" for _ in inspect.signature(f).parameters]
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return f"{head} -> {text_of(f(*map(Expr, names)))}"


def call(name: str, *args: object) -> Expr:
    return Expr(f"{name}({', '.join(function(a) if callable(a) and not isinstance(a, Expr) else text_of(a) for a in args)})")


def __getattr__(name: str) -> Callable[..., Expr]:
    """Any function of Spark SQL."""
    if name.startswith("_"):
        raise AttributeError(name)
    return lambda *args: call(name, *args)
