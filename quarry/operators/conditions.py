"""Filter conditions as a small tree, compiled to columns under one of three rule sets.

engine  relational rules: = and != treat NULL as a value, order comparisons with NULL are false
graph   a missing property fails every comparison but !=; floats equal within machine epsilon
meta    a missing field fails every comparison
sql     plain three-valued logic
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 64
#: Fixed value: machine epsilon of a double.
EPSILON = 2.220446049250313e-16


class ConditionTooDeepError(ValueError):
    pass


@dataclass(frozen=True)
class Condition:
    """op is one of eq ne lt le gt ge and or not true exists contains starts_with in."""

    op: str
    field: str | None = None
    value: Any = None
    parts: tuple[Condition, ...] = ()

    def __and__(self, other: Condition) -> Condition:
        return Condition("and", parts=(self, other))

    def __or__(self, other: Condition) -> Condition:
        return Condition("or", parts=(self, other))

    def __invert__(self) -> Condition:
        return Condition("not", parts=(self,))

    def depth(self) -> int:
        return 1 + max([p.depth() for p in self.parts], default=0)


TRUE = Condition("true")


def eq(field: str, value: Any) -> Condition:
    return Condition("eq", field, value)


def ne(field: str, value: Any) -> Condition:
    return Condition("ne", field, value)


def lt(field: str, value: Any) -> Condition:
    return Condition("lt", field, value)


def le(field: str, value: Any) -> Condition:
    return Condition("le", field, value)


def gt(field: str, value: Any) -> Condition:
    return Condition("gt", field, value)


def ge(field: str, value: Any) -> Condition:
    return Condition("ge", field, value)


def exists(field: str) -> Condition:
    return Condition("exists", field)


def contains(field: str, value: str) -> Condition:
    return Condition("contains", field, value)


def starts_with(field: str, value: str) -> Condition:
    return Condition("starts_with", field, value)


def is_in(field: str, values: list) -> Condition:
    return Condition("in", field, tuple(values))


def _compare(op: str, c: Column, v: Any) -> Column:
    return {"eq": lambda: c == v, "ne": lambda: c != v, "lt": lambda: c < v, "le": lambda: c <= v, "gt": lambda: c > v, "ge": lambda: c >= v}[op]()


def compile_condition(cond: Condition, mode: str = "engine", resolve=F.col, max_depth: int = MAX_DEPTH) -> Column:
    """A boolean column. resolve turns a field name into a column, so that properties may live in a map or struct."""
    if cond.depth() > max_depth:
        raise ConditionTooDeepError(f"condition is nested deeper than {max_depth}")
    return _compile(cond, mode, resolve)


def _compile(cond: Condition, mode: str, resolve) -> Column:
    if cond.op == "true":
        return F.lit(True)
    if cond.op in ("and", "or"):
        sides = [_compile(p, mode, resolve) for p in cond.parts]
        return reduce(lambda a, b: a & b if cond.op == "and" else a | b, sides)
    if cond.op == "not":
        return ~_compile(cond.parts[0], mode, resolve)
    c, v = resolve(cond.field), cond.value
    if cond.op == "exists":
        return c.isNotNull()
    if cond.op == "contains":
        return F.coalesce(c.cast("string").contains(v), F.lit(False))
    if cond.op == "starts_with":
        return F.coalesce(c.cast("string").startswith(v), F.lit(False))
    if cond.op == "in":
        return F.coalesce(c.isin(*v), F.lit(False)) if v else F.lit(False)
    if mode == "sql":
        return _compare(cond.op, c, v)
    if mode == "engine" and cond.op in ("eq", "ne"):
        same = c.eqNullSafe(F.lit(v))
        return same if cond.op == "eq" else ~same
    if isinstance(v, bool) and cond.op not in ("eq", "ne"):
        return F.lit(False)  # truth values have no order
    if v is None:
        return F.lit(cond.op == "ne") & c.isNotNull() if mode == "meta" else F.lit(False)
    if mode == "graph" and isinstance(v, float) and cond.op in ("eq", "ne"):
        close = F.abs(c - v) < EPSILON
        return F.coalesce(close if cond.op == "eq" else ~close, F.lit(cond.op == "ne"))
    return F.coalesce(_compare(cond.op, c, v), F.lit(mode == "graph" and cond.op == "ne"))


def truthy(c: Column, kind: str) -> Column:
    """Whether a value of a Spark type counts as true: NULL, 0, empty text and false don't."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c) > 0, F.lit(False))
    return F.coalesce(c != 0, F.lit(False))
