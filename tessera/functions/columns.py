"""Expressions to Spark columns: name resolution, static type checks, and the semantics Spark lacks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaConflictError, UnresolvedColumnError, UnsupportedExpressionError
from .expr import Between, Binary, Call, Expr, InList, IsNull, Like, Literal, Name, Star, Unary, text

_LONG, _DOUBLE, _BOOL, _TEXT = T.LongType(), T.DoubleType(), T.BooleanType(), T.StringType()
_SYMBOL = {"EQ": "=", "NEQ": "<>", "LT": "<", "LE": "<=", "GT": ">", "GE": ">=", "ADD": "+", "SUB": "-", "MUL": "*", "DIV": "/", "MOD": "%"}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def distinct_names(names: list[str]) -> list[str]:
    seen: set[str] = set()
    for n in names:
        if n in seen:
            raise SchemaConflictError(n)
        seen.add(n)
    return names


def matches(name: Name, schema: T.StructType) -> list[str]:
    """The columns that ``name`` may stand for."""
    wanted = text(name)
    return [n for n in schema.names if n == wanted or not name.table and n.endswith("." + wanted)]


def resolve(name: Name, schema: T.StructType) -> str:
    """The full column name that ``name`` stands for."""
    found = matches(name, schema)
    if len(found) != 1:
        raise UnresolvedColumnError(text(name), "ambiguous" if found else "no such column")
    return found[0]


@dataclass(frozen=True)
class Typed:
    column: Column
    type: T.DataType
    constant: bool = False

    @property
    def kind(self) -> str:
        if isinstance(self.type, T.NullType):
            return "null"
        if isinstance(self.type, T.NumericType):
            return "number"
        return {T.StringType: "text", T.BooleanType: "boolean"}.get(type(self.type), "other")


def _reject(op: str, *sides: Typed) -> UnsupportedExpressionError:
    return UnsupportedExpressionError(f"{op} does not take {' and '.join(s.type.simpleString() for s in sides)}")


def _comparable(op: str, a: Typed, b: Typed) -> tuple[Column, Column] | None:
    """Both sides in comparable form; None if they are never equal."""
    kinds = {a.kind, b.kind}
    if "null" in kinds or len(kinds) == 1 or "other" in kinds:
        return a.column, b.column
    if kinds == {"boolean", "number"}:
        return tuple(s.column.cast("long") if s.kind == "boolean" else s.column for s in (a, b))
    if op in ("EQ", "NEQ"):
        return None
    raise _reject(_SYMBOL[op], a, b)


def _compare(op: str, a: Typed, b: Typed) -> Column:
    sides = _comparable(op, a, b)
    if sides is None:
        return F.when(a.column.isNotNull() & b.column.isNotNull(), F.lit(op == "NEQ"))
    x, y = sides
    return {"EQ": x == y, "NEQ": x != y, "LT": x < y, "LE": x <= y, "GT": x > y, "GE": x >= y}[op]


def _widened(t: Typed) -> Typed:
    """Whole numbers compute with 64 bits, whatever their column stores."""
    return Typed(t.column.cast("long"), _LONG, t.constant) if isinstance(t.type, T.IntegralType) and t.type != _LONG else t


def _arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if not {a.kind, b.kind} <= {"number", "null"}:
        raise _reject(_SYMBOL[op], a, b)
    a, b = _widened(a), _widened(b)
    x, y = a.column, b.column
    if op == "DIV":
        return Typed(x / y, _DOUBLE)
    real = any(isinstance(s.type, T.FractionalType) for s in (a, b))
    kind = _DOUBLE if real else _LONG
    if op == "MOD":  # the sign of the divisor, not of the dividend
        r = x % y
        return Typed(F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r), kind)
    return Typed({"ADD": x + y, "SUB": x - y, "MUL": x * y}[op], kind)


def like_pattern(pattern: str) -> str:
    """A pattern in which the escape character stands only before %, _ and itself, as Spark wants it."""
    return re.sub(r"(?s)\\(.?)", lambda m: m[0] if m[1] in ("%", "_", "\\") and m[1] else m[1], pattern)


def _like(e: Like, schema: T.StructType) -> Column:
    operand = typed(e.operand, schema).column.cast("string")
    if isinstance(e.pattern, Literal) and isinstance(e.pattern.value, str):
        return operand.like(like_pattern(e.pattern.value))
    pattern = typed(e.pattern, schema).column.cast("string")
    return F.like(operand, F.regexp_replace(pattern, r"(?s)(\\[%_\\])|\\(.)|\\\z", "$1$2"))


def _truth(t: Typed, op: str) -> Column:
    if t.kind not in ("boolean", "null"):
        raise _reject(op, t)
    return t.column.cast("boolean") if t.kind == "null" else t.column


def typed(e: Expr, schema: T.StructType) -> Typed:
    """The column of an expression over rows of ``schema``, with its type."""
    match e:
        case Literal(None):
            return Typed(F.lit(None), T.NullType(), True)
        case Literal(bool() as v):
            return Typed(F.lit(v), _BOOL, True)
        case Literal(int() as v):
            return Typed(F.lit(v), T.IntegerType() if -(2**31) <= v < 2**31 else _LONG, True)
        case Literal(float() as v):
            return Typed(F.lit(v), _DOUBLE, True)
        case Literal(str() as v):
            return Typed(F.lit(v), _TEXT, True)
        case Name():
            full = resolve(e, schema)
            return Typed(quoted(full), schema[full].dataType)
        case Binary("AND" | "OR" as op, left, right):
            a, b = (_truth(typed(x, schema), op) for x in (left, right))
            return Typed(a & b if op == "AND" else a | b, _BOOL)
        case Binary("EQ" | "NEQ" | "LT" | "LE" | "GT" | "GE" as op, left, right):
            return Typed(_compare(op, typed(left, schema), typed(right, schema)), _BOOL)
        case Binary("ADD" | "SUB" | "MUL" | "DIV" | "MOD" as op, left, right):
            return _arithmetic(op, typed(left, schema), typed(right, schema))
        case Unary("NOT", operand):
            return Typed(~_truth(typed(operand, schema), "NOT"), _BOOL)
        case Unary("NEG" | "POS" as op, operand):
            t = typed(operand, schema)
            if t.kind not in ("number", "null"):
                raise _reject(op, t)
            t = _widened(t)
            return Typed(-t.column if op == "NEG" else t.column, t.type)
        case Between(operand, low, high, negated):
            x, lo, hi = (typed(y, schema) for y in (operand, low, high))
            inside = _compare("GE", x, lo) & _compare("LE", x, hi)
            return Typed(~inside if negated else inside, _BOOL)
        case InList(operand, values, negated):
            x = typed(operand, schema)
            found = F.lit(False)
            for v in values:
                found = found | _compare("EQ", x, typed(v, schema))
            return Typed(~found if negated else found, _BOOL)
        case Like(negated=negated):
            found = _like(e, schema)
            return Typed(~found if negated else found, _BOOL)
        case IsNull(operand, negated):
            c = typed(operand, schema).column
            return Typed(c.isNotNull() if negated else c.isNull(), _BOOL)
        case Call():
            name = text(e)
            if name not in schema.names:
                raise UnsupportedExpressionError(f"{name} is not a column of the aggregation below")
            return Typed(quoted(name), schema[name].dataType)
        case Star():
            raise UnsupportedExpressionError("* stands alone in a select list or in COUNT(*)")
    raise UnsupportedExpressionError(f"no such expression: {e!r}")


def projected(e: Expr, schema: T.StructType) -> Column:
    """As ``typed``, for output: a bare NULL is a BOOLEAN."""
    t = typed(e, schema)
    return t.column.cast("boolean") if t.kind == "null" else t.column


def predicate(e: Expr, schema: T.StructType) -> Column:
    return _truth(typed(e, schema), "a condition")


def aggregate(call: Call, schema: T.StructType) -> Column:
    """The Spark aggregate of a call over rows of ``schema``."""
    if call.function not in ("COUNT", "SUM", "AVG", "MIN", "MAX"):
        raise UnsupportedExpressionError(f"no aggregate named {call.function}")
    if len(call.arguments) != 1:
        raise UnsupportedExpressionError(f"{call.function} takes one argument")
    (arg,) = call.arguments
    if isinstance(arg, Star):
        if call.function != "COUNT" or call.distinct:
            raise UnsupportedExpressionError(f"{text(call)}: * is for COUNT(*) only")
        return F.count(F.lit(1))
    t = typed(arg, schema)
    if call.function in ("SUM", "AVG") and t.kind not in ("number", "null"):
        raise _reject(call.function, t)
    c = projected(arg, schema) if call.function in ("COUNT", "MIN", "MAX") else t.column.cast("double") if t.kind == "null" else t.column
    if call.distinct and call.function in ("COUNT", "SUM", "AVG"):
        return F.count_distinct(c) if call.function == "COUNT" else F.sum_distinct(c) if call.function == "SUM" else F.sum_distinct(c) / F.count_distinct(c)
    return {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[call.function](c)
