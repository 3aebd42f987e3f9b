"""Typed errors, and their translation from Spark's."""

from __future__ import annotations

from contextlib import contextmanager


class EngineError(Exception):
    """Base of all errors this engine raises on purpose."""


class UnresolvedColumnError(EngineError):
    def __init__(self, column_name: str, why: str = "no such column"):
        super().__init__(f"{column_name}: {why}")
        self.column_name = column_name


class UnknownTableError(EngineError):
    def __init__(self, table_name: str):
        super().__init__(f"no table named {table_name}")
        self.table_name = table_name


class UnsupportedExpressionError(EngineError):
    pass


class UnsupportedOperatorError(EngineError):
    def __init__(self, node: object):
        super().__init__(f"no lowering for {type(node).__name__}")
        self.node = node


class UnsupportedJoinConditionError(EngineError):
    pass


class DivisionByZeroError(EngineError):
    pass


class NumericOverflowError(EngineError):
    pass


class SchemaConflictError(EngineError):
    def __init__(self, column_name: str):
        super().__init__(f"more than one column would be named {column_name}")
        self.column_name = column_name


class MemoryLimitExceededError(EngineError):
    def __init__(self, operator_name: str, requested_bytes: int, limit_bytes: int):
        super().__init__(f"{operator_name} is estimated to need {requested_bytes} bytes; the limit is {limit_bytes}")
        self.operator_name, self.requested_bytes, self.limit_bytes = operator_name, requested_bytes, limit_bytes


_CONDITIONS = {
    "DIVIDE_BY_ZERO": DivisionByZeroError,
    "REMAINDER_BY_ZERO": DivisionByZeroError,
    "ARITHMETIC_OVERFLOW": NumericOverflowError,
    "BINARY_ARITHMETIC_OVERFLOW": NumericOverflowError,
}


@contextmanager
def translated():
    """Raise this engine's error for a Spark error of a run that has one."""
    try:
        yield
    except EngineError:
        raise
    except Exception as e:
        text = str(e)
        for condition, kind in _CONDITIONS.items():
            if f"[{condition}" in text:
                raise kind(text.split("\n", 1)[0]) from e
        raise
