"""Relational plans that run as one Catalyst-optimised DataFrame."""

from .errors import (
    DivisionByZeroError,
    EngineError,
    MemoryLimitExceededError,
    NumericOverflowError,
    SchemaConflictError,
    UnknownTableError,
    UnresolvedColumnError,
    UnsupportedExpressionError,
    UnsupportedJoinConditionError,
    UnsupportedOperatorError,
)
from .functions.expr import Call, Item, Star, avg, col, count, lit, max_, min_, sum_, text
from .plans.nodes import Aggregate, Distinct, Filter, IndexScan, Join, Limit, Project, Query, Scan, Sort, SortKey, desc, index_scan, scan
from .run import collect, execute, explain, to_dataframe
from .session import configure, session
from .sources.catalog import Catalog
