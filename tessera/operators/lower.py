"""Plan nodes to DataFrames. A new kind of node registers its own function with ``lower.register``."""

from __future__ import annotations

from dataclasses import dataclass
from functools import singledispatch

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MemoryLimitExceededError, UnsupportedExpressionError, UnsupportedJoinConditionError, UnsupportedOperatorError
from ..functions.columns import aggregate, distinct_names, matches, predicate, projected, quoted, resolve
from ..functions.expr import Binary, Name, Star, text
from ..plans import nodes as P
from ..sources.catalog import TableSource


#: Catalyst's size of a relation without an estimate.
_UNKNOWN = 2**63 - 1


@dataclass
class Context:
    source: TableSource
    #: Keep input order for ties of a sort, and first appearance in DISTINCT; needs a row id.
    stable: bool = False
    #: Turn ``strategy`` into a join hint.
    honour_hints: bool = False
    #: Estimated bytes that blocking operators may take in, all together.
    memory_limit: int | None = None
    admitted: int = 0

    def admit(self, operator: str, df: DataFrame) -> None:
        """An admission guard by Catalyst's size estimate; Spark itself spills and needs none.

        Where a leaf has no estimate (an RDD), nothing is known and nothing refused.
        """
        if self.memory_limit is None:
            return
        need = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if need >= _UNKNOWN:
            return
        if self.admitted + need > self.memory_limit:
            raise MemoryLimitExceededError(operator, need, self.memory_limit)
        self.admitted += need


@singledispatch
def lower(node, context: Context) -> DataFrame:
    raise UnsupportedOperatorError(node)


def _prefixed(context: Context, table: str, alias: str | None) -> DataFrame:
    df = context.source.table(table)
    return df.toDF(*[f"{alias or table}.{c}" for c in df.columns])


@lower.register
def _(node: P.Scan, context: Context) -> DataFrame:
    return _prefixed(context, node.table, node.alias)


@lower.register
def _(node: P.IndexScan, context: Context) -> DataFrame:
    df = _prefixed(context, node.table, node.alias)
    return df.where(predicate(node.predicate, df.schema))


@lower.register
def _(node: P.Filter, context: Context) -> DataFrame:
    df = lower(node.input, context)
    return df.where(predicate(node.predicate, df.schema))


@lower.register
def _(node: P.Project, context: Context) -> DataFrame:
    df = lower(node.input, context)
    if any(isinstance(i.expr, Star) for i in node.items):
        if len(node.items) > 1:
            raise UnsupportedExpressionError("* must be the only select item")
        return df
    names = [i.name or (i.expr.name if isinstance(i.expr, Name) else text(i.expr)) for i in node.items]
    schema = df.schema
    return df.select(*[projected(i.expr, schema).alias(n) for i, n in zip(node.items, distinct_names(names))])


_HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full"}


def _one_equality(condition, left: DataFrame, right: DataFrame) -> None:
    sides = {"left": left.schema, "right": right.schema}

    def side(e: Name) -> str | None:
        found = [label for label, schema in sides.items() if matches(e, schema)]
        for label in found:
            resolve(e, sides[label])  # a name that is ambiguous on its own side is an error of that kind
        return found[0] if len(found) == 1 else None

    if not (isinstance(condition, Binary) and condition.op == "EQ" and isinstance(condition.left, Name) and isinstance(condition.right, Name)):
        raise UnsupportedJoinConditionError("a hash join takes one equality of two columns")
    if {side(condition.left), side(condition.right)} != {"left", "right"}:
        raise UnsupportedJoinConditionError("a hash join compares a column of each side")


@lower.register
def _(node: P.Join, context: Context) -> DataFrame:
    left, right = lower(node.left, context), lower(node.right, context)
    distinct_names([*left.columns, *right.columns])
    if node.how not in _HOW:
        raise UnsupportedOperatorError(node)
    if node.strategy == "hash":
        _one_equality(node.condition, left, right)
        context.admit("HashJoin", left)
        if context.honour_hints:
            left = left.hint("shuffle_hash")
    if node.condition is None:
        return left.crossJoin(right) if node.how == "inner" else left.join(right, F.lit(True), _HOW[node.how])
    schema = type(left.schema)([*left.schema.fields, *right.schema.fields])
    return left.join(right, predicate(node.condition, schema), _HOW[node.how])


@lower.register
def _(node: P.Aggregate, context: Context) -> DataFrame:
    if not node.keys and not node.calls:
        raise UnsupportedExpressionError("an aggregation needs keys or aggregates")
    df = lower(node.input, context)
    context.admit("HashAggregate", df)
    schema = df.schema
    names = [resolve(k, schema) if isinstance(k, Name) else text(k) for k in node.keys]
    distinct_names([*names, *map(text, node.calls)])
    keys = [projected(k, schema).alias(n) for k, n in zip(node.keys, names)]
    if not node.calls:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*[aggregate(c, schema).alias(text(c)) for c in node.calls])


_ROW = "__row"


@lower.register
def _(node: P.Distinct, context: Context) -> DataFrame:
    df = lower(node.input, context)
    context.admit("Distinct", df)
    if not context.stable:
        return df.distinct()
    seen = df.withColumn(_ROW, F.monotonically_increasing_id()).groupBy(*map(quoted, df.columns)).agg(F.min(_ROW).alias(_ROW))
    return seen.orderBy(_ROW).drop(_ROW)


@lower.register
def _(node: P.Sort, context: Context) -> DataFrame:
    df = lower(node.input, context)
    if not node.keys:
        return df
    context.admit("Sort", df)
    schema = df.schema
    keys = [projected(k.expr, schema) for k in node.keys]
    order = [c.desc_nulls_last() if k.descending else c.asc_nulls_last() for c, k in zip(keys, node.keys)]
    if context.stable:
        return df.withColumn(_ROW, F.monotonically_increasing_id()).orderBy(*order, _ROW).drop(_ROW)
    return df.orderBy(*order)


@lower.register
def _(node: P.Limit, context: Context) -> DataFrame:
    df = lower(node.input, context)
    if node.offset > 0:
        df = df.offset(node.offset)
    return df if node.limit is None else df.limit(max(0, node.limit))
