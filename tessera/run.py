"""Running plans: as a DataFrame, as Arrow batches, or collected; and printing them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .errors import translated
from .operators.lower import Context, lower
from .plans.nodes import Node, Query
from .sources.catalog import TableSource

BATCH_ROWS = 2048


def _tree(plan: Node | Query) -> Node:
    return plan.plan if isinstance(plan, Query) else plan


def to_dataframe(plan: Node | Query, source: TableSource, **options) -> DataFrame:
    """The plan as one lazy DataFrame. Options: stable, honour_hints, memory_limit."""
    return lower(_tree(plan), Context(source, **options))


def execute(plan: Node | Query, source: TableSource, batch_rows: int = BATCH_ROWS, **options) -> Iterator[pa.RecordBatch]:
    """Batches of the result. Errors in the plan show here, errors in the data on the first batch.

    Executors write Arrow streams, which come to the driver a partition at a time.
    """
    df = to_dataframe(plan, source, **options)
    schema = to_arrow_schema(df.schema)
    plain = df.toDF(*[f"c{i}" for i in range(len(schema))])

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["stream"])

    def batches() -> Iterator[pa.RecordBatch]:
        with translated():
            for row in plain.mapInArrow(streams, "stream binary").toLocalIterator(prefetchPartitions=True):
                for batch in pa.ipc.open_stream(row.stream):
                    for at in range(0, batch.num_rows, batch_rows):
                        part = batch.slice(at, batch_rows)
                        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, schema)], schema=schema)

    return batches()


def collect(plan: Node | Query, source: TableSource, **options) -> pa.Table:
    """The whole result; no rows still have their columns."""
    df = to_dataframe(plan, source, **options)
    with translated():
        return df.toArrow()


def explain(plan: Node | Query, indent: int = 0) -> str:
    """One line per node with its estimates, inputs indented."""
    node = _tree(plan)
    lines = [f"{'  ' * indent}{type(node).__name__} (rows={node.rows:.0f}, cost={node.cost:.1f})"]
    for f in fields(node):
        if isinstance(child := getattr(node, f.name), Node):
            lines.append(explain(child, indent + 1))
    return "\n".join(lines)
