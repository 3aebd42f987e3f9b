"""Plans over streams: a source whose tables are streaming DataFrames lowers to a streaming query.

Scans, filters, projections, inner joins with static tables and aggregations keep their meaning; sorts and
limits follow Structured Streaming's own rules.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..plans.nodes import Node, Query
from ..run import to_dataframe
from ..sources.catalog import Catalog


def stream_table(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet"):
    return spark.readStream.format(file_format).schema(schema).load(path)


def start(plan: Node | Query, source: Catalog, name: str, checkpoint: str, mode: str = "append"):
    """Process what is there and stop: a query into the in-memory table ``name``."""
    writer = to_dataframe(plan, source).writeStream.outputMode(mode).format("memory").queryName(name)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
