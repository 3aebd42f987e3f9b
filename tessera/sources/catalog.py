"""Named tables: files, DataFrames and rows in memory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import UnknownTableError

#: The four declared column types; sources may carry any other Spark type through.
TYPES = {"INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType()}


class TableSource(Protocol):
    def table(self, name: str) -> DataFrame: ...


class Catalog:
    """Tables by name, the first of: given DataFrames and rows, then ``<directory>/<name>.<format>``."""

    def __init__(self, spark: SparkSession, directory: str | None = None, file_format: str = "parquet"):
        self.spark, self.directory, self.format = spark, directory, file_format
        self._tables: dict[str, DataFrame] = {}

    def add(self, name: str, df: DataFrame) -> Catalog:
        self._tables[name] = df
        return self

    def add_rows(self, name: str, columns: Mapping[str, str | T.DataType], rows: Sequence[Mapping[str, Any]]) -> Catalog:
        """Rows as dicts: a missing key is NULL, other keys are ignored, values must fit the declared types.

        They become an Arrow table, whose size the optimiser knows.
        """
        schema = T.StructType([T.StructField(c, TYPES[t] if isinstance(t, str) else t) for c, t in columns.items()])
        arrow = to_arrow_schema(schema)
        values = pa.Table.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)
        return self.add(name, self.spark.createDataFrame(values, schema))

    def table(self, name: str) -> DataFrame:
        if name in self._tables:
            return self._tables[name]
        if self.directory is None:
            raise UnknownTableError(name)
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.format(self.format).load(f"{self.directory}/{name}.{self.format}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                raise UnknownTableError(name) from e
            raise

    def schema(self, name: str) -> T.StructType:
        return self.table(name).schema
