"""Small tables that queries make themselves, and the folder that they write to."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.steps import work_dir

__all__ = ["rows", "work_dir"]


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    """A local relation: Spark knows its size, and so broadcasts it."""
    kinds = T._parse_datatype_string(schema)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(kinds.names, r)) for r in data], schema=to_arrow_schema(kinds)), kinds)
