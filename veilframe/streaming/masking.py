"""Incremental masking: the same projection on a stream of files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from veilframe.plans.compiler import mask_table
from veilframe.plans.nested import mask_docs
from veilframe.plans.rules import RuleSet


def mask_stream(
    stream: DataFrame, table: str, rules: RuleSet, profile: str = "table", domains: Mapping[str, str] | None = None
) -> DataFrame:
    """Masking keeps no state: no watermark is needed and rows may arrive in any order."""
    nested = any(isinstance(f.dataType, (T.StructType, T.ArrayType)) for f in stream.schema.fields)
    return mask_docs(stream, table, rules, profile) if nested else mask_table(stream, table, rules, profile, domains)


def read_file_stream(spark: SparkSession, folder: str, schema: T.StructType, form: str = "parquet", **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).format(form).load(folder)


def start_masking(masked: DataFrame, path: str, checkpoint: str, form: str = "parquet", once: bool = True) -> StreamingQuery:
    """Write the masked stream. The checkpoint makes it restartable; `once` stops after the files present now."""
    writer = masked.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).outputMode("append").start()
