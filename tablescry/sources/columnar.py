"""Parquet: native reads, row windows, normalised values and the export envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import Table, cell_text

ENVELOPE_FORMAT = "tablescry/parquet-export@1"


def read(spark: SparkSession, path: str, *, start: int | None = None, count: int | None = None) -> DataFrame:
    """All rows, or a window of row indices of each file; columns and filters reach the scan."""
    df = spark.read.parquet(path)
    if start is None:
        return df
    index = F.col("_metadata.row_index")
    return df.where((index >= start) & (index < start + (count or 1 << 62)))


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """path, rows and bytes of each file."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"))


def table(df: DataFrame, path_order: bool = True) -> Table:
    """A table in file order, values normalised: 64-bit numbers and dates as text, times in ISO, bytes as number lists, nested values as JSON."""
    from ..operators.cells import numbered

    cells = F.array(*[cell_text(df, n) for n in df.columns]).alias("cells")
    placed = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"), cells)
    return Table(numbered(placed, "f", "i").select("row_id", "cells"), tuple(df.columns))


def envelope(df: DataFrame, *order: str) -> DataFrame:
    """One row, json: {format, schema, headers, rows, metadata}. For tables that fit a message."""
    import json

    cells = F.array(*[cell_text(df, n) for n in df.columns])
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("k"), cells.alias("c")))), lambda x: x["c"])
    one = df.agg(rows.alias("rows"), F.struct(F.count("*").alias("rowCount")).alias("metadata"))
    schema = F.lit(json.dumps([{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields], separators=(",", ":")))
    head = F.to_json(F.struct(F.lit(ENVELOPE_FORMAT).alias("format")))
    body = F.to_json(F.struct(F.array(*map(F.lit, df.columns)).alias("headers"), "rows", "metadata"))
    return one.select(F.concat(F.rtrim(head, F.lit("}")), F.lit(',"schema":'), schema, F.lit(","), F.substring(body, F.lit(2), F.char_length(body))).alias("json"))
