"""Tables of tensors: sizes by type, totals, the dominant type, and checks of the layout in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.binary import DTYPE_BITS, GGML
from . import sequences, stats


def widths(spark: SparkSession) -> DataFrame:
    """dtype, block_elements, block_bits of all known storage types; a fixed table."""
    rows = {k: (1, b) for k, b in DTYPE_BITS.items()} | {name: (n, 8 * b) for name, n, b in GGML.values()}
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], "dtype string, block_elements int, block_bits int")


def sized(tensors: DataFrame) -> DataFrame:
    """Tensors (name, dtype, elements, begin, end) with the bytes they should take (null: unknown type or uneven blocks) and what is wrong with them."""
    out = tensors.join(F.broadcast(widths(tensors.sparkSession)), "dtype", "left")
    n = F.col("elements").cast("decimal(38,0)")
    bits = n / F.col("block_elements") * F.col("block_bits")
    even = (n % F.col("block_elements") == 0) & ((n * F.col("block_bits") / F.col("block_elements")) % 8 == 0)
    out = out.withColumn("bytes", F.when(even, (bits / 8).cast("long")))
    problem = F.when(F.col("block_bits").isNull(), "unknown dtype").when(F.col("bytes").isNull(), "uneven blocks").when(F.col("bytes") != F.col("end") - F.col("begin"), "size")
    return out.withColumn("problem", problem).drop("block_elements", "block_bits")


def totals(tensors: DataFrame) -> DataFrame:
    """tensors, elements, dtypes (sorted) and the dominant dtype, ties to the first in the file."""
    one = tensors.agg(F.count("*").alias("tensors"), F.coalesce(F.sum(F.col("elements").cast("decimal(38,0)")), F.lit(0)).alias("elements"), F.array_sort(F.collect_set("dtype")).alias("dtypes"))
    return one.join(stats.mode(tensors, "dtype", "begin").select(F.col("mode").alias("dominant")), F.lit(True), "left")


def misplaced(tensors: DataFrame, buffer: int) -> DataFrame:
    """Tensors that don't begin where those before them end, and whether all of them fill the buffer."""
    placed = sequences.packing(tensors.withColumn("buffer", F.lit(buffer)).withColumn("file", F.lit(0)), "file", total="buffer")
    return placed.where(~F.col("fits") | ~F.col("fills")).select("name", "begin", "end", "expected", "fits", "fills")
