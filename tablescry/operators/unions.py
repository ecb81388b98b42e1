"""Set-like operators: implicit directories, appended chunks, lists of types, key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def implicit_directories(entries: DataFrame) -> DataFrame:
    """Directories that entries lie in but that aren't listed, just before their first member. entries: entry_id, path, is_dir.

    Ids of new ones are -1, -2, ... in that order.
    """
    from .cells import numbered

    parts = entries.select("entry_id", F.posexplode(V.directory_prefixes(F.rtrim(F.col("path"), F.lit("/")))).alias("depth", "path"))
    first = parts.groupBy("path").agg(F.min(F.struct("entry_id", "depth")).alias("at"))
    listed = entries.where("is_dir").select(F.concat(F.rtrim(F.col("path"), F.lit("/")), F.lit("/")).alias("path")).distinct()
    new = numbered(first.join(listed, "path", "left_anti"), "at", name="n")
    new = new.select((-F.col("n") - 1).cast("long").alias("entry_id"), "path", F.lit(True).alias("is_dir"), F.col("at.entry_id").cast("double").alias("ord"), F.col("at.depth").alias("sub"))
    old = entries.select("entry_id", "path", "is_dir", F.col("entry_id").cast("double").alias("ord"), F.lit(1 << 20).alias("sub"))
    return new.unionByName(old)


def appended(loaded: DataFrame, chunk: DataFrame) -> DataFrame:
    return loaded.unionByName(chunk, allowMissingColumns=True)


def all_types(messages: DataFrame, enums: DataFrame, services: DataFrame) -> DataFrame:
    """full_name, kind of all declared types."""
    kinds = zip((messages, enums, services), ("message", "enum", "service"))
    out = None
    for df, kind in kinds:
        part = df.select("full_name", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


def other_keys(keys: Column, excluded: list[str]) -> Column:
    return F.array_except(keys, F.array(*map(F.lit, excluded)))
