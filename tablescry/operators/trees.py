"""Views of node tables: leaves, first expansion, ancestors of matches, whole values again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaves(nodes: DataFrame) -> DataFrame:
    """Values without children; empty containers aren't values."""
    return nodes.where("children = 0 and kind not in ('object', 'array')")


def expanded(nodes: DataFrame, depth: int = 2) -> DataFrame:
    """What shows when nodes above a depth are open: every node whose parent is open."""
    return nodes.where(F.col("depth") <= depth)


def opened_for(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """Ancestors to open so that hits show, without the hits themselves. hits: doc_id, lineage."""
    above = hits.select("doc_id", F.explode(F.slice("lineage", F.lit(1), F.size("lineage") - 1)).alias("node_id")).distinct()
    return nodes.join(above, ["doc_id", "node_id"], "left_semi")


def parents(nodes: DataFrame) -> DataFrame:
    """Each node with its parent's path."""
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("path").alias("parent_path"))
    return nodes.join(up, ["doc_id", "parent_id"], "left")
