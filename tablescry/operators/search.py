"""Searches over cells, trees and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from .cells import Table


def holds(cells: Column, term: str) -> Column:
    """Some cell contains the term, case folded."""
    return F.exists(cells, lambda c: F.contains(F.lower(c), F.lower(F.lit(term))))


def any_cell(table: Table, term: str, *, least: int = 2) -> Table:
    """Rows with the term in some cell; terms shorter than `least` don't filter. The term isn't trimmed."""
    return table if len(term) < least else table.but(table.rows.where(holds(F.col("cells"), term)))


def match_counts(table: Table, term: str) -> DataFrame:
    """rows and cells that match."""
    hits = F.size(F.filter("cells", lambda c: F.contains(F.lower(c), F.lower(F.lit(term)))))
    return table.rows.agg(F.count_if(hits > 0).alias("matched_rows"), F.coalesce(F.sum(hits), F.lit(0)).alias("matched_cells"))


def tree_search(nodes: DataFrame, term: str) -> DataFrame:
    """Nodes whose key, path, kind or value contains the trimmed term, with a match number in document order."""
    from pyspark.sql.window import Window

    hay = F.lower(F.concat_ws(" ", "key", "path", "kind", F.coalesce("value", F.lit(""))))
    hits = nodes.where(F.contains(hay, F.lower(F.lit(term.strip()))))
    return hits.withColumn("match", F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id")))


def scoped_search(nodes: DataFrame, term: str, scope: str = "all") -> DataFrame:
    """As tree_search within one scope - all, key, path or value - with ASCII case folding, the root left out."""
    fields = {"all": ("key", "path", "value"), "key": ("key",), "path": ("path",), "value": ("value",)}[scope]
    hay = F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields])
    return nodes.where((F.col("depth") > 0) & F.contains(V.ascii_lower(hay), V.ascii_lower(F.lit(term))))


def subtree_search(nodes: DataFrame, term: str) -> DataFrame:
    """Nodes that match or have a descendant that does: ids of matches and of all their ancestors.

    Ancestors are prefixes of a match's path, so one equi-join does for any depth.
    nodes: doc_id, node_id, parent_id, ..., lineage array of ids from the root.
    """
    hay = F.lower(F.concat_ws(" ", "key", "path", F.coalesce("value", F.lit(""))))
    seen = nodes.where(F.contains(hay, F.lower(F.lit(term)))).select("doc_id", F.explode("lineage").alias("node_id")).distinct()
    return nodes.join(seen, ["doc_id", "node_id"], "left_semi")


def line_search(lines: DataFrame, term: str) -> DataFrame:
    """Lines of a JSON-lines text whose raw text contains the term, ASCII case folded."""
    return lines.where(F.contains(V.ascii_lower(F.col("raw")), V.ascii_lower(F.lit(term))))


def path_filter(entries: DataFrame, term: str) -> DataFrame:
    """Archive entries whose path contains the term, and directories above them. entries: path, is_dir."""
    hits = entries.where(F.contains(F.lower("path"), F.lower(F.lit(term))))
    above = hits.select(F.explode(V.directory_prefixes(F.rtrim(F.col("path"), F.lit("/")))).alias("path")).distinct()
    shown = above.unionByName(hits.select("path")).distinct()
    return entries.join(shown, "path", "left_semi")


def find_all(texts: DataFrame, term: str, *, id_col: str, text_col: str) -> DataFrame:
    """id, start, end of each non-overlapping occurrence, case folded, from the lengths of the parts between them."""
    n = len(term)
    if not n:
        return texts.select(id_col).limit(0).selectExpr(id_col, "0 AS start", "0 AS end")
    import re

    parts = F.split(F.lower(F.col(text_col)), re.escape(term.lower()), -1)
    rows = texts.select(id_col, F.posexplode(F.transform(parts, F.char_length)).alias("i", "gap"))
    from pyspark.sql.window import Window

    before = F.sum("gap").over(Window.partitionBy(id_col).orderBy("i")) + F.col("i") * n
    last = F.max("i").over(Window.partitionBy(id_col))
    return rows.withColumns({"start": before, "last": last}).where("i < last").select(id_col, F.col("start").cast("long").alias("start"), (F.col("start") + n).cast("long").alias("end"))


def tightest(nodes: DataFrame, offset: int) -> DataFrame:
    """The node with the smallest span that holds the offset, by document."""
    inside = nodes.where((F.col("span_start") <= offset) & (F.col("span_end") > offset))
    return inside.groupBy("doc_id").agg(F.min_by("node_id", F.struct(F.col("span_end") - F.col("span_start"), -F.col("node_id"))).alias("node_id"))


def safe_link(url: Column, schemes: tuple[str, ...] = ("http", "https", "mailto")) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin(*schemes), F.lit(False))


def safe_path(path: Column) -> Column:
    """A relative path that stays below its base."""
    return ~(path.rlike(r"^(/|\\|[A-Za-z]:)") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)") | F.contains(path, F.lit("\0")))
