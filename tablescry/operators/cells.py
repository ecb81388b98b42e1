"""The canonical table: (row_id, cells array<string>), and ways into and out of it.

Headers live beside the table, in order, so duplicate and empty headers are legal.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import values as V
from ..plans.storage import saved


def cell_text(df: DataFrame, name: str) -> Column:
    """A column as cell text: null is empty, nested values are JSON, numbers print without exponents or trailing zeros."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        text = c
    elif isinstance(kind, T.DoubleType):
        text = V.plain_double(c)
    elif isinstance(kind, (T.FloatType, T.DecimalType)):
        text = V.plain_number(c)
    elif isinstance(kind, T.DateType):
        text = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    elif isinstance(kind, T.BinaryType):
        text = F.to_json(F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.hex(F.substring(c, i, F.lit(1))), 16, 10).cast("int")))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


@dataclass(frozen=True)
class Table:
    """rows: (row_id long, cells array<string>). row_id is the source order."""

    rows: DataFrame
    headers: tuple[str, ...]
    report: dict = field(default_factory=dict)

    def cell(self, column: int) -> Column:
        return F.get(F.col("cells"), F.lit(column))

    def but(self, rows: DataFrame, headers: tuple[str, ...] | None = None) -> Table:
        return replace(self, rows=rows, headers=self.headers if headers is None else headers)

    def named(self) -> DataFrame:
        """Named string columns; headers must be distinct and not empty."""
        if len({*self.headers}) < len(self.headers) or "" in self.headers:
            raise ValueError("headers repeat or are empty; use cells by position")
        return self.rows.select("row_id", *[self.cell(i).alias(h) for i, h in enumerate(self.headers)])

    def project(self, *columns: int) -> Table:
        """Columns by position."""
        return self.but(self.rows.select("row_id", F.array(*[self.cell(i) for i in columns]).alias("cells")), tuple(self.headers[i] for i in columns))

    def as_json(self) -> DataFrame:
        """row_id, json: each row as an object; a blank header becomes col<i>, the last of equal headers wins."""
        last = {h or f"col{i}": i for i, h in enumerate(self.headers)}
        return self.rows.select("row_id", F.to_json(F.struct(*[self.cell(i).alias(h) for h, i in last.items()])).alias("json"))


def numbered(df: DataFrame, *key: str | Column, name: str = "row_id") -> DataFrame:
    """Rows numbered from 0 in the order of the key, without sorting all in one task. A key is a column or a sort order of one.

    The rows are range-partitioned, sorted and written once, each with its partition and
    its place there as columns. Counts and rows both come from that one table, so they
    agree whatever the partitions are; a partition's start is the sum of the counts before
    it (one row a partition). Rows that tie are numbered in any order, but only once.
    """
    at = F.monotonically_increasing_id()
    parts = F.shiftrightunsigned(at, 33).cast("int").alias("part"), at.bitwiseAND((1 << 33) - 1).alias("place")
    placed = saved(df.orderBy(*key).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *parts), "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c != name]
    return placed.join(F.broadcast(starts), "part").select(*kept, (F.col("start") + F.col("place")).alias(name))


def from_frame(df: DataFrame, *key: str) -> Table:
    """Any DataFrame as a table of text cells; row_id follows the key, which must be unique, or is the key itself if it is one long column."""
    names = df.columns
    cells = F.array(*[cell_text(df, n) for n in names]).alias("cells")
    if len(key) == 1 and isinstance(df.schema[key[0]].dataType, (T.LongType, T.IntegerType)):
        return Table(df.select(F.col(key[0]).cast("long").alias("row_id"), cells), tuple(names))
    return Table(numbered(df.select(*key, cells), *key).select("row_id", "cells"), tuple(names))


def dense(cells: DataFrame, *, has_header: bool = False) -> Table:
    """Sparse cells (r, c, w) of one sheet as a table over their used range; what is missing is empty."""
    span = cells.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    if span[0] is None:
        return Table(cells.sparkSession.createDataFrame([], "row_id long, cells array<string>"), ())
    r0, r1, c0, c1 = span
    byrow = cells.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("c", "w"))).alias("m"))
    all_rows = cells.sparkSession.range(r0, r1 + 1).select(F.col("id").cast("int").alias("r"))
    rows = all_rows.join(byrow, "r", "left").select(
        (F.col("r") - r0).cast("long").alias("row_id"),
        F.transform(F.sequence(F.lit(c0), F.lit(c1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))).alias("cells"),
    )
    width = c1 - c0 + 1
    if has_header:
        first = rows.where("row_id = 0").first()["cells"]
        return Table(rows.where("row_id > 0"), tuple(first))
    return Table(rows, tuple(f"Column {i + 1}" for i in range(width)))


#: Rows and columns of a tile in the join of cells and merged ranges.
TILE = 64


def grid(cells: DataFrame, merges: DataFrame, *, max_cells: int | None = None) -> DataFrame:
    """Cells of a sheet with merged ranges: the origin keeps its span, covered cells go. merges: r0, c0, r1, c1.

    An equi-join on tiles of TILE rows and columns: a merged range is in each tile that it touches, a cell in one.
    """
    tile = lambda c: F.floor(F.col(c) / TILE)
    spread = merges.withColumn("_tr", F.explode(F.sequence(tile("r0"), tile("r1")))).withColumn("_tc", F.explode(F.sequence(tile("c0"), tile("c1"))))
    inside = (F.col("r") >= F.col("r0")) & (F.col("r") <= F.col("r1")) & (F.col("c") >= F.col("c0")) & (F.col("c") <= F.col("c1"))
    origin = (F.col("r") == F.col("r0")) & (F.col("c") == F.col("c0"))
    same_tile = (tile("r") == F.col("_tr")) & (tile("c") == F.col("_tc"))
    met = cells.join(spread, same_tile & inside, "left").where(F.col("r0").isNull() | origin)
    out = met.select("r", "c", "w", F.coalesce(F.col("r1") - F.col("r0") + 1, F.lit(1)).alias("row_span"), F.coalesce(F.col("c1") - F.col("c0") + 1, F.lit(1)).alias("col_span"))
    return out.orderBy("r", "c").limit(max_cells) if max_cells else out
