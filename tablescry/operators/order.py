"""Type inference, typed stable sorts with blanks last, pages and top-k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from .cells import Table


#: Kinds of cells, as bits.
BLANK, NUMBER, DAY, TEXT = 0, 1, 2, 4


def type_facts(table: Table) -> DataFrame:
    """column, numbers, dates: whether all cells of each column that aren't blank are numbers, or are dates; neither without any.

    Cells become rows, so that one small test serves any number of columns, and are merged
    before they move. Most cells show what they are as they stand: nothing, a letter first, plain digits,
    a plain day. Only the rest are trimmed and tested in full. No condition is on the cells
    themselves, which Spark would test where they are made, making each one twice; hence the outer explode.
    """
    cell, t = F.col("cell"), F.col("t")
    cells = table.rows.select(F.posexplode_outer("cells").alias("column", "cell")).where(F.col("column") < len(table.headers))
    plain = F.when(cell == "", BLANK).when((cell >= "A") & (cell < "\x7f"), TEXT).when(cell.rlike(V.PLAIN), NUMBER).when(cell.rlike(V.PLAIN_DAY), DAY)
    rest = cells.select("column", "cell", plain.alias("plain")).select("column", "plain", F.when(F.col("plain").isNull(), V.trimmed(cell)).alias("t"))
    full = F.when(t == "", BLANK).when(F.substring(t, 5, 1).isin("-", "/") & V.is_date(t), DAY).when(V.is_number(t), NUMBER).otherwise(TEXT)
    kinds = rest.groupBy("column").agg(F.bit_or(F.coalesce("plain", full)).alias("kinds"))
    return kinds.select("column", (F.col("kinds") == NUMBER).alias("numbers"), (F.col("kinds") == DAY).alias("dates"))


def type_of() -> Column:
    """number, date or text from the facts of a column: blanks don't count, and all blank is text."""
    return F.when(F.col("numbers"), "number").when(F.col("dates"), "date").otherwise("text")


def column_types(table: Table) -> DataFrame:
    """column, header, type; one pass over the table for all columns."""
    heads = table.rows.sparkSession.createDataFrame(list(enumerate(table.headers)), "column int, header string")
    return heads.join(type_facts(table), "column", "left").select("column", "header", type_of().alias("type"))


@dataclass(frozen=True)
class Sort:
    column: int
    descending: bool = False


def next_sort(now: Sort | None, column: int) -> Sort | None:
    """Ascending, descending, none; another column starts over."""
    if now is None or now.column != column:
        return Sort(column)
    return None if now.descending else Sort(column, True)


def sort_keys(table: Table, sort: Sort, kind: str) -> list[Column]:
    """Blanks last either way, then the typed key, then source order."""
    cell = table.cell(sort.column)
    key = {"number": V.parse_numeric, "date": lambda c: V.parse_date_key(V.trimmed(c)), "text": V.natural_key}[kind](cell)
    return [V.is_blank(cell).asc(), key.desc() if sort.descending else key.asc(), F.col("row_id").asc()]


def inferred(table: Table, column: int) -> str:
    found = type_facts(table.project(column)).select(type_of()).first()
    return found[0] if found else "text"


def ordered(table: Table, sort: Sort | None, *, kind: str | None = None) -> Table:
    """Sorted by a column, whose type is inferred from the whole table unless given; by row_id without a sort."""
    if sort is None:
        return table.but(table.rows.orderBy("row_id"))
    return table.but(table.rows.orderBy(*sort_keys(table, sort, kind or inferred(table, sort.column))))


@dataclass(frozen=True)
class Page:
    index: int = 0
    size: int = 500

    def clamped(self, total: int) -> Page:
        return Page(max(0, min(self.index, self.count(total) - 1)), self.size)

    def count(self, total: int) -> int:
        return max(1, -(-total // self.size))

    def resized(self, size: int) -> Page:
        """The page of the new size that shows the first row shown now."""
        return Page(self.index * self.size // size, size)


def page(df: DataFrame, at: Page) -> DataFrame:
    """A page of an ordered frame."""
    return df.offset(at.index * at.size).limit(at.size)


def shown(df: DataFrame, limit: int) -> DataFrame:
    """The first rows with the number of all."""
    total = df.agg(F.count("*").alias("total"))
    return df.limit(limit).crossJoin(F.broadcast(total))


def top_counts(df: DataFrame, key: str, order: str, limit: int | None = None) -> DataFrame:
    """key, n by falling count, ties by first appearance."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    out = counts.orderBy(F.desc("n"), "first")
    return out.limit(limit) if limit else out


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in order of first appearance."""
    return df.groupBy(key).agg(F.min(order).alias("first")).orderBy("first")
