"""Edits of tables as a log that is replayed over the source: cells, headers, rows and columns, undo and redo, save points.

The log is small and on the driver; each edit is one column expression or filter, so a
table of any size is edited lazily and nothing is rewritten until it is saved.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import Table

HISTORY = 200


@dataclass(frozen=True)
class Edit:
    kind: str
    row: int | None = None
    column: int | None = None
    value: str = ""


def edit_cell(row: int, column: int, value: str) -> Edit:
    return Edit("cell", row, column, value)


def edit_header(column: int, value: str) -> Edit:
    return Edit("header", column=column, value=value)


def insert_row(after: int | None = None) -> Edit:
    """A blank row below another, or at the end."""
    return Edit("insert-row", after)


def delete_row(row: int) -> Edit:
    return Edit("delete-row", row)


def insert_column(at: int) -> Edit:
    return Edit("insert-column", column=at)


def delete_column(at: int) -> Edit:
    return Edit("delete-column", column=at)


def applied(table: Table, edit: Edit) -> Table:
    """The table after one edit. The last column can't be deleted; rows keep their ids, and places go by `ord` beside them."""
    rows, width = table.rows, len(table.headers)
    if "ord" not in rows.columns:
        rows = rows.withColumn("ord", F.col("row_id").cast("double"))
    if edit.kind == "cell":
        changed = F.transform("cells", lambda c, i: F.when(i == edit.column, F.lit(edit.value)).otherwise(c))
        return table.but(rows.withColumn("cells", F.when(F.col("row_id") == edit.row, changed).otherwise(F.col("cells"))))
    if edit.kind == "header":
        return table.but(rows, tuple(edit.value if i == edit.column else h for i, h in enumerate(table.headers)))
    if edit.kind == "delete-row":
        return table.but(rows.where(F.col("row_id") != edit.row))
    if edit.kind == "insert-row":
        blank = F.array(*[F.lit("")] * width)
        at = F.max("ord") if edit.row is None else F.max(F.when(F.col("row_id") == edit.row, F.col("ord")))
        # Half way to the next row; a fresh id above all others.
        place = rows.agg((F.max("row_id") + 1).alias("row_id"), at.alias("a"))
        below = rows.select(F.col("ord").alias("o"))
        after = place.join(below, F.col("o") > F.col("a"), "left").groupBy("row_id", "a").agg(F.min("o").alias("b"))
        new = after.select("row_id", blank.alias("cells"), F.coalesce((F.col("a") + F.col("b")) / 2, F.col("a") + 1).alias("ord"))
        return table.but(rows.unionByName(new))
    if edit.kind == "insert-column":
        cells = F.concat(F.slice("cells", 1, edit.column), F.array(F.lit("")), F.slice("cells", edit.column + 1, width))
        headers = (*table.headers[: edit.column], f"Column{width + 1}", *table.headers[edit.column :])
        return table.but(rows.withColumn("cells", cells), headers)
    if edit.kind == "delete-column":
        if width <= 1:
            return table
        cells = F.filter("cells", lambda c, i: i != edit.column)
        return table.but(rows.withColumn("cells", cells), tuple(h for i, h in enumerate(table.headers) if i != edit.column))
    raise ValueError(edit.kind)


def shifted_sort(column: int | None, edit: Edit) -> int | None:
    """Where a sort column is after columns were put in or taken out; None if it went."""
    if column is None or edit.kind not in ("insert-column", "delete-column"):
        return column
    if edit.kind == "insert-column":
        return column + (edit.column <= column)
    return None if edit.column == column else column - (edit.column < column)


@dataclass(frozen=True)
class Session:
    """A source with the edits done and undone. `saved` is the length of the log at the save point, None if it can't be reached again."""

    source: Table
    done: tuple[Edit, ...] = ()
    undone: tuple[Edit, ...] = ()
    base: tuple[Edit, ...] = field(default=())
    saved: int | None = 0

    def dispatch(self, edit: Edit) -> Session:
        done = (*self.done, edit)
        base, saved = self.base, self.saved if self.saved is not None and self.saved <= len(self.done) else None
        if len(done) > HISTORY:  # the oldest edit stays done for good
            base, done = (*base, done[0]), done[1:]
            saved = saved - 1 if saved else None
        return replace(self, done=done, undone=(), base=base, saved=saved)

    def undo(self) -> Session:
        return replace(self, done=self.done[:-1], undone=(*self.undone, self.done[-1])) if self.done else self

    def redo(self) -> Session:
        return replace(self, done=(*self.done, self.undone[-1]), undone=self.undone[:-1]) if self.undone else self

    def mark_saved(self) -> Session:
        return replace(self, saved=len(self.done))

    @property
    def dirty(self) -> bool:
        return self.saved != len(self.done)

    def table(self) -> Table:
        out = self.source
        for edit in (*self.base, *self.done):
            out = applied(out, edit)
        return out


def renumbered(lines: DataFrame, order: str = "ord") -> DataFrame:
    """Lines of a document numbered again from 1 after they moved. lines: doc_id, ord, raw."""
    from pyspark.sql.window import Window

    return lines.withColumn("line", F.row_number().over(Window.partitionBy("doc_id").orderBy(order)))


def moved(lines: DataFrame, line: int, up: bool) -> DataFrame:
    """One line up or down: it trades places with its neighbour."""
    other = line - 1 if up else line + 1
    swapped = F.when(F.col("line") == line, other).when(F.col("line") == other, line).otherwise(F.col("line"))
    return lines.withColumn("line", F.when(F.lit(other) < 1, F.col("line")).otherwise(swapped))


def reparsed(session: Session, make: Callable[[], Table]) -> Session:
    """A session over the source read another way; refused while there are edits that aren't saved."""
    return session if session.dirty else Session(make())


def replaced(session: Session, new: Table, status: str) -> Session:
    """A session over a whole new document, only if it was read without loss."""
    return replace(Session(new), saved=None) if status == "ok" else session


def sheet_edit(sheets: dict[str, Session], name: str, edit: Edit) -> dict[str, Session]:
    """An edit of one sheet of a workbook; each sheet has its own history."""
    return sheets | {name: sheets[name].dispatch(edit)}
