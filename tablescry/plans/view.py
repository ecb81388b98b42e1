"""The table view: sort, search and page in one lazy plan, in this order whatever the order of calls."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..operators import order, search, stats
from ..operators.cells import Table


@dataclass(frozen=True)
class View:
    table: Table
    sort: order.Sort | None = None
    term: str = ""
    at: order.Page = order.Page()

    def toggled(self, column: int) -> View:
        """The next sort state of a column; back to the first page."""
        return replace(self, sort=order.next_sort(self.sort, column), at=replace(self.at, index=0))

    def searched(self, term: str) -> View:
        return replace(self, term=term, at=replace(self.at, index=0))

    def paged(self, index: int) -> View:
        return replace(self, at=replace(self.at, index=max(0, index)))

    def resized(self, size: int) -> View:
        return replace(self, at=self.at.resized(size))

    def matching(self) -> Table:
        """All matching rows in order. The column type comes from the whole table, as the sort comes first; Catalyst filters before it sorts."""
        kind = order.inferred(self.table, self.sort.column) if self.sort else None
        return order.ordered(search.any_cell(self.table, self.term), self.sort, kind=kind)

    def rows(self) -> DataFrame:
        return order.page(self.matching().rows, self.at)

    def statistics(self) -> DataFrame:
        """Of the whole document: neither search nor page counts."""
        return stats.column_statistics(self.table)
