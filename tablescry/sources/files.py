"""Files of many formats as tables: each parser turns bytes into a Summary, and Spark runs it over folders of files.

A summary is what any format gives: label-value facts, titled tables and warnings. The
long form is one DataFrame for all of them; table() gives one titled table with its columns.
Files are read whole by the task that parses them, so the unit of parallelism is the file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Summary:
    format: str
    title: str
    facts: list[tuple[str, object]] = field(default_factory=list)
    tables: dict[str, tuple[list[str], list[list]]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def add(self, title: str, headers: list[str], rows: list[list]) -> Summary:
        self.tables[title] = (headers, rows)
        return self


Parser = Callable[[bytes], Summary]
PARSERS: dict[str, Parser] = {}
LONG = "path string, format string, table string, row_idx long, col_idx int, header string, value string"


def parser(*names: str) -> Callable[[Parser], Parser]:
    def register(f: Parser) -> Parser:
        for n in names:
            PARSERS[n] = f
        return f

    return register


def text(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
        return str(int(v))
    return str(v)


def long_rows(path: str, s: Summary) -> list[tuple]:
    """The summary in long form; facts and warnings are the tables (facts) and (warnings)."""
    everything = {"(facts)": (["label", "value"], [list(f) for f in s.facts]), **s.tables, "(warnings)": (["warning"], [[w] for w in s.warnings])}
    return [(path, s.format, t, i, j, h, text(row[j]) if j < len(row) else "") for t, (heads, rows) in everything.items() for i, row in enumerate(rows) for j, h in enumerate(heads)]


def too_large(files: DataFrame, max_bytes: int) -> DataFrame:
    """The files over the limit in long form: a warning row each, so that none goes missing without a word. Their contents are not read."""
    big = files.where(F.col("length") > max_bytes)
    said = F.format_string(f"not read: %d bytes, limit {max_bytes}", "length")
    return big.select("path", F.lit("skipped").alias("format"), F.lit("(warnings)").alias("table"), F.lit(0).cast("long").alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("warning").alias("header"), said.alias("value"))


def summarise(spark: SparkSession, path: str, kind: str, *, max_bytes: int = 256 << 20) -> DataFrame:
    """Long form of every file under path; a file that can't be read, or is over max_bytes, gives a warning row and no error."""
    parse = PARSERS[kind]

    def work(batches):
        import pandas as pd

        for pdf in batches:
            rows: list[tuple] = []
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    s = parse(bytes(content))
                except Exception as e:  # the contract: bad input is data
                    s = Summary(kind, "unreadable", warnings=[f"{type(e).__name__}: {e}"])
                rows += long_rows(name, s)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LONG.split(", ")])

    files = spark.read.format("binaryFile").load(path)
    return files.where(F.col("length") <= max_bytes).select("path", "content").mapInPandas(work, LONG).union(too_large(files, max_bytes))


def table(summary: DataFrame, title: str, headers: list[str]) -> DataFrame:
    """One titled table, a column for each header by position."""
    rows = summary.where(F.col("table") == title).groupBy("path", "row_idx")
    return rows.agg(*[F.max(F.when(F.col("col_idx") == i, F.col("value"))).alias(h) for i, h in enumerate(headers)])


def matching(summary: DataFrame, term: str) -> DataFrame:
    """Rows of tables with the trimmed term in some cell."""
    hits = summary.where(F.contains(F.lower("value"), F.lower(F.lit(term.strip())))).select("path", "table", "row_idx").distinct()
    return summary.join(hits, ["path", "table", "row_idx"], "left_semi")


def hex_lines(data: bytes, count: int = 256) -> list[list]:
    return [[f"{at:08x}", data[at : at + 16].hex(" "), "".join(chr(b) if 32 <= b < 127 else "." for b in data[at : at + 16])] for at in range(0, min(len(data), count), 16)]


def preview(s: Summary, data: bytes) -> Summary:
    return s.add("Header preview", ["Offset", "Hex", "ASCII"], hex_lines(data))
