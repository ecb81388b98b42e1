"""Delimited text read exactly - ragged rows, quotes, generated headers - and written again."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import Table
from ..plans.contracts import Limits, Report

DELIMITERS = (",", "\t", ";", "|")


def logical_lines(text: str, most: int) -> list[str]:
    """Up to `most` lines that aren't empty; breaks inside quotes don't count."""
    text = re.sub("\r\n?", "\n", text.removeprefix("﻿"))
    out = []
    for m in re.finditer(r'(?:"(?:[^"]|"")*(?:"|\Z)|[^"\n])+', text):
        out.append(m.group())
        if len(out) == most:
            break
    return out


def count_outside_quotes(line: str, delimiter: str) -> int:
    return re.sub(r'"(?:[^"]|"")*(?:"|\Z)', "", line).count(delimiter)


def detect_delimiter(text: str, sample: int = 10) -> tuple[str, float]:
    """(delimiter, confidence): the highest mean count times the squared share of lines that have it; ties to less variance, then to order."""
    rows = logical_lines(text, sample)
    scored = []
    for rank, d in enumerate(DELIMITERS):
        counts = [n for n in (count_outside_quotes(r, d) for r in rows) if n]
        mean = sum(counts) / len(counts) if counts else 0.0
        spread = sum((n - mean) ** 2 for n in counts) / len(counts) if counts else float("inf")
        scored.append((-(mean * (len(counts) / len(rows)) ** 2 if rows else 0.0), spread, rank, d))
    scored.sort()
    best, second = -scored[0][0], -scored[1][0]
    return (scored[0][3], (best - second) / (best + second)) if best else (",", 0.0)


def records(text: str, delimiter: str = ",") -> list[list[str]]:
    """RFC 4180 records: a quote opens only an empty field, a doubled quote is one, line breaks of any kind end a record outside quotes."""
    text = re.sub("\r\n?", "\n", text.removeprefix("﻿"))
    d = re.escape(delimiter)
    field = re.compile(rf'(?:"((?:[^"]|"")*)(?:"|\Z)([^{d}\n]*)|([^{d}\n]*))({d}|\n|\Z)')
    rows, row, at = [], [], 0
    while at < len(text) or row:
        m = field.match(text, at)
        quoted, rest, bare, end = m.groups()
        row.append(quoted.replace('""', '"') + rest if quoted is not None else bare)
        at = m.end()
        if end != delimiter:
            rows.append(row)
            row = []
            if end == "" or at >= len(text):
                break
    return rows


RECORD = "path string, row_id long, cells array<string>"


def read(spark: SparkSession, path: str, *, delimiter: str | None = None, has_header: bool = True, limits: Limits = Limits()) -> Table:
    """A file or folder of delimited text as a table: the widest row sets the width, short rows are padded, missing headers are made up.

    Each file is read whole by one task (quotes may hold line breaks); many files are
    read in parallel. Rows are numbered by file and place; the report has the ragged count, and the
    files over limits.max_bytes, which aren't read.
    """
    report = Report(path)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path)
    files = found.where(F.col("length") <= limits.max_bytes)
    big = found.where(F.col("length") > limits.max_bytes).agg(F.count("*").alias("n"), F.min("path").alias("first")).first()
    if big["n"]:
        report.note("warning", "limit-bytes", big["first"], limit=limits.max_bytes, files=big["n"])
    if delimiter is None:
        head = files.orderBy("path").select(F.decode(F.substring("content", 1, 65536), "UTF-8")).first()
        delimiter, confidence = detect_delimiter(head[0] if head else "")
        if re.search(r"\.tsv$", path, re.I):
            delimiter, confidence = "\t", 1.0
        report.note("info", "delimiter", delimiter=delimiter, confidence=confidence)

    def work(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = records(bytes(content).decode("utf-8", "replace"), delimiter)
                yield pd.DataFrame({"path": name, "row_id": range(len(rows)), "cells": rows})

    parsed = files.select("path", "content").mapInPandas(work, RECORD)
    facts = parsed.agg(F.max(F.size("cells")).alias("w"), F.count("*").alias("n"), F.count_distinct("path").alias("files")).first()
    width = facts["w"] or 0
    if has_header:
        head = parsed.where("row_id = 0").orderBy("path").select("cells").first()
        headers = list(head[0]) if head else []
        rows = parsed.where("row_id > 0").withColumn("row_id", F.col("row_id") - 1)
    else:
        headers, rows = [], parsed
    ragged = rows.where(F.size("cells") != (len(headers) or width)).count()
    headers += [f"Column {i + 1}" for i in range(len(headers), width)]
    if ragged:
        report.note("warning", "ragged-rows", count=ragged)
    if facts["files"] > 1:
        from ..operators.cells import numbered

        rows = numbered(rows.select("path", F.col("row_id").alias("place"), "cells"), "path", "place")
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.lit(width) - F.size("cells"), F.lit(0)).cast("int")))
    rows = rows.select("row_id", padded.alias("cells"))
    if facts["n"] > limits.max_entries:
        report.note("warning", "limit-entries", limit=limits.max_entries)
        rows = rows.where(F.col("row_id") < limits.max_entries)
    return Table(rows, tuple(headers), {"report": report, "ragged": ragged, "delimiter": delimiter})


def fast(spark: SparkSession, path: str, *, delimiter: str = ",", header: bool = True) -> DataFrame:
    """Spark's own reader, splittable where no field holds a line break: short rows get nulls and extra cells are lost."""
    return spark.read.csv(path, sep=delimiter, header=header, quote='"', escape='"', multiLine=True)


def quoted(cell: Column, delimiter: str) -> Column:
    """A cell as written: quoted only if it holds the delimiter, a quote or a line break."""
    text = F.coalesce(cell, F.lit(""))
    odd = F.contains(text, F.lit(delimiter)) | text.rlike('[\r\n"]')
    return F.when(odd, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def text_rows(table: Table, delimiter: str = ",") -> DataFrame:
    """row_id, line."""
    return table.rows.select("row_id", F.array_join(F.transform("cells", lambda c: quoted(c, delimiter)), delimiter).alias("line"))


def header_line(headers: tuple[str, ...], delimiter: str = ",") -> str:
    odd = lambda h: delimiter in h or re.search('[\r\n"]', h)
    return delimiter.join('"' + h.replace('"', '""') + '"' if odd(h) else h for h in headers)


def write(table: Table, path: str, *, delimiter: str = ",", header: bool = True) -> None:
    """Text part files in row order, a header in each, line feeds between rows and no byte order mark."""
    lines = text_rows(table, delimiter).orderBy("row_id").select("line")
    if header:
        head = header_line(table.headers, delimiter)

        def with_head(batches):
            import pandas as pd

            first = True
            for pdf in batches:
                yield pd.concat([pd.DataFrame({"line": [head]}), pdf]) if first else pdf
                first = False

        lines = lines.mapInPandas(with_head, "line string")
    lines.write.text(path)


EXPORT_FORMAT = "tablescry/csv-export@1"


def envelope(table: Table, *, scope: str = "full-results", loaded: int | None = None, complete: bool = True) -> DataFrame:
    """One row, json: {format, headers, rows, metadata}. For tables that fit a message; larger ones are written as rows."""
    meta = F.struct(F.lit(scope).alias("scope"), F.coalesce(F.lit(loaded).cast("long"), F.count("*")).alias("sourceRowsLoaded"), F.lit(complete).alias("sourceFullyScanned"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row_id", "cells"))), lambda x: x["cells"])
    heads = F.array(*map(F.lit, table.headers)) if table.headers else F.array().cast("array<string>")
    one = table.rows.agg(ordered.alias("rows"), meta.alias("metadata"))
    return one.select(F.to_json(F.struct(F.lit(EXPORT_FORMAT).alias("format"), heads.alias("headers"), "rows", "metadata")).alias("json"))
