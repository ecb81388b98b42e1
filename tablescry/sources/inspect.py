"""Open a folder of unfamiliar files: detect each file's format, parse it, and give all of it in one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, documents, engineering, office  # noqa: F401  they register their parsers
from .detect import SNIFF_BYTES, detect, probe
from .files import LONG, PARSERS, Summary, long_rows, too_large

#: Parsers of detected formats whose names differ.
PARSER_OF = {"shapefile": "shp", "excel": "xlsx", "word": "docx", "ppt": "pptx"}


def formats(spark: SparkSession, path: str) -> DataFrame:
    """path, name, length, format, matched_by of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    heads = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.substring("content", 1, SNIFF_BYTES).alias("head"))
    text = F.when(F.try_validate_utf8(F.col("head")).isNotNull(), F.decode("head", "UTF-8"))
    return detect(heads.withColumn("sample", text), head="head", text="sample").drop("head", "sample")


def summaries(spark: SparkSession, path: str, *, max_bytes: int = 256 << 20) -> DataFrame:
    """Long form of every file below path by its detected format; containers are probed, the rest falls back to text or a dump; a file over max_bytes gives a warning row."""

    def work(batches):
        import pandas as pd

        for pdf in batches:
            rows: list[tuple] = []
            for name, content, kind, how in zip(pdf["path"], pdf["content"], pdf["format"], pdf["matched_by"]):
                data = bytes(content)
                if how == "ambiguous-container":
                    kind = probe(data) or kind
                parse = PARSERS.get(PARSER_OF.get(kind, kind), PARSERS["fallback"])
                try:
                    s = parse(data)
                except Exception as e:  # the contract: bad input is data
                    s = Summary(kind, "unreadable", warnings=[f"{type(e).__name__}: {e}"])
                rows += long_rows(name, s)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LONG.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    told = formats(spark, path).select("path", "format", "matched_by")
    readable = files.where(F.col("length") <= max_bytes).select("path", "content")
    return readable.join(told, "path").mapInPandas(work, LONG).union(too_large(files, max_bytes))
