"""Incremental loads as Structured Streaming: pages of line-delimited text, windowed counts, pyramids of a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """window_start, event_type, n; over a stream with a watermark it is append-ready."""
    source = events.withWatermark("ts", late) if late else events
    counts = source.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n")


def paged_records(chunks: DataFrame) -> DataFrame:
    """Records of sources whose bytes come in pages: only lines that have ended are visible, the rest waits in state until `done`.

    chunks: source string, page long, data string, done boolean; a record split over pages comes
    out once, numbered from 1 as in one read. Pages of a source may come in any number of batches, in order.
    """
    import pandas as pd

    def take(key: tuple, pages: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tail, line = state.get if state.exists else ("", 0)
        pdf = pd.concat(list(pages)).sort_values("page")
        text, done = tail + "".join(pdf["data"]), bool(pdf["done"].any())
        parts = text.split("\n")
        tail = parts.pop()
        if done and tail:
            parts.append(tail)
            tail = ""
        yield pd.DataFrame({"source": [key[0]] * len(parts), "line": range(line + 1, line + 1 + len(parts)), "raw": [p.removesuffix("\r") for p in parts]})
        if done:
            state.remove()
        else:
            state.update((tail, line + len(parts)))

    return chunks.groupBy("source").applyInPandasWithState(take, "source string, line long, raw string", "tail string, line long", "append", "NoTimeout")


def bucketed(samples: DataFrame, base: int = 256) -> DataFrame:
    """Level 0 of a pyramid over a stream of samples: min and max don't care how the stream is cut."""
    return samples.groupBy("channel", F.floor(F.col("frame") / base).alias("bucket")).agg(F.min("sample").alias("min"), F.max("sample").alias("max"))


def row_window(path_frame: DataFrame, start: int, count: int) -> DataFrame:
    """The next chunk of a columnar file by row index; the reader skips row groups outside it."""
    index = F.col("_metadata.row_index")
    return path_frame.where((index >= start) & (index < start + count))
