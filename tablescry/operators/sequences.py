"""Order-dependent operators: carry-forward, running offsets, packing checks, previous holders, pyramids, spectrograms."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def carried(df: DataFrame, value: str, out: str, *by: str, order: str) -> DataFrame:
    """The latest value that isn't null, this row included."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def line_offsets(texts: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """id, line, text, start, end of each line; a line break counts one. Offsets add up within a document only."""
    rows = texts.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line", "text"))
    before = F.sum(F.char_length("text") + 1).over(Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("start", F.coalesce(before, F.lit(0))).withColumn("end", F.col("start") + F.char_length("text"))


def packing(spans: DataFrame, *by: str, total: str | None = None) -> DataFrame:
    """Spans (begin, end) in order, with a flag where one doesn't begin at the furthest end before it."""
    before = Window.partitionBy(*by).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    expected = F.coalesce(F.max("end").over(before), F.lit(0))
    out = spans.withColumn("expected", expected).withColumn("fits", F.col("begin") == F.col("expected"))
    if total:
        whole = Window.partitionBy(*by)
        out = out.withColumn("fills", F.max("end").over(whole) == F.col(total))
    return out


def previous(df: DataFrame, value: str, *by: str, order: str) -> DataFrame:
    """The value of the row before with the same key."""
    return df.withColumn(f"previous_{value}", F.lag(value).over(Window.partitionBy(*by).orderBy(order)))


def step_match(total: int, now: int, forward: bool = True) -> int:
    """The next or previous of matches 0..total-1, around the ends; -1 without any."""
    return (now + (1 if forward else -1)) % total if total else -1


BASE, FACTOR, TOP = 256, 8, 512


def pyramid(samples: DataFrame, *, base: int = BASE, factor: int = FACTOR, top: int = TOP, levels: int | None = None) -> DataFrame:
    """level, channel, bucket, min, max of samples (frame, channel, sample).

    Level 0 buckets `base` frames; each further level joins `factor` buckets until no more than
    `top` are left, or there are `levels` of them if that is given. Every level aggregates the one
    below, so samples are shuffled once.
    """
    level = samples.groupBy("channel", F.floor(F.col("frame") / base).alias("bucket")).agg(F.min("sample").alias("min"), F.max("sample").alias("max"))
    frames = samples.agg(F.max("frame")).first()[0]
    out, n, count = level.withColumn("level", F.lit(0)), 0, -(-((frames if frames is not None else -1) + 1) // base)
    while count > top and (levels is None or n + 1 < levels):
        n, count = n + 1, -(-count // factor)
        level = level.groupBy("channel", F.floor(F.col("bucket") / factor).alias("bucket")).agg(F.min("min").alias("min"), F.max("max").alias("max"))
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out.select("level", "channel", "bucket", "min", "max")


def pick_level(levels: int, frames_per_pixel: float, *, base: int = BASE, factor: int = FACTOR) -> int:
    """The coarsest level whose buckets are no longer than a pixel; level 0 when all are."""
    best = 0
    for n in range(levels):
        if base * factor**n <= frames_per_pixel:
            best = n
    return best


def envelope(levels: DataFrame, level: int, first: int, last: int, pixels: int, *, base: int = BASE, factor: int = FACTOR) -> DataFrame:
    """channel, pixel, min, max over frames first..last (exclusive) drawn on so many pixels, from the buckets that each pixel touches."""
    size, per = base * factor**level, (last - first) / pixels
    lo = F.floor((F.col("bucket") * size - first) / per)
    hi = F.ceil(((F.col("bucket") + 1) * size - first) / per) - 1
    used = levels.where((F.col("level") == level) & (F.col("bucket") * size < last) & ((F.col("bucket") + 1) * size > first))
    spread = used.withColumn("pixel", F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, F.lit(pixels - 1)))))
    return spread.groupBy("channel", "pixel").agg(F.min("min").alias("min"), F.max("max").alias("max"))


def mono_peaks(samples: DataFrame, frames: int, width: int) -> DataFrame:
    """column, peak: the greatest magnitude of the mean of channels, in equal columns."""
    mono = samples.groupBy("frame").agg(F.avg("sample").alias("sample"))
    return mono.groupBy(F.floor(F.col("frame") * width / frames).alias("column")).agg(F.max(F.abs("sample")).alias("peak"))


def spectrogram(samples: DataFrame, *, rate: int, fft: int = 1024, hop: int = 512, bands: int = 64) -> DataFrame:
    """hop_id, levels array<int> (0..255 for -100..0 dB) in mel bands; frames are spread over all hops that hold them, then each hop is one FFT."""
    import pyarrow as pa

    mono = samples.groupBy("frame").agg(F.avg("sample").alias("sample"))
    first = F.greatest(F.ceil((F.col("frame") - fft + 1) / hop), F.lit(0))
    windows = mono.withColumn("hop_id", F.explode(F.sequence(first.cast("long"), F.floor(F.col("frame") / hop)))).groupBy("hop_id")
    windows = windows.agg(F.array_sort(F.collect_list(F.struct("frame", "sample"))).alias("w"))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(fft) / (fft - 1))
        to_mel, from_mel = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
        bins = from_mel(np.linspace(0, to_mel(rate / 2), bands)) * fft / rate
        low = np.minimum(bins.astype(int), fft // 2 - 1)
        for b in batches:
            out = []
            for hop_id, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.zeros(fft)
                for s in w:
                    x[s["frame"] - hop_id * hop] = s["sample"]
                m = np.abs(np.fft.rfft(x * hann)) / (fft / 2)
                m = m[low] + (m[low + 1] - m[low]) * (bins - low)
                out.append(np.clip((20 * np.log10(np.maximum(m, 1e-10)) + 100) / 80 * 255, 0, 255).astype(int).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["hop_id", "levels"])

    return windows.select("hop_id", "w").mapInArrow(transform, "hop_id long, levels array<int>")


def merged_boxes(boxes: DataFrame) -> DataFrame:
    """Highlight boxes (page, x, y, w, h) joined along rows: by running row centre, then across small gaps; one page a group."""
    import pandas as pd

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[list] = []
        for _, r in pdf.sort_values(["y", "x"]).iterrows():
            centre = r.y + r.h / 2
            if rows and abs(centre - rows[-1][0]) <= r.h / 2:
                row = rows[-1]
                row[1].append(r)
                row[0] = sum(k.y + k.h / 2 for k in row[1]) / len(row[1])
            else:
                rows.append([centre, [r]])
        out = []
        for _, members in rows:
            members.sort(key=lambda r: r.x)
            now = None
            for r in members:
                gap = min(max(0.9 * r.h, 4), 16)
                if now and r.x - (now["x"] + now["w"]) <= gap:
                    right, low = max(now["x"] + now["w"], r.x + r.w), max(now["y"] + now["h"], r.y + r.h)
                    now["y"] = min(now["y"], r.y)
                    now["w"], now["h"] = right - now["x"], low - now["y"]
                else:
                    now = {"page": r.page, "x": r.x, "y": r.y, "w": r.w, "h": r.h}
                    out.append(now)
        return pd.DataFrame(out, columns=["page", "x", "y", "w", "h"])

    return boxes.groupBy("page").applyInPandas(join, "page long, x double, y double, w double, h double")
