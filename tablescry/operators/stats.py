"""Column statistics, counts, modes, totals and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from .cells import Table

KINDS = ("object", "array", "string", "number", "boolean", "null")


def column_statistics(table: Table) -> DataFrame:
    """Per column: total, count, null_count, null_fraction; and n, mean, min, max where all that isn't blank is numeric.

    All columns are aggregated in one pass with partial sums; nothing is exploded or shuffled but one row a task.
    """
    columns = range(len(table.headers))
    texts = table.rows.select(*[V.trimmed(table.cell(i)).alias(f"t{i}") for i in columns])
    parsed = texts.select(*[c for i in columns for c in ((F.col(f"t{i}") != "").alias(f"f{i}"), V.numeric(F.col(f"t{i}")).alias(f"v{i}"))])
    aggs = [F.count("*").alias("total")]
    for i in columns:
        n = F.col(f"v{i}")
        aggs += [
            F.count_if(f"f{i}").alias(f"full{i}"),
            F.count(n).alias(f"n{i}"), F.avg(n).alias(f"mean{i}"), F.min(n).alias(f"min{i}"), F.max(n).alias(f"max{i}"),
        ]
    one = parsed.agg(*aggs)

    def row(i: int) -> Column:
        full, total = F.col(f"full{i}"), F.col("total")
        numeric = (full > 0) & (F.col(f"n{i}") == full)
        return F.struct(
            F.lit(i).alias("column"), F.lit(table.headers[i]).alias("header"), total.alias("total"), full.alias("count"), (total - full).alias("null_count"),
            F.when(total > 0, (total - full) / total).otherwise(0.0).alias("null_fraction"),
            F.when(numeric, F.col(f"n{i}")).alias("n"), *[F.when(numeric, F.col(f"{k}{i}")).alias(k) for k in ("mean", "min", "max")],
        )

    return one.select(F.inline(F.array(*[row(i) for i in range(len(table.headers))])))


def kind_statistics(nodes: DataFrame) -> DataFrame:
    """Nodes, greatest depth and counts of all six kinds."""
    return nodes.agg(F.count("*").alias("total"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])


def mode(df: DataFrame, key: str, order: str, *by: str) -> DataFrame:
    """The most frequent key, ties to the first seen."""
    counts = df.groupBy(*by, key).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(key, F.struct(F.col("n"), -F.col("first"))).alias("mode"), F.max("n").alias("n"))


def best_by(df: DataFrame, choice: str, score: str, *by: str) -> DataFrame:
    """The choice with the best score, ties to the smaller choice."""
    return df.groupBy(*by).agg(F.min_by(choice, F.struct(-F.col(score), F.col(choice))).alias(choice))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def peak_rms(df: DataFrame, samples: str, *, most: int = 200_000) -> DataFrame:
    """peak and rms of an array of samples, strided so that no more than `most` are looked at."""
    step = F.greatest(F.floor(F.size(samples) / most), F.lit(1))
    used = F.filter(samples, lambda x, i: i % step == 0)
    return df.withColumns({
        "peak": F.array_max(F.transform(used, lambda x: F.abs(x.cast("double")))),
        "rms": F.sqrt(F.aggregate(used, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(used)),
    })


def bounding_box(points: DataFrame, *by: str) -> DataFrame:
    """min_x, min_y, max_x, max_y; null where any coordinate isn't finite."""
    fine = F.bool_and(F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False)))
    return points.groupBy(*by).agg(*[F.when(fine, f(c)).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")])


def chart_bounds(points: DataFrame, kind: str = "clustered") -> DataFrame:
    """low, high of a chart's axis. points: category, series, value; kind: clustered, stacked or percent."""
    if kind == "percent":
        return points.agg(F.when(F.min("value") < 0, -100.0).otherwise(0.0).alias("low"), F.lit(100.0).alias("high"))
    if kind == "stacked":
        points = points.groupBy("category").agg(F.sum(F.greatest("value", F.lit(0.0))).alias("up"), F.sum(F.least("value", F.lit(0.0))).alias("down"))
        return points.agg(F.min("down").alias("low"), F.max("up").alias("high"))
    return points.agg(F.min("value").alias("low"), F.max("value").alias("high"))


def shares(points: DataFrame) -> DataFrame:
    """Share of each value in its category, and where its segment begins. points: category, ord, value."""
    from pyspark.sql.window import Window

    of = Window.partitionBy("category")
    before = of.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.abs("value")).over(of)
    return points.withColumns({"share": F.when(total > 0, F.abs("value") / total).otherwise(0.0), "start": F.when(total > 0, F.coalesce(F.sum(F.abs("value")).over(before), F.lit(0.0)) / total).otherwise(0.0)})


def embedded_chart(table: Table) -> DataFrame:
    """category, series, value of a sheet whose first row names series and first column categories; non-numbers are 0.

    Empty when there are fewer than two rows or three columns, or all values are 0.
    """
    head = table.rows.where("row_id = 0").select("cells").first()
    if head is None or len(head[0]) < 3:
        return table.rows.sparkSession.createDataFrame([], "category string, series string, value double")
    names = F.array(*map(F.lit, head[0][1:]))
    values = F.transform(F.slice("cells", 2, len(head[0]) - 1), lambda c: F.coalesce(V.parse_numeric(c), F.lit(0.0)))
    rows = table.rows.where("row_id > 0").select(F.get("cells", F.lit(0)).alias("category"), F.inline(F.arrays_zip(names.alias("series"), values.alias("value"))))
    rows = rows.toDF("category", "series", "value")
    used = rows.agg(F.max(F.abs("value")).alias("m"))
    return rows.join(F.broadcast(used.where("m > 0")), F.lit(True), "left_semi")


def contract_counts(table: Table, page_size: int) -> DataFrame:
    """Rows, ragged rows and pages."""
    width = len(table.headers)
    return table.rows.agg(F.count("*").alias("rows"), F.count_if(F.size("cells") != width).alias("ragged"), F.greatest(F.lit(1), F.ceil(F.count("*") / page_size)).cast("long").alias("pages"))
