"""Connected components of a graph given as edges, without any of it on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, save

EDGES = "x long, y long"


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition: an edge from each node to the smallest node it reaches here."""
    parent: dict[int, int] = {}

    def root(n: int) -> int:
        while (p := parent.setdefault(n, n)) != n:
            parent[n] = n = parent.setdefault(p, p)
        return n

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [(r, n) for n in parent if (r := root(n)) != n]
    yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in nodes], pa.int64()) for i in (0, 1)], ["x", "y"])


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating stars: neighbours above (large) or below a node move to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))) if large else edges.select(F.col("y").alias("x"), F.col("x").alias("y"))
    least = both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("low"))
    moved = both.join(least, "x")
    moved = moved.where(F.col("y") > F.col("x")).select(F.col("low").alias("x"), "y") if large else moved.select(F.col("low").alias("x"), "y").unionByName(least.select(F.col("low").alias("x"), F.col("x").alias("y")))
    return moved.where("x <> y").distinct()


def components(edges: DataFrame, *, task_edges: int = 250_000) -> DataFrame:
    """x, y: the smallest node reachable and each node but that one.

    Tasks shrink their share of the edges to spanning stars; while there is more than
    one share, large and small stars bring the shares together until nothing moves.
    """
    edges = save(edges.select("x", "y"), "edges")
    seen = None
    while True:
        shares = -(-edges.count() // task_edges)
        spread = edges.repartition(max(1, shares))
        stars = spread.mapInArrow(spanning, EDGES)
        if shares <= 1:
            return save(stars, "components")
        stars = save(stars, "edges")
        moved = save(star(star(stars, True), False), "edges")
        delete(edges.sparkSession, edges, stars)
        now = moved.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == seen:
            return moved
        edges, seen = moved, now
