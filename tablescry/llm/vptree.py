"""Approximate nearest neighbours by inner product: a vantage-point tree in each shard.

Largest inner product becomes smallest distance when every vector x gets one more
component, sqrt(M^2 - |x|^2), and queries get 0 there (M: the largest norm). A
subtree is left out when factor times its triangle-inequality lower bound exceeds
the distance of the k-th neighbour so far: factor 1 is exact search, larger factors
visit less. Every vector is in a tree; copies of a vector in a shard share a place.

build() makes the trees once and writes them; search() sends each tree to one task, where
all blocks of queries stream past it. Vectors are scaled by a power of two inside the trees,
so that squares of very large or small components stay finite.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part, as rows with a null id; vectors of one length are searched among those of the same
length, since others have no product with them; rows that share the query's id aren't its
neighbours; an empty table gives an empty result; ties go to the smaller id; products beyond
the range of doubles are infinite and tie; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, let, save

HIT = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


class Tree:
    """A vantage-point tree over distinct vectors of norm top at most.

    Node i: vantage point points[i] and radius[i] with children left[i] (inside) and
    right[i], or, where radius is negative, a leaf: order[left[i]:right[i]].
    """

    def __init__(self, vectors: np.ndarray, top: float, *arrays: np.ndarray):
        self.x, self.top = vectors, top
        self.points, self.radius, self.left, self.right, self.order = arrays or self._built()

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.points, self.radius, self.left, self.right, self.order

    def _built(self, leaf: int = 96, seed: int = 5, deepest: int = 200) -> tuple[np.ndarray, ...]:
        lift = np.sqrt(np.maximum(self.top**2 - np.einsum("ij,ij->i", self.x, self.x), 0.0))
        points = np.concatenate([self.x, lift[:, None]], axis=1)
        rng = np.random.default_rng(seed)
        nodes: list[list] = []
        order: list[np.ndarray] = []
        placed = 0

        def build(rows: np.ndarray, depth: int) -> int:
            nonlocal placed
            me = len(nodes)
            nodes.append([])
            if len(rows) > leaf and depth < deepest:
                vantage = int(rows[rng.integers(len(rows))])
                apart = points[rows] - points[vantage]
                d = np.sqrt(np.einsum("ij,ij->i", apart, apart))
                radius = float(np.median(d))
                inner = d <= radius
                if inner.any() and not inner.all():
                    nodes[me] = [vantage, radius, build(rows[inner], depth + 1), build(rows[~inner], depth + 1)]
                    return me
            nodes[me] = [-1, -1.0, placed, placed + len(rows)]
            order.append(rows)
            placed += len(rows)
            return me

        build(np.arange(len(self.x)), 0)
        vantage, radius, left, right = (np.array(c) for c in zip(*nodes))
        return np.where(vantage[:, None] >= 0, points[vantage], 0.0), radius, left, right, np.concatenate(order)

    def search(self, queries: np.ndarray, k: int, factor: float) -> np.ndarray:
        """For each query the rows of k nearest vectors found (-1: none), unordered."""
        m = len(queries)
        q = np.concatenate([queries, np.zeros((m, 1))], axis=1)
        norms = np.einsum("ij,ij->i", queries, queries) + self.top**2
        rows = np.full((m, k), -1)
        score = np.full((m, k), -np.inf)
        packed = self.x[self.order]
        home = np.zeros(m, dtype=np.int64)

        def over(at: int, who: np.ndarray) -> np.ndarray:
            return np.linalg.norm(q[who] - self.points[at], axis=1) - self.radius[at]

        def visit(at: int, who: np.ndarray) -> None:
            first, end = self.left[at], self.right[at]
            s = queries[who] @ packed[first:end].T
            better = s.max(axis=1) > score[who].min(axis=1)
            who, s = who[better], s[better]
            if len(who):
                both = np.concatenate([score[who], s], axis=1)
                ids = np.concatenate([rows[who], np.broadcast_to(self.order[first:end], s.shape)], axis=1)
                best = np.argpartition(-both, k - 1, axis=1)[:, :k]
                score[who], rows[who] = np.take_along_axis(both, best, 1), np.take_along_axis(ids, best, 1)

        def descend(at: int, who: np.ndarray) -> None:
            if self.radius[at] < 0:
                home[who] = at
                visit(at, who)
                return
            inside = over(at, who) <= 0
            for child, part in ((self.left[at], who[inside]), (self.right[at], who[~inside])):
                if len(part):
                    descend(child, part)

        def sweep(at: int, who: np.ndarray, bound: np.ndarray) -> None:
            limit = np.sqrt(np.maximum(norms[who] - 2 * score[who].min(axis=1), 0.0))
            near = factor * bound <= limit * (1 + 1e-12) + 1e-12
            who, bound = who[near], bound[near]
            if not len(who):
                return
            if self.radius[at] < 0:
                if len(rest := who[home[who] != at]):
                    visit(at, rest)
                return
            gap = over(at, who)
            sides = ((self.left[at], gap), (self.right[at], -gap))
            for child, far in sides if (gap <= 0).mean() >= 0.5 else sides[::-1]:
                sweep(child, who, np.maximum(bound, far))

        descend(0, np.arange(m))
        sweep(0, np.arange(m), np.zeros(m))
        return rows


def blob(*arrays: np.ndarray) -> bytes:
    import io

    np.savez(f := io.BytesIO(), *arrays)
    return f.getvalue()


def unblob(data: bytes) -> list[np.ndarray]:
    import io

    with np.load(io.BytesIO(data)) as z:
        return [z[k] for k in z.files]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def picked(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), wide.alias("w")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    return rows.select("vec_id", F.size("w").alias("dim"), F.col("w").alias("v"))


def grouped(rows: DataFrame, groups: dict[int, int]) -> DataFrame:
    """With a column `part`: vectors of one length are dealt by id over that many groups of their own."""
    rank = F.create_map(*[F.lit(x) for i, d in enumerate(sorted(groups)) for x in (d, sum(groups[e] for e in sorted(groups)[:i]))])
    count = F.create_map(*[F.lit(x) for x in sum(sorted(groups.items()), ())])
    return rows.withColumn("part", (F.try_element_at(rank, "dim") + F.pmod(F.xxhash64("vec_id"), F.try_element_at(count, "dim").cast("long"))).cast("int"))


INDEX = "part int, dim int, data binary"


def build(vectors: DataFrame, *, shard_rows: int = 16_384, most_lengths: int = 1_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """part, dim, data: a written table with a tree a row, for search(). More than most_lengths lengths of vectors raise an error."""
    base = picked(vectors, id_col, vector_col)
    norm = let(F.array_max(F.transform("v", F.abs)), lambda m: F.log2(m) + F.log2(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / m) * (x / m))) / 2)
    facts = base.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("top")).limit(most_lengths + 1).collect()
    if len(facts) > most_lengths:
        raise ValueError(f"vectors of more than {most_lengths} lengths")
    if not facts:
        return vectors.sparkSession.createDataFrame([], INDEX)
    scale = {r["dim"]: math.floor(r["top"]) + 1 for r in facts}
    tops = {r["dim"]: 2.0 ** (r["top"] - scale[r["dim"]]) * (1 + 1e-9) for r in facts}

    def plant(table: pa.Table) -> pa.Table:
        part, dim = table.column("part")[0].as_py(), table.column("dim")[0].as_py()
        distinct, place = np.unique(matrix(table.column("v")), axis=0, return_inverse=True)
        place, ids = place.reshape(-1), table.column("vec_id").to_numpy()
        by = np.lexsort((ids, place))
        first = np.searchsorted(place[by], np.arange(len(distinct) + 1))
        tree = Tree(np.ldexp(distinct, -scale[dim]), tops[dim])
        data = blob(ids[by], first, distinct, np.array([tops[dim], scale[dim]]), *tree.arrays())
        return pa.table({"part": pa.array([part], pa.int32()), "dim": pa.array([dim], pa.int32()), "data": pa.array([data], pa.binary())})

    return save(grouped(base, {r["dim"]: -(-r["n"] // shard_rows) for r in facts}).groupBy("part").applyInArrow(plant, INDEX), "vp-trees")


def search(index: DataFrame, queries: DataFrame, *, k: int = 20, factor: float = 1.15, block_rows: int = 4_096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query in the trees of build()."""
    spark = index.sparkSession
    bound_batches(spark)
    asked = picked(queries, id_col, vector_col)
    spans = {r["dim"]: (r["first"], r["last"]) for r in index.groupBy("dim").agg(F.min("part").alias("first"), F.max("part").alias("last")).collect()}
    asked = asked.where(F.col("dim").isin(list(spans)))
    counts = {r["dim"]: -(-r["count"] // block_rows) for r in asked.groupBy("dim").count().collect()}

    def pack(table: pa.Table) -> pa.Table:
        part, dim = table.column("part")[0].as_py(), table.column("dim")[0].as_py()
        return pa.table({"block": pa.array([part], pa.int32()), "dim": pa.array([dim], pa.int32()), "ask": pa.array([blob(table.column("vec_id").to_numpy(), matrix(table.column("v")))], pa.binary())})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by part: a tree, then all blocks of queries for it, one at a time."""
        here = None
        for b in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for part, data, ask in zip(b.column("part").to_pylist(), b.column("data"), b.column("ask")):
                if data.is_valid:
                    ids, first, distinct, (top, scale), *arrays = unblob(data.as_py())
                    tree, here = Tree(np.ldexp(distinct, -int(scale)), top, *arrays), part
                    continue
                if part != here:  # a group that got no vectors
                    continue
                query_ids, q = unblob(ask.as_py())
                # a few more than k: the query itself is among them, and near ties are told apart below
                found = tree.search(np.ldexp(q, -int(scale)), k + 6, factor)
                for i, rows in enumerate(found):
                    rows = rows[rows >= 0]
                    with np.errstate(over="ignore", invalid="ignore"):
                        exact = (distinct[rows] * q[i]).sum(axis=1)
                    near = [ids[first[r] : first[r + 1]] for r in rows]
                    near = [v[v != query_ids[i]][:k] for v in near]
                    v, s = np.concatenate(near), np.repeat(exact, [len(v) for v in near])
                    keep = np.lexsort((v, -s))[:k]
                    out.append((np.full(len(keep), query_ids[i]), v[keep], s[keep]))
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    if counts:
        blocks = save(grouped(asked, counts).groupBy("part").applyInArrow(pack, "block int, dim int, ask binary"), "vp-queries")
        first, last = (F.try_element_at(F.create_map(*[F.lit(x) for d, span in spans.items() for x in (d, span[i])]), "dim") for i in (0, 1))
        trees = index.select("part", F.lit(-1).alias("block"), "data", F.lit(None).cast("binary").alias("ask"))
        asks = blocks.select(F.explode(F.sequence(first, last)).alias("part"), "block", F.lit(None).cast("binary").alias("data"), "ask")
        ordered = trees.unionByName(asks).repartition(max(1, index.count()), "part").sortWithinPartitions("part", "block")
        hits = ordered.select("part", "data", "ask").mapInArrow(find, HIT)
    else:
        hits = spark.createDataFrame([], HIT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, factor: float = 1.15, shard_rows: int = 16_384, block_rows: int = 4_096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, which are rows like those of vectors."""
    columns = {"id_col": id_col, "vector_col": vector_col}
    return search(build(vectors, shard_rows=shard_rows, **columns), queries, k=k, factor=factor, block_rows=block_rows, **columns)


def neighbours(embeddings: DataFrame) -> DataFrame:
    """The digest for the query: every vector whose id is divisible by 20 against all."""
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 20 == 0))
