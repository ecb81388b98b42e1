"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Documents with equal shingle sets form a class and the smallest id stands for it. Each
class takes a place in several sorted orders, one for each tree of the forest, by the
values of its own part of the signature. Neighbours there have the longest common prefixes.
Each class goes down its tree, from the least depth, until no more than a few share its
prefix: all of those are its candidates, so crowded regions compare at greater depth than
sparse ones; where even whole signatures are shared by many, the nearest few are. Confirmed links
form components. Depth alone could lose links: regions of least depth that are crowded, or that a
partition boundary cuts, are then finished exactly if they still span components
(unless exact=False): their members meet in blocks, each pair of blocks is compared in one
task, and only a spanning forest of its links comes out.

A pair at Jaccard likeness J shares a region with probability 1 - (1 - J^3)^24; at
0.75 that is 0.999998. No cap on partners or candidates loses a link. Without the exact
finish, what moves grows in proportion to the documents whatever the regions; a pair in a region that is
crowded down to depth d is found directly with probability 1 - (1 - J^d)^24, 0.991 at
0.75 and depth 6, and through common partners beyond that.

Defined results: words are runs of anything but ASCII white space, A-Z lower-cased;
fewer than five words are one shingle; a null or wordless text has no shingle and no
link; rows that share an id are one node; a null id has no link and is kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, delete, partitions, save, text_of
from .components import components

TREES, DEPTH, LEAST_DEPTH = 24, 6, 3
WORDS = 5
#: Bits in which the 128-bit sketches of a linked pair may differ: 16 expected at 0.75, and 5.5 standard deviations.
SKETCH_BITS = 37
#: Classes that may share a prefix before a deeper one is asked for; all of them are compared.
GROUP = 16
#: Neighbours looked back at where more than that share a whole signature.
WINDOW = 3
ORDER = "tree int, p1 long, p2 int, r1 int, r2 long, rep long, n long, s1 long, s2 long"


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: every bit of the input moves every bit of the output."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signature(sets: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Least value of each multiplicative permutation, in blocks so that long texts need no more memory."""
    low = (sets >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(least, (low[at : at + 4096, None] * multipliers).min(axis=0), out=least)
    return least


def shingle_rows(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, a, b (hash of the set), parts (TREES x DEPTH values), s1, s2 (sketch)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = np.random.default_rng(99).integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        for b in batches:
            n, sums, parts, sketches = [], [], [], []
            for text in b.column(1):
                s = shingles(text.as_buffer().to_pybytes())
                n.append(len(s))
                sums.append((mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                values = signature(s, multipliers)
                parts.append(values.tobytes())
                bits = ((values[:128] * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
                sketches.append(np.packbits(bits).view(np.int64))
            sums_, sketch = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64), np.array(sketches, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), *map(pa.array, (sums_[:, 0], sums_[:, 1])), pa.array(parts, pa.binary()), *map(pa.array, (sketch[:, 0], sketch[:, 1]))],
                ["doc_id", "n", "a", "b", "parts", "s1", "s2"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(work, "doc_id long, n long, a long, b long, parts binary, s1 long, s2 long")


def orders(classes: DataFrame) -> DataFrame:
    """A row for each class and tree: the tree's part of the signature, split after the least depth."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            v = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(m, TREES, DEPTH).astype(np.int64)
            columns = [np.tile(np.arange(TREES, dtype=np.int32), m), (v[..., 0] << 32 | v[..., 1]).ravel(), v[..., 2].ravel().astype(np.uint32).view(np.int32), v[..., 3].ravel().astype(np.uint32).view(np.int32), (v[..., 4] << 32 | v[..., 5]).ravel()]
            columns += [np.repeat(b.column(i).to_numpy(zero_copy_only=False), TREES) for i in (0, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["tree", "p1", "p2", "r1", "r2", "rep", "n", "s1", "s2"])

    return classes.select("rep", "parts", "n", "s1", "s2").mapInArrow(work, ORDER)


def depths(tree: np.ndarray, p1: np.ndarray, p2: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: (common prefix of each row with the one before, runs of equal prefix by depth from the least one on)."""
    same = np.zeros(len(tree), np.int64)
    steps = (tree, p1), (p2,), (r1,), (r2 >> 32,), (r2,)
    alike = np.ones(max(len(tree) - 1, 0), bool)
    for i, columns in enumerate(steps):
        for c in columns:
            alike &= c[1:] == c[:-1]
        same[1:][alike] = i + LEAST_DEPTH - 1
    return same, np.stack([np.cumsum(same < d) for d in range(LEAST_DEPTH, DEPTH + 1)])


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one sorted partition: pairs of near neighbours (x, y) with their region, and regions (x null) that need finishing."""
    keys = ["tree", "p1", "p2", "r1", "r2"]
    names = [*keys, "rep", "n", "s1", "s2"]
    kept = {c: np.empty(0, np.int64) for c in names}
    run, first, last = 0, True, None

    def rows(x, y, tree, p1, p2) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((x, y, tree, p1, p2), kinds)], ["x", "y", "tree", "p1", "p2"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = {c: np.concatenate([kept[c], b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for c in names}
        old, m = len(kept["rep"]), len(cols["rep"])
        same, runs = depths(*(cols[c] for c in keys))
        # The least depth at which no more than a few share the prefix, as a row of runs; the last is for whole signatures that many share.
        crowd = np.stack([np.bincount(r)[r] for r in runs]) > GROUP
        level = np.where(crowd.all(axis=0), len(runs), crowd.argmin(axis=0))
        mine = runs[np.minimum(level, len(runs) - 1), np.arange(m)]
        xs, ys, at_ = [], [], []
        for lag in range(1, GROUP):
            i = np.arange(max(old, lag), m)
            near = (runs[0][i] == runs[0][i - lag]) if lag <= WINDOW else (mine[i] == runs[np.minimum(level[i], len(runs) - 1), i - lag]) & (level[i] < len(runs))
            i = i[near]
            j = i - lag
            n_i, n_j = cols["n"][i], cols["n"][j]
            # As unsigned numbers: numpy counts the bits of a signed number's magnitude.
            apart = sum(np.bitwise_count((cols[s][i] ^ cols[s][j]).view(np.uint64)).astype(int) for s in ("s1", "s2"))
            good = (apart <= SKETCH_BITS) & (4 * np.minimum(n_i, n_j) >= 3 * np.maximum(n_i, n_j)) & (cols["rep"][i] != cols["rep"][j])
            u, v = cols["rep"][i[good]], cols["rep"][j[good]]
            xs.append(np.minimum(u, v))
            ys.append(np.maximum(u, v))
            at_.append(i[good])
        x, y, i = map(np.concatenate, (xs, ys, at_))
        yield rows(x, y, *(cols[c][i] for c in keys[:3]))
        # Regions: rows of this batch by run; the run that goes on from the batch before keeps its count.
        new = same < LEAST_DEPTH
        starts = np.flatnonzero(new[old:]) + old
        edges = np.unique(np.concatenate([[old], starts, [m]]))
        lengths = np.diff(edges)
        if old and not new[old]:
            lengths[0] += run
        run = int(lengths[-1])
        marked = np.flatnonzero(lengths > GROUP)
        if first:
            marked = np.union1d(marked, [0])
            first = False
        at = edges[:-1][marked]
        yield rows([None] * len(at), [None] * len(at), *(cols[c][at] for c in keys[:3]))
        last = [int(cols[c][-1]) for c in keys[:3]]
        kept = {c: cols[c][-(GROUP - 1) :] for c in names}
    if last is not None:
        yield rows([None], [None], *([v] for v in last))


def shingle_sets(texts: DataFrame, wanted: DataFrame, *, bits: int = 25) -> DataFrame:
    """doc_id, shingles of the wanted documents, without moving any text.

    A bitmap of hashed ids, 4 MB whatever the input, tells workers which texts can be
    skipped; the exact semi-join follows on the sets that remain.
    """
    spot = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)) + 1).cast("long")
    parts = wanted.groupBy(F.bitmap_bucket_number(spot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).collect()
    bitmap = np.zeros((1 << bits) // 8 + 4096, np.uint8)
    for r in parts:
        at = (r["k"] - 1) * 4096
        bitmap[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column("spot").to_numpy() - 1
            b = b.filter(pa.array((sent.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_buffer().to_pybytes()).tobytes() for t in b.column(1)], pa.binary())], ["doc_id", "shingles"])

    made = texts.where("doc_id is not null").withColumn("spot", spot).mapInArrow(work, "doc_id long, shingles binary")
    return made.where(F.octet_length("shingles") > 0).join(wanted, "doc_id", "left_semi").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are alike enough: 100 * intersection >= 75 * union."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for p, q in zip(b.column("left"), b.column("right")):
                u, v = (np.frombuffer(s.as_buffer(), np.uint64) for s in (p, q))
                if len(u) > len(v):
                    u, v = v, u
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                both = int((v[at] == u).sum())
                keep.append(100 * both >= 75 * (len(u) + len(v) - both))
            yield b.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("left")), sets.select(F.col("doc_id").alias("y"), F.col("shingles").alias("right"))
    return pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "left", "right").mapInArrow(work, "x long, y long")


def dense_links(table: pa.Table) -> pa.Table:
    """All links among the documents of one pair of blocks, cut down to a spanning forest.

    Intersections are products of 0/1 matrices over the shingles that two of the
    documents share; nothing but the links leaves the task.
    """
    ids = table.column("rep").to_numpy()
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles")]
    m = len(ids)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    shingle, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    by = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[by], owner[by]
    new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    both = np.zeros((m, m), np.float32)
    width = 2048
    for lo in range(0, int(shared.sum()), width):
        part = slice(*np.searchsorted(column, [lo, lo + width]))
        block = np.zeros((m, width), np.float32)
        block[owner[part], column[part] - lo] = 1
        both += block @ block.T
    both = both.astype(np.float64)
    u, v = np.nonzero(np.triu(100 * both >= 75 * (sizes[:, None] + sizes[None, :] - both), 1))
    parent = list(range(m))

    def root(n: int) -> int:
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    links = []
    for a, b in zip(u.tolist(), v.tolist()):
        p, q = root(a), root(b)
        if p != q:
            parent[q] = p
            links.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
    return pa.table({c: pa.array([x[i] for x in links], pa.int64()) for i, c in enumerate(("x", "y"))})


def root_of(roots: DataFrame, df: DataFrame, node: str, out: str) -> DataFrame:
    r = roots.select(F.col("y").alias(node), F.col("x").alias(out))
    return df.join(r, node, "left").withColumn(out, F.coalesce(out, node))


def finished(spark, members: DataFrame, roots: DataFrame, sets: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Links inside crowded regions that span components, and the members compared: where one region leads to the next, all meet in blocks."""
    region = ["tree", "p1", "p2"]
    rooted = root_of(roots, members, "rep", "root")
    mixed = rooted.groupBy(region).agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min("rep").alias("x")).where("least <> most").select(*region, "x")
    mixed = save(mixed, "mixed")
    edges = save(members.join(mixed, region).select("x", F.col("rep").alias("y")).distinct(), "mixed")
    clusters = components(edges.where("x <> y"))
    grouped = save(edges.select(F.col("y").alias("rep")).distinct().join(clusters.select(F.col("y").alias("rep"), "x"), "rep", "left").select(F.coalesce("x", "rep").alias("cluster"), "rep"), "clusters")
    counted = grouped.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sized = grouped.join(counted, "cluster").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = sized.join(sets.withColumnRenamed("doc_id", "rep"), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "rep", "shingles")
    last = save(met.groupBy("cluster", "i", "j").applyInArrow(dense_links, "x long, y long"), "links")
    delete(spark, mixed, edges)
    return last, grouped


def near_duplicates(docs: DataFrame, *, block: int = 400, exact: bool = True, facts: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept.

    exact: finish crowded regions that span components by comparing all their members.
    facts receives the numbers of classes, candidate pairs and members of regions that blocks compared.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    signed = save(shingle_rows(docs, id_col=id_col, text_col=text_col), "minhash", "lz4")
    one = [F.first(c).alias(c) for c in ("n", "parts", "s1", "s2")]
    classes = save(signed.where("n > 0 and doc_id is not null").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), *one), "classes", "lz4")
    signed_ = signed.select("doc_id", "n", "a", "b")
    forest = orders(classes)
    region = ["tree", "p1", "p2"]
    place = [*region, "r1", "r2", "rep"]
    ordered = forest.select(*place, "n", "s1", "s2").repartitionByRange(4 * partitions(spark), *place).sortWithinPartitions(*place)
    found = save(ordered.mapInArrow(neighbours, "x long, y long, tree int, p1 long, p2 int"), "neighbours")
    crowded = save(found.where("x is null").select(*region).distinct(), "regions")
    told = found.where("x is not null").join(crowded.withColumn("crowd", F.lit(True)), region, "left")
    pairs = save(told.groupBy("x", "y").agg(F.count("*").alias("votes"), F.bool_or(F.col("crowd").isNull()).alias("small")), "pairs")
    members = save(forest.join(crowded, region).select(*region, "rep"), "members")
    # Tables that joins meet are written first, so that a join of exchanges can split a crowded region.
    several = save(members.groupBy(*region).agg(F.count("*").alias("c")).where("c > 1").select(*region), "several")
    wanted = pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y"))
    if exact:
        wanted = wanted.union(members.join(several, region).select("rep"))
    sets = save(shingle_sets(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), save(wanted.distinct(), "wanted")), "sets", "lz4")

    # The likeliest partner of each class; then pairs that are in different components still. Ones that a single
    # tree found in a crowded region are left to the exact finish, if there is one.
    likeliest = pairs.groupBy("y").agg(F.max_by("x", F.struct("votes", -F.col("x"))).alias("x"))
    links = save(confirmed(likeliest, sets), "links")
    roots = components(links)

    open_ = pairs.where("small or votes > 1") if exact else pairs
    apart = root_of(roots, root_of(roots, open_.select("x", "y"), "x", "rx"), "y", "ry").where("rx <> ry")
    more = save(confirmed(apart, sets), "links")
    links = links.unionByName(more)
    roots = components(links)

    if exact:
        more, compared = finished(spark, members, roots, sets, block)
        if more.take(1):
            roots = components(links.unionByName(more))
    if facts is not None:
        facts |= {"classes": classes.count(), "pairs": pairs.count(), "compared": compared.count() if exact else 0}
    delete(spark, found, crowded, pairs, members, several, sets)

    to_class = classes.select("a", "b", "rep")
    out = signed_.join(to_class, ["a", "b"], "left").join(roots.select(F.col("y").alias("rep"), "x"), "rep", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.when(F.col("n") > 0, F.coalesce("x", "rep")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.cast("long").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i)),
  n AS (SELECT doc_id, count(s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
  c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
  l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c.n >= 75 * (nx.n + ny.n - c.n)),
  r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id, n.doc_id = min(r.y) AS kept FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
"""
