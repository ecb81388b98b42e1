"""Look-ups as joins: positional, as-of, containment, range, schema diff, graph edges, includes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import saved


def positional(left: DataFrame, right: DataFrame, on: str = "row_id") -> DataFrame:
    """Rows of two tables at the same place; what the right lacks is null."""
    return left.join(right, on, "left")


def annotated(facts: DataFrame, notes: DataFrame, *key: str) -> DataFrame:
    """Facts with their notes (comments, value tables); notes without a fact are dropped."""
    return facts.join(notes, list(key), "left")


def unresolved(refs: DataFrame, types: DataFrame) -> DataFrame:
    """References (column ref) that name no declared type (full_name), neither fully nor by the short name at its end."""
    short = types.select(F.element_at(F.split("full_name", r"\."), -1).alias("ref")).distinct()
    full = types.select(F.col("full_name").alias("ref")).distinct()
    return refs.join(full, "ref", "left_anti").join(short, "ref", "left_anti")


def used_by(types: DataFrame, refs: DataFrame) -> DataFrame:
    """full_name and the places that refer to it by full or short name."""
    names = types.select("full_name", F.explode(F.array_distinct(F.array("full_name", F.element_at(F.split("full_name", r"\."), -1)))).alias("ref"))
    return names.join(refs, "ref")


def edges(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Graph edges: each input of a node to the last node that puts it out, else to a graph input or initializer.

    nodes: node_id, inputs array<string>, outputs array<string>; sources: name, kind.
    """
    wants = nodes.select(F.col("node_id").alias("to_node"), F.posexplode("inputs").alias("slot", "name")).where("name <> ''")
    makes = nodes.select(F.col("node_id").alias("n"), F.explode("outputs").alias("name")).where("name <> ''").groupBy("name").agg(F.max("n").alias("from_node"))
    out = wants.join(makes, "name", "left").join(sources.groupBy("name").agg(F.min("kind").alias("source")), "name", "left")
    return out.select("name", "from_node", F.when(F.col("from_node").isNull(), F.col("source")).alias("source"), "to_node", "slot")


def graph_inputs(inputs: DataFrame, initializers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Inputs that no initializer shadows, and whether a node uses them."""
    used = nodes.select(F.explode("inputs").alias("name")).distinct().withColumn("used", F.lit(True))
    return inputs.join(initializers.select("name").distinct(), "name", "left_anti").join(used, "name", "left").withColumn("used", F.coalesce("used", F.lit(False)))


def as_of(uses: DataFrame, definitions: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Each use with the latest definition strictly before it, or else the last of all. One sort of the union, no pair-wise join.

    uses: key, at; definitions: key, at, value. Skewed keys only sort longer: rows aren't multiplied.
    """
    both = uses.select("*", F.lit(1).alias("_use"), F.lit(None).cast(definitions.schema[value].dataType).alias("_v")).unionByName(
        definitions.select(*key, at, F.lit(0).alias("_use"), F.col(value).alias("_v")), allowMissingColumns=True
    )
    # A definition at the same place is not before the use: uses sort first there.
    before = Window.partitionBy(*key).orderBy(F.col(at), F.col("_use").desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = definitions.groupBy(*key).agg(F.max_by(value, at).alias("_last"))
    found = both.withColumn(value, F.last(F.when(F.col("_use") == 0, F.col("_v")), ignorenulls=True).over(before)).where("_use = 1").drop("_use", "_v")
    return found.join(last, key, "left").withColumn(value, F.coalesce(value, "_last")).drop("_last")


def owners(holes: DataFrame, rings: DataFrame) -> DataFrame:
    """Each hole with the smallest ring of its feature that holds its first point, or null.

    Feature-wise equi-join; holes and rings: feature, ring_id, xs, ys.
    """
    from ..functions import values as V

    outer = rings.select("feature", F.col("ring_id").alias("owner"), F.col("xs").alias("oxs"), F.col("ys").alias("oys"), F.abs(V.signed_ring_area(F.col("xs"), F.col("ys"))).alias("area"))
    inside = V.point_in_ring(F.get("xs", F.lit(0)), F.get("ys", F.lit(0)), F.col("oxs"), F.col("oys"))
    best = holes.join(outer, "feature").where(inside).groupBy("feature", "ring_id").agg(F.min_by("owner", F.struct("area", "owner")).alias("owner"))
    return holes.join(best, ["feature", "ring_id"], "left")


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, *, bucket: float) -> DataFrame:
    """Points with each range (lo, hi inclusive) that holds them, by equi-join on buckets of the given width or that doubled as often as the range needs.

    A range has one level, the first at which a bucket is no narrower, and sits in the one or
    two buckets that it touches there; a point is in one bucket at each level in use. So no
    pair comes twice, and wide ranges cost no more rows than narrow ones.
    """
    width = F.col("hi") - F.col("lo")
    level = F.when(width > bucket, F.ceil(F.log2(width / bucket))).otherwise(0).cast("int")
    place = lambda c: F.floor(F.col(c) / (bucket * F.pow(F.lit(2.0), F.col("_l"))))
    placed = ranges.where(F.col("lo") <= F.col("hi")).withColumn("_l", level)
    levels = sorted(r[0] for r in placed.select("_l").distinct().collect())
    if not levels:
        levels = [0]
    spread = placed.withColumn("_b", F.explode(F.sequence(place("lo"), place("hi"))))
    probes = points.withColumn("_l", F.explode(F.array(*map(F.lit, levels)))).withColumn("_b", place(at))
    return probes.join(spread, ["_l", "_b"]).where((F.col(at) >= F.col("lo")) & (F.col(at) <= F.col("hi"))).drop("_l", "_b")


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Breaking changes between schemas: message, number, change. Both: message, number, name, type."""
    n = new.select("message", "number", F.col("name").alias("new_name"), F.col("type").alias("new_type"), F.lit(True).alias("there"))
    kept = new.select("message").distinct().withColumn("kept", F.lit(True))
    met = old.join(kept, "message", "left").join(n, ["message", "number"], "left")
    change = (
        F.when(F.col("kept").isNull(), "message removed").when(F.col("there").isNull(), "field removed")
        .when((F.col("name") != F.col("new_name")) & (F.col("type") != F.col("new_type")), "name and type changed")
        .when(F.col("name") != F.col("new_name"), "name changed").when(F.col("type") != F.col("new_type"), "type changed")
    )
    out = met.select("message", F.when(F.col("kept").isNotNull(), F.col("number")).alias("number"), change.alias("change"))
    return out.where(F.col("change").isNotNull()).distinct()


def numbered_paths(nodes: DataFrame) -> DataFrame:
    """Nodes with a path that is unique in its document: later ones of equal paths get #2, #3."""
    n = F.row_number().over(Window.partitionBy("doc_id", "path").orderBy("node_id"))
    return nodes.withColumn("unique_path", F.when(n > 1, F.concat("path", F.lit("#"), n.cast("string"))).otherwise(F.col("path")))


def dimension(facts: DataFrame, dims: DataFrame, on: str, *, most: int = 10_000) -> DataFrame:
    """Join with a table of fixed facts (type widths, block layouts); broadcast only if it is as small as that promises."""
    small = dims.limit(most + 1).count() <= most
    return facts.join(F.broadcast(dims) if small else dims, on, "left")


def includes(root: str, refs: DataFrame, sizes: DataFrame, *, depth: int = 8, files: int = 64, most_bytes: int = 8 << 20) -> DataFrame:
    """Files reached from a root by include lines: path, depth, chain; cycles cut. refs: path, target; sizes: path, bytes."""
    reached = level = refs.sparkSession.createDataFrame([(root, 0, [root])], "path string, depth int, chain array<string>")
    for d in range(1, depth + 1):
        step = level.join(refs, "path").where(~F.array_contains("chain", F.col("target")))
        level = step.select(F.col("target").alias("path"), F.lit(d).alias("depth"), F.concat("chain", F.array("target")).alias("chain"))
        reached = reached.unionByName(level)
    first = reached.groupBy("path").agg(F.min_by(F.struct("depth", "chain"), F.struct("depth", F.array_join("chain", "/"))).alias("x")).select("path", "x.depth", "x.chain")
    first = first.join(sizes, "path", "left").orderBy("depth", F.array_join("chain", "/")).limit(files)  # a bound of the feature
    total = F.sum(F.coalesce("bytes", F.lit(0))).over(Window.orderBy("depth", F.array_join("chain", "/")))
    return first.withColumn("_t", total).where(F.col("_t") <= most_bytes).drop("_t")


def topological_depth(nodes: DataFrame) -> DataFrame:
    """node_id, depth: one more than the deepest producer, by rounds of one join until nothing moves.

    Only producers with a smaller node_id count, so there are no cycles; each round's depths are written, so plans stay small.
    """
    made = nodes.select(F.col("node_id").alias("p"), F.explode("outputs").alias("name"))
    links = saved(nodes.select("node_id", F.explode("inputs").alias("name")).join(made, "name").where("p < node_id").select("p", "node_id").distinct(), "links")
    depth, moved = nodes.select("node_id", F.lit(0).alias("depth")), True
    while moved:
        up = links.join(depth.withColumnRenamed("node_id", "p"), "p").groupBy("node_id").agg((F.max("depth") + 1).alias("d"))
        new = saved(depth.join(up, "node_id", "left").select("node_id", F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth"), (F.coalesce("d", F.lit(0)) > F.col("depth")).alias("moved")), "depth")
        moved = bool(new.where("moved").take(1))
        depth = new.drop("moved")
    return depth


def path_closure(hits: DataFrame, lineage: str = "lineage") -> DataFrame:
    """Ids of hits and all their ancestors."""
    return hits.select("doc_id", F.explode(lineage).alias("node_id")).distinct()


def resolve(column: Column, mapping: dict[str, str]) -> Column:
    """Relationship ids to targets."""
    return F.try_element_at(F.create_map(*[x for kv in mapping.items() for x in map(F.lit, kv)]), column) if mapping else F.lit(None).cast("string")
