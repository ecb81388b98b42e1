"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, given as knots
(time, weight) joined by straight lines. The integral of a schedule sets the
source's share of the words to train on and, scaled to its target, is the
source's cumulative demand. Documents of a source are laid one after another in a
pseudo-random but fixed order, pass after pass; inverting the cumulative demand at
the place where a document begins gives its training position.

Defined results: a null text has size 0; a null source is a source of its own, the
last; documents of size 0 are never taken; repeated rows and repeated ids are
documents of their own; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, fresh, partitions, save, text_of

Schedule = Sequence[tuple[float, float]]
SEGMENT = "array<struct<t0:double,dt:double,w0:double,w1:double,done:double>>"


def segments(schedule: Schedule) -> tuple[list[tuple[float, float, float, float, float]], float]:
    """Straight pieces (start, length, weight at either end, integral before it) and the whole integral."""
    knots = sorted((float(t), float(w)) for t, w in schedule)
    if len(knots) == 1:
        knots = [(0.0, knots[0][1]), (1.0, knots[0][1])]
    if any(w < 0 for _, w in knots):
        raise ValueError("weights must not be negative")
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 > t0:
            out.append((t0, t1 - t0, w0, w1, done))
            done += (w0 + w1) / 2 * (t1 - t0)
    return out, done


def capped_targets(sizes: dict, weights: dict, total: float, cap: float) -> dict:
    """Share total by weight; what a source would get above cap times its size goes to the others by weight."""
    targets, open_, left = {}, [s for s in sizes if weights[s] > 0], float(total)
    targets = dict.fromkeys(sizes, 0.0)
    while open_:
        whole = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / whole >= cap * sizes[s]]
        if not full:
            targets |= {s: left * weights[s] / whole for s in open_}
            break
        for s in full:
            targets[s] = float(cap * sizes[s])
        left -= sum(targets[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return targets


def plan_mix(docs: DataFrame, schedule_of: Callable[[int, str | None], Schedule], *, share: float = 1.0, cap: float = 3.0, seed: int = 17, most_sources: int = 100_000, identity: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, takes, turn.

    schedule_of(n, source) gives the schedule of the n-th source by code point, null
    last. takes lists each pass that uses the document: pass number, words used and
    training position; turn, the hash of id and text or of the given identity, orders the
    source. Only the table of sources, one row each, visits the driver: the mixing recipe
    is the user's and names every source. More than most_sources raise an error, since a recipe
    for them (one source a host, say) has to group them first.
    """
    spark = docs.sparkSession
    identity = F.struct(F.col(id_col).cast("string"), text_of(text_col)) if identity is None else identity
    rows = save(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), identity).alias("turn"),
        ),
        "mix-sizes",
    )
    found = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).limit(most_sources + 1).collect()}
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources: group them, or raise most_sources")
    names = sorted((s for s in found if s is not None)) + [None] * (None in found)
    pieces = {s: segments(schedule_of(n, s)) for n, s in enumerate(names)}
    targets = capped_targets(found, {s: pieces[s][1] for s in names}, share * sum(found.values()), cap)
    sources = spark.createDataFrame(
        [(s is None, s or "", found[s], targets[s], pieces[s][1], pieces[s][0]) for s in names],
        f"no_source boolean, name string, source_size long, target double, whole double, pieces {SEGMENT}",
    )
    if len(names) <= 10_000:
        sources = F.broadcast(sources)

    # Prefix sums in two levels: over slices of the fixed order, then inside a slice. A hot source has many slices.
    bits = max(6, (4 * partitions(spark)).bit_length())
    key = ["no_source", "name", "slice"]
    rows = rows.select(
        "doc_id", "size", "turn", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"),
        F.shiftrightunsigned("turn", 64 - bits).alias("slice"),
    )
    in_source = Window.partitionBy("no_source", "name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(key).agg(F.sum("size").alias("words")).select(*key, F.coalesce(F.sum("words").over(in_source), F.lit(0)).alias("start"))
    in_slice = Window.partitionBy(key).orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("before", F.coalesce(F.sum("size").over(in_slice), F.lit(0)))
        .join(starts, key)
        .join(sources, ["no_source", "name"])
        .withColumn("before", F.col("before") + F.col("start"))
    )
    goal = F.round("target").cast("long")
    passes = F.ceil(goal / F.when(F.col("source_size") > 0, F.col("source_size"))).cast("int")

    def take(n):
        at = n * F.col("source_size") + F.col("before")
        reached = F.least(F.coalesce(F.try_divide(at, "target"), F.lit(0.0)), F.lit(1.0)) * F.col("whole")
        piece = F.element_at(F.filter("pieces", lambda p: (p["done"] <= reached) & ((p["w0"] + p["w1"]) > 0)), -1)
        rest = reached - piece["done"]
        slope = (piece["w1"] - piece["w0"]) / piece["dt"]
        root = piece["w0"] + F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * slope * rest, F.lit(0.0)))
        into = F.when(rest <= 0, F.lit(0.0)).otherwise(F.least(F.try_divide(2 * rest, root), piece["dt"]))
        return F.struct(n.alias("pass"), F.least(F.col("size"), goal - at).alias("words"), (piece["t0"] + into).alias("position"))

    takes = F.filter(F.transform(F.sequence(F.lit(0), F.coalesce(passes, F.lit(0))), take), lambda x: x["words"] > 0)
    return placed.withColumn("takes", F.when(F.col("target") > 0, takes).otherwise(F.filter(F.array(take(F.lit(0))), lambda x: F.lit(False)))).select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("name")).alias("source"),
        "size",
        "source_size",
        "target",
        F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"),
        "takes",
        "turn",
    )


def identity_of(df: DataFrame) -> Column:
    """The whole row as a value to hash: nulls count, and maps, which have no hash, as their JSON."""
    plain = lambda c: F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in df.schema[c].dataType.simpleString() else F.col(f"`{c}`")
    return F.struct(*[x for c in df.columns for x in (F.col(f"`{c}`").isNull(), plain(c))])


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of that many words, white space as it stands."""
    length = lambda parts: F.aggregate(F.slice(parts, F.lit(1), words.cast("int")), F.lit(0), lambda a, x: a + F.char_length(x))
    return F.substring(text, F.lit(1), length(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))) + length(F.split(text, WORD, -1)))


def occurrences(plan: DataFrame) -> DataFrame:
    """One row for each use of a document, range-sorted by training position."""
    return plan.select("*", F.inline("takes")).drop("takes").orderBy("position", "doc_id", "pass")


def mixed_texts(docs: DataFrame, schedule_of: Callable[[int, str | None], Schedule], *, seed: int = 17, **options) -> DataFrame:
    """The documents themselves, once for each use, in training order; a use that ends inside a document keeps its first words.

    Takes columns doc_id, text, source and any others, and returns the same ones. Rows are
    told apart by all their columns; rows that agree in every one are one document that
    occurs as often. n_chars, if there, follows the text.
    """
    identity = identity_of(docs)
    plan = plan_mix(docs, schedule_of, seed=seed, identity=identity, **options)
    name, turn, rank, taken = (fresh(docs, c) for c in ("use_name", "use_turn", "use_rank", "use_taken"))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(name)
    uses = plan.where(F.size("takes") > 0).select(named("doc_id"), F.col("turn").alias(turn), "size", F.inline("takes"))
    uses = uses.select(name, turn, F.struct("pass", "words", "position", "size").alias(taken))
    rows = docs.select("*", named("doc_id"), F.xxhash64(F.lit(seed), identity).alias(turn))
    # Equal rows: one stands for all, since each has uses of its own in the plan. The join finds the rows where this left them.
    one = rows.withColumn(rank, F.row_number().over(Window.partitionBy(name, turn).orderBy(turn))).where(F.col(rank) == 1)
    used = one.join(uses, [name, turn]).orderBy(f"{taken}.position", name, turn, f"{taken}.pass")
    cut = F.when(F.col(taken)["words"] < F.col(taken)["size"], first_words(F.col("text"), F.col(taken)["words"])).otherwise(F.col("text"))
    changed = {"text": cut} | ({"n_chars": F.char_length(cut).cast("long")} if "n_chars" in docs.columns else {})
    return used.withColumns(changed).select(*[F.col(f"`{c}`") for c in docs.columns])


def curriculum(n: int, source: str | None) -> Schedule:
    """Mean weights 1, 2, 3 in turn: the first kind fades, the second stays level, the third grows."""
    return [[(0.0, 1.5), (1.0, 0.5)], [(0.0, 2.0), (1.0, 2.0)], [(0.0, 1.5), (0.5, 3.0), (1.0, 4.5)]][n % 3]


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The digest for the query: words taken of each document, in order of first position."""
    plan = plan_mix(docs, curriculum)
    first = F.element_at(F.transform("takes", lambda x: x["position"]), 1)
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.when(F.size("takes") > 0, first).alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")
