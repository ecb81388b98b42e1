"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is cut into units: words, long ones in pieces, and single ideographs. Of
each run of K units, the hashes of its inner runs of S units are compared; the run is
an anchor when the least of them lies at either edge. Whether a run is an anchor
depends on nothing outside it, so a passage keeps its anchors wherever it stands, and
at least one of any K - S + 1 runs in a row is an anchor. A fingerprint is the
anchors' hashes in order, with their positions beside them for positional matching.

Defined results: a null text is empty and has an empty fingerprint; a text without an
anchor (fewer than eight units) has its whole as the only one; two empty
fingerprints are alike (1); rows in descending id have null ids last, ties by text
hash; if all ids are null, the last row has no next; repeated rows are each other's
next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, partitions, text_of

K, S = 5, 2
UNIT = r"\p{IsIdeographic}|[^\s\p{IsIdeographic}]{1,24}"
ANCHOR = "array<struct<pos:int,hash:int>>"


def short_hash(*parts: Column) -> Column:
    """31 bits, so that it fits an int."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 33).cast("int")


def anchors(text: Column) -> Column:
    """array<struct<pos, hash>>: the closed syncmers of the text in order; pos counts units."""

    def inner(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(S)]))

    def chosen(h: Column, s: Column) -> Column:
        last = K - S

        def at_edge(i: Column) -> Column:
            least = F.least(*[F.get(s, i + j) for j in range(last + 1)])
            return (least == F.get(s, i)) | (least == F.get(s, i + last))

        starts = F.filter(F.sequence(F.lit(0), F.size(h) - K), at_edge)
        return F.transform(starts, lambda i: F.struct(i.alias("pos"), short_hash(F.get(s, i), F.get(h, i + S), F.get(s, i + last)).alias("hash")))

    def whole(h: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("pos"), short_hash(h).alias("hash")))

    def body(h: Column) -> Column:
        long_enough = let(let(inner(h), lambda s: chosen(h, s)), lambda a: F.when(F.size(a) > 0, a).otherwise(whole(h)))
        return F.when(F.size(h) >= K, long_enough).when(F.size(h) > 0, whole(h)).otherwise(F.array().cast(ANCHOR))

    return let(F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u)), body)


def hashes(found: Column) -> Column:
    return F.transform(found, lambda a: a["hash"])


def as_text(found: Column) -> Column:
    """The fingerprint as a string: hashes in hexadecimal, in order."""
    return F.array_join(F.transform(found, lambda h: F.lower(F.hex(h))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct anchors against the mean number of both: 0 to 1."""
    sizes = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(sizes > 0, 2.0 * F.size(F.array_intersect(a, b)) / sizes).otherwise(1.0)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, anchors, fingerprint."""
    rows = docs.select(F.col(id_col).alias("doc_id"), anchors(text_of(text_col)).alias("anchors"))
    return rows.withColumn("fingerprint", as_text(hashes(F.col("anchors"))))


def shifts(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """Positional matching: for each pair (a, b) of ids, the shifts between shared anchors with the anchors that vote for each."""
    one = pairs.join(prints.select(F.col("doc_id").alias("a"), F.inline("anchors")), "a").select("a", "b", "hash", F.col("pos").alias("pos_a"))
    two = pairs.join(prints.select(F.col("doc_id").alias("b"), F.inline("anchors")), "b").select("a", "b", "hash", F.col("pos").alias("pos_b"))
    return one.join(two, ["a", "b", "hash"]).groupBy("a", "b", (F.col("pos_b") - F.col("pos_a")).alias("shift")).agg(F.count("*").alias("votes"))


def with_next(rows: DataFrame, *payload: str) -> DataFrame:
    """Each row with next_<column> of the following row in descending doc_id, the first after the last.

    The order is cut at quantiles of the ids, which are ids themselves: the head of a
    cut. Heads also go, as guests, to the end of the cut before, so each cut is
    sorted alone and no row but the heads is sent twice.
    """
    spark = rows.sparkSession
    cuts = max(2, min(4 * partitions(spark), 100_000))
    asked = [i / cuts for i in range(1, cuts + 1)]
    heads = rows.agg(F.percentile_approx("doc_id", asked, max(10_000, 20 * cuts)).alias("h"), F.max("doc_id").alias("m")).first()
    bounds = sorted({*(heads["h"] or []), heads["m"]} - {None})
    if bounds:
        table, steps = F.array(*map(F.lit, bounds)), len(bounds).bit_length()

        def halve(a: Column, _: Column) -> Column:
            middle = F.shiftright(a["lo"] + a["hi"], 1)
            low = F.get(table, middle) < F.col("doc_id")
            return F.struct(F.when(low, middle + 1).otherwise(a["lo"]).alias("lo"), F.when(low, a["hi"]).otherwise(middle).alias("hi"))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds) - 1).alias("hi")), halve, lambda a: a["lo"])
        cut = F.when(F.col("doc_id").isNull(), 0).otherwise(found)
        own = F.struct(F.col("_cut").alias("cut"), F.lit(0).alias("guest"))
        guest = F.struct(F.when(F.col("_cut") == len(bounds) - 1, 0).otherwise(F.col("_cut") + 1).alias("cut"), F.lit(1).alias("guest"))
        is_head = F.get(table, F.col("_cut")) == F.col("doc_id")
        placed = rows.withColumn("_cut", cut).withColumn("_at", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))))
    else:
        placed = rows.withColumn("_at", F.struct(F.lit(0).alias("cut"), F.lit(0).alias("guest")))
    order = Window.partitionBy("_at.cut").orderBy("_at.guest", F.col("doc_id").desc_nulls_last(), "_tie")
    following = placed.withColumns({f"next_{c}": F.lead(c).over(order) for c in payload})
    return following.where("_at.guest = 0").drop("_at", "_cut")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The digest for the query: each document's fingerprint against its edited text's and the next document's."""
    text = text_of("text")
    rows = docs.select("doc_id", text.alias("text")).withColumns({"own": hashes(anchors(F.col("text"))), "_tie": F.xxhash64("text")})
    chars = F.char_length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    out = with_next(rows, "text", "own").select("doc_id", chars.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited")).withColumn("edited_own", hashes(anchors(F.col("edited"))))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited_own")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"),
        F.coalesce(likeness(F.col("own"), F.col("next_own")), F.lit(0.0)).alias("near_next"),
    )
