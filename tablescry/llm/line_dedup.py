"""Corpus-wide line deduplication with DataFrame functions only.

Lines are exploded with their position, normalised and hashed (128 bits); distinct
documents are counted for each hash with map-side pre-aggregation, so a line that
a third of all documents hold costs no more than any other; positions of lines to
drop go back to their documents, whose remaining lines are joined in order.

Defined results: a null or empty text is one empty line; lines split at \\n only; a
null doc_id counts as a document that is smaller than all others; repeated rows of one
doc_id are one document for counting and keep separate texts; an empty table gives
an empty result; other columns of the input are ignored or, in keep_lines, kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, fresh, hash128, let, save, text_of


def repeated_lines(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (hash of the text), drop: positions of lines that lose to a larger doc_id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    lines = rows.select("doc_id", F.xxhash64("text").alias("print"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("line", F.btrim("line", F.lit(SPACES))).where(F.char_length("line") >= min_chars).withColumn("line", ascii_lower(F.col("line")))
    a, b = hash128(F.col("line"))
    keyed = save(keyed.select("doc_id", "print", "pos", a.alias("a"), b.alias("b")), "lines", "lz4")
    common = (
        keyed.groupBy("a", "b")
        .agg(F.countDistinct("doc_id").alias("docs"), F.max(F.col("doc_id").isNull()).alias("no_id"), F.max("doc_id").alias("last"))
        .where(F.col("docs") + F.col("no_id").cast("int") >= min_docs)
    )
    # Written first: a join of two exchanges, not one of an aggregate in place, can split a line that very many documents hold.
    common = save(common.select("a", "b", "last"), "common-lines")
    losing = keyed.join(common, ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return losing.groupBy("doc_id", "print").agg(F.collect_set("pos").alias("drop"))


def keep_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns kept, with n_lines, n_dropped and kept_text added; where a name is taken, the one that fresh() gives."""
    here, text, other_id, other_print, gone, *out = (fresh(docs, c) for c in ("here", "whole_text", "other_id", "other_print", "gone", "n_lines", "n_dropped", "kept_text"))
    drops = repeated_lines(docs, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias(other_id), F.col("print").alias(other_print), F.col("drop").alias(gone))
    rows = docs.withColumn(text, text_of(text_col)).withColumn(here, F.xxhash64(text))
    joined = rows.join(drops, F.col(id_col).eqNullSafe(F.col(other_id)) & (F.col(here) == F.col(other_print)), "left")
    rest = let(F.split(text, "\n", -1), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda i: F.get(x, i)))
    added = (
        F.size(F.split(text, "\n", -1)).cast("long"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"),
        F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(rest, "\n")),
    )
    return joined.withColumns(dict(zip(out, added))).drop(other_id, other_print, gone, text, here)


def deduplicated_lines(docs: DataFrame) -> DataFrame:
    """The digest for the query."""
    kept = keep_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


LINES_SQL = """
WITH lines AS (
  SELECT doc_id, i AS pos, l[i] AS line, lower_az(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)
), common AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM (SELECT lines.*, last IS NOT NULL AND last <> doc_id AS lost FROM lines LEFT JOIN common USING (key))
GROUP BY doc_id
""".replace("lower_az(", "translate(").replace("chr(13)))", f"chr(13)), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')")
