"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of documents. run() writes each stage's result to the shared
folder and reads it again, so that the next one, which reads it more than once, computes
nothing twice and a lost executor costs no more than a stage.

Defined results, in every stage: rows are matched to verdicts by doc_id, so rows that share one
share the verdict; a null doc_id is a value like others; a null or empty text is a text
like others; texts are worked on whole, however long; ties go to the smaller id or are settled by
hashes, so reruns agree; repeated rows are documents of their own; extra columns, whatever
their names, come through all but the last stage; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescry.llm import line_dedup, mixing, near_dedup, packing, quality, queries
from tablescry.llm.common import delete, few_files, fresh, save


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ids."""
    key = fresh(docs, "wanted")
    wanted = ids.select(F.col("doc_id").alias(key)).distinct()
    return few_files(docs.join(wanted, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model accepts; null and empty texts are accepted. Without labels nothing is rejected."""
    verdicts = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _only(docs, verdicts.where("kept"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that other documents repeat; n_chars follows. A null text stays null."""
    text = F.when(F.col("text").isNotNull(), F.col(fresh(docs, "kept_text")))
    kept = line_dedup.keep_lines(docs).withColumns({"text": text, "n_chars": F.char_length(text).cast("long")})
    return few_files(kept.select(*[F.col(f"`{c}`") for c in docs.columns]))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Texts without words, and rows without an id, are no one's duplicates."""
    return _only(docs, near_dedup.near_duplicates(docs).where("kept"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum's documents, once for each use, in training order. Texts without words have nothing to train on and are not used."""
    return few_files(mixing.mixed_texts(docs, mixing.curriculum))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens; other columns end here."""
    return few_files(packing.packed_documents(docs, queries.tokenizer()))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Hashes order the mix, and the language model, components and packing aren't for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        done = save(stage(spark, docs, sf_dir), "stage")
        if i:
            delete(spark, docs)
        docs = done
    return docs
