"""What the operators share: tables written in the shared folder, and small column helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import new_path

#: What a word is, wherever the operators count or compare words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, as characters.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of input that one task of a whole-table stage reads at most.
TASK_BYTES = 32 << 20


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the files that the plan scans, from the sizes that the planner knows; what isn't a file has none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def few_files(df: DataFrame) -> DataFrame:
    """No more output files than keep all cores busy a few times over, or than tasks of bounded input need; more partitions are worked off one after another."""
    tasks = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-scanned_bytes(df) // TASK_BYTES))
    return df.coalesce(min(tasks, 1 << 30))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have: this one, with underscores added while it is taken."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def save(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again."""
    path = new_path(df.sparkSession, label)
    few_files(df).write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_by(df: DataFrame, label: str, key: str, parts: int) -> DataFrame:
    """Like save(), bucketed by a key: later joins on the key leave these rows where they are."""
    name = f"tablescry_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(parts, key).option("path", new_path(df.sparkSession, label)).option("compression", "lz4").saveAsTable(name)
    out = df.sparkSession.table(name)
    out._catalog_name = name
    return out


def delete(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables made by save() or save_by() that nothing reads any more."""
    for table in tables:
        for name in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if name := getattr(table, "_catalog_name", None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Let Arrow batches hold no more bytes than this: a worker's memory follows the batch, and texts may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > size:
        spark.conf.set(name, f"{size}b")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str) -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once a row however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(value: Column) -> Column:
    """A-Z in lower case and nothing else changed; all-ASCII strings take the fast built-in."""
    return F.when(F.octet_length(value) == F.char_length(value), F.lower(value)).otherwise(F.translate(value, UPPER, LOWER))


def hash128(value: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes; together they take the place of the value."""
    return F.xxhash64(value), F.xxhash64(F.lit(7919), value)
