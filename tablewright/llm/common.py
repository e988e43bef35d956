"""Shared by the operators: table access, words, staging."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.functions.stage import shared_dir

#: White space and words of every operator here: only the six ASCII white space characters part words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the one that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "llm") -> DataFrame:
    """Cut lineage: write the table to the shared folder and read it again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "1m"):
    """What runs inside hands Arrow batches of about `size` to Python tasks, so texts are held few at a time on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def words(text: Column) -> Column:
    """The words of a text as an array; null, empty and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def once(column: Column) -> Column:
    """A column that is computed once a row: the optimizer may not copy it into the expressions that use it."""
    return F.explode(F.array(column))


def parts(batch: pa.RecordBatch, column: str, size: int):
    """Slices of an Arrow batch of about `size` bytes of one column, so that few rows are Python objects at a time."""
    total = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(total.tolist()):
        held += n
        if held >= size:
            yield batch.slice(lo, i + 1 - lo)
            lo, held = i + 1, 0
    if lo < batch.num_rows:
        yield batch.slice(lo)


def spread(df: DataFrame) -> DataFrame:
    """At least two tasks a core for work that is heavy per row; inputs with more partitions stay as they are."""
    n = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n // 2 else df



#: Ids that may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def row_key() -> Column:
    """16 bytes that tell rows apart by doc_id and text: ids may be null or repeated. Null and empty texts are one."""
    who = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    size = F.when(F.col("doc_id").isNull(), "-").otherwise(F.length(who).cast("string"))
    return F.unhex(F.substring(F.sha2(F.concat(size, F.lit(":"), who, F.coalesce("text", F.lit(""))), 256), 1, 32))


def text_key() -> Column:
    """16 bytes that tell texts apart. Null and empty texts are one."""
    return F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The documents whose `column` is not in the one column of `ids`; a null is a value like others."""
    ids = staged(ids.toDF("_out").distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col(column).eqNullSafe(F.col("_out")), "left_anti")
