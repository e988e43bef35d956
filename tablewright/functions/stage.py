"""Cut lineage with a written table in the shared checkpoint folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names; a folder of our own only in local runs where none is set."""
    path = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder all executors share")
    path = tempfile.mkdtemp(prefix="tablewright-")
    spark.conf.set(SETTING, path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Write the table once and read it back: later passes prune columns and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give compute-heavy work at least one partition per core; large inputs have more and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
