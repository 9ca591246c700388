"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def widened(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a scan has fewer splits than there are cores: a small table in one row group is read by one
    task, and text functions over it would then run there too. A table with enough splits is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def kept(df: DataFrame) -> DataFrame:
    """A result that is read more than once: checkpoint() where the session names a shared folder for it, else persist()."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            return df.persist()
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Mark a kept join side for broadcasting if it has at most `most` rows; beyond that Spark exchanges both sides."""
    return F.broadcast(df) if df.count() <= most else df
