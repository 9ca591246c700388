"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hushlens.sources.tables import read_table, widened

#: Where the public tokenizers' vocabulary files are; every operator takes the path as a parameter.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data directory."""
    return read_table(spark, sf_dir, name)


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are worked on in Python or by many patterns: over all cores even if it is one small file."""
    return widened(read_table(spark, sf_dir, name))


def small_side(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Mark a join side for broadcasting only after counting that it has at most max_rows rows; otherwise leave the choice to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder of spark.checkpoint.dir. Where the session names none, a local session gets a folder of
    its own; on a cluster, whose machines share no temporary folder, it is an error. Spark deletes the files of a checkpoint no
    longer referred to if spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have yet, so helper columns never clash with the caller's."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def spread(df: DataFrame, *keys) -> DataFrame:
    """Even out rows over all cores before a Python stage: input splits can be fewer than cores and of unequal cost.

    With keys the distribution is by their hash and thus repeatable after a lost executor.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def map_columns(df: DataFrame, make: Callable[[], Callable[..., Sequence[Sequence]]], ddl: str) -> DataFrame:
    """Arrow stage on plain lists: make() runs once per task and gives a function from the columns of a batch to those of the result.

    Lists keep nulls and large integers as they are, which pandas columns would not.
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            out = work(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return df.mapInArrow(run, ddl)


def transposed(rows: Sequence[Sequence], width: int) -> list[Sequence]:
    """Rows as columns."""
    return list(zip(*rows)) if rows else [[] for _ in range(width)]
