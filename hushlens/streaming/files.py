"""The analysis over a stream of files.

Files that arrive in a directory are parsed and split as they come (a stateless plan in append mode). Scores need all evidence
of a chunk, and a file arrives whole, so each micro-batch is analysed on its own and its results are appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hushlens.config import Config
from hushlens.plans.pipeline import Analysis, sentences
from hushlens.sources.files import PATTERN, parse

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_chunks(spark: SparkSession, directory: str, max_files: int = 1_000) -> DataFrame:
    """Chunks of arriving files; a file that can't be read becomes a row with status error instead of ending the stream.
    Spark's reader passes over files of no bytes."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", PATTERN).option("maxFilesPerTrigger", max_files).load(directory)
    return parse(files, fail_fast=False)


def stream_sentences(chunks: DataFrame, config: Config) -> DataFrame:
    return sentences(chunks, config, ("file_path", "chunk_id"))


def stream_decisions(chunks: DataFrame, config: Config, output: str, checkpoint: str, **options) -> StreamingQuery:
    """Category results of every chunk appended to Parquet, one micro-batch at a time; a batch done again overwrites itself."""

    def analyse(batch: DataFrame, batch_id: int) -> None:
        results = Analysis(batch.where("status = 'ok'"), config).results
        results.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return chunks.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
