"""Command line: scan a directory, run example texts, report which optional libraries are there."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hushlens.config import load_config
from hushlens.operators.backends import resources
from hushlens.plans.pipeline import Analysis, as_chunks
from hushlens.sources.files import read_directory, read_examples
from hushlens.sources.reports import write_reports


def scan(spark: SparkSession, directory: str, config: str, output: str, single: bool) -> dict:
    chunks = read_directory(spark, directory)
    analysis = Analysis(chunks, load_config(config))
    return {"directory": directory, "chunks": chunks.count(), "outputs": write_reports(analysis, output, single)}


def examples(spark: SparkSession, path: str, config: str) -> list[dict]:
    """Per text, in order of its id, the text, the log and its categories that are not clear. An example file is read by a person."""
    given = read_examples(spark, path)
    analysis = Analysis(as_chunks(given, id_col="text_id"), load_config(config))
    shown = lambda c: F.struct(c["category_key"].alias("category_key"), c["category_label"].alias("label"), c["score"].alias("score"), c["decision"].alias("decision"), c["explanation"].alias("explanation"))
    flagged = F.transform(F.filter("categories", lambda c: c["decision"] != "clear"), shown).alias("categories")
    rows = analysis.audit.select(F.col("metadata.file_name").alias("text_id"), "decision_log", flagged)
    rows = given.join(rows, "text_id").select("text_id", "text", "decision_log", "categories").orderBy("text_id")
    return [json.loads(r) for r in rows.toJSON().toLocalIterator()]


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="hushlens")
    commands = parser.add_subparsers(dest="command", required=True)
    s = commands.add_parser("scan")
    s.add_argument("--input-dir", default="data/raw")
    s.add_argument("--config", default="configs/categories.yml")
    s.add_argument("--output-dir", default="data/processed")
    s.add_argument("--single-files", action="store_true")
    e = commands.add_parser("examples")
    e.add_argument("--examples", required=True)
    e.add_argument("--config", default="configs/categories.yml")
    r = commands.add_parser("resources")
    r.add_argument("--config", default="configs/categories.yml")
    args = parser.parse_args(argv)
    if args.command == "resources":
        found = resources(load_config(args.config))
        print(json.dumps(found, indent=2, ensure_ascii=False))
        return int(any(x["status"] == "failed" for x in found))
    spark = SparkSession.builder.appName("hushlens").getOrCreate()
    done = scan(spark, args.input_dir, args.config, args.output_dir, args.single_files) if args.command == "scan" else examples(spark, args.examples, args.config)
    print(json.dumps(done, indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
