"""Writing and reading the four reports: findings and summary as CSV, findings and audit records as JSON.

Reports are Spark output folders by default, written in parallel. `single` merges one into a file of a given name: CSV with a
header, minimal quoting and CRLF; JSON as one indented array. That passes through the driver row by row and is meant for
reports a person opens.
"""

from __future__ import annotations

import csv
import json
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlens.operators.report import FINDINGS, SUMMARY
from hushlens.plans.pipeline import Analysis

NAMES = {"findings_csv": "article9_findings.csv", "summary_csv": "article9_summary.csv", "findings_json": "article9_findings.json", "audit_json": "article9_audit_log.json"}
FINDINGS_SCHEMA = ", ".join(f"{c} {'int' if c in ('page_number', 'line_number') else 'double' if c.endswith('_score') else 'string'}" for c in FINDINGS)
SUMMARY_SCHEMA = ", ".join(f"{c} {'bigint' if c.endswith('_count') else 'double' if c == 'max_score' else 'string'}" for c in SUMMARY)


def frames(analysis: Analysis) -> dict[str, DataFrame]:
    """Each report's rows in their order."""
    findings = analysis.findings.orderBy("file_path", F.col("page_number").asc_nulls_first(), "chunk_id", "cat_ord", "ev_ord").select(*FINDINGS)
    summary = analysis.summary.orderBy("file_name", "file_path")
    audit = analysis.audit.orderBy("metadata.file_path", F.col("metadata.page_number").asc_nulls_first(), "metadata.chunk_id").select("text_id", "metadata", "decision_log", "categories")
    return {"findings_csv": findings, "summary_csv": summary, "findings_json": findings, "audit_json": audit}


def write_reports(analysis: Analysis, directory: str, single: bool = False) -> dict[str, str]:
    """Write all four, overwriting; label -> path. The evidence is detected once, not anew for every report and every sort."""
    out = {}
    for label, df in frames(replace(analysis, several=True)).items():
        path = f"{directory.rstrip('/')}/{NAMES[label]}"
        if single:
            _single(df, path, label.endswith("csv"))
        elif label.endswith("csv"):
            df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        else:
            df.write.mode("overwrite").json(path, ignoreNullFields=False)
        out[label] = path
    return out


def _single(df: DataFrame, path: str, as_csv: bool) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    if as_csv:
        with open(path, "w", encoding="utf-8", newline="") as out:
            writer = csv.writer(out)
            writer.writerow(df.columns)
            writer.writerows(tuple(r) for r in df.toLocalIterator())
        return
    with open(path, "w", encoding="utf-8") as out:
        first = True
        for line in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            body = json.dumps(json.loads(line.j), ensure_ascii=False, indent=2).replace("\n", "\n  ")
            out.write(("[\n  " if first else ",\n  ") + body)
            first = False
        out.write("[]" if first else "\n]")


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"')


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, FINDINGS_SCHEMA)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, SUMMARY_SCHEMA)


def read_audit(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Audit records from a folder of JSON lines or one array; no rows if there is nothing at the path."""
    audit_schema = schema or AUDIT_SCHEMA
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], audit_schema)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    return spark.read.schema(audit_schema).option("multiLine", not folder).json(path)


AUDIT_SCHEMA = (
    "text_id string, metadata struct<file_name:string,file_path:string,file_type:string,chunk_id:string,page_number:int>, decision_log array<string>, "
    "categories array<struct<cat_ord:int,category_key:string,category_label:string,score:double,decision:string,method_scores:map<string,double>,explanation:string,"
    "evidences:array<struct<method:string,score:double,trigger:string,matched_variant:string,sentence:string,context_hits:array<string>,field_hits:array<string>,explanation:string,"
    "metadata:struct<sentence_index:int,overlap:array<string>,similarity:double>>>>>"
)
