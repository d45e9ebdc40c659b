"""Lists that users keep beside their code: expected findings and allowlists, as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """file_path, line_number, rule_id of each expected finding; one row with nulls for a file that should have none."""
    rows = spark.read.schema("file_path string, expected_findings array<struct<line_number:int,rule_id:string>>").option("multiLine", "true").json(path)
    return rows.select("file_path", F.explode_outer("expected_findings").alias("f")).select("file_path", "f.line_number", "f.rule_id")


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """file_path, rule_id, line_number of each entry; those without a path are passed over."""
    return spark.read.schema("file_path string, rule_id string, line_number int").option("multiLine", "true").json(path).where("file_path <> ''")
