"""A folder of Parquet tables that hands results from one stage to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED_TABLES = ["pages", "edges", "pri_scores"]
OPTIONAL_TABLES = ["anchor_candidates", "page_segments", "url_metrics", "segment_metrics"]
SCENARIO_TABLES = ["scenario_edges", "scenario_pri", "scenario_comparison"]


class Workspace:
    """Named tables under one shared folder, written once as zstd Parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write a table (replacing it) and return it as read back."""
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def has(self, name: str) -> bool:
        try:
            self.read(name)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return False
            raise
        return True

    def table(self, name: str, make: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
        """The stored table, made first if it is missing."""
        return self.read(name) if self.has(name) else self.write(name, make(), partition_by)


def scenario_table_scan(workspace: Workspace, name: str = "scenario_edges") -> DataFrame:
    """All scenarios of one table, tagged by the ``scenario`` partition folder."""
    return workspace.read(name).withColumn("scenario", F.col("scenario").cast("string"))


def csv_export(df: DataFrame, path: str) -> None:
    """Text is written as it is, blanks at its ends included."""
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**options).csv(path)


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """An exported table as strings, null and empty text told apart."""
    options = {"header": True, "escape": '"', "multiLine": True, "nullValue": "\u0000", "emptyValue": ""}
    return spark.read.options(**options).csv(path)


def export_workspace(workspace: Workspace, folder: str, include_scenarios: bool = True) -> tuple[DataFrame, list[str]]:
    """CSV copies of all tables; returns (table, row_count) as read back and the optional tables not found."""
    missing = [name for name in REQUIRED_TABLES if not workspace.has(name)]
    if missing:
        raise ValueError("missing tables for export: " + ", ".join(workspace.path(name) for name in missing))
    optional = OPTIONAL_TABLES + (SCENARIO_TABLES if include_scenarios else [])
    absent = [name for name in OPTIONAL_TABLES if not workspace.has(name)]
    exported = None
    for name in [*REQUIRED_TABLES, *[n for n in optional if n not in absent and workspace.has(n)]]:
        target = f"{folder.rstrip('/')}/csv/{name}"
        table = workspace.read(name)
        csv_export(table, target)
        row = csv_table(workspace.spark, target).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
        exported = row if exported is None else exported.unionByName(row)
    return exported, absent


def run_log_append(spark: SparkSession, path: str, record: DataFrame) -> DataFrame:
    """Append a one-row run summary to the run history and return the history."""
    record.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
