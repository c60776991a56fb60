"""Catalogued tables: external partitioned tables, bulk loads, seeds, statistics, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import check_identifier


def register_external(spark: SparkSession, name: str, path: str, schema: str, partition_by: list[str] | None = None) -> None:
    """A table over Parquet files that are there already; its partitions are discovered."""
    parts = f"PARTITIONED BY ({', '.join(map(check_identifier, partition_by))})" if partition_by else ""
    location = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {check_identifier(name)} ({schema}) USING parquet {parts} LOCATION '{location}'")
    if partition_by:
        repair(spark, name)


def repair(spark: SparkSession, name: str) -> None:
    """Find partitions that were added to the folder since."""
    spark.sql(f"MSCK REPAIR TABLE {check_identifier(name)}")


def copy_into(spark: SparkSession, name: str, path: str) -> None:
    """Bulk-load Parquet files into a table, columns by name."""
    columns = spark.table(check_identifier(name)).columns
    spark.read.parquet(path).select(*columns).write.insertInto(name)


def analyze(spark: SparkSession, name: str, columns: list[str] | None = None) -> None:
    """Statistics for the optimizer."""
    what = f"FOR COLUMNS {', '.join(map(check_identifier, columns))}" if columns else ""
    spark.sql(f"ANALYZE TABLE {check_identifier(name)} COMPUTE STATISTICS {what}")


def seed(spark: SparkSession, path: str, schema: str, view: str | None = None) -> DataFrame:
    """A small reference table from CSV with a header; as a view if one is named."""
    d = spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)
    if view:
        d.createOrReplaceTempView(check_identifier(view))
    return d


def log_counts(logs: DataFrame, where: Column | None = None, *by: str) -> DataFrame:
    """Structured log lines counted by fields, most frequent first."""
    d = logs if where is None else logs.where(where)
    return d.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def validate_source(df: DataFrame, required: list[str], at_least: int = 1) -> dict:
    """{valid, row_count, missing}: whether a source has its columns and enough rows, before it is loaded."""
    missing = [c for c in required if c not in df.columns]
    rows = df.limit(at_least).count() if at_least else 0
    return {"valid": not missing and rows >= at_least, "row_count": df.count() if not missing else None, "missing": missing}
