"""Table extracts: full, and incremental by time or by id under a high-water mark."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..control import ControlStore
from ..functions.expressions import check_identifier


class Tables:
    """Where tables come from: a folder of Parquet datasets, a catalogue database or JDBC."""

    def __init__(self, spark: SparkSession, path: str | None = None, database: str | None = None, jdbc: dict | None = None):
        self.spark, self.path, self.database, self.jdbc = spark, path, database, jdbc

    def read(self, name: str) -> DataFrame:
        check_identifier(name)
        if self.jdbc:
            return self.spark.read.format("jdbc").options(**self.jdbc, dbtable=name).load()
        if self.database:
            return self.spark.table(f"{check_identifier(self.database)}.{name}")
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def read_split(self, name: str, column: str, parts: int = 8) -> DataFrame:
        """A JDBC table over several connections, each with a range of a numeric or time column; nulls go with the first.

        The bounds come from one query that the source runs itself. Other sources are split by their own files.
        """
        if not self.jdbc:
            return self.read(name)
        c = check_identifier(column)
        bounds = self.query(f"SELECT MIN({c}) AS lo, MAX({c}) AS hi FROM {check_identifier(name)}").first()
        if bounds["lo"] is None or parts < 2:
            return self.read(name)
        return self.spark.read.format("jdbc").options(**self.jdbc, dbtable=name, partitionColumn=c, lowerBound=str(bounds["lo"]), upperBound=str(bounds["hi"]), numPartitions=str(parts)).load()

    def read_where(self, name: str, predicates: list[str]) -> DataFrame:
        """A JDBC table with one connection to each predicate, which must not overlap; other sources take their union as a filter."""
        if not self.jdbc:
            return self.read(name).where(" or ".join(f"({p})" for p in predicates))
        rest = {k: v for k, v in self.jdbc.items() if k != "url"}
        return self.spark.read.jdbc(self.jdbc["url"], check_identifier(name), predicates=predicates, properties=rest)

    def query(self, sql: str) -> DataFrame:
        """A query that the JDBC source runs itself."""
        if not self.jdbc:
            raise ValueError("only JDBC sources run queries")
        return self.spark.read.format("jdbc").options(**self.jdbc, query=sql).load()


def extract_full(tables: Tables, name: str) -> DataFrame:
    return tables.read(name)


def since(df: DataFrame, column: str, mark: Any | None) -> DataFrame:
    """Rows beyond the mark; all without one. The mark is a literal, so that the filter reaches the scan."""
    return df if mark is None else df.where(F.col(check_identifier(column)) > F.lit(mark).cast(df.schema[column].dataType))


def extract_incremental(tables: Tables, name: str, column: str, pipeline: str, store: ControlStore) -> tuple[DataFrame, Any | None]:
    """(rows beyond the committed mark, the mark to commit after loading them). Begins the mark, does not commit it."""
    mark = store.watermark(pipeline, name)
    rows = since(tables.read(name), column, mark)
    newest = rows.agg(F.max(check_identifier(column)).alias("m")).first()["m"]
    newest = mark if newest is None else newest
    store.begin_watermark(pipeline, name, newest)
    return rows, newest


def extract_by_timestamp(tables: Tables, name: str, pipeline: str, store: ControlStore, column: str = "updated_at") -> tuple[DataFrame, Any | None]:
    return extract_incremental(tables, name, column, pipeline, store)


def extract_by_id(tables: Tables, name: str, id_column: str, pipeline: str, store: ControlStore) -> tuple[DataFrame, Any | None]:
    """By a growing id: updates of known ids are not seen."""
    return extract_incremental(tables, name, id_column, pipeline, store)
