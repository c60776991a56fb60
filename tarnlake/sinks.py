"""Writers: zones of the lake, quarantine, tables and views, versioned tables with atomic commits."""

from __future__ import annotations

import json
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import LakeError
from .functions.expressions import check_identifier

_COMMIT = "commit-"
ZONES = ("raw", "bronze", "silver", "gold", "quarantine")


def zone_path(root: str, zone: str, dataset: str) -> str:
    if zone not in ZONES:
        raise ValueError(f"unknown zone: {zone}")
    return f"{root.rstrip('/')}/{zone}/{dataset}"


def write_zone(df: DataFrame, root: str, zone: str, dataset: str, partition_by: list[str] | None = None, mode: str = "overwrite", compression: str = "snappy") -> str:
    """Write a dataset; with partitions, overwriting replaces only those that the rows fall into.

    Rows of a partition meet in few files: they are rebalanced by the partition columns, large partitions into several.
    """
    path = zone_path(root, zone, dataset)
    writer = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode(mode).option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return path


def quarantine(df: DataFrame, root: str, dataset: str, reason: str = "_dq_reason") -> str:
    """Append rejected rows with their reason, "unspecified" without one."""
    why = F.coalesce(F.col(reason), F.lit("unspecified")) if reason in df.columns else F.lit("unspecified")
    return write_zone(df.withColumn("_dq_reason", why), root, "quarantine", dataset, mode="append")


def create_table_as(df: DataFrame, name: str, partition_by: list[str] | None = None, bucket_by: tuple[int, str] | None = None, sort_by: list[str] | None = None) -> None:
    """Save as a catalogued Parquet table; bucketed tables join on the bucket key without a shuffle."""
    writer = df.write.mode("overwrite").format("parquet").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(*bucket_by)
        if sort_by:
            writer = writer.sortBy(*sort_by)
    writer.saveAsTable(name)


def create_view(df: DataFrame, name: str) -> None:
    """A view of the session under a plain name; replaces one of that name."""
    df.createOrReplaceTempView(check_identifier(name))


def land_raw(spark: SparkSession, payloads: list[dict], root: str, dataset: str, day: str) -> str:
    """Append answers of an API as they came, one JSON document to a line, below the day they were fetched on; the path."""
    path = f"{zone_path(root, 'raw', dataset)}/ingest_date={day}"
    rows = [(json.dumps(p, sort_keys=True),) for p in payloads]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").option("compression", "gzip").text(path)
    return path


class VersionedTable:
    """A dataset in versions ``version-<n>-<id>``, each made current by a file ``commit-<n>`` that names it.

    The highest commit is the current version. A commit is written beside and renamed into its place, where
    none was before; none is ever deleted or replaced, so at no moment is a table without its version, and a
    crash leaves the version before. Readers see a version as a whole; rewriting from the table itself is
    safe, as plain Parquet paths cannot be overwritten while they are read. Works on any Hadoop file system.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> tuple[JavaObject, JavaObject]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self) -> list[str]:
        fs, top = self._at("")
        return [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []

    def current(self) -> str | None:
        """The current version, None before the first; an error where commits were lost."""
        names = self._names()
        commits = sorted(n for n in names if n.startswith(_COMMIT))
        if commits:
            return self.spark.read.text(f"{self.path}/{commits[-1]}", wholetext=True).first()[0].strip()
        if any(n.startswith("version-") and not n.startswith("version-1-") for n in names):
            raise LakeError(f"{self.path} has versions but no commit")
        return None

    def read(self) -> DataFrame | None:
        version = self.current()
        return None if version is None else self.spark.read.parquet(f"{self.path}/{version}")

    def replace(self, df: DataFrame) -> str:
        """Write a new version and make it the current one; an error if another writer has got there first."""
        before = self.current()
        number = int(before.split("-")[1]) + 1 if before else 1
        version = f"version-{number}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{version}")
        self._commit(number, version)
        return version

    def _commit(self, number: int, version: str) -> None:
        fs, new = self._at(f"_next-{version}")
        out = fs.create(new, True)
        out.write(bytearray(version.encode()))
        out.close()
        _, commit = self._at(f"{_COMMIT}{number:012d}")
        if fs.exists(commit) or not fs.rename(new, commit):
            fs.delete(new, False)
            raise LakeError(f"{self.path}: version {number} was committed by another writer")

    def vacuum(self) -> int:
        """Remove all versions but the current one, and their commits; the number removed."""
        keep, n = self.current(), 0
        if keep is None:
            return 0
        newest = f"{_COMMIT}{int(keep.split('-')[1]):012d}"
        for name in self._names():
            if name.startswith(_COMMIT) and name < newest:
                fs, p = self._at(name)
                fs.delete(p, False)
            elif name.startswith("version-") and name != keep:
                fs, p = self._at(name)
                fs.delete(p, True)
                n += 1
        return n
