"""File readers, and the ingestor that lands files once, checked and with their origin. Paths may be in any Hadoop file system."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..control import ControlStore
from ..errors import LakeError, NonRetryableError, SchemaError
from ..operators.project import flatten
from ..sinks import write_zone


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file as it is."""
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    if data:
        out.write(bytearray(data))
    out.close()


class Found(NamedTuple):
    path: str
    name: str
    size: int
    sha256: str


def fingerprints(spark: SparkSession, path: str) -> list[Found]:
    """The files at a path or pattern, by name, with their sha256, computed by the executors; empty files and folders included."""
    fs, p = _at(spark, path)
    there = sorted((s for s in fs.globStatus(p) or [] if s.isFile()), key=lambda s: s.getPath().getName())
    full = [s for s in there if s.getLen()]
    sums = {}
    if full:
        d = spark.read.format("binaryFile").load([s.getPath().toString() for s in full])
        sums = {_plain(r["path"]): r["sha"] for r in d.select("path", F.sha2("content", 256).alias("sha")).collect()}
    return [Found(s.getPath().toString(), s.getPath().getName(), s.getLen(), sums.get(_plain(s.getPath().toString()), "")) for s in there]


def _plain(path: str) -> str:
    """A path without the slashes that differ between notations of a local file."""
    return path.replace("file:///", "file:/")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records of a document: an array's elements, or those of the first list field of an object, or the object itself; flattened."""
    d = spark.read.option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    if not d.columns:
        raise SchemaError(f"no records in {path}")
    lists = [f.name for f in d.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if lists and not lines and not _is_array(spark, path):
        d = d.select(F.explode(f"`{lists[0]}`").alias("r")).select("r.*")
    return flatten(d)


def _is_array(spark: SparkSession, path: str) -> bool:
    head = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    return bool(head) and head["c"] == "["


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Elements ``row_tag`` as rows: attributes and child elements as columns."""
    return spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "").option("mode", "FAILFAST").load(path)


def _avro(spark: SparkSession, path: str) -> DataFrame:
    from .avro import read_avro

    return read_avro(spark, path)


class Format(NamedTuple):
    endings: tuple[str, ...]
    read: Callable[[SparkSession, str], DataFrame]


#: What is read by ending; a new format is one more entry.
FORMATS = {
    "csv": Format(("csv",), read_csv),
    "json": Format(("json",), read_json),
    "xml": Format(("xml",), lambda spark, path: read_xml(spark, path, _row_tag(spark, path))),
    "parquet": Format(("parquet", "pq"), lambda spark, path: spark.read.parquet(path)),
    "avro": Format(("avro",), _avro),
    "orc": Format(("orc",), lambda spark, path: spark.read.orc(path)),
}


def sniff_format(path: str) -> str:
    """The format whose ending a path has, in any letter case."""
    ending = path.rstrip("/").rpartition("/")[2].lower().rpartition(".")[2]
    for kind, f in FORMATS.items():
        if ending in f.endings:
            return kind
    raise NonRetryableError(f"unknown file type: {path}")


def read_file(spark: SparkSession, path: str, kind: str | None = None, row_tag: str | None = None) -> DataFrame:
    """Read a file by its format. Missing and empty files are NonRetryableError, malformed ones SchemaError."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        raise NonRetryableError(f"no such file: {path}")
    status = fs.getFileStatus(p)
    if status.isFile() and not status.getLen():
        raise NonRetryableError(f"empty file: {path}")
    kind = kind or sniff_format(path)
    if kind not in FORMATS:
        raise NonRetryableError(f"unknown format: {kind}")
    try:
        if kind == "xml" and row_tag:
            return read_xml(spark, path, row_tag)
        return FORMATS[kind].read(spark, path)
    except (PySparkException, Py4JJavaError, ValueError) as e:
        raise SchemaError(f"{path}: {e}") from e


def _row_tag(spark: SparkSession, path: str) -> str:
    """Name of the first child of the root element, from as many lines as it takes."""
    from xml.etree import ElementTree

    parser, depth = ElementTree.XMLPullParser(events=("start", "end")), 0
    try:
        for line in spark.read.text(path).toLocalIterator():
            parser.feed(line["value"] + "\n")
            for event, e in parser.read_events():
                depth += 1 if event == "start" else -1
                if event == "start" and depth == 2:
                    return e.tag
        parser.close()
    except ElementTree.ParseError as e:
        raise ValueError(f"not XML: {e}") from e
    raise ValueError("no rows")


@dataclass
class FileResult:
    path: str
    status: str
    rows: int = 0
    reason: str = ""


@dataclass
class Sweep:
    results: list[FileResult] = field(default_factory=list)

    @property
    def counts(self) -> dict[str, int]:
        return dict(Counter(r.status for r in self.results))


class FileIngestor:
    """Lands files in bronze once each. Bad files are quarantined in the ledger; purposeful errors never escape."""

    def __init__(self, spark: SparkSession, root: str, dataset: str, required: list[str], store: ControlStore, row_tag: str | None = None):
        self.spark, self.root, self.dataset, self.required, self.store, self.row_tag = spark, root, dataset, required, store, row_tag

    def ingest_file(self, path: str) -> FileResult:
        found = fingerprints(self.spark, path)
        return self._ingest(found[0]) if found else FileResult(path, "QUARANTINED", reason=f"no such file: {path}")

    def _ingest(self, file: Found) -> FileResult:
        try:
            if not file.size:
                raise NonRetryableError(f"empty file: {file.path}")
            if self.store.file_done(file.name, file.sha256):
                return FileResult(file.path, "SKIPPED_DUPLICATE")
            d = read_file(self.spark, file.path, row_tag=self.row_tag)
            missing = [c for c in self.required if c not in d.columns]
            if missing:
                raise SchemaError(f"missing columns: {', '.join(missing)}")
            # Rows are counted as they are written, not in a pass of their own.
            seen = Observation(f"rows of {file.name}")
            d = d.withColumns({"_source_file": F.lit(file.name), "_ingested_checksum": F.lit(file.sha256)}).observe(seen, F.count("*").alias("n"))
            write_zone(d, self.root, "bronze", self.dataset, mode="append")
        except (LakeError, PySparkException, Py4JJavaError) as e:
            self.store.mark_file(file.name, file.sha256, "QUARANTINED")
            return FileResult(file.path, "QUARANTINED", reason=str(e))
        self.store.mark_file(file.name, file.sha256, "PROCESSED")
        return FileResult(file.path, "PROCESSED", seen.get["n"])

    def ingest_dir(self, directory: str, pattern: str = "*") -> Sweep:
        """Ingest the folder's files by name; the checksums of all of them come from one job."""
        return Sweep([self._ingest(f) for f in fingerprints(self.spark, f"{directory.rstrip('/')}/{pattern}")])


class InboxIngestor:
    """A drop folder (as SFTP leaves it): new files are ingested and copied to an archive; the source stays."""

    def __init__(self, inbox: str, archive: str, ingestor: FileIngestor):
        self.inbox, self.archive, self.ingestor = str(inbox).rstrip("/"), str(archive).rstrip("/"), ingestor

    def discover(self, pattern: str = "*.csv") -> list[str]:
        return [f.path for f in fingerprints(self.ingestor.spark, f"{self.inbox}/{pattern}")]

    def ingest(self, pattern: str = "*.csv") -> Sweep:
        spark = self.ingestor.spark
        out = self.ingestor.ingest_dir(self.inbox, pattern)
        for r in out.results:
            if r.status == "PROCESSED":
                fs, p = _at(spark, r.path)
                to, top = _at(spark, self.archive)
                to.mkdirs(top)
                spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, _at(spark, f"{self.archive}/{p.getName()}")[1], False, spark._jsc.hadoopConfiguration())
        return out


def watch(spark: SparkSession, folder: str, checkpoint: str, on_file: Callable[[str], object], trigger: dict | None = None) -> StreamingQuery:
    """Call ``on_file`` with the path of each file that comes into a folder, once; empty files never trigger.

    A stream over the folder remembers in its checkpoint what it has seen; by default it takes all that is there and ends.
    """
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "modificationTime")

    def react(batch: DataFrame, _: int) -> None:
        for r in batch.orderBy("modificationTime", "path").select("path").toLocalIterator():
            on_file(r["path"])

    return found.writeStream.foreachBatch(react).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
