"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import functools
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java character class of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of rows that go to a Python worker at once.
BATCH = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only in local mode (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark.conf.get("tarnlake.scratch", None) or tempfile.mkdtemp(prefix="tarnlake-")
        spark.conf.set("tarnlake.scratch", found)
    return found.rstrip("/")


def quoted(name: str) -> str:
    """A column's name that dots in it don't take apart."""
    return "`" + name.replace("`", "``") + "`"


def free_prefix(df: DataFrame) -> str:
    """Underscores that no column's name begins with, for the names of helper columns."""
    p = "_"
    while any(c.startswith(p) for c in df.columns):
        p += "_"
    return p


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks it ran, and steps that
    read the result several times do not compute it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnlake-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for held in _HELD[-1:]:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


_HELD: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what ``settle`` writes inside the block when the block ends.

    Results that are still read afterwards are settled outside of it, or inside of an outer block.
    """
    _HELD.append([])
    try:
        yield
    finally:
        for path in _HELD.pop():
            delete(spark, path)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; lazy results that read them are lost."""
    delete(spark, f"{shared_dir(spark)}/tarnlake-{spark.sparkContext.applicationId}")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with memory that goes back to the system as a task ends.

    Python workers outlive their tasks and are used again; without this, each would hold on to the most
    that any of its tasks has needed while later stages run beside it. Batches are held to ``BATCH``
    bytes (a longer row goes alone), so that neither side holds many long texts at once.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name)) > BATCH:
        conf.set(name, str(BATCH))
    return df.mapInArrow(functools.partial(_lean, run), schema)


def _lean(run, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _libc()
    try:
        yield from run(batches)
    finally:
        give_back()


def give_back() -> None:
    """Return this process's free memory to the system."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


@functools.cache
def _libc():
    """glibc, told to keep what it has while a task runs, as it is given back in the end; None on other systems."""
    if not sys.platform.startswith("linux"):
        return None
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 29)  # M_TRIM_THRESHOLD
        libc.malloc_trim
    except (OSError, AttributeError):
        return None
    return libc


def bucket_of(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the identifier's decimal text, modulo ``mod``: the fixed folds of the labelled tables."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % mod


def slabs(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Split Arrow batches into slabs of about ``max_bytes`` of text (one row at least).

    Yields (rows, bytes, bounds): the rows, their UTF-8 text as one array without gaps and the
    n + 1 offsets of the rows in it. A null text is empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
        ends = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + max_bytes, "right")) - 1)
            part = col.slice(at, to - at).fill_null("")
            bounds = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8)
            data = part.buffers()[2]
            raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
            yield batch.slice(at, to - at), raw, bounds - bounds[0]
            at = to


def components(pairs: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Smallest identifier reachable from each vertex that has a link: columns (id, component).

    Alternates large-star and small-star rounds (Kiveris et al., 2014) until the stars no longer
    change. Every round is two aggregations by vertex; the rows of a vertex are only ever reduced
    by min(), never gathered. Links and labels stay distributed.
    """
    edges = settle(
        pairs.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct(), "edges"
    )
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        edges = settle(small, "stars")
        seen = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 40)), F.lit(0)), F.countDistinct("u")).first()
        if tuple(seen) == before and seen[0] == seen[2]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = tuple(seen)


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, in place."""
    h ^= h >> np.uint64(30)
    h *= _MIX[0]
    h ^= h >> np.uint64(27)
    h *= _MIX[1]
    h ^= h >> np.uint64(31)
    return h


_BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        p = np.full(max(n, 1 << 20), np.uint64(base))
        p[0] = 1
        _POWERS[base] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[base]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of the words, which end at white space and at the ends of their text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_IS_SPACE[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes give equal hashes wherever they stand."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[raw] * _powers(_BASE, n + 1)[:n], out=sums[1:])
    inverse = _powers(pow(_BASE, -1, 1 << 64), n + 1)
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]
