"""Avro object container files, for sessions without the Avro module.

Files are read with ``binaryFile`` and decoded on the executors, one file at a time in a task and ``ROWS`` rows
of it at a time, so memory follows the largest file. Supported: all types, nested and by name, but for unions
of several types beside null; logical types come as the types that they are written in; codecs null and deflate.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TYPES = {"boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "string": "string", "bytes": "binary"}
MAGIC = b"Obj\x01"
#: Rows that are decoded at a time.
ROWS = 10_000


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("Avro data ends early")
        self.at += n
        return out

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def value(self, kind: Any, names: dict[str, Any] | None = None) -> Any:
        names = {} if names is None else names
        if isinstance(kind, list):
            return self.value(kind[self.long()], names)
        if isinstance(kind, str) and kind not in TYPES and kind != "null":
            kind = names[kind]
        if isinstance(kind, dict):
            whole, kind = kind, kind["type"]
            if kind == "record":
                return {f["name"]: self.value(f["type"], names) for f in whole["fields"]}
            if kind == "enum":
                return whole["symbols"][self.long()]
            if kind == "fixed":
                return self.take(whole["size"])
            if kind == "array":
                return [self.value(whole["items"], names) for _ in self._blocks()]
            if kind == "map":
                return [(self.value("string"), self.value(whole["values"], names)) for _ in self._blocks()]
            return self.value(kind, names)
        if kind == "null":
            return None
        if kind == "boolean":
            return self.take(1) != b"\0"
        if kind in ("int", "long"):
            return self.long()
        if kind == "float":
            return struct.unpack("<f", self.take(4))[0]
        if kind == "double":
            return struct.unpack("<d", self.take(8))[0]
        if kind in ("string", "bytes"):
            raw = self.take(self.long())
            return raw.decode() if kind == "string" else raw
        raise ValueError(f"Avro type {kind}")

    def _blocks(self) -> Iterator[int]:
        """Once for each entry of an array or map, which comes in counted blocks."""
        while n := self.long():
            if n < 0:  # followed by the block's bytes
                self.long()
            yield from range(abs(n))


def _names(kind: Any, found: dict[str, Any] | None = None) -> dict[str, Any]:
    """The named types of a schema."""
    found = {} if found is None else found
    if isinstance(kind, list):
        for k in kind:
            _names(k, found)
    elif isinstance(kind, dict):
        if "name" in kind and kind["type"] in ("record", "enum", "fixed"):
            found[kind["name"]] = kind
            if kind.get("namespace"):
                found[f"{kind['namespace']}.{kind['name']}"] = kind
        for k in ("items", "values"):
            _names(kind.get(k), found)
        for f in kind.get("fields", ()):
            _names(f["type"], found)
        if not isinstance(kind["type"], str):
            _names(kind["type"], found)
    return found


def header(data: bytes) -> tuple[dict, str, bytes, int]:
    """(schema, codec, sync marker, where the blocks begin)."""
    b = _Bytes(data)
    if b.take(4) != MAGIC:
        raise ValueError("not an Avro file")
    meta: dict[str, bytes] = {}
    while n := b.long():
        if n < 0:
            b.long()
        for _ in range(abs(n)):
            key = b.value("string")
            meta[key] = b.value("bytes")
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), b.take(16), b.at


def records(data: bytes) -> Iterator[tuple]:
    schema, codec, sync, at = header(data)
    names = _names(schema)
    if codec not in ("null", "deflate"):
        raise ValueError(f"Avro codec {codec}")
    b = _Bytes(data)
    b.at = at
    while b.at < len(data):
        n, block = b.long(), b.take(b.long())
        if b.take(16) != sync:
            raise ValueError("broken Avro block")
        part = _Bytes(zlib.decompress(block, -15) if codec == "deflate" else block)
        for _ in range(n):
            yield tuple(part.value(f["type"], names) for f in schema["fields"])


def _ddl(schema: dict) -> str:
    names = _names(schema)

    def kind(t: Any) -> str:
        if isinstance(t, list):
            some = [x for x in t if x != "null"]
            if len(some) != 1:
                raise ValueError(f"Avro union {t}")
            return kind(some[0])
        if isinstance(t, str) and t in names:
            t = names[t]
        if isinstance(t, dict):
            if t["type"] == "record":
                return f"struct<{', '.join(f'`{f['name']}`: {kind(f['type'])}' for f in t['fields'])}>"
            if t["type"] == "array":
                return f"array<{kind(t['items'])}>"
            if t["type"] == "map":
                return f"map<string, {kind(t['values'])}>"
            t = {"enum": "string", "fixed": "bytes"}.get(t["type"], t["type"]) if isinstance(t["type"], str) else t["type"]
            return kind(t)
        if t not in TYPES:
            raise ValueError(f"Avro type {t}")
        return TYPES[t]

    return ", ".join(f"`{f['name']}` {kind(f['type'])}" for f in schema["fields"])


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    """By Spark's Avro module where it is present, else by this decoder (all files have the first one's schema)."""
    try:
        return spark.read.format("avro").load(path)
    except AnalysisException:
        pass
    files = spark.read.format("binaryFile").load(path).select("content")
    first = files.limit(1).collect()
    if not first:
        raise ValueError(f"no files: {path}")
    schema = header(first[0]["content"])[0]
    ddl = _ddl(schema)
    target = spark.createDataFrame([], ddl).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for content in batch.column(0):
                rows = records(content.as_py())
                while part := list(islice(rows, ROWS)):
                    cols = zip(*part, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return files.mapInArrow(decode, ddl)
