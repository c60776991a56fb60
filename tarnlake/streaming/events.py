"""Event streams for tests and demonstrations: a seeded generator, a sharded log, file drops."""

from __future__ import annotations

import hashlib
import json
import random
from collections import defaultdict
from collections.abc import Iterable
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.expressions import CITIES
from .fraud import EVENT


def generate(n: int = 200, seed: int = 3, frauds: bool = True, start: datetime = datetime(2025, 1, 1)) -> list[dict]:
    """n ordinary events, and with ``frauds`` nine more: a high value, four in quick succession, London to Tokyo in 30 s, a repeated and a late one."""
    r = random.Random(seed)
    cities = list(CITIES)
    home = {f"C{i:04d}": r.choice(cities) for i in range(max(1, n // 5))}
    out = []

    def add(customer: str, amount: float, city: str, at: datetime) -> dict:
        e = {"transaction_id": f"T{len(out):06d}", "customer_id": customer, "account_id": f"A{customer[1:]}", "amount": round(amount, 2), "currency": r.choice(["USD", "EUR", "GBP"]), "merchant": f"M{r.randrange(50):03d}", "city": city, "timestamp": at.isoformat()}
        out.append(e)
        return e

    for i in range(n):
        customer = r.choice(list(home))
        add(customer, r.gammavariate(2, 60) + 1, home[customer], start + timedelta(minutes=5 * i))
    if frauds:
        at = start + timedelta(minutes=5 * n)
        add("F0001", 9000, "Paris", at)
        for i in range(4):
            add("F0002", 20, "Berlin", at + timedelta(seconds=5 * i))
        add("F0003", 50, "London", at)
        last = add("F0003", 60, "Tokyo", at + timedelta(seconds=30))
        out.append(dict(last))
        add("F0003", 10, "London", at - timedelta(minutes=10))
    return out


class ShardedLog:
    """An append-only log in shards; a key's records stay in order, across keys there is none."""

    def __init__(self, shards: int = 2):
        self.shards: list[list[dict]] = [[] for _ in range(shards)]
        self.sequence = 0

    def put(self, record: dict, key: str) -> int:
        self.sequence += 1
        shard = int(hashlib.md5(key.encode()).hexdigest(), 16) % len(self.shards)
        self.shards[shard].append({"data": record, "partition_key": key, "sequence_number": self.sequence})
        return self.sequence

    def read_shard(self, shard: int, after: int = 0) -> list[dict]:
        return [r for r in self.shards[shard] if r["sequence_number"] > after]

    def read_all(self) -> list[dict]:
        return [r for s in range(len(self.shards)) for r in self.read_shard(s)]


def produce(events: Iterable[dict], log: ShardedLog) -> int:
    n = 0
    for e in events:
        log.put(e, e["customer_id"])
        n += 1
    return n


def drop_files(log: ShardedLog, folder: str, per_file: int = 50) -> int:
    """Write the log's records, with their arrival number ``seq``, as JSON files that a file stream reads in order."""
    rows = sorted(log.read_all(), key=lambda r: r["sequence_number"])
    Path(folder).mkdir(parents=True, exist_ok=True)
    files = defaultdict(list)
    for i, r in enumerate(rows):
        files[i // per_file].append(json.dumps(r["data"] | {"seq": r["sequence_number"]}))
    for k, lines in files.items():
        (Path(folder) / f"part-{k:05d}.json").write_text("\n".join(lines))
    return len(files)


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(f"{EVENT}, seq long").option("maxFilesPerTrigger", files_per_batch).json(folder)


def archive_stream(events: DataFrame, path: str, checkpoint: str, ts: str = "timestamp", trigger: dict | None = None):
    """Append a stream to Parquet by year, month and day, as a delivery stream buffers to object storage."""
    from ..operators.project import with_date_parts

    w = with_date_parts(events, ts, day=True).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return w.partitionBy("year", "month", "day").trigger(**(trigger or {"processingTime": "60 seconds"})).start()
