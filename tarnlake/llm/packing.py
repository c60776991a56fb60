"""Operator 9: best-fit packing by hierarchical residual packing.

``pieces`` tokenizes each document (its ids, then id 0) and cuts those longer than ``capacity``;
the first piece takes the remainder, so that all others fill a sequence. ``pack`` then places the
pieces: every partition packs its share best-fit decreasing and emits nearly full sequences; the
sequences left underfull become items of the next round, which merges partitions, until one
partition is left or a round no longer helps. Sequences never exceed the capacity, offsets have no
gaps and no piece is lost.

A task holds one partition's lengths, about ``GROUP`` items whatever the size of the table. A
round that would not shrink the underfull sequences by a twentieth ends the merging, so the last
task stays bounded too.

Defined results: a null or empty text is the single id 0; a null doc_id and repeated rows are packed
like any other row; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, settle
from .tokenizer import byte_bpe

CAPACITY = 2048
#: Items to a packing task.
GROUP = 60_000
#: Unused places up to which a sequence counts as full.
SLACK = 4


def pieces(docs: DataFrame, capacity: int = CAPACITY, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document."""
    kind = docs.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(json_path, ranks_path)
        for batch in batches:
            which, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                raw = encoder.encode(text.as_py() or "").astype("<u4").tobytes() + b"\0\0\0\0"
                n = len(raw) // 4
                at, to, k = 0, (n - 1) % capacity + 1, 0
                while at < n:
                    which.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(raw[4 * at : 4 * to]))
                    at, to, k = to, to + capacity, k + 1
            cols = [batch.column("doc_id").take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow(docs.select("doc_id", "text"), cut, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each item and the fill of each bin."""
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    has = 0  # bit r: some bin has r places left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = has >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                has ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if r > n:
            room[r - n].append(b)
            has |= 1 << (r - n)
    return bins, offsets, np.array(fill, np.int64)


def _round(items: DataFrame, groups: int, capacity: int, level: int, key: list) -> DataFrame:
    """Pack the items of each of ``groups`` partitions; adds bin, place, fill."""
    dealt = items.repartition(groups, *key) if groups > 1 else items.repartition(1)
    names = items.columns

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        # Rows are put in one order first, so that a task that is run again packs alike.
        t = pa.Table.from_batches(rows).sort_by([(c, "ascending") for c in names]).combine_chunks()
        bins, place, fill = best_fit(t.column("length").to_numpy(), capacity)
        first = (level << 58) | (TaskContext.get().partitionId() << 32)
        for name, x in (("bin", bins + first), ("place", place), ("fill", fill[bins])):
            t = t.append_column(name, pa.array(x, pa.int64()))
        yield from t.to_batches(max_chunksize=100_000)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)
    return settle(arrow(dealt, packed, f"{schema}, bin long, place long, fill long"), f"packed{level}")


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, slack: int = SLACK, on_round: Callable[[int, int], None] | None = None) -> DataFrame:
    """Add sequence_id and offset to ``items`` (distinct names, a ``length`` of 1 to ``capacity``)."""
    keep = items.columns
    items = settle(items, "pieces")
    n = items.count()
    groups = -(-n // group) or 1
    key = [F.xxhash64(*keep)]
    out = _round(items, groups, capacity, 0, key).withColumns({"sequence_id": F.col("bin"), "offset": F.col("place")}).drop("bin", "place")
    level, left = 0, None
    while groups > 1:
        level += 1
        under = out if left is None else left
        under = under.where(F.col("fill") < capacity - slack).groupBy(F.col("sequence_id" if left is None else "bin").alias("child")).agg(F.max("fill").alias("length"))
        before = under.count()
        groups = 1 if before <= group else min(-(-before // group), -(-groups // 4))
        left = _round(under, groups, capacity, level, [F.xxhash64("child")])
        moved = left.select("child", F.col("bin").alias("_bin"), F.col("place").alias("_place"))
        out = (
            out.join(moved, F.col("sequence_id") == F.col("child"), "left")
            .withColumn("offset", F.col("offset") + F.coalesce("_place", F.lit(0)))
            .withColumn("sequence_id", F.coalesce("_bin", "sequence_id"))
            .select(*keep, "fill", "sequence_id", "offset")
        )
        after = left.select("bin").distinct().count()
        if on_round:
            on_round(before, after)
        if after > 0.95 * before:
            break
    return out.select(*keep, "sequence_id", "offset")
