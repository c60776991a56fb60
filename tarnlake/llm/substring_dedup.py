"""Operator 4: exact removal of long repeated byte strings, on Burrows-Wheeler transforms.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else, in any document, is
removed. A window is one such string; the corpus is cut into segments, runs of neighbouring windows
whose smallest ``GRAM``-byte hash is the same. Equal windows have the same smallest hash, so only
segments of the same hash can hold equal windows:

* segments with equal bytes repeat as a whole, they are only counted;
* unequal segments of one hash are put together, once each. Blocks of their windows whose common
  bytes occur once are set aside; the rest is indexed: the suffixes are sorted,
  the Burrows-Wheeler transform goes into a wavelet matrix, and threshold-bounded interval
  expansion (breadth-first backward extension, after Beller et al., 2013) finds the common
  prefixes by increasing length. It stops at ``LENGTH``: boundaries not reached by then separate
  suffixes that share a whole window;
* a hash with more than ``CROWD`` unequal segments, such as the edge of a passage that very many
  documents share, would not fit one index. Its windows are counted instead: first by blocks of
  ``BLOCK`` windows through the bytes that all windows of a block have in common, then, in the
  blocks that occur twice, one by one. Both counts are aggregations by hash that combine early.

No step gathers the segments of a copied passage: copies are reduced to one row by partial sums.

Defined results: a null or empty text has 0 bytes and nothing removed; a text shorter than
``LENGTH`` keeps all; repeated rows, even with equal doc_id, are documents of their own and repeat
each other; a null doc_id is carried through; only doc_id and text are read; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, settle, slabs, span_hashes

LENGTH = 400
GRAM = 128
#: Windows to a segment at most.
LONGEST = 512
#: Unequal segments of one hash that go into one index.
CROWD = 3000
BLOCK = 16
#: Bytes of segments to an index, but for a larger group of one hash.
INDEX = 3 << 20
SLAB = 1 << 20


# --- segments -------------------------------------------------------------------------------


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place that has so many."""
    at = np.arange(max(len(raw) - gram + 1, 0))
    return span_hashes(raw, at, at + gram)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours: prefix and suffix minima of blocks meet in every window."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, h.dtype)
    padded = np.full(-(-len(h) // width) * width, np.iinfo(h.dtype).max, h.dtype)
    padded[: len(h)] = h
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _may_recur(h: np.ndarray, low: np.ndarray, width: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the smallest hash of a segment may stand in it twice, so that its own windows may be equal.

    All hashes in reach of a segment are at least its smallest, so equal ones follow each other among
    the places that are the smallest of some window.
    """
    edge = np.zeros(width - 1, low.dtype)
    highest = ~window_minima(~np.concatenate([edge, low, edge]), width)
    places = np.flatnonzero(h == highest)
    twice = np.concatenate([[0, 0], np.cumsum(h[places[1:]] == h[places[:-1]])])
    first, last = np.searchsorted(places, start), np.searchsorted(places, end + width - 1)
    return twice[last] > twice[np.minimum(first + 1, last)]


def segments(raw: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, smallest hash, hash of the bytes, may recur in itself) of each segment."""
    h = gram_hashes(raw, gram)
    low = window_minima(h, length - gram + 1)
    size = np.diff(bounds)
    windows = np.maximum(size - length + 1, 0)
    if not len(low) or not windows.any():
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    use = np.zeros(len(low) + 1, np.int8)
    np.add.at(use, bounds[:-1][windows > 0], 1)
    np.add.at(use, (bounds[:-1] + windows)[windows > 0], -1)
    live = np.cumsum(use[:-1]) > 0
    cut = live.copy()
    cut[1:] &= (low[1:] != low[:-1]) | ~live[:-1]
    cut[bounds[:-1][windows > 0]] = True
    start = np.flatnonzero(cut)
    row = np.searchsorted(bounds, start, "right") - 1
    end = np.minimum(np.concatenate([start[1:], [len(low)]]), (bounds[:-1] + windows)[row])
    parts = -(-(end - start) // LONGEST)
    if parts.max() > 1:
        first = np.cumsum(parts) - parts
        step = (np.arange(parts.sum()) - np.repeat(first, parts)) * LONGEST
        row, start, end = np.repeat(row, parts), np.repeat(start, parts) + step, np.repeat(end, parts)
        end = np.minimum(end, start + LONGEST)
    recurs = _may_recur(h, low, length - gram + 1, start, end)
    return row, start - bounds[row], end - start, low[start], span_hashes(raw, start, end + length - 1), recurs


def _pieces(raw: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes before it in its text, bytes, bounds): very long texts come in overlapping pieces."""
    if len(raw) <= 4 * SLAB or len(bounds) > 2:
        yield 0, 0, raw, bounds
        return
    for a in range(0, max(len(raw) - length + 1, 1), 2 * SLAB):
        b = min(a + 2 * SLAB + length - 1, len(raw))
        yield 0, a, raw[a:b], np.array([0, b - a])


def _emit_segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, whole, all_bounds in slabs(batches, "text", SLAB):
            key = rows.column("k").to_numpy()
            for _, skip, raw, bounds in _pieces(whole, all_bounds, length):
                row, start, n, low, own, recurs = segments(raw, bounds, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low.view(np.int64)), pa.array(own.view(np.int64)), pa.array(key[row]), pa.array(start + skip), pa.array(n.astype(np.int32)), pa.array(recurs.astype(bool))],
                    names=["low", "own", "k", "start", "n", "recurs"],
                )

    return run


# --- the index ------------------------------------------------------------------------------


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` codes (at least), by prefix doubling from 8 codes on."""
    n = len(codes)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = codes
    key = padded[:n].copy()
    bits = max(int(codes.max()).bit_length(), 1)
    h = min(8, 64 // bits)
    for i in range(1, h):
        key = key << np.uint64(bits) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    while True:
        ranked = key[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank[order] = new
        if h >= depth or new[-1] == n - 1:
            return order
        # Only suffixes that still share their rank are sorted again.
        size = np.bincount(new)
        tied = size[new] > 1
        where = order[tied]
        behind = np.zeros(len(where), np.int64)
        inside = where + h < n
        behind[inside] = rank[where[inside] + h] + 1
        sub = np.argsort(rank[where] * (n + 1) + behind, kind="stable")
        order[tied] = where[sub]
        key = np.empty(n, np.int64)
        key[order] = new * (n + 1)
        key[where] = rank[where] * (n + 1) + behind
        h *= 2


class WaveletMatrix:
    """Ranks of the codes of a sequence, for many intervals at once."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(int(codes.max(initial=0)).bit_length(), 1)
        self.ones, self.zeros = [], []
        x = codes
        for b in range(self.bits - 1, -1, -1):
            bit = (x >> b & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(x) - int(self.ones[-1][-1]))
            x = np.concatenate([x[~bit], x[bit]])
        self.base = np.zeros((1 << self.bits) + 1, np.int64)
        values, first = np.unique(x, return_index=True)
        self.base[values] = first

    def extensions(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the intervals [lo, hi): each code in them, with its number before lo and before hi."""
        code = np.zeros(len(lo), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, b = ones[lo], ones[hi]
            l0, h0, l1, h1 = lo - a, hi - b, zeros + a, zeros + b
            left, right = h0 > l0, h1 > l1
            lo, hi = np.concatenate([l0[left], l1[right]]), np.concatenate([h0[left], h1[right]])
            code = np.concatenate([code[left] << 1, code[right] << 1 | 1])
        return code, lo - self.base[code], hi - self.base[code]


def repeated_places(codes: np.ndarray, length: int) -> np.ndarray:
    """Places whose next ``length`` codes also start elsewhere; code 0 separates texts and matches nothing."""
    n = len(codes)
    out = np.zeros(n, bool)
    if n <= length or not codes.any():
        return out
    order = suffix_order(codes, length)
    bwt = codes[order - 1]
    matrix = WaveletMatrix(bwt)
    first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=int(codes.max()) + 1))])
    # open[i]: the common prefix of the suffixes of rank i - 1 and i is not known to be shorter than ``length``.
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    lo, hi = first[:-1], first[1:]
    some = hi > lo
    lo, hi = lo[some], hi[some]
    open_[hi] = False
    for _ in range(1, length):
        # Intervals of one suffix extend to one suffix, whose right boundary may still be open.
        code, a, b = matrix.extensions(lo, hi)
        text = code > 0
        lo, hi = first[code[text]] + a[text], first[code[text]] + b[text]
        new = open_[hi]
        lo, hi = lo[new], hi[new]
        if not len(lo):
            break
        open_[hi] = False
    out[order] = open_[:-1] | open_[1:]
    return out


def _ranges(hit: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to) of the runs of hits, which lie segment by segment."""
    ends = np.cumsum(n)
    edge = np.zeros(len(hit) + 1, bool)
    edge[ends - n] = True
    edge[-1] = True
    begin = hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]]))
    last = hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))
    a, b = np.flatnonzero(begin), np.flatnonzero(last) + 1
    which = np.searchsorted(ends, a, "right")
    return which, a - (ends - n)[which], b - (ends - n)[which]


def promising(low: np.ndarray, n: np.ndarray, raw: np.ndarray, at: np.ndarray, length: int, gram: int, block: int = BLOCK) -> np.ndarray:
    """Windows that may be equal to another: what all windows of their block have in common occurs twice.

    ``raw`` holds the segments' bytes one behind the other, from ``at`` on; blocks lie at equal
    distances from the next place of the segment's smallest hash, so equal windows lie in equal blocks.
    """
    size = n + length - 1
    h = gram_hashes(raw, gram)
    here = np.flatnonzero(h == np.repeat(low, size)[: len(h)])
    x = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    anchor = here[np.searchsorted(here, x)]
    segment = np.repeat(np.arange(len(n)), n)
    part = (anchor - x) // block
    first = np.ones(len(x), bool)
    first[1:] = (part[1:] != part[:-1]) | (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])
    edge = np.flatnonzero(first)
    core = anchor[edge] - part[edge] * block
    key = span_hashes(raw, core, core + length - block + 1) + low[segment[edge]] * np.uint64(0x9E3779B97F4A7C15) + part[edge].astype(np.uint64)
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    return np.repeat(count[back] > 1, np.diff([*edge, len(x)]))


def _index_groups(length: int, gram: int):
    """Of each unequal segment of a hash: the ranges of its windows that another holds too."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (low, own, windows, bytes)."""
        low, n = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[2] for r in rows], np.int64)
        raw = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        size = n + length - 1
        whole = np.cumsum(size) - size
        use, a, b = _ranges(promising(low, n, raw, whole, length, gram), n)
        # Only these windows are indexed, each run of them as a text of its own.
        n, size = b - a, b - a + length - 1
        at = np.cumsum(size + 1) - size - 1
        take = np.repeat(whole[use] + a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        place = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
        used = np.zeros(257, bool)
        used[0] = True
        used[np.unique(raw[take]).astype(int) + 1] = True
        code = np.cumsum(used) - 1
        codes = np.zeros(int((size + 1).sum()), np.int64)
        codes[place] = code[raw[take].astype(np.int64) + 1]
        inside = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        which, c, d = _ranges(repeated_places(codes, length)[inside], n)
        c, d, which = c + a[which], d + a[which], use[which]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in which], pa.int64()), pa.array([rows[i][1] for i in which], pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int32())],
            names=["low", "own", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, dict[int, tuple]] = {}
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("low", "own", "n", "bytes")), strict=True):
                groups.setdefault(r[0], {})[r[1]] = r  # repeated rows bring a segment more than once
        held, total = [], 0
        for low in sorted(groups):
            held += sorted(groups[low].values())
            total += sum(len(r[3]) for r in groups[low].values())
            if total >= INDEX:
                yield solve(held)
                held, total = [], 0
        if held:
            yield solve(held)

    return run


# --- crowded hashes ---------------------------------------------------------------------------


def _hash_at(raw: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    return span_hashes(raw, start, start + size).view(np.int64)


def _crowd_blocks(length: int, gram: int):
    """Blocks of windows at equal distance from the smallest hash, with the hash of the bytes they have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("low", "own", "block", "core", "a", "bytes", "shift")}
            for low, own, n, data in zip(*(batch.column(c).to_pylist() for c in ("low", "own", "n", "bytes")), strict=True):
                raw = np.frombuffer(data, np.uint8)
                places = np.flatnonzero(gram_hashes(raw, gram).view(np.int64) == low)
                x = np.arange(n)
                anchor = places[np.searchsorted(places, x)]
                block = (anchor - x) // BLOCK
                edge = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (anchor[1:] != anchor[:-1])]))
                core = anchor[edge] - block[edge] * BLOCK
                hashes = _hash_at(raw, core, length - BLOCK + 1)
                for e, f, c, g in zip(edge.tolist(), [*edge[1:].tolist(), n], core.tolist(), hashes.tolist(), strict=True):
                    out["low"].append(low)
                    out["own"].append(own)
                    out["block"].append(int(block[e]))
                    out["core"].append(g)
                    out["a"].append(e)
                    out["bytes"].append(data[e : f + length - 1])
                    out["shift"].append(c - e)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _crowd_windows(length: int):
    """The windows of a block: their distance from the block's common bytes and their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("low", "own", "block", "core", "a", "shift")
            out = {k: [] for k in (*names, "hash")}
            for *head, data in zip(*(batch.column(c).to_pylist() for c in (*names, "bytes")), strict=True):
                raw = np.frombuffer(data, np.uint8)
                x = np.arange(len(raw) - length + 1)
                hashes = _hash_at(raw, x, length).tolist()
                for i, g in enumerate(hashes):
                    for k, v in zip(names, head, strict=True):
                        out[k].append(v)
                    out["a"][-1] += i
                    out["shift"][-1] -= i
                    out["hash"].append(g)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _crowded(few: DataFrame, length: int, gram: int) -> DataFrame:
    """low, own, a, b: windows of crowded hashes that another segment holds too."""
    blocks = settle(arrow(few, _crowd_blocks(length, gram), "low long, own long, block int, core long, a int, bytes binary, shift int"), "blocks")
    by = ["low", "block", "core"]
    twice = blocks.groupBy(*by).count().where("count > 1").select(*by)
    windows = arrow(blocks.join(twice, by), _crowd_windows(length), "low long, own long, block int, core long, a int, shift int, hash long")
    windows = settle(windows, "windows")
    by = ["low", "block", "core", "shift", "hash"]
    again = windows.groupBy(*by).count().where("count > 1").select(*by)
    return windows.join(again, by).select("low", "own", "a", (F.col("a") + 1).alias("b"))


# --- the operator -----------------------------------------------------------------------------


def _cut_out(length: int):
    """Bytes of each segment asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("low", "own", "n", "bytes")}
            for text, want in zip(batch.column("text"), batch.column("want"), strict=True):
                raw = text.as_buffer()
                for w in want.as_py():
                    out["low"].append(w["low"])
                    out["own"].append(w["own"])
                    out["n"].append(w["n"])
                    out["bytes"].append(raw[w["start"] : w["start"] + w["n"] + length - 1].to_pybytes())
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def covered(starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the windows of the ranges [start, end) cover."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(ends[order] + length - 1) if len(order) else ends
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    return a[first], b[np.concatenate([first[1:], [len(a)]]) - 1] if len(a) else b


def _remove(length: int, with_text: bool):
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in names}
            kept_texts = []
            for text, gone in zip(batch.column("text"), batch.column("gone"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                v = np.array([(g["a"], g["b"]) for g in gone.as_py() or ()], np.int64).reshape(-1, 2)
                starts, ends = covered(v[:, 0], v[:, 1], length)
                cuts = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)) if len(starts) else raw
                for k, x in zip(names, (len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()), strict=True):
                    out[k].append(x)
                kept_texts.append(kept)
            cols = [pa.array(out[k], pa.string() if k == "kept_sha256" else pa.int64()) for k in names]
            extra = [pa.array(kept_texts, pa.binary())] if with_text else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, *extra], names=["doc_id", *names, *(["kept"] if with_text else [])])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int | None = None, crowd: int = CROWD, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document; ``kept`` (its remaining bytes) if asked for."""
    gram = gram or max(length * GRAM // LENGTH, 4)
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = arrow(docs.select("k", "text"), _emit_segments(length, gram), "low long, own long, k long, start long, n int, recurs boolean")
    cut = settle(cut, "segments")

    equal = cut.groupBy("low", "own").agg(F.count("*").alias("c"), F.min(F.struct("k", "start", "n")).alias("one"), F.max("recurs").alias("recurs"))
    unequal = equal.groupBy("low").agg(F.count("*").alias("m")).where("m > 1")
    equal = equal.join(unequal, "low", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    equal = settle(equal.where("c > 1 or m > 1 or recurs").withColumn("unsure", F.expr("m > 1 or (recurs and c = 1)")), "equal")

    want = equal.where("unsure").select("one.k", F.struct("low", "own", "one.start", "one.n").alias("w"))
    want = want.groupBy("k").agg(F.collect_list("w").alias("want"))
    texts = arrow(docs.select("k", "text").join(want, "k"), _cut_out(length), "low long, own long, n int, bytes binary")
    texts = settle(texts.join(unequal_sizes(equal), "low"), "unequal")
    few = texts.where(F.col("m") <= crowd).repartition(max(parts, 2), "low").select("low", "own", "n", "bytes")
    found = arrow(few, _index_groups(length, gram), "low long, own long, a int, b int")
    found = found.unionByName(_crowded(texts.where(F.col("m") > crowd).dropDuplicates(["low", "own"]).select("low", "own", "n", "bytes"), length, gram))
    whole = equal.where("c > 1").select("low", "own", F.lit(0).alias("a"), F.col("one.n").alias("b"))
    ranges = settle(found.join(whole.select("low", "own"), ["low", "own"], "left_anti").unionByName(whole), "ranges")

    gone = cut.join(ranges, ["low", "own"]).select("k", F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")).alias("x"))
    gone = gone.groupBy("k").agg(F.collect_set("x").alias("gone"))
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return arrow(docs.join(gone, "k", "left").select("doc_id", "text", "gone"), _remove(length, with_text), schema)


def unequal_sizes(equal: DataFrame) -> DataFrame:
    """low, m of the hashes with unequal segments."""
    return equal.where("unsure").groupBy("low").agg(F.max("m").alias("m"))
