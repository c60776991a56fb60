"""Operator 6: n-gram Jaccard join, size-aware, with a light and a heavy way.

Two texts link when their sets of word shingles have a Jaccard similarity of at least
``THRESHOLD`` percent. Equal sets form one class; everything below works on classes, so copies cost
no more than one of them. No pair of copies is ever made.

Light way: a small set enumerates its subsets of the one size that a partner of a given size must
share; two sets with a common subset are linked by proof. Heavy way: inverted lists. The lists are
cut to prefixes under rarest-first order: shingles of a single class can match nothing and fill
the front of the prefix, so most sets leave before any pair is looked at. In each list all
classes are compared with one pivot first; only where a list still spans several components are the
classes of different components compared, after size and position bounds, with exact verification.
The size up to which sets go the light way is the one with the least estimated cost.

Most classes share too little with all others together to have a partner, and leave before their shingles
are sent: of a sample of the shingles by hash, the same for all classes, a class with a partner shares
all but as many as it may lack of its whole set. Only classes of which that holds go on; none with a link is lost.

Shingles travel as packed blocks of 6-byte hashes dealt by hash range, about ``RANGE`` shingles to a
range. With many ranges each shingle has its class's key beside it, so it is the sample that keeps what is sent small. Shingles of more than ``FREQUENT`` of the classes are known from partial counts, need no list to
tell that they are shared, and are dealt by class instead, so that no task gathers the postings of a
hot shingle. The lists that remain are reduced to (component, bounds) before they are joined.

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing; with fewer words than a shingle the whole sequence is the one shingle; a null doc_id is
returned with component_id null and links nobody; rows that repeat a doc_id share its component;
columns beyond doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, components, lower_ascii, mix, settle, slabs, span_hashes, word_bounds

WORDS = 4
THRESHOLD = 85
#: Shingles to a hash range.
RANGE = 750_000
#: Share of the classes, and number of them, from which a shingle counts as frequent. At most
#: 2 / FREQUENT * (mean set size) shingles can be, which bounds what is sent to the executors.
FREQUENT, FREQUENT_LEAST = 0.005, 500
#: Stands for the hash range of frequent shingles.
_EVERYWHERE = 1 << 30
#: The light way ends here at the latest.
LIGHT_MOST = 20
SLAB = 2 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LOW48 = np.uint64((1 << 48) - 1)


def runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    if len(x):
        cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
        yield from zip(cuts, cuts[1:], strict=False)


def need(m: int, n: int, t: int = THRESHOLD) -> int:
    """Least overlap with which sets of sizes m and n link: 100 * o >= t * (m + n - o)."""
    return -(-t * (m + n) // (100 + t))


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the distinct shingles of each text in ascending order, and where each text's end."""
    raw = lower_ascii(raw)
    ws, we = word_bounds(raw, bounds)
    h = span_hashes(raw, ws, we)
    n = len(bounds) - 1
    first = np.searchsorted(ws, bounds)  # words before each text
    count = np.diff(first)
    full = max(len(h) - words + 1, 0)
    g = np.zeros(full, np.uint64)
    for k in range(words):
        g = mix(g * _ODD[4] + h[k : k + full] * _ODD[k % 4] + np.uint64(k))
    row = np.repeat(np.arange(n), count)
    inside = row[:full] == row[words - 1 :] if full else np.zeros(0, bool)
    g, grow = g[inside], row[:full][inside]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        whole = []
        for r in short:
            v = np.array([count[r]], np.uint64)
            for k in range(first[r], first[r + 1]):
                v = mix(v * _ODD[4] + h[k : k + 1] * _ODD[0])
            whole.append(v[0])
        g, grow = np.concatenate([g, np.array(whole, np.uint64)]), np.concatenate([grow, short])
        order = np.argsort(grow, kind="stable")
        g, grow = g[order], grow[order]
    ends = np.searchsorted(grow, np.arange(n + 1))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a > 1:
            g[a:b].sort()
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (grow[1:] != grow[:-1])
    return g[new], np.searchsorted(grow[new], np.arange(n + 1))


def set_keys(g: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit key to each set (0 for the empty one)."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(g * _ODD[1] + _ODD[3]), dtype=np.uint64)])
    n = np.diff(ends).astype(np.uint64)
    key = mix(sums[ends[1:]] - sums[ends[:-1]] + n * _ODD[2])
    key[n == 0] = 0
    return key.view(np.int64)


_SEEN = pa.list_(pa.struct([("token", pa.int64()), ("k", pa.int64())]))


def _sets(words: int, t: int):
    most = _partner(LIGHT_MOST, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, bounds in slabs(batches, "text", SLAB):
            g, ends = shingle_sets(raw, bounds, words)
            n = np.diff(ends)
            small = n <= most
            # Of each slab's distinct sets, the shingles that half of the share would make frequent.
            _, first = np.unique(set_keys(g, ends), return_index=True)
            use = np.zeros(len(n), bool)
            use[first] = True
            often, count = np.unique(g[np.repeat(use, n)], return_counts=True)
            some = count >= max(2, FREQUENT / 2 * len(first))
            seen = pa.array([[{"token": t, "k": k} for t, k in zip(often[some].view(np.int64).tolist(), count[some].tolist(), strict=True)]] + [None] * (len(n) - 1), _SEEN)
            tokens = [g[a:b].view(np.int64) if s else None for a, b, s in zip(ends[:-1], ends[1:], small, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(set_keys(g, ends)), pa.array(tokens, pa.list_(pa.int64())), seen],
                names=["doc_id", "n", "h", "tokens", "seen"],
            )

    return run


def _partner(n: int, t: int = THRESHOLD) -> int:
    """Largest size that can link with size n."""
    return 100 * n // t


def _spread(x: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each hash, from its upper 24 bits."""
    return ((x >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def _lack(n: int, t: int = THRESHOLD) -> int:
    """How many of its n shingles a set that links may miss in its partner, at most."""
    return n - need(n, -(-t * n // 100), t)


def _share(t: int) -> float:
    """Share of the shingles in the sample: twice what a set may lack, so that half of its sample tells."""
    return min(1.0, 2 * (100 - t) / 100)


def _sampled(words: int, t: int, ranges: int, frequent: np.ndarray):
    """Packed sampled shingles by hash range, and of each class how many of them others must have (in ranges of their own).

    Frequent shingles are not sent: all are taken as shared.
    """
    below = np.uint64(min(int(_share(t) * (1 << 32)), 1 << 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, bounds in slabs(batches, "text", SLAB):
            g, ends = shingle_sets(raw, bounds, words)
            keys, sizes = set_keys(g, ends), np.diff(ends)
            _, first = np.unique(keys, return_index=True)
            first = first[sizes[first] > 0]
            row = np.repeat(np.arange(len(sizes)), sizes)
            use = np.zeros(len(sizes), bool)
            use[first] = True
            some = use[row] & ((mix(g * _ODD[2]) >> np.uint64(32)) < below)
            if len(frequent):
                some &= frequent[np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)] != g
            g, row = g[some], row[some]
            must = np.bincount(row, minlength=len(sizes))[first] - np.array([_lack(n, t) for n in sizes[first].tolist()], np.int64)
            out = {k: [] for k in ("p", "keys", "counts", "tokens")}

            def put(p, key, count, token):
                for k, x in zip(out, (int(p), key.tobytes(), count.astype(np.int32).tobytes(), token), strict=True):
                    out[k].append(x)

            part = _spread(g, ranges)
            order = np.argsort(part, kind="stable")
            g, row, part = g[order], row[order], part[order]
            packed = np.ascontiguousarray(g.view(np.uint8).reshape(-1, 8)[:, :6])
            for a, b in runs(part):
                at = np.flatnonzero(np.concatenate([[True], row[a + 1 : b] != row[a : b - 1]]))
                put(part[a], keys[row[a:b][at]], np.diff([*at, b - a]), packed[a:b].tobytes())
            own = _spread(mix(keys[first].view(np.uint64) * _ODD[2]), ranges)
            order = np.argsort(own, kind="stable")
            first, must, own = first[order], must[order], own[order]
            for a, b in runs(own):
                put(ranges + own[a], keys[first[a:b]], must[a:b], None)
            kinds = [pa.int32(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _sharing(ranges: int):
    """Of each hash range, how many shingles of each class another one has; what a class must have is counted below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in _by_range(batches, ("p", "keys", "counts", "tokens")):
            counts = np.concatenate([np.frombuffer(r["counts"], np.int32) for r in rows])
            key = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows])
            if p >= ranges:
                key, first = np.unique(key, return_index=True)  # copies in other slabs must have the same
                count = -counts[first]
            else:
                token = np.concatenate([_unpack6(r["tokens"]) for r in rows])
                key = np.repeat(key, counts)
                order = np.lexsort((key, token))
                token, key = token[order], key[order]
                new = np.ones(len(token), bool)
                new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
                token, key = token[new], key[new]
                same = token[1:] == token[:-1]
                both = np.zeros(len(token), bool)
                both[1:] |= same
                both[:-1] |= same
                key, count = np.unique(key[both], return_counts=True)
            rows.clear()
            q = _spread(mix(key.view(np.uint64) * _ODD[2]), ranges)
            order = np.argsort(q, kind="stable")
            key, count, q = key[order], count[order].astype(np.int32), q[order]
            out = [(int(q[a]), key[a:b].tobytes(), count[a:b].tobytes()) for a, b in runs(q)]
            kinds = [pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["q", "keys", "counts"])

    return run


def _enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of the classes that share as many sampled shingles as they must."""
    for _, rows in _by_range(batches, ("q", "keys", "counts")):
        key, at = np.unique(np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows]), return_inverse=True)
        left = np.bincount(at, weights=np.concatenate([np.frombuffer(r["counts"], np.int32) for r in rows]), minlength=len(key))
        yield pa.RecordBatch.from_arrays([pa.array(key[left >= 0])], names=["h"])


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Three bits of a Bloom filter to each key."""
    return np.stack([mix(keys.view(np.uint64) * x + y) % np.uint64(bits) for x, y in zip(_ODD[:3], _ODD[2:], strict=True)], axis=1).astype(np.int64)


def _bloom(keys: DataFrame, each: int = 12) -> np.ndarray:
    """A Bloom filter of the keys ``h``, ``each`` bits to a key, as bytes. One key in a hundred passes without being among them."""
    bits = max(1, -(-keys.count() * each // 32768)) * 32768

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_places(np.array(batch.column("h"), np.int64), bits).ravel())], names=["at"])

    at = arrow(keys, run, "at long")
    maps = at.groupBy(F.shiftright("at", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("bits")).collect()
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for m in maps:
        out[m["page"]] = np.frombuffer(m["bits"], np.uint8)
    return out.ravel()


def _among(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _places(keys, len(bloom) * 8)
    return ((bloom[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _blocks(words: int, ranges: int, frequent: np.ndarray, bloom: np.ndarray):
    """Packed shingles of the classes in ``bloom`` by hash range: of each class in it the key, the set's size, how many and which.

    Frequent shingles go to ranges of their own, by class and as their number in ``frequent``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, bounds in slabs(batches, "text", SLAB):
            g, ends = shingle_sets(raw, bounds, words)
            keys, sizes = set_keys(g, ends), np.diff(ends)
            # A copy within the slab adds nothing; empty sets have no shingle.
            _, first = np.unique(keys, return_index=True)
            first = first[_among(bloom, keys[first])]
            row = np.repeat(np.arange(len(sizes)), sizes)
            use = np.zeros(len(sizes), bool)
            use[first] = True
            g, row = g[use[row]], row[use[row]]
            part = _spread(g, ranges)
            if len(frequent):
                number = np.searchsorted(frequent, g)
                hot = frequent[np.minimum(number, len(frequent) - 1)] == g
                part[hot] = ranges + _spread(mix(keys.view(np.uint64)[row[hot]] * _ODD[2]), ranges)
                g[hot] = number[hot].astype(np.uint64)
            order = np.argsort(part, kind="stable")
            g, row, part = g[order], row[order], part[order]
            packed = np.ascontiguousarray(g.view(np.uint8).reshape(-1, 8)[:, :6])
            out = {k: [] for k in ("p", "keys", "sizes", "counts", "tokens")}
            for a, b in runs(part):
                at = np.flatnonzero(np.concatenate([[True], row[a + 1 : b] != row[a : b - 1]]))
                r = row[a:b][at]
                out["p"].append(int(part[a]))
                out["keys"].append(keys[r].tobytes())
                out["sizes"].append(sizes[r].astype(np.uint32).tobytes())
                out["counts"].append(np.diff([*at, b - a]).astype(np.uint32).tobytes())
                out["tokens"].append(packed[a:b].tobytes())
            kinds = [pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


_BLOCK = "p int, keys binary, sizes binary, counts binary, tokens binary"


def _unpack6(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64).ravel()


def _by_range(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of a partition by their first column."""
    held: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.select(names).to_pylist():
            held.setdefault(row[names[0]], []).append(row)
    while held:
        yield held.popitem()


def _shared(ranges: int):
    """Of each hash range, the shingles that two classes have, packed by class again with the number of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in _by_range(batches, ("p", "keys", "sizes", "counts", "tokens")):
            counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
            key = np.repeat(np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows]), counts)
            size = np.repeat(np.concatenate([np.frombuffer(r["sizes"], np.uint32) for r in rows]), counts)
            token = np.concatenate([_unpack6(r["tokens"]) for r in rows])
            rows.clear()
            order = np.lexsort((key, token))
            token, key, size = token[order], key[order], size[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            token, key, size = token[new], key[new], size[new]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.concatenate([starts, [len(token)]]))
            df = np.repeat(length, length)
            if p >= ranges:
                df[:] = 65535
            both = df >= 2
            token, key, size, df = token[both], key[both], size[both], df[both]
            q = _spread(mix(key.view(np.uint64) * _ODD[2]), ranges)
            order = np.lexsort((key, q))
            token, key, size, df, q = token[order], key[order], size[order], df[order], q[order]
            out = {k: [] for k in ("q", "p", "keys", "sizes", "counts", "tokens", "df")}
            for a, b in runs(q):
                at = np.flatnonzero(np.concatenate([[True], key[a + 1 : b] != key[a : b - 1]]))
                out["q"].append(int(q[a]))
                out["p"].append(_EVERYWHERE if p >= ranges else p)
                out["keys"].append(key[a:b][at].tobytes())
                out["sizes"].append(size[a:b][at].tobytes())
                out["counts"].append(np.diff([*at, b - a]).astype(np.uint32).tobytes())
                out["tokens"].append(np.ascontiguousarray(token[a:b].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
                out["df"].append(np.minimum(df[a:b], 65535).astype(np.uint16).tobytes())
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _prefixes(t: int):
    """Classes that can still link: size, shared shingles (as bytes) and those of them in the rarest-first prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_range(batches, ("q", "p", "keys", "sizes", "counts", "tokens", "df")):
            counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
            key = np.repeat(np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows]), counts)
            size = np.repeat(np.concatenate([np.frombuffer(r["sizes"], np.uint32) for r in rows]), counts).astype(np.int64)
            token = np.concatenate([mix(_unpack6(r["tokens"]) * _ODD[0] + np.array([r["p"]], np.uint64) * _ODD[1]) for r in rows])
            df = np.concatenate([np.frombuffer(r["df"], np.uint16) for r in rows])
            rows.clear()
            order = np.lexsort((token, df, key))
            token, key, size = token[order].view(np.int64), key[order], size[order]
            out = {k: [] for k in ("h", "n", "tokens", "prefix", "skipped")}
            for a, b in runs(key):
                n = int(size[a])
                alone = n - (b - a)  # shingles of this class only: they come first in the order
                length = _lack(n, t) + 1
                if alone < length:
                    out["h"].append(int(key[a]))
                    out["n"].append(n)
                    out["tokens"].append(np.sort(token[a:b]).tobytes())
                    out["prefix"].append(token[a : a + length - alone])
                    out["skipped"].append(alone)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _verify(pairs: DataFrame, sets: DataFrame, t: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of class keys whose sets link."""
    a = sets.select(F.col("h").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("h").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            na, ta, nb, tb = (batch.column(c) for c in ("na", "ta", "nb", "tb"))
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.int64) for c in (ta, tb))
                o = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * o >= t * (na[i].as_py() + nb[i].as_py() - o))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "ta", "nb", "tb"), run, "a long, b long")


def light_keys(n: int, light: int = LIGHT_MOST, t: int = THRESHOLD) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, size of the common subset) for each partner size of a set, if the smaller is light."""
    sizes = [m for m in range(-(-t * n // 100), _partner(n, t) + 1) if m > 0 and min(m, n) <= light]
    return [(min(m, n), max(m, n), need(m, n, t)) for m in sizes]


def _light_cost(n: int, light: int, t: int) -> int:
    return sum(comb(n, c) for _, _, c in light_keys(n, light, t))


def _subsets(light: int, t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("h", "n", "low", "high", "key")}
            for h, n, tokens in zip(*(batch.column(c).to_pylist() for c in ("h", "n", "tokens")), strict=True):
                v = mix(np.array(tokens, np.int64).view(np.uint64) * _ODD[0] + _ODD[2])
                for low, high, c in light_keys(n, light, t):
                    left = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
                    key = mix(v.sum(dtype=np.uint64) - v[left].sum(axis=1, dtype=np.uint64) + np.array([low * 1000 + high], np.uint64) * _ODD[1])
                    for k, x in (("h", h), ("n", n), ("low", low), ("high", high)):
                        out[k] += [x] * len(key)
                    out["key"] += key.view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out.values()], names=list(out))

    return run


def light_links(sets: DataFrame, light: int, t: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between small sets: each is linked with the smallest class that shares a subset with it."""
    few = sets.where((F.col("n") > 0) & (F.col("n") <= _partner(light, t))).select("h", "n", "tokens").dropDuplicates(["h"])
    s = arrow(few, _subsets(light, t), "h long, n long, low long, high long, key long").where("n = low or n = high")
    by = ["low", "high", "key"]
    best = s.groupBy(by).agg(F.min(F.when(F.col("n") == F.col("low"), F.col("h"))).alias("x"), F.min(F.when(F.col("n") == F.col("high"), F.col("h"))).alias("y")).where("x is not null and y is not null")
    return s.join(best, by).select(F.col("h").alias("a"), F.explode(F.array(F.when(F.col("n") == F.col("low"), F.col("y")), F.when(F.col("n") == F.col("high"), F.col("x")))).alias("b")).where("b is not null and a <> b").distinct()


def choose_light(sizes: dict[int, int], list_length: float, t: int = THRESHOLD) -> int:
    """The size up to which enumerating subsets is estimated to cost less than scanning lists and verifying."""

    def cost(light: int) -> float:
        small = sum(k * _light_cost(n, light, t) for n, k in sizes.items() if n <= _partner(light, t))
        return small + sum(k * (n - need(n, n, t) + 1) * list_length * n for n, k in sizes.items() if n > light)

    return min(range(1, LIGHT_MOST + 1), key=cost)


def links(docs: DataFrame, words: int = WORDS, t: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows, components): doc_id, n and class key h of each row; (id, component) of the classes that have a link."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = settle(arrow(docs, _sets(words, t), f"doc_id {kind}, n long, h long, tokens array<long>, seen array<struct<token:long,k:long>>"), "sets")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    number = lambda n: min(max(1, int(-(-n // RANGE))), 1 << 24)
    classes = rows.agg(F.approx_count_distinct("h")).first()[0]
    often = rows.select(F.explode("seen").alias("s")).groupBy("s.token").agg(F.sum("s.k").alias("k")).where(F.col("k") >= max(FREQUENT_LEAST, FREQUENT / 2 * classes))
    frequent = np.sort(np.array([r["token"] for r in often.select("token").collect()], np.int64).view(np.uint64))
    known = docs.where("doc_id is not null")
    ranges = number(total * _share(t))
    sample = arrow(known, _sampled(words, t, ranges, frequent), "p int, keys binary, counts binary, tokens binary")
    sharing = arrow(sample.repartition(max(ranges, 2), "p"), _sharing(ranges), "q int, keys binary, counts binary")
    able = settle(arrow(sharing.repartition(max(ranges, 2), "q"), _enough, "h long"), "able")
    ranges = number(rows.join(able, "h", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    blocks = arrow(known, _blocks(words, ranges, frequent, _bloom(able)), _BLOCK)
    shared = arrow(blocks.repartition(max(ranges, 2), "p"), _shared(ranges), "q int, p int, keys binary, sizes binary, counts binary, tokens binary, df binary")
    heavy = settle(arrow(shared.repartition(max(ranges, 2), "q"), _prefixes(t), "h long, n long, tokens binary, prefix array<long>, skipped long"), "prefixes")

    few = rows.where(F.col("doc_id").isNotNull() & F.col("n").between(1, _partner(LIGHT_MOST, t)))
    sizes = {r["n"]: r["k"] for r in few.groupBy("n").agg(F.countDistinct("h").alias("k")).collect()}
    lists = heavy.select("h", "n", F.posexplode("prefix").alias("i", "token"), "skipped").select("token", "h", "n", (F.col("i") + F.col("skipped")).alias("pos"))
    # A list costs a comparison with its pivot for each entry, so its plain mean length counts, not the long lists' square.
    length = lists.groupBy("token").count().agg(F.avg("count").alias("x")).first()["x"]
    light = choose_light(sizes, length or 1.0, t)
    proven = settle(light_links(few, light, t), "light")

    # Rows of a list still compare if both can reach the overlap from their places on.
    lists = settle(lists.where(F.col("n") > light).withColumn("rest", F.col("n") - F.col("pos")), "lists")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / t)))
    listed = lists.withColumn("band", band)
    pivot = listed.groupBy("token", "band").agg(F.min(F.struct("pos", "h", "n", "rest")).alias("v"), F.count("*").alias("k")).where("k > 1").select("token", "band", "v.*")
    pivot = pivot.select("token", "band", F.col("h").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    reach = lambda x, y, m, n: (100 + t) * F.least(x, y) >= t * (F.col(m) + F.col(n))
    first = listed.join(pivot, ["token", "band"]).where((F.col("h") != F.col("b")) & reach("rest", "rb", "n", "nb")).select(F.col("h").alias("a"), "b").distinct()
    found = settle(proven.unionByName(_verify(first, heavy.select("h", "n", "tokens"), t)), "links")
    parts = components(found)

    # Lists whose classes are all in one component have nothing left to find.
    in_parts = lists.join(parts.select(F.col("id").alias("h"), "component"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    mixed = in_parts.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    in_parts = settle(in_parts.join(mixed, "token"), "mixed")
    groups = in_parts.groupBy("token", "component").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest"))
    other = groups.select(F.col("token").alias("token2"), F.col("component").alias("c2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("rest").alias("rest2"))
    fits = (F.col("component") < F.col("c2")) & (100 * F.col("hi") >= t * F.col("lo2")) & (100 * F.col("hi2") >= t * F.col("lo")) & reach("rest", "rest2", "lo", "lo2")
    meet = groups.join(other, (F.col("token") == F.col("token2")) & fits).select("token", F.col("component").alias("c1"), "c2", "lo2", "hi2", "rest2")
    x = in_parts.select("token", F.col("component").alias("c1"), F.col("h").alias("a"), F.col("n").alias("n1"), F.col("rest").alias("r1"))
    y = in_parts.select("token", F.col("component").alias("c2"), F.col("h").alias("b"), F.col("n").alias("n2"), F.col("rest").alias("r2"))
    # A class goes on only if some class of the other component can still reach it.
    can = (100 * F.col("n1") >= t * F.col("lo2")) & (100 * F.col("hi2") >= t * F.col("n1")) & reach("r1", "rest2", "n1", "lo2")
    ok = (100 * F.least("n1", "n2") >= t * F.greatest("n1", "n2")) & reach("r1", "r2", "n1", "n2")
    pairs = meet.join(x, ["token", "c1"]).where(can).join(y, ["token", "c2"]).where(ok).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = settle(_verify(pairs, heavy.select("h", "n", "tokens"), t), "links")
    if not more.isEmpty():
        joined = parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)
        parts = components(joined)
    return rows, parts


def join_components(docs: DataFrame, words: int = WORDS, t: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), class_id for each row."""
    rows, parts = links(docs, words, t)
    ids = rows.where("n > 0 and doc_id is not null").groupBy("h").agg(F.min("doc_id").alias("class_id"))
    ids = ids.join(parts.select(F.col("id").alias("h"), "component"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    least = ids.groupBy("component").agg(F.min("class_id").alias("component_id"))
    ids = ids.join(least, "component").select("h", "class_id", "component_id")
    some = F.col("n") > 0
    out = rows.select("doc_id", "n", "h").join(ids, "h", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(some, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.when(some, F.col("class_id")).otherwise(F.col("doc_id"))).alias("class_id"),
    )
