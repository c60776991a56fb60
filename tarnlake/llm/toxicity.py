"""Operator 5: toxicity, a character n-gram linear classifier with naive Bayes scaled features.

Texts are folded (lower case, everything but letters, marks and digits to spaces, a space at both ends)
and cut into character n-grams of ``GRAMS`` lengths, hashed into ``BUCKETS`` buckets. A feature is the
presence of a bucket, scaled by its naive Bayes log-count ratio; a logistic regression over the scaled
features gives the score (Wang and Manning, 2012). Its regularisation is the one of ``STRENGTHS`` that
does best on folds of the training rows, each fold with ratios that have not seen it; the bias is set so
that the best threshold there has the score ``DECISION``.

``train`` fits on a bounded sample of labelled rows: at most ``PER_CLASS`` documents of each label, the
ones with the smallest hash of their doc_id, each with its whole text. Buckets are counted by label and
fold in the executors; the driver gets those whose ratio stands out from chance, and which of them each
sampled document has. Scoring reads every whole text once, in vectorised slabs, without a shuffle.

Defined results: a null or empty text has no n-gram, its score is the model's bias; repeated rows
get equal scores; a null doc_id is scored but never a training row; of rows that repeat a labelled doc_id
the least text is learnt from; other columns are carried through (``score`` is replaced); an empty table
gives an empty result; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, give_back, scratch, settle, slabs

BITS = 22
BUCKETS = 1 << BITS
#: Characters to an n-gram.
GRAMS = (4, 5, 6, 7, 8)
PER_CLASS = 2500
FOLDS = 3
STRENGTHS = (0.5, 2.0)
#: Score that the threshold found on the folds is mapped to.
DECISION = 0.7
#: What the share of clean documents above the threshold costs, against that of toxic ones below it.
FALSE_ALARM = 4.0
#: A bucket is a feature from so many documents on; see also ``stands_out``.
LEAST = 4
#: Bytes of text that are worked on at once: few enough for their arrays to stay in the cache.
SLAB = 1 << 17
#: Buckets to a block in which they are counted together.
_BLOCK = 14
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
#: Letters, marks and digits; beyond these planes every character counts as one.
_PLANES = 0x20000
_KEEP: list[np.ndarray] = []


def _kept() -> np.ndarray:
    if not _KEEP:
        _KEEP.append(np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(_PLANES)]))
    return _KEEP[0]


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, bounds): text i is at bounds[i] to bounds[i + 1], with the space before it; one more ends the last."""
    low = [(t or "").lower() for t in texts]
    c = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le"), np.uint32)
    c = np.where(_kept()[np.minimum(c, _PLANES - 1)] | (c >= _PLANES), c, np.uint32(32))
    return c, np.cumsum([0, *(len(t) + 1 for t in low)])


def gram_buckets(c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each n-gram length: the bucket of the n-gram from each character on."""
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(c) - n + 1
        if m <= 0:
            return
        # A polynomial in the characters, whose product with an odd number is well mixed in its upper bits.
        h = h[:m]
        h *= _MUL[0]
        h += c[n - 1 :]
        if n in GRAMS:
            mixed = h ^ (h >> np.uint64(31))
            mixed *= _MUL[1]
            mixed >>= np.uint64(64 - BITS)
            yield n, mixed.view(np.int64)


def _present(texts: list[str | None], useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs, by row; only buckets that are marked in ``useful``."""
    c, bounds = folded(texts)
    keys = []
    for n, bucket in gram_buckets(c):
        where = np.flatnonzero(useful[bucket]) if useful is not None else np.arange(len(bucket))
        row = np.searchsorted(bounds, where, "right") - 1
        inside = row < len(texts)
        inside[inside] = where[inside] + n <= bounds[row[inside] + 1] + 1
        keys.append(row[inside] << BITS | bucket[where[inside]])
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return keys >> BITS, keys & (BUCKETS - 1)


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if "_useful" not in self.__dict__:
            self._useful = np.zeros(BUCKETS, bool)
            self._useful[self.buckets] = True
        row, bucket = _present(texts, self._useful)
        z = self.bias + np.bincount(row, self.weights[np.searchsorted(self.buckets, bucket)], len(texts))
        return _sigmoid(z)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_useful"}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(which, cols, ratio, y, weight, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Adam on the class-balanced logistic loss of the pairs (row, feature); a feature that is present has its ratio as value."""
    n = len(ratio)
    w, b = np.zeros(n), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(which, (w * ratio)[cols], len(y))
        g = weight * (_sigmoid(z) - y)
        gw, gb = np.bincount(cols, g[which], n) * ratio + l2 * w / len(y), g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        step = 0.05 / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= step * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w * ratio, float(b)


def stands_out(rows: float) -> float:
    """Standard deviations from which a bucket's log ratio is a feature; more rows bring more buckets, so more by chance."""
    return 2 + np.log(max(rows, 1)) / 8


def log_ratios(counts: np.ndarray, rows: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(naive Bayes log-count ratio, whether it stands out from chance) of each bucket.

    ``counts`` are the documents without and with the label that have it, ``rows`` all documents of either kind.
    """
    neg, pos = counts[:, 0] + alpha, counts[:, 1] + alpha
    ratio = np.log(pos / (rows[1] + 2 * alpha)) - np.log(neg / (rows[0] + 2 * alpha))
    return ratio, (np.abs(ratio) >= stands_out(rows.sum()) * np.sqrt(1 / pos + 1 / neg)) & (counts.sum(1) >= LEAST)


def _fit(found: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, useful: np.ndarray, l2: float, rounds: int = 100) -> tuple[np.ndarray, float]:
    """(weight of each bucket's presence, bias) from the buckets of each document, as places in ``ratio``."""
    live = np.flatnonzero(useful)
    index = np.zeros(len(useful), np.int32)
    index[live] = np.arange(len(live), dtype=np.int32)
    kept = [index[r[useful[r]]] for r in found]
    which, cols = np.repeat(np.arange(len(kept), dtype=np.int32), [len(r) for r in kept]), np.concatenate(kept)
    del kept
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    out = np.zeros(len(useful))
    out[live], b = _descend(which, cols, ratio[live], y, weight, l2, rounds)
    return out, b


def _threshold(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(value, threshold) with the largest share of the labelled caught, less ``FALSE_ALARM`` times that of the others."""
    order = np.argsort(-z, kind="stable")
    gain = np.cumsum(y[order]) / y.sum() - FALSE_ALARM * np.cumsum(1 - y[order]) / (1 - y).sum()
    k = int(gain.argmax())
    return float(gain[k]), float((z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2)


def fit(buckets: np.ndarray, counts: np.ndarray, found: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> Model:
    """The model from each bucket's documents by (fold, label), and each document's buckets as places in ``buckets``."""
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -40.0)
    rows = np.array([[((fold == k) & (y == v)).sum() for v in (0, 1)] for k in range(FOLDS)])
    best, shift = STRENGTHS[-1], 0.0
    if rows.min() >= 5:
        z = np.zeros((len(STRENGTHS), len(y)))
        for k in range(FOLDS):
            ratio, useful = log_ratios(counts.sum(1) - counts[:, k], rows.sum(0) - rows[k])
            rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            for i, l2 in enumerate(STRENGTHS):
                w, b = _fit([found[r] for r in rest], y[rest], ratio, useful, l2)
                z[i, own] = [b + w[found[r]].sum() for r in own]
        tried = [_threshold(x, y) for x in z]
        i = max(range(len(STRENGTHS)), key=lambda i: (tried[i][0], STRENGTHS[i]))
        best, shift = STRENGTHS[i], np.log(DECISION / (1 - DECISION)) - tried[i][1]
    ratio, useful = log_ratios(counts.sum(1), rows.sum(0))
    w, b = _fit(found, y, ratio, useful, best)
    keep = np.abs(w) > 1e-3
    return Model(buckets[keep], w[keep].astype(np.float32), float(b + shift))


def _labelled(labels: DataFrame, label: str, train_rows, per_class: int) -> DataFrame:
    """Up to ``per_class`` training rows of each label: (doc_id, y)."""
    ok = labels.where(train_rows & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    ok = ok.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    few = [ok.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return few[0].unionByName(few[1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slab, by block: bucket * 2 * FOLDS + fold * 2 + label, and the number of documents."""
    width = 2 * FOLDS
    for rows, _, _ in slabs(batches, "text", SLAB):
        row, bucket = _present(rows.column("text").to_pylist())
        key, n = np.unique(bucket * width + (rows.column("fold").to_numpy() * 2 + rows.column("y").to_numpy())[row], return_counts=True)
        block = key // (width << _BLOCK)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(key)] if len(key) else [0]
        parts = list(zip(cuts, cuts[1:], strict=False))
        cols = [pa.array([int(block[a]) for a, _ in parts], pa.int32())]
        cols += [pa.array([x[a:b].astype("<u4").tobytes() for a, b in parts], pa.binary()) for x in (key, n)]
        yield pa.RecordBatch.from_arrays(cols, names=["block", "key", "n"])


def _select(rows: np.ndarray):
    """Buckets that stand out in all documents or in all but a fold, with their counts by (fold, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        width = 2 * FOLDS
        for batch in batches:
            for block, key, n in zip(*(batch.column(c).to_pylist() for c in ("block", "key", "n")), strict=True):
                if block not in sums:
                    sums[block] = np.zeros(width << _BLOCK, np.int64)
                sums[block][np.frombuffer(key, "<u4") - block * (width << _BLOCK)] += np.frombuffer(n, "<u4")
        for block, total in sorted(sums.items()):
            counts = total.reshape(-1, FOLDS, 2)
            useful = log_ratios(counts.sum(1), rows.sum(0))[1]
            for k in range(FOLDS):
                useful |= log_ratios(counts.sum(1) - counts[:, k], rows.sum(0) - rows[k])[1]
            some = np.flatnonzero(useful)
            yield pa.RecordBatch.from_arrays([pa.array((block << _BLOCK) + some, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in counts[some]], pa.binary())], names=["bucket", "counts"])

    return run


def _find(buckets: np.ndarray):
    """Each document's features, as places in ``buckets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        useful = np.zeros(BUCKETS, bool)
        useful[buckets] = True
        for rows, _, _ in slabs(batches, "text", SLAB):
            row, bucket = _present(rows.column("text").to_pylist(), useful)
            ends = np.searchsorted(row, np.arange(rows.num_rows + 1))
            at = np.searchsorted(buckets, bucket).astype("<i4")
            # Places ascend within a document: their differences are small and compress to about a byte each.
            col = pa.array([zlib.compress(np.diff(at[a:b], prepend=np.int32(0)).tobytes(), 1) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("h", "y", "fold")), col], names=["h", "y", "fold", "found"])

    return run


def _train(docs: DataFrame, labels: DataFrame, label: str, train_rows, per_class: int) -> Model:
    few = _labelled(labels, label, F.lit(True) if train_rows is None else train_rows, per_class)
    # At most 2 * per_class rows of an identifier and a number: broadcasting them has a fixed bound.
    d = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    d = d.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    d = d.select(F.xxhash64("doc_id").alias("h"), "y", "text").withColumn("fold", F.pmod("h", F.lit(FOLDS)).cast("int"))
    d = settle(d, "labelled")
    rows = np.zeros((FOLDS, 2), np.int64)
    for r in d.groupBy("fold", "y").count().collect():
        rows[r["fold"], r["y"]] = r["count"]
    if not rows.sum(0).all():
        return fit(np.zeros(0, np.int64), np.zeros((0, FOLDS, 2)), [], np.zeros(0), np.zeros(0))
    counted = arrow(d, _count, "block int, key binary, n binary").repartition("block")
    got = arrow(counted, _select(rows), "bucket long, counts binary").toArrow().sort_by("bucket")
    buckets = got.column("bucket").to_numpy()
    counts = np.frombuffer(b"".join(got.column("counts").to_pylist()), "<u4").astype(np.int64).reshape(-1, FOLDS, 2)
    got = arrow(d, _find(buckets), "h long, y int, fold int, found binary").toArrow().sort_by([(c, "ascending") for c in ("h", "y", "found")])
    found = [np.cumsum(np.frombuffer(zlib.decompress(x.as_py()), "<i4"), dtype=np.int32) for x in got.column("found")]
    return fit(buckets, counts, found, got.column("y").to_numpy(), got.column("fold").to_numpy())


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows=None, per_class: int = PER_CLASS) -> Model:
    """Fit on labelled documents for which ``train_rows`` holds (all by default); leaves no intermediate table."""
    with scratch(docs.sparkSession):
        try:
            return _train(docs, labels, label, train_rows, per_class)
        finally:
            give_back()  # the driver held the features of the sample


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Add ``into``: the score, 0 to 1."""
    keep = [c for c in docs.columns if c != into]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(into, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in slabs(batches, text, SLAB):
            z = pa.array(model.scores(rows.column(rows.schema.get_field_index(text)).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*rows.columns, z], names=[*rows.schema.names, into])

    return arrow(docs.select(*keep), scored, schema)
