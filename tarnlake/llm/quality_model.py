"""Operator 1: document quality from a linear-chain conditional random field over lines.

Every line gets features of its own and of its neighbours (character classes, word lengths, words
that repeat the word before, likeness to the line before). The chain labels lines good or bad;
forward-backward marginals of "good", weighted by line length, average to the document's score.

``train`` fits on a bounded sample of labelled rows: at most ``PER_CLASS`` documents of each label,
those with the smallest hash of their doc_id, as long as those before have fewer than ``LINES`` lines
of their label; each with all its lines. A document's label stands for its lines. Scoring reads every whole text once, without a shuffle.

Defined results: a null or empty text, or one of empty lines, counts as a single empty line;
repeated rows get equal scores; a null doc_id is scored but never a training row; of rows that repeat a
labelled doc_id the least text is learnt from; other columns are carried through (``score`` is replaced); an empty table gives an empty result; without labels of
both kinds every score is 1 (nothing is rejected).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, give_back, scratch, settle, slabs, span_hashes, word_bounds

PER_CLASS = 1500
#: Lines of each label from which no further document is taken: 1500 documents of 256 lines.
LINES = 384_000
SLAB = 1 << 20
#: Byte classes: letters a-z, A-Z, digits, white space, sentence marks, symbols, bars, "!", other ASCII, UTF-8 lead and tail bytes.
_CLASSES = 11


def _classes() -> np.ndarray:
    t = np.full(256, 8, np.uint8)
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = 0, 1, 2
    for k, chars in ((3, " \t\n\x0b\x0c\r"), (4, ".,;:?"), (5, "#*$%&<>=~^_{}[]\\@/"), (6, "|"), (7, "!")):
        t[[ord(c) for c in chars]] = k
    t[0xC0:], t[0x80:0xC0] = 9, 10
    return t


_CLASS = _classes()
FEATURES = 14


def line_bounds(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the lines that have a byte; a row without any gets one empty line."""
    cut = np.unique(np.concatenate([np.flatnonzero(raw == 10) + 1, bounds]))
    start, end = cut[:-1], cut[1:].copy()
    if len(start):
        end -= raw[end - 1] == 10
    row = np.searchsorted(bounds, start, "right") - 1
    some = end > start
    row, start, end = row[some], start[some], end[some]
    bare = np.setdiff1d(np.arange(len(bounds) - 1), row)
    row, start, end = (np.concatenate(x) for x in ((row, bare), (start, bounds[bare]), (end, bounds[bare])))
    order = np.lexsort((start, row))
    return row[order], start[order], end[order]


def line_features(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bytes, features) of each line."""
    row, start, end = line_bounds(raw, bounds)
    n, size = len(row), end - start
    f = np.zeros((n, FEATURES), np.float32)
    if not len(raw):
        f[:, 2] = 1 / 12  # as for an empty line beside others
        return row, size, f
    line_at = np.repeat(np.arange(n), size)
    inside = _CLASS[raw] if size.sum() == len(raw) else _CLASS[raw[np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]]
    counts = np.bincount(line_at * 16 + inside, minlength=n * 16).reshape(n, 16)[:, :_CLASSES].astype(np.float32)
    chars = np.maximum(counts.sum(1) - counts[:, 10], 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 9], 1)
    ws, we = word_bounds(raw, bounds)
    at = np.searchsorted(start, ws, "right") - 1
    # An empty line may share its start with the next line; words belong to the last that begins there.
    words = np.bincount(at, minlength=n).astype(np.float32)
    h = span_hashes(raw, ws, we)
    again = np.zeros(len(h))
    for lag in (1, 2):
        if len(h) > lag:
            again[lag:] = np.maximum(again[lag:], (h[lag:] == h[:-lag]) & (at[lag:] == at[:-lag]))
    repeats = np.bincount(at, again, n)
    line_hash = span_hashes(raw, start, end)
    many = np.maximum(words, 1)
    f[:, 0] = np.log1p(size) / 8
    f[:, 1] = np.log1p(words) / 6
    f[:, 2] = np.minimum(chars / many, 30) / 12
    f[:, 3] = np.sqrt(counts[:, 5] / chars)
    f[:, 4] = np.sqrt(counts[:, 6] / chars)
    f[:, 5] = counts[:, 1] / letters
    f[:, 6] = np.sqrt(counts[:, 2] / chars)
    f[:, 7] = np.sqrt(np.minimum(counts[:, 7] / many, 2))
    f[:, 8] = np.sqrt(counts[:, 4] / chars)
    f[:, 9] = np.sqrt(repeats / many)
    f[:, 10] = repeats > 0.3 * many
    f[:, 11] = np.isin(raw[np.maximum(end, 1) - 1], [46, 33, 63]) & (size > 0)
    f[1:, 12] = (line_hash[1:] == line_hash[:-1]) & (row[1:] == row[:-1]) & (size[1:] > 0)
    f[:, 13] = counts[:, 8] / chars
    return row, size, f


def with_neighbours(row: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it, with marks for the ends and a constant."""
    n = len(row)
    out = np.zeros((n, 3 * FEATURES + 3), np.float32)
    out[:, :FEATURES] = f
    same = row[1:] == row[:-1]
    out[1:, FEATURES : 2 * FEATURES] = f[:-1] * same[:, None]
    out[:-1, 2 * FEATURES : 3 * FEATURES] = f[1:] * same[:, None]
    out[1:, -3] = same
    out[:-1, -2] = same
    out[:, -1] = 1
    return out


def _message(logit: np.ndarray, stay: float, leave: float) -> np.ndarray:
    """Log-odds passed along one link: from the odds before it to those after."""
    return np.logaddexp(logit + stay, leave) - np.logaddexp(logit + leave, stay)


def forward_backward(row: np.ndarray, u: np.ndarray, stay: float, leave: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds that reach each line from the lines before and after it. Rows advance together, longest first."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
    length = np.diff(np.concatenate([first, [len(row)]]))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    fwd, bwd = np.zeros(len(row)), np.zeros(len(row))
    for t in range(1, length[0] if len(length) else 0):
        live = np.searchsorted(-length, -t, "left")
        at = first[:live] + t
        fwd[at] = _message(fwd[at - 1] + u[at - 1], stay, leave)
        at = first[:live] + length[:live] - 1 - t
        bwd[at] = _message(bwd[at + 1] + u[at + 1], stay, leave)
    return fwd, bwd


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    #: Log-potential of two neighbours with equal labels, and with different ones.
    stay: float
    leave: float

    def scores(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        row, size, f = line_features(raw, bounds)
        # Summed row by row: a matrix product's last digits depend on a row's place in it.
        u = (with_neighbours(row, f) * self.weights).sum(axis=1)
        fwd, bwd = forward_backward(row, u, self.stay, self.leave)
        good, weight = _sigmoid(fwd + u + bwd), np.maximum(size, 1)
        n = len(bounds) - 1
        return np.bincount(row, good * weight, n) / np.maximum(np.bincount(row, weight, n), 1)


def fit(row: np.ndarray, f: np.ndarray, y: np.ndarray, rounds: int = 250, l2: float = 1e-4) -> Model:
    """Maximise the weighted likelihood of the line labels ``y`` (one label per line) by Adam."""
    x = with_neighbours(row, f).astype(float)
    if not len(y) or y.min() == y.max():
        return Model(np.concatenate([np.zeros(x.shape[1] - 1), [40.0]]), 0.0, 0.0)
    dense = np.unique(row, return_inverse=True)[1]
    per_row = (1 / np.bincount(dense))[dense]
    # Good documents weigh more: rejecting one costs more than keeping a bad one.
    weight = per_row * np.where(y == 1, 0.7 / (per_row * y).sum(), 0.3 / (per_row * (1 - y)).sum())
    link = np.flatnonzero(row[1:] == row[:-1])
    p = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        u, stay = x @ p[:-1], p[-1]
        fwd, bwd = forward_backward(row, u, stay, 0.0)
        g = np.empty_like(p)
        g[:-1] = x.T @ (weight * (_sigmoid(fwd + u + bwd) - y)) + l2 * p[:-1]
        # Chance that two neighbours have equal labels, from their joint marginal.
        a, b = fwd[link] + u[link], bwd[link + 1] + u[link + 1]
        same = _sigmoid(np.logaddexp(a + b, 0) + stay - np.logaddexp(a, b))
        g[-1] = (weight[link] * (same - (y[link] == y[link + 1]))).sum() + 0.003 * stay
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.15 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(p[:-1], float(p[-1]), 0.0)


def _train(docs: DataFrame, labels: DataFrame, label: str, train_rows, per_class: int) -> Model:
    ok = labels.where((F.lit(True) if train_rows is None else train_rows) & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    ok = ok.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    few = [ok.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    # At most 2 * per_class rows of an identifier and a number: broadcasting them has a fixed bound.
    d = docs.select("doc_id", "text").join(F.broadcast(few[0].unionByName(few[1])), "doc_id")
    d = d.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, bounds in slabs(batches, "text", SLAB):
            row, _, f = line_features(raw, bounds)
            ends = np.searchsorted(row, np.arange(rows.num_rows + 1)) * FEATURES
            col = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("y"), col], names=["doc_id", "y", "f"])

    d = settle(arrow(d, features, f"doc_id {kind}, y int, f array<float>"), "lines")
    sizes = d.groupBy("doc_id", "y").agg(F.sum(F.size("f") / FEATURES).alias("k")).select("*", F.xxhash64("doc_id").alias("h")).collect()
    before, ids = [0, 0], []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if before[r["y"]] < LINES:
            before[r["y"]] += r["k"]
            ids.append(r["doc_id"])
    d = d if len(ids) == len(sizes) else d.where(F.col("doc_id").isin(ids))
    got = d.toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return fit(np.zeros(0, int), np.zeros((0, FEATURES)), np.zeros(0))
    f = got.column("f").combine_chunks()
    lines = np.asarray(f.value_lengths()) // FEATURES
    x = np.asarray(f.flatten()).reshape(-1, FEATURES)
    return fit(np.repeat(np.arange(len(lines)), lines), x, np.repeat(got.column("y").to_numpy(), lines))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows=None, per_class: int = PER_CLASS) -> Model:
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
        for rows, raw, bounds in slabs(batches, text, SLAB):
            z = pa.array(model.scores(raw, bounds), pa.float64())
            yield pa.RecordBatch.from_arrays([*rows.columns, z], names=[*rows.schema.names, into])

    return arrow(docs.select(*keep), scored, schema)
