"""Operator 3: token counts that follow edits.

A document's text is cut into pre-tokens, as the tokenizer's pattern does before merging. Blocks of
about ``BLOCK`` pre-tokens hold their text, lengths and token counts; a segment tree over the blocks
holds the characters and tokens of each subtree. An edit finds its place by walking down the tree and
re-encodes only the pre-tokens it touches plus their boundary context: cutting starts where no earlier
pre-token could have seen the edit and stops at the first boundary that falls on an old one. Then the
sums of those blocks and of their ancestors are updated.

``build`` encodes a table once and returns its trees as a table, one row to a document, to be kept.
``apply`` joins an edits table to it by doc_id and returns the trees as they then are, with the pre-tokens
that were encoded again; trees without an edit pass through as they are and never reach Python.
``counts`` does both. Special-token strings count as ordinary text.

Defined results: a null or empty text has no token; a null doc_id and repeated rows are counted like
any other row; the edits of a doc_id apply to each of its rows, those of a null or unknown one to none;
a null replacement is empty; edits that overlap or leave the text raise ValueError; of the documents only
doc_id and text are read; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, settle
from .tokenizer import Encoder, byte_bpe

BLOCK = 64
#: How far beyond its end the pattern may look to end a pre-token there.
LOOK_AHEAD = 3

#: Hashes of doc_ids by which trees without an edit are told.
SLOTS = 1 << 23

#: (start, end, replacement) in characters of the text as it was.
Edit = tuple[int, int, str]


@dataclass
class Block:
    text: str
    lengths: np.ndarray
    counts: np.ndarray


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in a byte each where that holds them all, else in four."""
    return x.astype("<u1" if x.max(initial=0) < 256 else "<u4").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n if n else 1}").astype(np.int64)


class TokenTree:
    def __init__(self, text: str, encoder: Encoder):
        self.encoder = encoder
        self.reencoded = 0
        lengths = encoder.cut(text)
        self._plant(self._blocks(text, lengths, encoder.count(text, lengths)))

    def dump(self) -> tuple[str, bytes, bytes, bytes, bytes]:
        """(text, lengths and counts of the pre-tokens, pre-tokens of the blocks, sums of the tree) to be kept."""
        lengths, counts = (_narrow(np.concatenate([np.zeros(0, np.int64), *(getattr(b, k) for b in self.blocks)])) for k in ("lengths", "counts"))
        sizes = np.array([len(b.lengths) for b in self.blocks], "<u4")
        return self.text, lengths, counts, sizes.tobytes(), self.tree.astype("<i8").tobytes()

    @classmethod
    def load(cls, encoder: Encoder, text: str, lengths: bytes, counts: bytes, sizes: bytes, tree: bytes) -> TokenTree:
        """The tree that ``dump`` has kept; nothing is encoded or summed again."""
        self = cls.__new__(cls)
        self.encoder, self.reencoded = encoder, 0
        cuts = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))
        n, k = (_wide(x, int(cuts[-1]) if len(cuts) else 0) for x in (lengths, counts))
        at = np.concatenate([[0], np.cumsum(n)])
        starts = [0, *cuts[:-1].tolist()] if len(cuts) else []
        self.blocks = [Block(text[at[i] : at[j]], n[i:j], k[i:j]) for i, j in zip(starts, cuts.tolist(), strict=True)]
        self.tree = np.frombuffer(tree, "<i8").reshape(-1, 2).copy()
        self.size = len(self.tree) // 2
        return self

    @staticmethod
    def _blocks(text: str, lengths: np.ndarray, counts: np.ndarray, parts: int = 0) -> list[Block]:
        """Cut a run of pre-tokens into ``parts`` blocks, or into blocks of ``BLOCK``."""
        cuts = np.linspace(0, len(lengths), parts + 1).astype(int) if parts else np.array([*range(0, len(lengths), BLOCK), len(lengths)])
        at = np.concatenate([[0], np.cumsum(lengths)])[cuts]
        return [Block(text[at[i] : at[i + 1]], lengths[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]]) for i in range(len(cuts) - 1)]

    def _plant(self, blocks: list[Block]) -> None:
        size = 1
        while size < len(blocks):
            size *= 2
        self.blocks, self.size = blocks, size
        self.tree = np.zeros((2 * size, 2), np.int64)  # characters, tokens
        for i, b in enumerate(blocks):
            self.tree[size + i] = len(b.text), b.counts.sum()
        level = size
        while level > 1:
            self.tree[level // 2 : level] = self.tree[level : 2 * level : 2] + self.tree[level + 1 : 2 * level : 2]
            level //= 2

    def _refresh(self, block: int) -> None:
        b, i = self.blocks[block], self.size + block
        self.tree[i] = len(b.text), b.counts.sum()
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] + self.tree[2 * i + 1]

    def _find(self, place: int) -> tuple[int, int]:
        """(block with the character, characters before that block); the last block beyond the text."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if place - before >= self.tree[i, 0]:
                before += int(self.tree[i, 0])
                i += 1
        block = i - self.size
        if block >= len(self.blocks):
            block = len(self.blocks) - 1
            before = int(self.tree[1, 0]) - len(self.blocks[block].text)
        return block, before

    @property
    def total(self) -> int:
        return int(self.tree[1, 1])

    @property
    def text(self) -> str:
        return "".join(b.text for b in self.blocks)

    def apply(self, edits: Sequence[Edit]) -> None:
        edits = sorted(edits)
        n = int(self.tree[1, 0])
        if any(y[0] < x[1] for x, y in zip(edits, edits[1:], strict=False)) or any(not 0 <= a <= b <= n for a, b, _ in edits):
            raise ValueError("edits overlap or leave the text")
        for edit in reversed(edits):  # from the right, so that places to the left stay
            self._edit(*edit)

    def _edit(self, a: int, b: int, new: str) -> None:
        if not self.blocks:
            self.blocks = [Block("", np.zeros(0, np.int64), np.zeros(0, np.int64))]
        lo, before = self._find(max(a - LOOK_AHEAD, 0))
        hi, _ = self._find(b)
        hi = min(hi + 1, len(self.blocks) - 1)
        while not self._recut(lo, hi, a - before, b - before, new):
            hi = min(2 * hi - lo + 1, len(self.blocks) - 1)

    def _ends(self, text: str, at: int) -> Iterator[int]:
        """Ends of the pre-tokens from a boundary on, one by one."""
        if self.encoder.certain(text):
            return (m.end() for m in self.encoder.pieces().finditer(text, at))
        return iter((at + np.cumsum(self.encoder.cut(text[at:]))).tolist())

    def _recut(self, lo: int, hi: int, a: int, b: int, new: str) -> bool:
        """Edit the text of the blocks lo..hi; False if the cuts do not meet again within them."""
        part = self.blocks[lo : hi + 1]
        old = "".join(x.text for x in part)
        lengths, counts = (np.concatenate([getattr(x, k) for x in part]) for k in ("lengths", "counts"))
        text, grown = old[:a] + new + old[b:], len(new) - (b - a)
        ends = np.cumsum(lengths)
        kept = int(np.searchsorted(ends, a - LOOK_AHEAD, "right"))
        at = int(ends[kept - 1]) if kept else 0
        last = hi == len(self.blocks) - 1
        cuts, meet = [], None
        for end in self._ends(text, at):
            if not last and end + LOOK_AHEAD > len(text):
                return False
            cuts.append(end)
            was = end - grown
            if was >= b and (j := int(np.searchsorted(ends, was))) < len(ends) and ends[j] == was:
                meet = j + 1
                break
        if meet is None:
            if not last:
                return False
            meet = len(lengths)
        starts = [at, *cuts[:-1]]
        fresh = np.array([len(self.encoder.encode_plain(text[x:y])) for x, y in zip(starts, cuts, strict=False)], np.int64)
        self.reencoded += len(cuts)
        lengths = np.concatenate([lengths[:kept], np.diff(np.array([at, *cuts], np.int64)), lengths[meet:]])
        counts = np.concatenate([counts[:kept], fresh, counts[meet:]])
        if len(lengths) > 4 * BLOCK * (hi - lo + 1):
            self._plant([*self.blocks[:lo], *self._blocks(text, lengths, counts), *self.blocks[hi + 1 :]])
        else:
            self.blocks[lo : hi + 1] = self._blocks(text, lengths, counts, hi - lo + 1)
            for k in range(lo, hi + 1):
                self._refresh(k)
        return True


_NUMBER = re.compile(r"[0-9]{3,}")


def mask_numbers(text: str) -> list[Edit]:
    """Every run of three digits or more becomes ``0``, and a closing line is added."""
    return [*number_edits(text), (len(text), len(text), "\n[end]")]


def number_edits(text: str) -> list[Edit]:
    """The edits of the registered query: every run of three digits or more becomes ``0``."""
    return [(m.start(), m.end(), "0") for m in _NUMBER.finditer(text)]


_TREE = "text string, lengths binary, counts binary, sizes binary, sums binary, n_tokens long, n_pretokens long"
_STATE = ("text", "lengths", "counts", "sizes", "sums")


def _rows(head: list[pa.Array], names: list[str], trees: list[TokenTree]) -> pa.RecordBatch:
    """Trees as rows behind the columns ``head``."""
    kinds = [pa.string(), *[pa.binary()] * 4]
    kept = [t.dump() for t in trees]
    cols = [pa.array([k[i] for k in kept], kind) for i, kind in enumerate(kinds)]
    cols += [pa.array([t.total for t in trees], pa.int64()), pa.array([sum(len(b.counts) for b in t.blocks) for t in trees], pa.int64())]
    return pa.RecordBatch.from_arrays([*head, *cols], names=[*names, *_STATE, "n_tokens", "n_pretokens"])


def build(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, the tree of its text, n_tokens, n_pretokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(json_path, ranks_path)
        for batch in batches:
            yield _rows([batch.column("doc_id")], ["doc_id"], [TokenTree(t.as_py() or "", encoder) for t in batch.column("text")])

    return arrow(docs.select("doc_id", "text"), built, f"doc_id {kind}, {_TREE}")


def apply(trees: DataFrame, edits: DataFrame, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """The trees after the edits (doc_id, start, end, replacement; in characters of the text as it is in the tree).

    Adds n_tokens_before, n_pretokens_before, n_edits and n_reencoded (pre-tokens encoded again).
    """
    kind = trees.schema["doc_id"].dataType.simpleString()
    edits = edits.where("doc_id is not null").select(F.col("doc_id").alias("edited_id"), F.struct("start", "end", F.coalesce("replacement", F.lit("")).alias("new")).alias("e"))
    own = edits.groupBy("edited_id").agg(F.collect_list("e").alias("edits"))
    # Only trees that may have edits are moved to them: a bit for each hash of an edited doc_id, 1 MB in all.
    bits = _bits(edits)
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)) + 1
    marked = trees.join(F.broadcast(bits), F.bitmap_bucket_number(slot) == F.col("bits_of"), "left")
    marked = marked.withColumn("may", F.coalesce(_bit("bits", F.bitmap_bit_position(slot)), F.lit(False)) & F.col("doc_id").isNotNull()).drop("bits", "bits_of")
    moved = marked.where("may").join(own, F.col("doc_id") == F.col("edited_id"), "left").drop("edited_id", "may")
    counted = "n_tokens_before long, n_pretokens_before long, n_edits long, n_reencoded long"

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(json_path, ranks_path)
        for batch in batches:
            changed, n = [], []
            for k, changes in enumerate(batch.column("edits").to_pylist()):
                tree = TokenTree.load(encoder, batch.column("text")[k].as_py(), *(batch.column(c)[k].as_py() for c in _STATE[1:]))
                tree.apply([(e["start"], e["end"], e["new"]) for e in changes])
                changed.append(tree)
                n.append(len(changes))
            out = _rows([batch.column("doc_id")], ["doc_id"], changed)
            more = [batch.column("n_tokens"), batch.column("n_pretokens"), pa.array(n, pa.int64()), pa.array([t.reencoded for t in changed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*out.columns, *more], names=[*out.schema.names, *(c.split()[0] for c in counted.split(", "))])

    touched = arrow(moved.where("edits is not null"), edited, f"doc_id {kind}, {_TREE}, {counted}")
    zero = F.lit(0).cast("long")
    same = marked.where("not may").drop("may").unionByName(moved.where("edits is null").drop("edits"))
    same = same.withColumns({"n_tokens_before": F.col("n_tokens"), "n_pretokens_before": F.col("n_pretokens"), "n_edits": zero, "n_reencoded": zero})
    return touched.unionByName(same)


def _bits(edits: DataFrame) -> DataFrame:
    """bits_of, bits: for every 32,768 of the ``SLOTS`` hashes, which of them an edited_id has."""
    slot = F.pmod(F.xxhash64("edited_id"), F.lit(SLOTS)) + 1
    return edits.groupBy(F.bitmap_bucket_number(slot).alias("bits_of")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))


def _bit(bits: str, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bits), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte.cast("long"), (place % 8).cast("int")) == 1


def edits_of(docs: DataFrame, find: Callable[[str], Sequence[Edit]]) -> DataFrame:
    """The edits table (doc_id, start, end, replacement) that a function finds for each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *e) for i, t in enumerate(batch.column("text")) for e in find(t.as_py() or "")]
            which = pa.array([f[0] for f in found], pa.int64())
            cols = [pa.array([f[k] for f in found], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(which), *cols], names=["doc_id", "start", "end", "replacement"])

    return arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, start long, end long, replacement string")


def counts(docs: DataFrame, edits: Callable[[str], Sequence[Edit]] | DataFrame = mask_numbers, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_edits, n_tokens_edited, n_reencoded: before and after the edits of a table or function.

    A function's edits need a doc_id to go by, and rows that repeat one must have equal texts.
    """
    trees = settle(build(docs, json_path, ranks_path), "trees")
    if not isinstance(edits, DataFrame):
        # Every copy of a document finds the same edits.
        edits = edits_of(docs, edits).distinct()
    after = apply(trees, edits, json_path, ranks_path)
    return after.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_pretokens_before").alias("n_pretokens"), "n_edits", F.col("n_tokens").alias("n_tokens_edited"), "n_reencoded")
