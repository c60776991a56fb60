"""Operator 7: benchmark decontamination (DataFrame functions only).

For every benchmark item, all windows of the documents with as many words as the item are searched
for weighted-shingle similarity of at least ``SIMILARITY``. Words are lower-cased and separated by
white space, shingles are ``WORDS`` words, a shingle weighs its code points; the similarity of two
multisets is the sum of weight * min(count) over the sum of weight * max(count).

1. Only windows with a shingle of an item can be similar to it. Documents are tested shingle by
   shingle against the benchmark's in one pass without a shuffle; the positions of the hits remain.
2. What a window shares with an item changes only where a hit enters or leaves it: a hit adds its
   weight to a run of starts, of repeated shingles at most as often as the item has them. A running
   sum over these changes gives the exact shared weight of all starts.
3. The weight of a union is at least the item's, so starts whose shared weight is below ``similarity``
   of the item's own cannot match. All others get their exact similarity from the window's weight.

No step estimates: the result has every window that reaches the similarity. The benchmark is the
stated query set and goes through in blocks of ``ITEMS`` shingles: only a block of that bound is ever
sent to the executors. Rows of a hot document or item are spread by document.

Defined results: a null or empty text matches nothing; an item with fewer than ``WORDS`` words has no
shingle and matches nothing; a document shorter than an item is compared as a whole; a null doc_id or
item_id is carried through; repeated rows give repeated results; columns beyond those named are not
read; an empty table, on either side, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, settle

WORDS = 5
SIMILARITY = 0.8
#: Benchmark shingles to a block.
ITEMS = 20_000


def _shingled(df: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """Replace the text by ``sh`` (hash of each shingle) and ``wt`` (its code points)."""
    keep = [c for c in df.columns if c != text]
    t = F.lower(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE_CHARS)))
    d = df.select(*keep, F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"{SPACE}+")).alias("_w"))
    enough = F.size("_w") >= words
    first = F.slice("_w", 1, F.size("_w") - (words - 1))
    rest = [lambda i, k=k: F.get("_w", i + k) for k in range(1, words)]
    return d.select(
        *keep,
        F.when(enough, F.transform(first, lambda w, i: F.xxhash64(w, *(r(i) for r in rest)))).otherwise(F.array().cast("array<bigint>")).alias("sh"),
        "_w",
    )


def _with_weights(d: DataFrame, words: int = WORDS) -> DataFrame:
    keep = [c for c in d.columns if c != "_w"]
    size = F.transform("_w", lambda w: F.length(w))
    d = d.select(*keep, size.alias("_l"))
    return d.select(*keep, F.transform("sh", lambda _, i: sum((F.get("_l", i + k) for k in range(1, words)), F.get("_l", i))).alias("wt"))


def _windows(hits: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """Windows that share enough with an item: uid, item, m (shingles of the item), total (its weight), start, both (shared weight)."""
    at = hits.select("uid", F.size("sh").alias("n"), F.explode("hits").alias("pos"), "sh", "wt")
    at = at.select("uid", "n", "pos", F.get("sh", F.col("pos")).alias("h"), F.get("wt", F.col("pos")).alias("w"))
    own = items.select("item", "m", "total", F.explode("sh").alias("h")).groupBy("item", "m", "total", "h").agg(F.count("*").cast("int").alias("c"))
    found = at.join(F.broadcast(own), "h").groupBy("uid", "n", "item", "m", "total", "h", "c", "w").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    # Beyond the c occurrences that the item has, one counts only in windows that begin after the c-th before it.
    runs = "transform(at, (p, i) -> struct(greatest(p - m + 1, 0, get(at, i - c) + 1) as a, least(p, greatest(n - m, 0)) as z))"
    found = found.select("uid", "item", "m", "total", "w", F.explode(F.expr(runs)).alias("x")).where("x.a <= x.z")
    ends = F.expr("array(struct(x.a as start, bigint(w) as d), struct(x.z + 1 as start, -bigint(w) as d))")
    change = found.select("uid", "item", "m", "total", F.explode(ends).alias("x")).select("uid", "item", "m", "total", "x.start", "x.d")
    by = Window.partitionBy("uid", "item").orderBy("start")
    runs = change.select("uid", "item", "m", "total", "start", F.lead("start").over(by).alias("next"), F.sum("d").over(by).alias("both"))
    some = runs.where((F.col("next") > F.col("start")) & (F.col("both") > 0) & (F.col("both") / F.col("total") >= similarity))
    return some.select("uid", "item", "m", "total", "both", F.explode(F.expr("sequence(start, next - 1)")).alias("start"))


def _matches(docs: DataFrame, items: DataFrame, values: list[int], words: int, similarity: float) -> DataFrame:
    """uid, doc_id, item_id, start, similarity for the windows of all documents and one block of items."""
    known = ", ".join(f"{v}L" for v in values)
    hits = F.expr(f"filter(transform(sh, (x, i) -> if(x in ({known}), i, cast(null as int))), x -> x is not null)")
    # The row number keeps the filter above this projection: below it, it would compute the hits a second time.
    d = _shingled(docs.select("doc_id", "text"), words=words).select("doc_id", "sh", "_w", hits.alias("hits"), F.monotonically_increasing_id().alias("uid"))
    hits = settle(_with_weights(d.where(F.size("hits") > 0), words), "hits")
    windows = _windows(hits, items, similarity).join(hits.select("uid", "wt"), "uid")
    weight = F.expr("aggregate(slice(wt, start + 1, m), 0L, (a, x) -> a + x)")
    good = windows.select("uid", "item", "start", (F.col("both") / (weight + F.col("total") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= similarity)
    best = good.groupBy("uid", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("x")).select("uid", "item", (-F.col("x.s")).alias("start"), "x.similarity")
    return best.join(hits.select("uid", "doc_id"), "uid").join(items.select("item", "item_id", "n_words"), "item").select("doc_id", "item_id", "start", "n_words", "similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, block: int = ITEMS) -> DataFrame:
    """doc_id, item_id, start (first word of the most similar window), n_words of the item, similarity.

    One row to each document and item with a window of at least ``similarity``.
    """
    b = _with_weights(_shingled(benchmark.select("item_id", "text"), words=words), words).where(F.size("sh") > 0)
    b = settle(b.select("item_id", "sh", "wt", F.size("sh").alias("m"), F.monotonically_increasing_id().alias("item")), "items")
    b = b.withColumn("n_words", F.col("m") + words - 1).withColumn("total", F.expr("aggregate(wt, 0L, (a, x) -> a + x)"))
    # Items in blocks of about ``block`` shingles; the blocks' numbers are all that the driver sees besides one block.
    total = b.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    blocks = -(-total // block)
    out = None
    for k in range(blocks):
        part = b if blocks == 1 else b.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        values = [r[0] for r in part.select(F.explode("sh").alias("h")).distinct().orderBy("h").collect()]
        if values:
            found = _matches(docs, part, values, words, similarity)
            out = found if out is None else out.unionByName(found)
    if out is None:
        kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, start int, n_words int, similarity double")
    return out
