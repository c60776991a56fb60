"""Window operators. Orders are made total by tie-break columns wherever a row is chosen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(column: str, ties: Sequence[str], descending: bool) -> list[Column]:
    first = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return [first, *[F.asc_nulls_last(t) for t in ties]]


def deduplicate(df: DataFrame, keys: Sequence[str], order_by: str, ties: Sequence[str] = (), keep: str = "last") -> DataFrame:
    """One row of each key: the last (or first) by ``order_by``; nulls order before all values for "last" and after for "first"."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep: {keep}")
    w = Window.partitionBy(*keys).orderBy(*_order(order_by, ties, keep == "last"))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_record(df: DataFrame, key: str, order_by: str = "updated_at", ties: Sequence[str] = ()) -> DataFrame:
    return deduplicate(df, [key], order_by, ties)


def rank_rows(df: DataFrame, partition: str, order: str) -> DataFrame:
    """Add ``rank`` and ``dense_rank`` by ``order`` descending; equal values share theirs."""
    w = Window.partitionBy(partition).orderBy(F.desc_nulls_last(order))
    return df.withColumns({"rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w)})


def neighbours(df: DataFrame, partition: str, order: str, value: str, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``previous`` and ``next`` value and ``running_total``; one sort serves all three."""
    w = Window.partitionBy(partition).orderBy(*_order(order, ties, False))
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({"previous": F.lag(value).over(w), "next": F.lead(value).over(w), "running_total": F.sum(value).over(up_to)})


def rolling_sum(df: DataFrame, partition: str, ts: str, value: str, days: int = 7, left_open: bool = False, alias: str = "rolling") -> DataFrame:
    """Sum over the last ``days`` days up to and with the row's time; ``left_open`` leaves out the exact start."""
    frame = f"INTERVAL {days - 1} DAYS 23 HOURS 59 MINUTES 59.999999 SECONDS" if left_open else f"INTERVAL {days} DAYS"
    return df.withColumn(alias, F.expr(f"sum(`{value}`) OVER (PARTITION BY `{partition}` ORDER BY `{ts}` RANGE BETWEEN {frame} PRECEDING AND CURRENT ROW)"))


def count_within(df: DataFrame, partition: str, ts: str, seconds: int, alias: str = "within") -> DataFrame:
    """Rows of the partition in the closed span of ``seconds`` that ends at the row's time."""
    return df.withColumn(alias, F.expr(f"count(*) OVER (PARTITION BY `{partition}` ORDER BY `{ts}` RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW)"))


def first_last(df: DataFrame, partition: str, order: str, value: str, ties: Sequence[str] = (), ignore_nulls: bool = False) -> DataFrame:
    w = Window.partitionBy(partition).orderBy(*_order(order, ties, False)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({"first_value": F.first(value, ignore_nulls).over(w), "last_value": F.last(value, ignore_nulls).over(w)})


def percentiles(df: DataFrame, value: str, *ties: str, tiles: int = 4, ranges: int | None = None) -> DataFrame:
    """Add ``pct_rank`` (rank - 1) / (n - 1), ``avg_pct`` (average rank / n) and ``quartile`` over the whole table.

    A window without partitions would sort the table in one task. Instead rows are counted by value first, so
    that a frequent value is one row; the values are cut at approximate quantiles into ``ranges`` (by default of
    about 250,000 values, 1024 ranges at most), ranked within each, and shifted by the rows of the ranges before.
    Only one row to each range is ever broadcast. Which rows of one value fall into which tile is decided by
    ``ties``, among the rows of the few values that a tile's edge falls into. Nulls order last.
    """
    counted = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    cuts = ", ".join(f"{i / 1024}D" for i in range(1, 1024))  # as text: a call to the JVM for each would take a second
    seen = counted.agg(F.sum("_k").alias("n"), F.count("*").alias("values"), F.expr(f"percentile_approx(_v, array({cuts}), 10000)").alias("c")).first()
    n = seen["n"] or 0
    ranges = ranges or min(1024, max(8, seen["values"] // 250_000))
    cuts = sorted(set((seen["c"] or ())[:: max(1, 1024 // ranges)]))
    kind = df.schema[value].dataType
    part = F.when(F.col("_v").isNull(), len(cuts) + 1).otherwise(
        F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast(f"array<{kind.simpleString()}>"), lambda c: c < F.col("_v"))) if cuts else F.lit(0)
    )
    counted = counted.withColumn("_part", part)
    sizes = counted.groupBy("_part").agg(F.sum("_k").alias("_s"))
    everything = Window.partitionBy().orderBy("_part")  # over at most ``ranges`` + 1 rows
    sizes = sizes.select("_part", F.coalesce(F.sum("_s").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    before = Window.partitionBy("_part").orderBy(F.asc_nulls_last("_v")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("_own", F.coalesce(F.sum("_k").over(before), F.lit(0))).join(F.broadcast(sizes), "_part")
    ranked = ranked.select("_v", "_k", (F.col("_start") + F.col("_own")).alias("_before"))  # rows below the value
    total = F.lit(n)
    small, extra = n // tiles, n % tiles
    edge = extra * (small + 1)
    tile = lambda row: F.when(row <= edge, F.ceil(row / (small + 1))).otherwise(extra + F.ceil((row - edge) / max(small, 1))).cast("int")
    ranked = ranked.withColumns({"_first": tile(F.col("_before") + 1), "_last": tile(F.col("_before") + F.col("_k"))})
    d = df.join(ranked, F.col(value).eqNullSafe(F.col("_v")))
    whole, cut = d.where("_first = _last").withColumn("_tile", F.col("_first")), d.where("_first <> _last")
    strict = Window.partitionBy("_v").orderBy(F.asc_nulls_last(value), *[F.asc_nulls_last(t) for t in ties])
    d = whole.unionByName(cut.withColumn("_tile", tile(F.col("_before") + F.row_number().over(strict))))
    return d.select(
        *df.columns,
        (F.col("_before") / (total - 1) if n > 1 else F.lit(0.0)).alias("pct_rank"),
        ((F.col("_before") + 1 + (F.col("_k") - 1) / 2) / total).alias("avg_pct"),
        F.col("_tile").alias("quartile"),
    )
