"""Analytical reports over transactions. Amounts are summed as exact decimals; everything is reduced before it is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import safe_ratio
from .project import with_date_parts

EXACT = "decimal(18,2)"


def exact_sum(c: str) -> Column:
    return F.sum(F.col(c).cast(EXACT)).cast("double")


def exact_mean(c: str) -> Column:
    return F.sum(F.col(c).cast(EXACT)).cast("double") / F.count(c)


def revenue_by_month(df: DataFrame, ts: str = "transaction_timestamp", amount: str = "amount") -> DataFrame:
    """year, month, revenue and n, in calendar order."""
    return with_date_parts(df, ts).groupBy("year", "month").agg(exact_sum(amount).alias("revenue"), F.count("*").alias("n")).orderBy("year", "month")


def average_by(df: DataFrame, key: str, amount: str = "amount") -> DataFrame:
    """key, n and avg_value."""
    return df.groupBy(key).agg(F.count("*").alias("n"), exact_mean(amount).alias("avg_value"))


def rate_by(df: DataFrame, key: str, flag: str, alias: str = "rate") -> DataFrame:
    """Percentage of a key's rows that have the flag (0 or 1)."""
    return df.groupBy(key).agg((F.lit(100.0) * F.sum(flag).cast("double") / F.count("*")).alias(alias))


def lifetime_value(df: DataFrame, key: str = "account_id", ts: str = "transaction_timestamp", amount: str = "amount") -> DataFrame:
    """key, total, and the total per month of the year and per calendar month with a transaction.

    Rows are first summed by key and calendar month, so that both counts of months are over few rows.
    """
    months = df.groupBy(key, F.trunc(F.col(ts).cast("date"), "month").alias("m")).agg(F.sum(F.col(amount).cast(EXACT)).alias("s"))
    d = months.groupBy(key).agg(F.sum("s").cast("double").alias("total"), F.size(F.collect_set(F.month("m"))).alias("n"), F.count("m").alias("c"))
    return d.select(key, "total", safe_ratio("total", "n").alias("per_month"), safe_ratio("total", "c").alias("per_calendar_month"))


def monthly_spend(df: DataFrame, key: str = "account_id", ts: str = "transaction_timestamp", amount: str = "amount", flag: str = "fraud_flag") -> DataFrame:
    """key, year, month, n, spend, avg_spend and frauds."""
    d = with_date_parts(df, ts).groupBy(key, "year", "month")
    return d.agg(F.count("*").alias("n"), exact_sum(amount).alias("spend"), exact_mean(amount).alias("avg_spend"), F.sum(flag).alias("frauds"))


def spend_by_group(df: DataFrame, members: DataFrame, key: str, group: str, amount: str = "amount") -> DataFrame:
    """group and spend; the rows are summed by key before the members' groups are joined."""
    s = df.groupBy(key).agg(F.sum(F.col(amount).cast(EXACT)).alias("s"))
    return s.join(members.select(key, group), key).groupBy(group).agg(F.sum("s").cast("double").alias("spend"))


def top_by_sum(df: DataFrame, names: DataFrame, key: str, name: str, amount: str, k: int, alias: str = "total") -> DataFrame:
    """The k names with the largest sums, equal ones by name."""
    s = df.groupBy(key).agg(F.sum(F.col(amount).cast(EXACT)).alias("s")).join(names.select(key, name), key)
    return s.groupBy(name).agg(F.sum("s").cast("double").alias(alias)).orderBy(F.desc_nulls_last(alias), F.asc_nulls_last(name)).limit(k)


def sample_rows(df: DataFrame, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """About a fraction of the rows, the same whatever the partitioning: those whose key's seeded hash is low enough.

    Rows of a key come or stay away together; a fraction's sample is part of every larger fraction's. The key must not be null.
    """
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction: {fraction}")
    if fraction == 1:
        return df
    return df.where(sample_hash(key, seed) < f"{int(fraction * (1 << 32)):08x}")


def sample_hash(key: str, seed: int = 42) -> Column:
    """Eight hexadecimal digits from a key and a seed."""
    return F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), 1, 8)
