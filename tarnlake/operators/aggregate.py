"""Aggregations, set operations and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_summary(df: DataFrame, id: str = "transaction_id", account: str = "account_id", amount: str = "amount", ts: str = "transaction_timestamp", currency: str = "currency", fraud: str = "fraud_flag", places: int | None = 2, drop_null_keys: bool = False) -> DataFrame:
    """Per UTC day and currency: counts, sums and bounds of the amounts, frauds."""
    d = df.select(F.to_date(ts).alias("transaction_date"), F.col(currency).alias("currency"), id, account, F.col(amount).alias("_a"), F.col(fraud).alias("_f"))
    if drop_null_keys:
        d = d.dropna(subset=["transaction_date", "currency"])
    mean = F.avg("_a") if places is None else F.round(F.avg("_a"), places)
    return d.groupBy("transaction_date", "currency").agg(
        F.count(id).alias("txn_count"),
        F.countDistinct(account).alias("distinct_accounts"),
        F.sum("_a").alias("total_amount"),
        mean.alias("avg_amount"),
        F.min("_a").alias("min_amount"),
        F.max("_a").alias("max_amount"),
        F.sum("_f").alias("fraud_count"),
    )


def top_k(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    """The k largest, equal ones by ``ties`` ascending. Tasks keep k rows each; no full sort."""
    return df.orderBy(F.desc_nulls_last(by), *[F.asc_nulls_last(t) for t in ties]).limit(k)


def profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """A row to each column: rows, nulls, null_pct, distinct values, numeric bounds and mean.

    Exact: each column is counted by value on its own, from a scan of that column alone, so no row is multiplied
    by the number of columns. ``approximate``: one pass over all columns, distinct values within about 5 %.
    """
    columns = columns or df.columns
    if approximate:
        return _profile_once(df, columns)
    out = None
    for c in columns:
        values = df.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n"))
        number = F.col("_v").try_cast("string").try_cast("double")
        one = values.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)).alias("null_count"),
            F.count("_v").alias("distinct_count"),
            F.min(number).alias("min_value"),
            F.max(number).alias("max_value"),
            F.try_divide(F.sum(number * F.col("_n")), F.sum(F.when(number.isNotNull(), F.col("_n")))).alias("mean_value"),
        )
        out = _profiled(one, c) if out is None else out.unionByName(_profiled(one, c))
    return out


def _profiled(one: DataFrame, column: str) -> DataFrame:
    return one.select(
        F.lit(column).alias("column_name"),
        "row_count",
        "null_count",
        F.round(F.try_divide(100.0 * F.col("null_count"), F.col("row_count")), 3).alias("null_pct"),
        "distinct_count",
        "min_value",
        "max_value",
        F.round("mean_value", 3).alias("mean_value"),
    )


def _profile_once(df: DataFrame, columns: list[str]) -> DataFrame:
    aggs: list[Column] = []
    for c in columns:
        number = F.col(c).try_cast("string").try_cast("double")
        parts = {"row_count": F.count("*"), "null_count": F.count_if(F.col(c).isNull()), "distinct_count": F.approx_count_distinct(c), "min_value": F.min(number), "max_value": F.max(number), "mean_value": F.avg(number)}
        aggs.append(F.struct(F.lit(c).alias("column_name"), *[v.alias(k) for k, v in parts.items()]))
    rows = df.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return rows.select("column_name", "row_count", "null_count", F.round(F.try_divide(100.0 * F.col("null_count"), F.col("row_count")), 3).alias("null_pct"), "distinct_count", "min_value", "max_value", F.round("mean_value", 3).alias("mean_value"))


def freshness(df: DataFrame, ts: str, as_of: Column, max_age_days: int = 2) -> DataFrame:
    """Latest time, whole days since then, and whether that is recent enough."""
    age = F.expr("timestampdiff(DAY, latest, as_of)")
    d = df.agg(F.max(ts).alias("latest")).withColumn("as_of", as_of)
    return d.select("latest", age.alias("age_days"), F.coalesce(age <= max_age_days, F.lit(False)).alias("is_fresh"))


def inactive_since(accounts: DataFrame, activity: DataFrame, key: str, ts: str, cutoff: Column) -> DataFrame:
    """Accounts without activity, or whose last lies before the cutoff; activity is reduced before it is joined."""
    last = activity.groupBy(key).agg(F.max(ts).alias("last_activity"))
    return accounts.join(last, key, "left").where(F.col("last_activity").isNull() | (F.col("last_activity") < cutoff))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def union_all(a: DataFrame, b: DataFrame, by_name: bool = True) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True) if by_name else a.union(b)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
