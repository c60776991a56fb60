"""Joins. Strategies are the optimizer's choice; a side is broadcast only behind a check of its size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOW = ("inner", "left", "right", "outer", "full", "cross", "semi", "anti")
#: Bytes up to which ``lookup`` broadcasts.
SMALL = 32 << 20


def join(left: DataFrame, right: DataFrame, on: list[str] | str | None = None, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join on columns of the same name. ``null_safe``: null keys match each other."""
    if how not in HOW:
        raise ValueError(f"unknown join: {how}")
    if how == "cross":
        return left.crossJoin(right)
    keys = [on] if isinstance(on, str) else list(on or ())
    how = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
    if not null_safe:
        return left.join(right, keys, how)
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    out = left.join(other, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys)), how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.withColumns({k: F.coalesce(k, f"_r_{k}") for k in keys}).drop(*[f"_r_{k}" for k in keys])


def semi_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def enrich(transactions: DataFrame, accounts: DataFrame, customers: DataFrame, how: str = "inner") -> DataFrame:
    """Transactions with their account's type and their customer's segment and country.

    accounts: account_id, customer_id, account_type; customers: customer_id, segment, country.
    """
    a = accounts.select("account_id", "customer_id", "account_type")
    c = customers.select("customer_id", "segment", F.col("country").alias("customer_country"))
    return join(join(transactions, a, "account_id", how), c, "customer_id", how)


def lookup(facts: DataFrame, dimension: DataFrame, key: str, value: str, small: int = SMALL) -> DataFrame:
    """Facts with the dimension's ``value`` for their ``key``, null where there is none.

    The dimension is broadcast if the optimizer's statistics bound it by ``small`` bytes. Without such a bound
    the choice is left to adaptive execution, which knows the size once it has read it. No job is run.
    """
    d = dimension.select(key, value)
    if plan_bytes(d) <= small:
        d = F.broadcast(d)
    return facts.join(d, key, "left")


def plan_bytes(df: DataFrame) -> int:
    """Bytes that the optimized plan's statistics give as the size of a result."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def changed_or_missing(source: DataFrame, target: DataFrame, key: str, tracked: list[str]) -> DataFrame:
    """Source rows without a target row, or whose tracked columns differ from it (null-safe)."""
    t = target.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_t_{c}") for c in tracked])
    differs = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in tracked))
    return source.join(t, F.col(key) == F.col("_k"), "left").where(F.col("_k").isNull() | differs).select(*source.columns)


def valid_at(facts: DataFrame, versions: DataFrame, key: str, ts: str, how: str = "inner") -> DataFrame:
    """Facts with the version of their key that was valid at their time: from <= ts < to."""
    v = versions.withColumnsRenamed({key: "_k"})
    on = (F.col(key) == F.col("_k")) & (F.col(ts) >= F.col("effective_from")) & (F.col(ts) < F.col("effective_to"))
    return facts.join(v, on, how).drop("_k")


def above_group_average(df: DataFrame, group: str, value: str, exact: str | None = None) -> DataFrame:
    """Rows whose value exceeds their group's average, with ``group_avg``. Groups meet as partial sums, rows are not gathered.

    ``exact``: a decimal type in which values are summed, so that the order of rows does not matter.
    """
    v = F.col(value).cast(exact) if exact else F.col(value)
    avg = df.groupBy(group).agg((F.sum(v).cast("double") / F.count(v)).alias("group_avg"))
    return df.join(avg, group).where(F.col(value) > F.col("group_avg"))


def missing_parents(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    p = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(p, child_key, "left_anti")
