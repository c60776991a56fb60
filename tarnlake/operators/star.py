"""Star schema: dimensions with hashed surrogate keys and the transaction fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import date_key, surrogate_key
from .joins import lookup

#: dimension -> (key, surrogate column, prefix, columns)
DIMENSIONS = {
    "customer": ("customer_id", "customer_sk", "CUSTSK_", ["first_name", "last_name", "segment", "city", "country"]),
    "account": ("account_id", "account_sk", "ACCSK_", ["customer_id", "account_type", "currency", "status"]),
    "card": ("card_id", "card_sk", "CARDSK_", ["account_id", "card_type", "status"]),
    "merchant": ("merchant_id", "merchant_sk", "MERSK_", ["merchant_name", "category", "country"]),
    "branch": ("branch_id", "branch_sk", "BRSK_", ["branch_name", "city", "country"]),
}


def dimension(df: DataFrame, name: str) -> DataFrame:
    """Surrogate key, natural key and those of the dimension's columns that are there."""
    key, sk, prefix, columns = DIMENSIONS[name]
    return df.select(surrogate_key(prefix, key).alias(sk), key, *[c for c in columns if c in df.columns])


def date_dimension(df: DataFrame, ts: str = "transaction_timestamp") -> DataFrame:
    """A row to each day from the first to the last; empty for an empty table."""
    bounds = df.agg(F.min(F.to_date(ts)).alias("lo"), F.max(F.to_date(ts)).alias("hi")).where("lo is not null")
    d = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))
    return d.select(
        date_key("date").alias("date_sk"),
        "date",
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
        F.date_format("date", "EEEE").alias("day_of_week"),
    )


FACT = ["transaction_id", "account_sk", "merchant_sk", "date_sk", "transaction_type", "amount", "currency", "channel", "status", "fraud_flag"]


def transaction_fact(transactions: DataFrame, dim_account: DataFrame, dim_merchant: DataFrame, ts: str = "transaction_timestamp") -> DataFrame:
    """Transactions with the keys of their account, merchant and day; a key without a dimension row is null."""
    d = lookup(transactions.withColumn("date_sk", date_key(ts)), dim_account, "account_id", "account_sk")
    d = lookup(d, dim_merchant, "merchant_id", "merchant_sk")
    return d.select(*[c for c in FACT if c in d.columns])
