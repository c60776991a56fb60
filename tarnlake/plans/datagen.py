"""Deterministic bank tables for demonstrations and tests: every value is a hash of its key and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import CITIES
from ..operators.quality import CURRENCIES, STATUSES
from ..streaming.fraud import RULES

#: Vocabularies.
SEGMENTS = ("RETAIL", "PREMIUM", "PRIVATE", "BUSINESS")
ACCOUNT_TYPES = ("CHECKING", "SAVINGS", "CREDIT", "INVESTMENT")
CHANNELS = ("ONLINE", "ATM", "BRANCH", "MOBILE", "POS")
TXN_TYPES = ("DEBIT", "CREDIT", "TRANSFER", "PAYMENT", "WITHDRAWAL")
CATEGORIES = ("GROCERY", "TRAVEL", "FUEL", "DINING", "RETAIL", "HEALTH", "UTILITIES", "ENTERTAINMENT", "EDUCATION", "OTHER")
ROLES = ("TELLER", "MANAGER", "ANALYST", "ADVISOR", "AUDITOR")
TERMS = (12, 24, 36, 60, 120, 240, 360)
LOAN_STATES = ("ACTIVE", "PAID_OFF", "DEFAULTED")
TABLES = ("branches", "employees", "customers", "accounts", "cards", "merchants", "transactions", "loans", "payments", "fraud_events", "customer_changes")
START, DAYS = "2024-01-01 00:00:00", 730


class Bank:
    def __init__(self, spark: SparkSession, customers: int = 200, accounts: int = 400, merchants: int = 60, transactions: int = 2000, seed: int = 42):
        self.spark, self.seed = spark, seed
        self.n = {"customers": customers, "accounts": accounts, "merchants": merchants, "transactions": transactions, "cards": accounts // 2, "branches": 10, "employees": 50, "loans": max(customers // 4, 1), "payments": max(customers, 1)}

    def _unit(self, *what) -> Column:
        """A number in [0, 1) from the row's id and a label."""
        return F.pmod(F.xxhash64("id", *[F.lit(w) for w in what], F.lit(self.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def _below(self, n: int, *what) -> Column:
        return F.floor(self._unit(*what) * n).cast("long")

    def _pick(self, values, *what) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), self._below(len(values), *what).cast("int"))

    @staticmethod
    def _key(prefix: str, c: Column, width: int = 8) -> Column:
        return F.concat(F.lit(prefix), F.lpad(c.cast("string"), width, "0"))

    def _time(self, *what) -> Column:
        return F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + self._below(DAYS * 86400, *what))

    def table(self, name: str) -> DataFrame:
        """One of ``TABLES``; keys that refer to another table always have a row there."""
        d = self.spark.range(self.n.get(name, 0))
        key = F.col("id")
        if name == "branches":
            city = self._pick(list(CITIES), "city")
            return d.select(self._key("BR", key).alias("branch_id"), F.concat(F.lit("Branch "), key.cast("string")).alias("branch_name"), city.alias("city"))
        if name == "customers":
            share = self._unit("segment")
            segment = F.when(share < 0.6, SEGMENTS[0]).when(share < 0.85, SEGMENTS[1]).when(share < 0.9, SEGMENTS[2]).otherwise(SEGMENTS[3])
            return d.select(self._key("CUST", key).alias("customer_id"), F.concat(F.lit("First"), key.cast("string")).alias("first_name"), F.concat(F.lit("Last"), self._below(500, "last").cast("string")).alias("last_name"), F.concat(F.lit("user"), key.cast("string"), F.lit("@example.com")).alias("email"), self._pick(list(CITIES), "city").alias("city"), segment.alias("segment"), self._time("updated").alias("updated_at"))
        if name == "accounts":
            return d.select(self._key("ACC", key).alias("account_id"), self._key("CUST", self._below(self.n["customers"], "owner")).alias("customer_id"), self._pick(ACCOUNT_TYPES, "type").alias("account_type"), self._pick(CURRENCIES, "currency").alias("currency"), F.when(self._unit("status") < 0.8, "ACTIVE").otherwise("DORMANT").alias("status"), self._time("updated").alias("updated_at"))
        if name == "cards":
            return d.select(self._key("CARD", key).alias("card_id"), self._key("ACC", self._below(self.n["accounts"], "account")).alias("account_id"), self._pick(("DEBIT", "CREDIT"), "type").alias("card_type"), F.lit("ACTIVE").alias("status"))
        if name == "merchants":
            return d.select(self._key("MER", key).alias("merchant_id"), F.concat(F.lit("Merchant "), key.cast("string")).alias("merchant_name"), self._pick(CATEGORIES, "category").alias("category"))
        if name == "transactions":
            # The sum of two exponential draws: a gamma distribution of shape 2.
            amount = F.round(-120 * F.log((1 - self._unit("a")) * (1 - self._unit("b"))) + 1, 2)
            share = self._unit("status")
            status = F.when(share < 0.1, STATUSES[0]).when(share < 0.92, STATUSES[1]).when(share < 0.98, STATUSES[2]).otherwise(STATUSES[3])
            d = d.withColumn("ts", self._time("ts"))
            return d.select(self._key("TXN", key, 10).alias("transaction_id"), self._key("ACC", self._below(self.n["accounts"], "account")).alias("account_id"), self._key("MER", self._below(self.n["merchants"], "merchant")).alias("merchant_id"), self._pick(TXN_TYPES, "type").alias("transaction_type"), amount.alias("amount"), self._pick(CURRENCIES, "currency").alias("currency"), self._pick(CHANNELS, "channel").alias("channel"), status.alias("status"), (self._unit("fraud") < 0.015).cast("int").alias("fraud_flag"), F.col("ts").alias("transaction_timestamp"), F.col("ts").alias("updated_at"))
        if name == "employees":
            return d.select(self._key("EMP", key).alias("employee_id"), self._key("BR", self._below(self.n["branches"], "branch")).alias("branch_id"), F.concat(F.lit("Employee "), key.cast("string")).alias("full_name"), self._pick(ROLES, "role").alias("role"), F.round(30000 + 90000 * self._unit("salary"), 2).alias("salary"))
        if name == "loans":
            return d.select(self._key("LN", key).alias("loan_id"), self._key("CUST", self._below(self.n["customers"], "borrower")).alias("customer_id"), F.round(1000 + 249000 * self._unit("amount"), 2).alias("principal"), F.round(2 + 10 * self._unit("rate"), 2).alias("interest_rate"), self._pick(TERMS, "term").alias("term_months"), self._pick(LOAN_STATES, "status").alias("status"), self._time("start").alias("start_date"))
        if name == "payments":
            return d.select(self._key("PAY", key).alias("payment_id"), self._key("LN", self._below(self.n["loans"], "loan")).alias("loan_id"), F.round(50 + 1950 * self._unit("amount"), 2).alias("amount"), self._time("paid").alias("payment_date"), self._pick(("ON_TIME", "LATE", "MISSED"), "status").alias("status"))
        if name == "fraud_events":
            flagged = self.table("transactions").where("fraud_flag = 1")
            return flagged.select(F.concat(F.lit("FRD"), F.substring("transaction_id", 4, 10)).alias("fraud_event_id"), "transaction_id", F.get(F.array(*[F.lit(r) for r in RULES]), F.pmod(F.xxhash64("transaction_id"), F.lit(len(RULES))).cast("int")).alias("rule"), F.col("transaction_timestamp").alias("detected_at"))
        if name == "customer_changes":
            # A later version of every tenth customer: another segment or city.
            later = self.table("customers").withColumn("id", F.substring("customer_id", 5, 8).cast("long")).where("id % 10 = 0")
            return later.select("customer_id", "first_name", "last_name", "email", self._pick(list(CITIES), "moved").alias("city"), self._pick(SEGMENTS, "changed").alias("segment"), F.expr("updated_at + interval 30 days").alias("updated_at"))
        raise ValueError(f"unknown table: {name}")

    def faulty_customers(self, ratio: float = 0.03) -> DataFrame:
        """Customers of which max(2, n * ratio) lack their e-mail address or have a blank name, in turn."""
        n = self.n["customers"]
        bad = max(2, int(n * ratio))
        step = max(n // bad, 1)
        d = self.table("customers").withColumn("id", F.substring("customer_id", 5, 8).cast("long"))
        fault = F.when((F.col("id") % step == 0) & (F.col("id") / step < bad), (F.col("id") / step).cast("long") % 2)
        return d.withColumn("email", F.when(F.coalesce(fault == 0, F.lit(False)), F.lit(None)).otherwise(F.col("email"))).withColumn("first_name", F.when(F.coalesce(fault == 1, F.lit(False)), "").otherwise(F.col("first_name"))).drop("id")

    def write_all(self, folder: str) -> dict[str, int]:
        """Every table as Parquet below the folder, the faulty customers and transactions in place of the clean ones; rows of each."""
        out = {}
        for name in TABLES:
            d = {"customers": self.faulty_customers, "transactions": self.faulty_transactions}.get(name, lambda name=name: self.table(name))()
            d.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}.parquet")
            out[name] = d.count()
        return out

    def faulty_transactions(self, ratio: float = 0.03) -> DataFrame:
        """Transactions of which max(6, n * ratio) have one of six faults, in equal shares."""
        n = self.n["transactions"]
        bad = max(6, int(n * ratio))
        t = self.table("transactions").withColumn("id", F.substring("transaction_id", 4, 10).cast("long"))
        # Faults sit at evenly spaced rows, so they can be told without a sort of the table.
        step = max(n // bad, 1)
        fault = F.when((F.col("id") % step == 0) & (F.col("id") / step < bad), (F.col("id") / step).cast("long") % 6)
        t = t.withColumn("_f", fault)
        return t.select(
            F.when(F.col("_f") == 4, self._key("TXN", F.col("id") + 1, 10)).otherwise(F.col("transaction_id")).alias("transaction_id"),
            F.when(F.col("_f") == 3, F.lit(None)).when(F.col("_f") == 5, "ACC99999999").otherwise(F.col("account_id")).alias("account_id"),
            "merchant_id",
            "transaction_type",
            F.when(F.col("_f") == 0, -F.col("amount")).otherwise(F.col("amount")).alias("amount"),
            F.when(F.col("_f") == 1, "XXX").otherwise(F.col("currency")).alias("currency"),
            "channel",
            "status",
            "fraud_flag",
            F.when(F.col("_f") == 2, F.lit("2027-02-04 00:00:00").cast("timestamp")).otherwise(F.col("transaction_timestamp")).alias("transaction_timestamp"),
            "updated_at",
        )
