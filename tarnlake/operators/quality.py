"""Declarative data quality: named rules, one-pass evaluation, quarantine with reasons."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QualityError

#: Vocabularies of the transaction rules.
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "AUD", "CAD", "SGD", "INR")
STATUSES = ("PENDING", "POSTED", "DECLINED", "REVERSED")


@dataclass(frozen=True)
class Expectation:
    """``row``: a condition each row must meet, null counts as failure. ``table``: an aggregate condition. One of both."""

    name: str
    row: Column | None = None
    table: Column | Callable[[DataFrame], bool] | None = None
    severity: str = "critical"
    column: str | None = None

    def __post_init__(self):
        if (self.row is None) == (self.table is None):
            raise ValueError(f"{self.name}: give a row or a table condition")
        if self.severity not in ("critical", "warn"):
            raise ValueError(f"{self.name}: severity {self.severity}")


@dataclass(frozen=True)
class Outcome:
    name: str
    passed: bool
    failed_rows: int
    total_rows: int
    severity: str
    column: str | None = None


@dataclass
class Report:
    outcomes: list[Outcome] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return all(o.passed for o in self.outcomes if o.severity == "critical")

    def to_json(self, **extra) -> str:
        return json.dumps({"passed": self.passed, **extra, "checks": [vars(o) for o in self.outcomes]}, sort_keys=True)

    def raise_if_failed(self) -> Report:
        if not self.passed:
            raise QualityError("; ".join(o.name for o in self.outcomes if not o.passed and o.severity == "critical"))
        return self


def _ok(e: Expectation) -> Column:
    return F.coalesce(e.row, F.lit(False))


def _rows(expectations: Iterable[Expectation], severities: Iterable[str] | None) -> list[Expectation]:
    return [e for e in expectations if e.row is not None and (severities is None or e.severity in severities)]


def checks(df: DataFrame, expectations: list[Expectation]) -> DataFrame:
    """A row to each rule with a column condition: check_name, severity, failed_rows, total_rows, passed. One aggregation."""
    use = [e for e in expectations if e.row is not None or isinstance(e.table, Column)]
    if not use:
        return df.sparkSession.createDataFrame([], "check_name string, severity string, failed_rows bigint, total_rows bigint, passed boolean")
    aggs = [(F.count_if(~_ok(e)) if e.row is not None else F.when(F.coalesce(e.table, F.lit(False)), F.lit(0)).otherwise(F.count("*"))).cast("long").alias(f"f{i}") for i, e in enumerate(use)]
    tests = [F.coalesce(e.table, F.lit(False)).alias(f"p{i}") for i, e in enumerate(use) if e.row is None]
    one = df.agg(F.count("*").alias("n"), *aggs, *tests)
    rows = [F.struct(F.lit(e.name).alias("check_name"), F.lit(e.severity).alias("severity"), F.col(f"f{i}").alias("failed_rows"), F.col("n").alias("total_rows"), (F.col(f"f{i}") == 0 if e.row is not None else F.col(f"p{i}")).alias("passed")) for i, e in enumerate(use)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def evaluate(df: DataFrame, expectations: list[Expectation]) -> Report:
    got = {r["check_name"]: r for r in checks(df, expectations).collect()}
    out = []
    for e in expectations:
        if e.name in got:
            r = got[e.name]
            out.append(Outcome(e.name, r["passed"], r["failed_rows"], r["total_rows"], e.severity, e.column))
        else:
            passed, n = bool(e.table(df)), df.count()
            out.append(Outcome(e.name, passed, 0 if passed else n, n, e.severity, e.column))
    return Report(out)


def failed(expectations: list[Expectation], severities: Iterable[str] | None = None) -> Column:
    """Whether any row rule fails; rules of severity "warn" count too unless ``severities`` says otherwise."""
    return reduce(lambda a, b: a | b, (~_ok(e) for e in _rows(expectations, severities)), F.lit(False))


def reasons(expectations: list[Expectation], severities: Iterable[str] | None = None) -> Column:
    """Names of the failed row rules in their order, joined by semicolons."""
    return F.concat_ws(";", *[F.when(~_ok(e), F.lit(e.name)) for e in _rows(expectations, severities)])


def split(df: DataFrame, expectations: list[Expectation], severities: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined with ``_dq_reason``): exact complements."""
    bad = failed(expectations, severities)
    return df.where(~bad), df.where(bad).withColumn("_dq_reason", reasons(expectations, severities))


def unique(*columns: str) -> Column:
    """No two rows agree in the columns; two nulls agree."""
    return F.count("*") == F.countDistinct(F.struct(*columns))


def transaction_rules(as_of: Column, id: str = "transaction_id", account: str = "account_id", amount: str = "amount", currency: str = "currency", ts: str = "transaction_timestamp", status: str = "status", currencies: Iterable[str] = CURRENCIES, statuses: Iterable[str] = STATUSES) -> list[Expectation]:
    return [
        Expectation("transaction_id_unique", table=unique(id), column=id),
        Expectation("account_id_not_null", F.col(account).isNotNull(), column=account),
        Expectation("amount_non_negative", F.col(amount).try_cast("double") >= 0, column=amount),
        Expectation("currency_valid", F.col(currency).isin(list(currencies)), column=currency),
        Expectation("timestamp_not_future", F.col(ts) <= as_of, column=ts),
        Expectation("status_valid", F.col(status).isin(list(statuses)), severity="warn", column=status),
    ]


def customer_rules(id: str = "customer_id", email: str = "email", first_name: str = "first_name") -> list[Expectation]:
    return [
        Expectation("customer_id_unique", table=unique(id), column=id),
        Expectation("email_present", F.col(email).isNotNull(), severity="warn", column=email),
        Expectation("first_name_present", F.length(first_name) > 0, column=first_name),
    ]


def referential_integrity(df: DataFrame, parent: DataFrame, child_key: str, parent_key: str, flag: str = "_has_parent") -> tuple[DataFrame, Expectation]:
    """The rows with a flag for "has a parent", and the rule on it. A null key has none."""
    p = parent.select(F.col(parent_key).alias("_p")).distinct().withColumn(flag, F.lit(True))
    d = df.join(p, F.col(child_key) == F.col("_p"), "left").drop("_p").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return d, Expectation(f"{child_key}_exists", F.col(flag), column=child_key)


def accepted_values(column: str, values: Iterable) -> Expectation:
    return Expectation(f"{column}_accepted", F.col(column).isNull() | F.col(column).isin(list(values)), column=column)


def not_null(column: str) -> Expectation:
    return Expectation(f"{column}_not_null", F.col(column).isNotNull(), column=column)
