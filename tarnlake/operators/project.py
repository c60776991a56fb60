"""Projections, filters, casts and null handling."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASTS = {"date": "date", "timestamp": "timestamp", "datetime": "timestamp", "decimal": "decimal(18,2)", "float": "double", "int": "int", "string": "string"}


def filter_valid(df: DataFrame, min_amount: float = 0.0, account: str = "account_id", amount: str = "amount", status: str = "status") -> DataFrame:
    """Rows with an account, an amount above the minimum and a status other than REVERSED. A null status fails."""
    return df.where(F.col(account).isNotNull() & (F.col(amount) > min_amount) & (F.col(status) != "REVERSED"))


def select_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The columns, in this order; KeyError names those that are missing."""
    wanted = dict.fromkeys(columns)
    if absent := wanted.keys() - set(df.columns):
        raise KeyError(f"missing columns: {sorted(absent)}")
    return df.select(*wanted)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename; names that are not there are ignored."""
    return df.withColumnsRenamed(dict(names))


def cast_types(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    """Cast the columns that are there; a value that does not fit becomes null."""
    unknown = sorted(set(casts.values()) - CASTS.keys())
    if unknown:
        raise ValueError(f"unknown types: {unknown}")
    return df.withColumns({c: F.col(c).try_cast(CASTS[t]) for c, t in casts.items() if c in df.columns})


def drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.dropna(subset=subset)


def fill_nulls(df: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    return df.fillna({c: v for c, v in defaults.items() if c in df.columns})


def conditional_default(df: DataFrame, column: str, condition_column: str, when: Any, default: Any) -> DataFrame:
    """Set ``column`` to ``default`` where ``condition_column`` equals ``when``."""
    return df.withColumn(column, F.when(F.col(condition_column) == F.lit(when), F.lit(default)).otherwise(F.col(column)))


def in_vocabulary(column: str, values: Iterable[Any]) -> Column:
    """Whether the column holds one of a short list of values; null where it is null."""
    return F.col(column).isin(list(values))


def with_date_parts(df: DataFrame, ts: str, day: bool = False, drop_null: bool = False) -> DataFrame:
    """Add year and month (and day) for partitioned writes."""
    parts = {"year": F.year(ts), "month": F.month(ts)} | ({"day": F.dayofmonth(ts)} if day else {})
    return (df.where(F.col(ts).isNotNull()) if drop_null else df).withColumns(parts)


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structures as columns with joined names; arrays and maps as JSON text; empty structures vanish."""

    def leaves(schema, path: tuple[str, ...]):
        for f in schema.fields:
            here = (*path, f.name)
            if f.dataType.typeName() == "struct":
                yield from leaves(f.dataType, here)
            else:
                c = F.col(".".join(f"`{p}`" for p in here))
                yield (F.to_json(c) if f.dataType.typeName() in ("array", "map") else c).alias(sep.join(here))

    return df.select(*leaves(df.schema, ()))
