"""Slowly changing dimensions, upserts and change-data replay, as joins and windows over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import surrogate_key
from .analytics import sample_hash
from .windows import deduplicate

HIGH_DATE = "9999-12-31 00:00:00"
VERSION = ["surrogate_key", "effective_from", "effective_to", "is_current"]


def _high(like: Column | None = None, kind: str = "timestamp") -> Column:
    return F.lit(HIGH_DATE).cast(kind)


def _differs(a: str, b: str, columns: Sequence[str]) -> Column:
    return reduce(lambda x, y: x | y, (~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns), F.lit(False))


def scd_type_1(current: DataFrame, updates: DataFrame, key: str, tracked: Sequence[str]) -> DataFrame:
    """Overwrite the tracked columns of known keys and append unknown keys. Updates hold a key once."""
    c, u = current.alias("c"), updates.withColumn("_u", F.lit(True)).alias("u")
    j = c.join(u, F.col(f"c.{key}") == F.col(f"u.{key}"), "full_outer")
    hit, new = F.col("u._u").isNotNull(), F.col(f"c.{key}").isNull()
    cols = []
    for name in current.columns:
        if name not in updates.columns:
            cols.append(F.col(f"c.{name}").alias(name))
        elif name in tracked:
            cols.append(F.when(hit, F.col(f"u.{name}")).otherwise(F.col(f"c.{name}")).alias(name))
        else:
            cols.append(F.when(new, F.col(f"u.{name}")).otherwise(F.col(f"c.{name}")).alias(name))
    return j.select(*cols)


def _versions(df: DataFrame, key: str, effective: str) -> DataFrame:
    kind = df.schema[effective].dataType.simpleString()
    stamp = F.date_format(effective, "yyyy-MM-dd HH:mm:ss")
    return df.withColumns(
        {"surrogate_key": surrogate_key("", F.col(key), stamp, digits=16), "effective_from": F.col(effective), "effective_to": _high(kind=kind), "is_current": F.lit(True)}
    )


def scd_type_2(
    dimension: DataFrame | None,
    incoming: DataFrame,
    key: str,
    tracked: Sequence[str],
    effective: str = "updated_at",
    as_of: Column | None = None,
    ties: Sequence[str] = (),
    strict: bool = False,
    close_missing: bool = False,
) -> DataFrame:
    """New state of a versioned dimension after a batch.

    The batch is reduced to its latest row of each key. New keys open a version; a change in a tracked
    column (null-safe) closes the open version at the change's time and opens another; equal rows
    change nothing. A null time counts as ``as_of``. ``strict`` ignores changes that are not newer than
    the open version; ``close_missing`` closes keys that the batch lacks at ``as_of``.
    """
    latest = deduplicate(incoming, [key], effective, ties)
    if as_of is not None:
        latest = latest.withColumn(effective, F.coalesce(F.col(effective), as_of))
    columns = [c for c in [key, *tracked, effective] if c in latest.columns]
    fresh = _versions(latest.select(*dict.fromkeys(columns)), key, effective)
    if dimension is None:
        return fresh
    d, f = dimension.alias("d"), fresh.alias("f")
    j = d.join(f, (F.col(f"d.{key}") == F.col(f"f.{key}")) & F.col("d.is_current"), "full_outer")
    newer = F.col("f.effective_from") > F.col("d.effective_from") if strict else F.lit(True)
    changed = F.col(f"d.{key}").isNotNull() & F.col(f"f.{key}").isNotNull() & _differs("d", "f", [c for c in tracked if c in dimension.columns]) & newer
    missing = F.col("d.is_current") & F.col(f"f.{key}").isNull() if close_missing else F.lit(False)
    end = F.when(changed, F.col("f.effective_from"))
    if close_missing:
        if as_of is None:
            raise ValueError("close_missing needs as_of")
        end = end.when(missing, as_of)
    closed = F.coalesce(changed | missing, F.lit(False))
    old = F.struct(
        *[F.when(closed, end).otherwise(F.col("d.effective_to")).alias(c) if c == "effective_to" else (F.col("d.is_current") & ~closed).alias(c) if c == "is_current" else F.col(f"d.{c}").alias(c) for c in dimension.columns]
    )
    new = F.struct(*[(F.col(f"f.{c}") if c in fresh.columns else F.lit(None).cast(dimension.schema[c].dataType)).alias(c) for c in dimension.columns])
    rows = F.array_compact(F.array(F.when(F.col(f"d.{key}").isNotNull(), old), F.when(F.col(f"d.{key}").isNull() | F.coalesce(changed, F.lit(False)), new)))
    return j.select(F.explode(rows).alias("r")).select("r.*")


def scd_type_2_history(changes: DataFrame, key: str, tracked: Sequence[str], effective: str, ties: Sequence[str] = ()) -> DataFrame:
    """All versions from a change log: rows that repeat the tracked values before them are dropped."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last(effective), *[F.asc_nulls_last(t) for t in ties])
    state = F.struct(*tracked)
    d = changes.withColumn("_before", F.lag(state).over(w)).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(state)).drop("_before")
    kind = changes.schema[effective].dataType.simpleString()
    to = F.coalesce(F.lead(effective).over(w), _high(kind=kind))
    d = _versions(d.withColumn("_to", to), key, effective)
    return d.withColumns({"effective_to": F.col("_to"), "is_current": F.col("_to") == _high(kind=kind)}).drop("_to")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Target with the source's rows merged in: known keys get the ``update`` columns (all by default), others are appended.

    The source holds a key once. One shuffle by key; both sides stay where their key is.
    """
    update = [c for c in (update or target.columns) if c not in keys]
    t, s = target.alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    on = reduce(lambda a, b: a & b, (F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys))
    j = t.withColumn("_t", F.lit(True)).alias("t").join(s, on, "full_outer")
    hit, known = F.col("s._s").isNotNull(), F.col("t._t").isNotNull()
    pick = lambda c: F.when(~known | (hit & F.lit(c in update)), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))
    return j.select(*[(pick(c) if c in source.columns else F.col(f"t.{c}")).alias(c) for c in target.columns])


def delete_insert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows with a source key go, all source rows come."""
    return target.join(source.select(*keys).distinct(), list(keys), "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def replay(snapshot: DataFrame, events: DataFrame, key: str, sequence: Sequence[str] = ()) -> DataFrame:
    """Latest state after change events (operation, primary_key, after_image, timestamp).

    Every event replaces its whole row, so the last one of each key decides: a DELETE removes the row,
    others put the after-image. ``sequence`` orders events of equal time.
    """
    order = F.struct(F.col("timestamp"), *[F.col(c) for c in sequence])
    last = events.groupBy("primary_key").agg(F.max_by(F.struct("operation", "after_image"), order).alias("e"))
    kept = snapshot.join(last.select(F.col("primary_key").alias(key)), key, "left_anti").select(*snapshot.columns)
    put = last.where("e.operation <> 'DELETE'").select(*[F.col(f"e.after_image.{c}").alias(c) for c in snapshot.columns])
    return kept.unionByName(put)


def synthesize_changes(snapshot: DataFrame, key: str, changes: dict[str, Column], n_updates: int, n_deletes: int, inserts: DataFrame | None = None, seed: int = 42, start: str = "2025-01-01 00:00:00") -> DataFrame:
    """Change events of a snapshot, as ``replay`` reads them: updates, then inserts, then deletes, one minute apart.

    Updated and deleted rows are those with the lowest seeded hashes of their key; ``changes`` gives the new values of
    updated columns, ``inserts`` the rows that come in. operation, primary_key, before_image, after_image, timestamp.
    """
    image = lambda d: F.struct(*[d[c] for c in snapshot.columns])
    none = F.lit(None).cast(snapshot.select(F.struct(*snapshot.columns)).schema.fields[0].dataType)

    def numbered(d: DataFrame, *order) -> DataFrame:
        # One task numbers the rows: they are as few as the events asked for.
        return d.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)

    order = (sample_hash(key, seed), F.col(key))
    chosen = numbered(snapshot.where(F.col(key).isNotNull()).orderBy(*order).limit(n_updates + n_deletes), *order)
    updated, gone = chosen.where(F.col("_i") < n_updates), chosen.where(F.col("_i") >= n_updates)
    after = F.struct(*[changes[c].cast(snapshot.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in snapshot.columns])
    events = updated.select(F.lit("UPDATE").alias("operation"), F.col(key).alias("primary_key"), image(updated).alias("before_image"), after.alias("after_image"), "_i")
    n_inserts = 0
    if inserts is not None:
        new = numbered(inserts.select(*snapshot.columns), key)
        n_inserts = inserts.count()
        events = events.unionByName(new.select(F.lit("INSERT").alias("operation"), F.col(key).alias("primary_key"), none.alias("before_image"), image(new).alias("after_image"), (F.col("_i") + n_updates).alias("_i")))
    events = events.unionByName(gone.select(F.lit("DELETE").alias("operation"), F.col(key).alias("primary_key"), image(gone).alias("before_image"), none.alias("after_image"), (F.col("_i") + n_inserts).alias("_i")))
    return events.select("operation", "primary_key", "before_image", "after_image", (F.lit(start).cast("timestamp") + F.make_dt_interval(mins=F.col("_i"))).alias("timestamp"))
