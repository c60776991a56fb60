"""Fraud rules over card events, as stateful streaming and as batch windows.

Rules: HIGH_VALUE (amount), VELOCITY (too many events in a span), IMPOSSIBLE_TRAVEL (speed between the
cities of one customer's events). The streaming form follows arrival order, late events included; the
batch form orders by event time. Both agree when events arrive in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.expressions import CITIES, EARTH_RADIUS_KM, city_coordinate, haversine_km


@dataclass(frozen=True)
class FraudConfig:
    high_value: float = 5000.0
    window_seconds: int = 60
    max_events: int = 3
    max_speed_kmh: float = 900.0
    #: Hours of event time without an event after which a customer is forgotten.
    forget_hours: float = 24.0


RULES = ("HIGH_VALUE", "VELOCITY", "IMPOSSIBLE_TRAVEL")
ALERT = "transaction_id string, customer_id string, rule string, severity string, detail string"
SCORED = f"{ALERT}, is_late boolean"
_Scored = Row("transaction_id", "customer_id", "rule", "severity", "detail", "is_late")
EVENT = "transaction_id string, customer_id string, account_id string, amount double, currency string, merchant string, city string, timestamp timestamp"


def _places(cities: np.ndarray) -> np.ndarray:
    """Latitude and longitude in radians of each city; NaN where it is not known."""
    return np.radians(np.array([CITIES[c][:2] if c in CITIES else (np.nan, np.nan) for c in cities], float).reshape(-1, 2))


@dataclass
class CustomerState:
    """What the rules know of one customer: times in the velocity span, and time and city of the newest event."""

    recent: list[float]
    place: tuple[float, str] | None = None
    newest: float | None = None

    def score(self, e: dict[str, Any], config: FraudConfig) -> tuple[bool, list[tuple[str, str, str]]]:
        """(late, alerts as (rule, severity, detail)) of the next event."""
        late, alerts = self.score_batch(np.array([e["at"]], float), np.array([e["amount"]], float), np.array([e["city"]], object), config)
        return bool(late[0]), [a[1:] for a in alerts]

    def score_batch(self, t: np.ndarray, amount: np.ndarray, city: np.ndarray, config: FraudConfig) -> tuple[np.ndarray, list[tuple[int, str, str, str]]]:
        """(late, alerts as (event, rule, severity, detail)) of events in arrival order; no loop over events."""
        n = len(t)
        start = -np.inf if self.newest is None else self.newest
        highest = np.maximum.accumulate(np.concatenate([[start], t]))
        late = t < highest[:-1]
        # An arrival drops times from the front of the span's list as long as they are too old for it. The first
        # time that stays is the first as new as the strictest limit so far, and those limits and the running
        # maximum of the times both ascend, so one binary search finds all fronts.
        times = np.concatenate([self.recent, t])
        most = np.maximum.accumulate(times)
        front = np.searchsorted(most, most[len(self.recent) :] - config.window_seconds, "left")
        count = np.arange(len(self.recent) + 1, len(times) + 1) - front
        # Where the customer was: the last event before this one that was not older than all before it.
        at = np.concatenate([[self.place[0] if self.place else np.nan], t])
        where = np.concatenate([np.array([self.place[1] if self.place else None], object), city])
        newer = np.where(t >= highest[:-1], np.arange(1, n + 1), 0)
        last = np.maximum.accumulate(np.concatenate([[0], newer]))
        here, there = _places(city), _places(where[last[:-1]])
        hours = np.abs(t - at[last[:-1]]) / 3600
        half = np.sin((here - there) / 2) ** 2
        km = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(half[:, 0] + np.cos(here[:, 0]) * np.cos(there[:, 0]) * half[:, 1]))
        speed = np.divide(km, hours, out=np.zeros(n), where=hours > 0)
        alerts = [(i, 0, "HIGH_VALUE", "HIGH", f"amount {amount[i]:.0f} >= {config.high_value:.0f}") for i in np.flatnonzero(amount >= config.high_value).tolist()]
        alerts += [(i, 1, "VELOCITY", "MEDIUM", f"{count[i]} events in {config.window_seconds}s") for i in np.flatnonzero(count > config.max_events).tolist()]
        alerts += [(i, 2, "IMPOSSIBLE_TRAVEL", "HIGH", f"{where[last[i]]}->{city[i]} at {speed[i]:.0f} km/h") for i in np.flatnonzero(speed > config.max_speed_kmh).tolist()]
        if n:
            self.recent = times[front[-1] :].tolist()
            self.newest = float(highest[-1])
            self.place = (float(at[last[-1]]), where[last[-1]])
        return late, [(i, *a) for i, _, *a in sorted(alerts)]


class FraudProcessor(StatefulProcessor):
    """Keeps a ``CustomerState`` to each customer; rows of a batch are taken in the order of ``seq``.

    With ``timers``, for streams with a watermark, the state of a customer is dropped once the watermark is
    ``config.forget_hours`` past the newest event; the next event is then scored as the customer's first.
    """

    def __init__(self, config: FraudConfig, timers: bool = False):
        self.config, self.timers = config, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("customer", "recent array<double>, place_at double, place_city string, newest double")

    def _ends(self, newest: float) -> int:
        """Milliseconds at which the state may go."""
        return int((newest + self.config.forget_hours * 3600) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.state.get()
        if kept is not None and self._ends(kept[3]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Most calls hold a few rows, so what a call costs counts: plain rows, no data frames, and the state is read once.
        s, kept = CustomerState([]), self.state.get()
        if kept is not None:
            recent, at, city, newest = kept
            s = CustomerState(list(recent), None if at is None else (at, city), newest)
        events = sorted(rows, key=lambda e: e["seq"])
        late, alerts = s.score_batch(*(np.array([e[c] for e in events], k) for c, k in (("at", float), ("amount", float), ("city", object))), self.config)
        self.state.update((s.recent, s.place[0] if s.place else None, s.place[1] if s.place else None, s.newest))
        if self.timers:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(self._ends(s.newest))
        loud = {i for i, *_ in alerts}
        found = alerts + [(i, None, None, None) for i in np.flatnonzero(late).tolist() if i not in loud]
        return iter([_Scored(events[i]["transaction_id"], key[0], *alert, bool(late[i])) for i, *alert in found])

    def close(self) -> None:
        pass


def drop_duplicates(events: DataFrame, key: str = "transaction_id", within: str | None = "1 hour", ts: str = "timestamp") -> DataFrame:
    """First arrival of each key.

    ``within`` bounds the state by a watermark: an event older than the newest by more than that is dropped, and
    so never scored, and a repeat that comes later than that counts as new. None drops nothing and keeps every
    key for ever.
    """
    if within is None:
        return events.dropDuplicates([key])
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def alerts(events: DataFrame, config: FraudConfig = FraudConfig(), within: str | None = "1 hour") -> DataFrame:
    """Alerts of a stream of events with an arrival number ``seq``; late events without an alert have a null rule.

    Without ``within`` there is no watermark: no event is dropped, and no state ever is.
    """
    # Only what the rules need goes to Python; of the time, seconds as a number, and the column with the watermark where there is one.
    at = F.coalesce(F.unix_micros("timestamp"), F.lit(-(1 << 63))) / F.lit(1e6)
    d = drop_duplicates(events, within=within).withColumn("at", at).select("transaction_id", "customer_id", "amount", "city", "seq", "at", *["timestamp"] * (within is not None))
    return d.groupBy("customer_id").transformWithState(FraudProcessor(config, within is not None), SCORED, "Append", "None" if within is None else "EventTime")


def windowed_counts(events: DataFrame, ts: str = "timestamp", size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", *keys: str) -> DataFrame:
    """Events and amounts by time window (tumbling, or sliding with ``slide``) and keys; works on streams and tables."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("events"), F.sum("amount").alias("amount"))


# --- batch forms ------------------------------------------------------------------------------


def high_value(df: DataFrame, amount: str = "amount", limit: float = 5000.0) -> DataFrame:
    return df.where(F.col(amount) >= limit)


def velocity(df: DataFrame, key: str, ts: str, seconds: int = 60, most: int = 3) -> DataFrame:
    """Events with more than ``most`` events of their key in the closed span that ends with them; adds ``events_in_window``."""
    n = F.expr(f"count(*) OVER (PARTITION BY `{key}` ORDER BY `{ts}` RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW)")
    return df.withColumn("events_in_window", n).where(F.col("events_in_window") > most)


def impossible_travel(df: DataFrame, key: str, ts: str, city: str, speed: float = 900.0) -> DataFrame:
    """Events whose distance from the one before needs more than ``speed`` km/h; adds previous_city, km and kmh."""
    w = Window.partitionBy(key).orderBy(ts)
    d = df.withColumns({"previous_city": F.lag(city).over(w), "_t": F.lag(ts).over(w)})
    km = haversine_km(*(city_coordinate(c, i) for c in ("previous_city", city) for i in (0, 1)))
    hours = F.expr(f"timestampdiff(MICROSECOND, _t, `{ts}`)") / F.lit(3.6e9)
    d = d.withColumn("km", km).withColumn("kmh", F.try_divide("km", hours))
    return d.where(F.col("kmh") > speed).drop("_t")


def late_events(df: DataFrame, key: str, ts: str, arrival: str) -> DataFrame:
    """Events older than one of their key that arrived before them; of events that arrive at once none is before another."""
    # By time among equal arrivals, where an event finds only older ones ahead of it, whatever order the rows come in.
    w = Window.partitionBy(key).orderBy(arrival, ts).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_seen", F.max(ts).over(w)).where(F.col(ts) < F.col("_seen")).drop("_seen")


def summary(events: DataFrame, alerts: DataFrame, seen: DataFrame | None = None, key: str = "transaction_id") -> DataFrame:
    """One row on what was consumed: processed and duplicate events, late ones, alerts, and alerts of each rule.

    ``events`` are all that arrived, ``alerts`` what the rules found of them; ``seen`` are events of earlier runs.
    """
    ids = events.select(key)
    known = ids if seen is None else ids.join(seen.select(key).distinct(), key, "left_anti")
    read = ids.agg(F.count("*").alias("_all")).crossJoin(known.groupBy(key).agg(F.lit(1).alias("_one")).agg(F.count("*").alias("processed")))  # one row each
    late = F.count_distinct(F.when(F.col("is_late"), F.col(key)))
    found = alerts.agg(late.alias("late"), F.count("rule").alias("alerts"), *[F.count_if(F.col("rule") == r).alias(r.lower()) for r in RULES])
    return read.crossJoin(found).select("processed", (F.col("_all") - F.col("processed")).alias("duplicates"), "late", "alerts", *[r.lower() for r in RULES])
