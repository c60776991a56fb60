"""Column expressions: bands, keys, dates, geography. All are JVM built-ins."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres, and city -> (latitude, longitude, country).
EARTH_RADIUS_KM = 6371.0
CITIES = {
    "New York": (40.7128, -74.0060, "US"),
    "London": (51.5074, -0.1278, "GB"),
    "Paris": (48.8566, 2.3522, "FR"),
    "Tokyo": (35.6762, 139.6503, "JP"),
    "Sydney": (-33.8688, 151.2093, "AU"),
    "Berlin": (52.5200, 13.4050, "DE"),
    "Toronto": (43.6532, -79.3832, "CA"),
    "Singapore": (1.3521, 103.8198, "SG"),
    "Dubai": (25.2048, 55.2708, "AE"),
    "Mumbai": (19.0760, 72.8777, "IN"),
}


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def amount_band(amount: str | Column, high: float = 5000, medium: float = 500) -> Column:
    """HIGH, MEDIUM or LOW; a null amount is LOW."""
    a = column(amount)
    return F.when(a >= high, "HIGH").when(a >= medium, "MEDIUM").otherwise("LOW")


def cents_to_currency(cents: str | Column, places: int = 2) -> Column:
    """Cents as units of the currency, rounded half up."""
    return F.round(column(cents).cast("decimal(18,2)") / F.lit(100).cast("decimal(5,0)"), places)


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """a / b; null where b is zero."""
    return column(a) / F.nullif(column(b), F.lit(0))


def surrogate_key(prefix: str, *parts: str | Column, digits: int = 12, sep: str = "|") -> Column:
    """``prefix`` and the first hexadecimal digits of the sha1 of the joined parts."""
    joined = F.concat_ws(sep, *[column(p).cast("string") for p in parts]) if len(parts) > 1 else column(parts[0]).cast("string")
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined.cast("binary")), 1, digits))


def date_key(ts: str | Column) -> Column:
    """yyyymmdd as an integer."""
    return F.date_format(column(ts), "yyyyMMdd").cast("int")


def email_is_valid(c: str | Column) -> Column:
    return column(c).rlike(r"^[^@]+@[^@]+\.[^@]+$")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null where a coordinate is."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(h))


def city_coordinate(city: str | Column, which: int) -> Column:
    """Latitude (0) or longitude (1) of a known city, else null. The table is a literal of fixed size."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v[which]))) for k, v in CITIES.items()))
    return F.try_element_at(table, column(city))


def check_identifier(name: str) -> str:
    """The name itself, if it is a plain SQL identifier."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", name or ""):
        raise ValueError(f"not a plain identifier: {name!r}")
    return name
