"""Scalar functions of the learners and of the trip data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in meters."""
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(a) * F.sin(a) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(b) * F.sin(b)
    return F.lit(EARTH_RADIUS_M) * 2 * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(1.0) - h, F.lit(0.0))))


def trip_type(duration: Column, limit: float) -> Column:
    """1 for long trips, 2 for short ones, null if the duration is."""
    return F.when(duration > limit, F.lit(1)).when(duration <= limit, F.lit(2))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def gini(q: Column) -> Column:
    """1 - sum q^2 of an array of shares."""
    return F.lit(1.0) - F.aggregate(q, F.lit(0.0), lambda s, x: s + x * x)


def entropy(q: Column) -> Column:
    """Entropy in bits of an array of shares; a share of 0 adds nothing."""
    return F.aggregate(q, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0)))


def split_quality(left: Column, right: Column, tau: float = 0.5) -> Column:
    """The quality used with shares of the node total: g(left) - tau g(left) - (1-tau) g(right)."""
    return gini(left) - F.lit(tau) * gini(left) - F.lit(1 - tau) * gini(right)


def pad(text: Column, width: int, with_: str = " ") -> Column:
    return F.lpad(text.cast("string"), width, with_)


def trip_calendar(ts: Column) -> tuple[Column, Column, Column]:
    """(date, hour, weekday with 0 = Sunday)."""
    return F.to_date(ts), F.hour(ts), F.dayofweek(ts) - 1


def polyline(text: Column) -> Column:
    """``[[lon,lat],..]`` as ARRAY<ARRAY<DOUBLE>>; null if malformed."""
    return F.from_json(text, "array<array<double>>")


def path_length(points: Column) -> Column:
    """Meters along an array of (lon, lat) points; 0 for fewer than two."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    legs = F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), lambda p, q: haversine(p[1], p[0], q[1], q[0]))
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)


def duration_minutes(n_points: Column) -> Column:
    """One point every 15 seconds."""
    return n_points * 15 / 60


def speed_kmh(meters: Column, minutes: Column) -> Column:
    return F.try_divide(meters / 1000, minutes / 60)
