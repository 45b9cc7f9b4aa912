"""Distances and speeds, as column expressions and as plain numbers for keyed folds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere's radius in metres, and the speed above which a jump is taken for a bad fix.
EARTH_RADIUS_M = 6_371_000.0
MAX_SPEED_KMH = 400.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null where a coordinate is."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))  # least() would pass over a null


def implied_speed_kmh(lat1: Column, lon1: Column, t1: Column, lat2: Column, lon2: Column, t2: Column) -> Column:
    """0 without movement; infinite for a movement in no time."""
    d, dt = haversine_m(lat1, lon1, lat2, lon2), (t2 - t1).cast("double")
    return F.when(d <= 0, F.lit(0.0)).when(dt <= 0, F.lit(float("inf"))).otherwise(d / dt * 3.6)


def is_implausible_jump(lat1, lon1, t1, lat2, lon2, t2, max_kmh: float = MAX_SPEED_KMH) -> Column:
    return implied_speed_kmh(lat1, lon1, t1, lat2, lon2, t2) > max_kmh


def accurate_enough(acc: Column, max_accuracy_m: float) -> Column:
    """A fix without a stated accuracy passes."""
    return acc.isNull() | (acc <= max_accuracy_m)


def distance(a: tuple[float, float], b: tuple[float, float]) -> float:
    """haversine_m for two (lat, lon) pairs of numbers."""
    dlat, dlon = math.radians(b[0] - a[0]) / 2, math.radians(b[1] - a[1]) / 2
    h = math.sin(dlat) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(dlon) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


def jump(a: tuple[float, float], t1: float, b: tuple[float, float], t2: float, max_kmh: float = MAX_SPEED_KMH) -> bool:
    d = distance(a, b)
    return d > 0 and (t2 <= t1 or d / (t2 - t1) * 3.6 > max_kmh)
