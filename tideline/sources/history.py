"""The events table, the place book, and replacing re-derived history."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.sources.table import EventsTable

def read_events(spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """The events table; of a window's days only, if one is given."""
    return EventsTable(spark, path).read(since and since.date(), until and until.date())


def append_events(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds rows. batch: <stream>-<number>; one that is there already adds nothing again, so that it may be retried."""
    stream, _, number = (batch or "").rpartition("-")
    EventsTable(rows.sparkSession, path).append(rows, stream if batch else None, int(number) if batch else None)


def scan_signals(events: DataFrame, user: str | None, since: datetime, until: datetime, names: list[str]) -> DataFrame:
    """Raw history of a window in canonical order (arrival_seq: arrival, event time, id), canonical fields from the columns and
    the whole body kept. User, names and the day range are pushed to the scan."""
    rows = events.filter(
        F.col("name").isin(names) & (F.col("event_class") == "raw") & (F.col("occurred_at") >= F.lit(since)) & (F.col("occurred_at") < F.lit(until))
    )
    if "event_date" in events.columns:
        rows = rows.filter((F.col("event_date") >= F.lit(since.date())) & (F.col("event_date") <= F.lit(until.date())))
    if user is not None:
        rows = rows.filter(F.col("user_id") == user)
    order = Window.partitionBy("user_id").orderBy("ingested_at", "ts", "id")
    j = lambda k, t: F.get_json_object("message", f"$.{k}").try_cast(t)
    rows = rows.withColumn("arrival_seq", F.row_number().over(order).cast("long"))
    for k, t in (("lat", "double"), ("lon", "double"), ("acc", "double")):
        if k not in rows.columns:
            rows = rows.withColumn(k, j(k, t))
    if "motion" not in rows.columns:
        rows = rows.withColumn("motion", F.from_json(F.get_json_object("message", "$.motion"), "array<string>"))
    return rows


def load_places(spark: SparkSession, source: str | DataFrame, **jdbc: str) -> DataFrame:
    """Enabled places of interest: name, lat, lon, radius_m, everyday, categories. source: a Parquet path, a DataFrame, or a
    table name with JDBC options."""
    rows = source if isinstance(source, DataFrame) else spark.read.format("jdbc").options(dbtable=source, **jdbc).load() if jdbc else spark.read.parquet(source)
    return rows.filter(F.col("enabled") & (F.col("kind") == "poi")).select("name", "lat", "lon", "radius_m", "everyday", "categories")


class PlaceBook:
    """A place book that is reloaded when older than ttl seconds. A reload that fails keeps the old book and isn't tried again
    before the next ttl; ttl 0 never reloads."""

    def __init__(self, load: Callable[[], DataFrame], ttl: float = 1800, clock: Callable[[], float] = time.monotonic):
        self.load, self.ttl, self.clock = load, ttl, clock
        self.book, self.at, self.error = load(), clock(), None

    def current(self) -> DataFrame:
        if self.ttl > 0 and self.clock() - self.at >= self.ttl:
            self.at = self.clock()
            try:
                self.book, self.error = self.load(), None
            except Exception as e:  # the stream goes on with the book it has
                self.error = e
        return self.book


class HistoryExists(ValueError):
    """Derived events of the window are there already."""


def rederive(spark: SparkSession, path: str, fresh: DataFrame, links: DataFrame, names: list[str], since: datetime, until: datetime, replace: bool = False) -> dict[str, int]:
    """Replaces derived events of a window of the events table, and their lineage, by fresh ones, in one step; without `replace`
    refuses if there are any. Returns how many were there by name."""
    table = EventsTable(spark, path)
    old = table.read(since.date(), until.date()).filter(
        (F.col("event_class") == "derived") & F.col("name").isin(names) & (F.col("occurred_at") >= F.lit(since)) & (F.col("occurred_at") < F.lit(until))
    )
    there = {r["name"]: r["n"] for r in old.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    if there and not replace:
        raise HistoryExists(f"already derived: {there}; pass replace=True to replace them")
    table.replace(old.select("id"), fresh, links)
    return there
