"""Windowed reads and the spend report. `as_of` is a parameter, never the clock, so reports can be repeated."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.sessions import in_cells, size_of, sizes_in
from tideline.staging import staged

DAY = 86_400
TOP = 8


def entities(events: DataFrame) -> DataFrame:
    return events.select("user_id").distinct().orderBy("user_id")


def check_days(days: int) -> int:
    if not 1 <= days <= 90:
        raise ValueError("days must be from 1 to 90")
    return days


def trailing_days(events: DataFrame, user: str | None, as_of: date, days: int) -> DataFrame:
    """A user's (or everyone's) events of the last `days` whole UTC days, as_of's included, in order. Events without a time
    drop out. The bound is a literal, so partitions and row groups outside are not read."""
    first = as_of - timedelta(days=check_days(days) - 1)
    rows = events.filter(F.col("occurred_at") >= F.lit(first.isoformat()).cast("timestamp"))
    return (rows if user is None else rows.filter(F.col("user_id") == user)).orderBy("occurred_at", "id")


def bounds(as_of: date, days: int) -> dict[str, int]:
    """Epoch seconds of the window [start, end) and of the equally long window before it."""
    end = int((as_of - date(1970, 1, 1)).days + 1) * DAY
    start = end - check_days(days) * DAY
    return {"start": start, "end": end, "previous": start - days * DAY}


def payments(events: DataFrame, name: str, body: str = "message") -> DataFrame:
    """(id, user_id, ts, amount, merchant) from JSON bodies; amounts that are no numbers are null."""
    return events.filter(F.col("name") == name).select(
        "id", "user_id", "ts", F.get_json_object(body, "$.amount").try_cast("decimal(18,2)").alias("amount"), F.coalesce(F.get_json_object(body, "$.merchant"), F.lit("unknown")).alias("merchant")
    )


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], extra: Column | None = None, width: int = DAY) -> DataFrame:
    """points (id, ts) with the shortest span (span_id, lo, hi, ...) that contains each, both ends included; nulls without
    one. Spans lie in cells of their own size, two at most, and points are looked up once for each size that occurs: an equality
    join with a check, not a product."""
    spans = staged(spans, "spans")
    lo, hi, ts = F.col("lo"), F.col("hi"), F.col("ts")
    s = in_cells(spans.withColumn("_own", F.array(size_of(lo, hi, width))), lo, hi, F.col("_own"), width).drop("_own", "_wide")
    p = in_cells(points.crossJoin(sizes_in((spans, lo, hi), width=width)), ts, ts, F.col("_sizes"), width).drop("_sizes", "_wide")
    inside = p.join(s, [*keys, "_size", "_cell"]).filter((lo <= ts) & (ts <= hi))
    if extra is not None:
        inside = inside.filter(extra)
    best = Window.partitionBy("id").orderBy(F.col("hi") - F.col("lo"), "span_id")
    taken = inside.withColumn("_k", F.row_number().over(best)).filter("_k = 1")
    columns = [c for c in spans.columns if c not in keys]
    return points.join(taken.select("id", *columns), "id", "left")


def located_payments(pay: DataFrame, stays: DataFrame, window_end: int) -> DataFrame:
    """Payments with the labelled stay they fall in; only stays emitted from the payment on, until a day after the window.
    stays: user_id, span_id, lo, hi, emitted_at, label."""
    later = (F.col("emitted_at") >= F.col("ts")) & (F.col("emitted_at") < window_end + DAY)
    return innermost(pay, stays.filter("label is not null"), ["user_id"], later)


def by_day(pay: DataFrame, start: int, end: int) -> DataFrame:
    """(day, n, total) for every day of [start, end), also without payments."""
    spark = pay.sparkSession
    days = spark.range(start // DAY, end // DAY).select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    sums = pay.filter((F.col("ts") >= start) & (F.col("ts") < end)).groupBy(F.to_date(F.timestamp_seconds("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total")
    )
    return days.join(sums, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0).cast("decimal(28,2)")).alias("total"))


def merchants(located: DataFrame, top: int = TOP) -> DataFrame:
    """Totals by place name, or by merchant where there is none; the top ones."""
    who = F.coalesce("label", "merchant")
    sums = located.groupBy(who.alias("who")).agg(F.bool_or(F.col("label").isNotNull()).alias("placed"), F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    return sums.orderBy(F.desc("total"), "who").limit(top)


def report(pay: DataFrame, stays: DataFrame, as_of: date, days: int, top: int = TOP) -> DataFrame:
    """One row: total, n, matched, prev_total, delta (null without a previous total), by_day and merchants as arrays."""
    b = bounds(as_of, days)
    now = pay.filter((F.col("ts") >= b["start"]) & (F.col("ts") < b["end"]))
    before = pay.filter((F.col("ts") >= b["previous"]) & (F.col("ts") < b["start"])).agg(F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(28,2)")).alias("prev_total"))
    located = located_payments(now, stays, b["end"])
    sums = located.agg(F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(28,2)")).alias("total"), F.count(F.lit(1)).alias("n"), F.count("label").alias("matched"))
    per_day = by_day(now, b["start"], b["end"]).agg(F.sort_array(F.collect_list(F.struct("day", "n", "total"))).alias("by_day"))
    names = merchants(located, top).agg(F.collect_list(F.struct("who", "placed", "n", "total")).alias("merchants"))
    delta = F.when(F.col("prev_total") != 0, (F.col("total") - F.col("prev_total")) / F.col("prev_total"))
    return sums.crossJoin(before).crossJoin(per_day).crossJoin(names).withColumn("delta", delta)  # each is one row


def latest_preferences(log: DataFrame, users: DataFrame) -> DataFrame:
    """Each user's last written preferences (level map, hidden array), or the defaults. log: user_id, level, hidden, updated_at."""
    last = log.groupBy("user_id").agg(F.max_by(F.struct("level", "hidden"), "updated_at").alias("_p"))
    none = F.create_map().cast("map<string,int>"), F.array().cast("array<string>")
    return users.select("user_id").distinct().join(last, "user_id", "left").select(
        "user_id", F.coalesce("_p.level", none[0]).alias("level"), F.coalesce("_p.hidden", none[1]).alias("hidden")
    )
