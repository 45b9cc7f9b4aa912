"""Timeline analytics. Timeline rows: id, user_id, name, ts, lo, hi (interval bounds, null for moments), and what a query
needs of label, everyday, mode, amount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.spend import innermost

#: The names of spans, what replaces what, and when silence counts.
SPANS = ["car_trip", "trip", "stay", "journey"]
REPLACED_BY = [("car_trip", "journey"), ("car_trip", "trip"), ("trip", "journey")]
DRIVES = ["journey", "trip", "car_trip"]
GAP_SECONDS, SILENCE_SECONDS, LEAST_LANES = 45 * 60, 50 * 60, 3
VERBS = {"payment": "Paid", "location_ping": "Location", "got_into_the_car": "Got in", "got_out_the_car": "Got out"}


def is_span() -> Column:
    return F.col("name").isin(SPANS) & F.col("lo").isNotNull()


def begins() -> Column:
    return F.coalesce("lo", "ts")


def ends() -> Column:
    return F.coalesce("hi", "ts")


def day_of(ts: Column) -> Column:
    return F.to_date(F.timestamp_seconds(ts))


def hosts(rows: DataFrame) -> DataFrame:
    """Moments with the shortest span that covers them (host_id, host_name), or nulls."""
    moments = rows.filter(~is_span()).select("id", "user_id", "name", "ts")
    spans = rows.filter(is_span()).select("user_id", F.col("id").alias("span_id"), F.col("name").alias("host_name"), "lo", "hi")
    return innermost(moments, spans, ["user_id"]).withColumnRenamed("span_id", "host_id").drop("lo", "hi")


def orphans(rows: DataFrame) -> DataFrame:
    return hosts(rows).filter("host_id is null").select("id", "user_id", "name", "ts")


def superseded(rows: DataFrame, rules=REPLACED_BY) -> DataFrame:
    """Ids of spans that a span of a replacing type overlaps, ends included, whichever day they are shown on. A sweep: a span is
    overlapped if, of the replacing ones that begin up to its end, the latest to end does so after its beginning. So one sorted
    window says it, and no pair is made. A span has a row for each type that it asks for, and one if it replaces others: spans are
    made once, and not in the task that sweeps."""
    no_time, no_id = F.lit(None).cast("long"), F.lit(None).cast("string")
    row = lambda by, at, end, id_, lo: F.struct(by.alias("by"), at.cast("long").alias("at"), end.cast("long").alias("end"), id_.cast("string").alias("id"), lo.cast("long").alias("lo"))
    lo, hi = F.col("lo"), F.col("hi")
    asks = [F.when(F.col("name") == n, row(F.lit(by), hi, no_time, F.col("id"), lo)) for n, by in rules]
    replaces = F.when(F.col("name").isin(sorted({b for _, b in rules})), row(F.col("name"), lo, hi, no_id, no_time))
    roles = rows.filter(is_span()).select("user_id", F.explode(F.array_compact(F.array(*asks, replaces))).alias("_r")).select("user_id", "_r.*")
    begun = Window.partitionBy("user_id", "by").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = roles.withColumn("_last", F.max("end").over(begun))
    return swept.filter(F.col("id").isNotNull() & (F.col("_last") >= F.col("lo"))).select("id").distinct()


def standing(rows: DataFrame, rules=REPLACED_BY) -> DataFrame:
    """Spans that nothing replaces."""
    return rows.filter(is_span()).join(superseded(rows, rules), "id", "left_anti")


def not_everyday(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.coalesce("everyday", F.lit(False)))


def ladder(depths: DataFrame, overrides: DataFrame, names: DataFrame) -> DataFrame:
    """(user_id, name, lane): deep types on top, users' overrides clamped, unseen types on the bottom lane.
    depths: name, depth; overrides: user_id, level map; names: user_id, name."""
    lanes = depths.agg(F.greatest(F.lit(LEAST_LANES), F.max("depth")).alias("_lanes"))  # one row
    rows = names.join(depths, "name", "left").join(overrides, "user_id", "left").crossJoin(lanes)
    clamp = lambda c: F.greatest(F.lit(1), F.least(c, F.col("_lanes")))
    own = F.try_element_at("level", F.col("name"))  # least() and greatest() pass over nulls, so they are asked for first
    lane = F.when(own.isNotNull(), clamp(own)).when(F.col("depth").isNotNull(), clamp(F.col("_lanes") - F.col("depth") + 1)).otherwise(F.col("_lanes"))
    return rows.select("user_id", "name", lane.cast("int").alias("lane"))


def visibility(altitude: Column, lane: Column, hidden: Column) -> Column:
    return F.when(hidden, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), altitude - lane + 1)))


def daily_totals(rows: DataFrame, payment: str = "payment", rules=REPLACED_BY) -> DataFrame:
    """(user_id, day, driving_seconds, spent)."""
    drives = standing(rows, rules).filter(F.col("name").isin(DRIVES) & (F.col("mode").isNull() | (F.col("mode") == "driving")))
    driving = drives.select("user_id", day_of(F.col("lo")).alias("day"), (F.col("hi") - F.col("lo")).alias("driving_seconds"), F.lit(None).cast("decimal(18,2)").alias("spent"))
    paid = rows.filter(F.col("name") == payment).select(
        "user_id", day_of(F.col("ts")).alias("day"), F.lit(None).cast("bigint").alias("driving_seconds"), F.coalesce(F.col("amount"), F.lit(0)).cast("decimal(18,2)").alias("spent")
    )
    both = driving.unionByName(paid)
    return both.groupBy("user_id", "day").agg(
        F.coalesce(F.sum("driving_seconds"), F.lit(0)).alias("driving_seconds"), F.coalesce(F.sum("spent"), F.lit(0).cast("decimal(28,2)")).alias("spent")
    )


def days_present(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", day_of(F.col("ts")).alias("day")).agg(F.sort_array(F.collect_set("name")).alias("names"))


def day_spine(rows: DataFrame, rules=REPLACED_BY) -> DataFrame:
    """Each day's spans that stand and aren't at everyday places, in order."""
    kept = not_everyday(standing(rows, rules)).withColumn("day", day_of(F.col("lo")))
    return kept.withColumn("place_in_day", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("lo", "id")))


def quiet_gaps(spans: DataFrame, least: int = GAP_SECONDS) -> DataFrame:
    """(user_id, day, gap_start, gap_end) of more than `least` seconds between a day's spans (lo, hi)."""
    rows = spans.withColumn("day", day_of(F.col("lo")))
    before = Window.partitionBy("user_id", "day").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("gap_start", F.max("hi").over(before))
    return rows.filter(F.col("lo") - F.col("gap_start") > least).select("user_id", "day", "gap_start", F.col("lo").alias("gap_end"))


def silences(rows: DataFrame, least: int = SILENCE_SECONDS) -> DataFrame:
    """Gaps over `least` seconds between a day's instants (starts, ends and moments) that no span covers."""
    spans = rows.filter(is_span()).select("user_id", "lo", "hi")
    instants = rows.select("user_id", F.explode(F.array(begins(), ends())).alias("lo")).select("user_id", "lo", F.col("lo").alias("hi"))
    return quiet_gaps(spans.unionByName(instants), least)


def latest_journey(rows: DataFrame, rules=REPLACED_BY) -> DataFrame:
    drives = standing(rows, rules).filter(F.col("name").isin(DRIVES))
    return drives.groupBy("user_id").agg(F.max_by(F.struct("id", "name", "lo", "hi"), F.struct("hi", "id")).alias("_j")).select("user_id", "_j.*")


def title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def label(place_label: Column, name: Column) -> Column:
    verbs = F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv])
    return F.coalesce(place_label, F.try_element_at(verbs, name), title(name))


def route_text(origin: Column, destination: Column) -> Column:
    return F.when(destination.isNotNull(), F.concat(F.lit("to "), destination)).when(origin.isNotNull(), F.concat(F.lit("from "), origin))


def duration_text(seconds: Column) -> Column:
    minutes = F.round(seconds / 60).cast("long")
    hours = F.floor(minutes / 60)
    return F.when(minutes < 60, F.format_string("%d min", minutes)).when(minutes % 60 == 0, F.format_string("%d h", hours)).otherwise(F.format_string("%d h %d min", hours, minutes % 60))
