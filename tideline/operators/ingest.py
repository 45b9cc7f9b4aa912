"""Ingest normalisation: HTTP bodies to canonical events, record by record, with rejects and why.

Raw rows: path, body (JSON text), received_at (timestamp), source_key (where the record came from; makes ids repeatable)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.settings import KIND_FIELD

#: Fields that a producer's own may never overwrite.
RESERVED = ["event_name", "user_id", "timestamp"]


def once(column: Column) -> Column:
    """The column as a generated one, in select or withColumn: what filters and projections make of it later reads its value
    and doesn't parse again."""
    return F.explode(F.array(column))


def parse_path(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """/<domain>/<app>/... to event_domain and source_app; the rest of the path is ignored. Second: what has neither."""
    parts = F.split(F.regexp_replace(F.trim("path"), "^/", ""), "/")
    named = rows.withColumns({"event_domain": F.nullif(F.try_element_at(parts, F.lit(1)), F.lit("")), "source_app": F.nullif(F.try_element_at(parts, F.lit(2)), F.lit(""))})
    good = F.col("event_domain").isNotNull() & F.col("source_app").isNotNull()
    return named.filter(good), named.filter(~good).withColumn("reason", F.lit("no domain or app in the path"))


def route_by_domain(rows: DataFrame, domain: str = "sensors") -> DataFrame:
    return rows.filter(F.col("event_domain") == domain)


def route_by_app(rows: DataFrame, batched: list[str]) -> tuple[DataFrame, DataFrame]:
    """Apps with an adapter of their own, and the standard ones."""
    return rows.filter(F.col("source_app").isin(batched)), rows.filter(~F.col("source_app").isin(batched))


def shape_standard(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Standard bodies: `payload` (an object, or an object as text) is the message; its event_name becomes name, which also
    goes to the row. Second: rejects."""
    payload = F.coalesce(F.nullif(F.get_json_object("body", "$.payload"), F.lit("")), F.lit("{}"))
    fields = F.from_json(payload, "map<string,string>")
    keyed = rows.withColumn("_payload", payload).withColumn("_m", once(fields))
    has = lambda k: F.coalesce(F.array_contains(F.map_keys("_m"), k), F.lit(False))
    is_object = F.ltrim("_payload").startswith("{") & F.col("_m").isNotNull()
    reason = F.when(~F.coalesce(is_object, F.lit(False)), "payload is no object").when(~has("event_name"), "no event_name").when(~has("user_id"), "no user_id")
    judged = keyed.withColumn("reason", reason)
    merged = F.map_concat(F.map_filter("_m", lambda k, _: ~k.isin("event_name", "name")), F.create_map(F.lit("name"), F.try_element_at("_m", F.lit("event_name"))))
    good = judged.filter("reason is null").withColumns({"message": merged, "name": F.try_element_at("_m", F.lit("event_name"))}).drop("_m", "_payload", "reason")
    return good, judged.filter("reason is not null").drop("_m", "_payload")


_LOCATIONS = (
    "struct<locations: array<struct<geometry: struct<coordinates: array<double>>, properties: struct<device_id: string, timestamp: string, "
    "horizontal_accuracy: string, speed: string, battery_level: string, motion: string, activity: string, wifi: string>>>>"
)


def _epoch(text: Column) -> Column:
    """ISO time with an offset (with or without a colon, or Z) and up to nine digits of a fraction to epoch seconds."""
    tries = [F.try_to_timestamp(text, F.lit(f"yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]{zone}")) for zone in ("XXX", "Z")]
    return F.unix_timestamp(F.coalesce(*tries))


def explode_locations(rows: DataFrame) -> DataFrame:
    """A batch of GeoJSON points to pings; points that name no device, position or time, or whose accuracy is negative or no
    number, are rejected one by one; a batch without a usable point gives nothing."""
    points = rows.withColumn("_l", F.from_json("body", _LOCATIONS)).withColumn("_p", F.explode("_l.locations")).drop("_l")
    p = lambda c: F.col(f"_p.properties.{c}")
    acc = F.when(p("horizontal_accuracy").isNotNull(), F.coalesce(p("horizontal_accuracy").try_cast("double"), F.lit(-1.0)))
    speed, level = p("speed").try_cast("double"), p("battery_level").try_cast("double")
    as_list = F.filter(F.from_json(p("motion"), "array<string>"), lambda m: m.isNotNull())
    is_list = F.coalesce(F.ltrim(p("motion")).startswith("["), F.lit(False))
    plain = ~is_list & ~F.coalesce(F.ltrim(p("motion")).startswith("{"), F.lit(False)) & (p("motion") != "") & p("motion").try_cast("double").isNull()
    out = points.select(
        *[c for c in rows.columns if c != "body"],
        F.nullif(p("device_id"), F.lit("")).alias("user_id"),
        F.try_element_at("_p.geometry.coordinates", F.lit(2)).alias("lat"),
        F.try_element_at("_p.geometry.coordinates", F.lit(1)).alias("lon"),
        _epoch(p("timestamp")).alias("ts"),
        acc.alias("acc"),
        F.when(speed >= 0, F.round(speed * 3.6).cast("long")).alias("vel"),
        F.when(level >= 0, F.round(level * 100).cast("long")).alias("batt"),
        F.when(is_list & (F.size(as_list) > 0), as_list).when(plain, F.array(p("motion"))).alias("motion"),
        F.when(p("motion").isNotNull() & ~is_list & ~plain & (p("motion") != ""), p("motion")).alias("motion_raw"),
        F.nullif(p("activity"), F.lit("")).alias("activity"),
        F.nullif(p("wifi"), F.lit("")).alias("wifi"),
    )
    good = F.col("user_id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.coalesce("ts", F.lit(0)) != 0) & (F.coalesce("acc", F.lit(0.0)) >= 0)
    return out.filter(good).withColumn("name", F.lit("location_ping"))


def enrich(rows: DataFrame, key: str = "source_key") -> DataFrame:
    """Trims the message's keys, drops routing fields and gives an id where there is none: the same for the same record."""
    m = F.transform_keys("message", lambda k, _: F.trim(k))
    made = F.sha2(F.concat_ws(":", F.col(key), F.to_json("message")), 256)
    ident = F.coalesce(F.nullif(F.try_element_at(m, F.lit("id")), F.lit("")), made)
    message = F.map_concat(F.map_filter(m, lambda k, _: k != "id"), F.create_map(F.lit("id"), ident))
    return rows.drop("path", "event_domain", "body").withColumn("_message", once(message)).drop("message").withColumnRenamed("_message", "message")


def shape_for_table(rows: DataFrame) -> DataFrame:
    """Rows of the events table; those without an id go."""
    get = lambda k: F.try_element_at("message", F.lit(k))
    ts = get("timestamp").try_cast("bigint")
    return rows.filter(get("id").isNotNull()).select(
        get("id").alias("id"),
        get("user_id").alias("user_id"),
        "name",
        F.when(get(KIND_FIELD).isNotNull(), "derived").otherwise("raw").alias("event_class"),
        "source_app",
        ts.alias("ts"),
        F.timestamp_seconds(ts).alias("occurred_at"),
        F.col("received_at").alias("ingested_at") if "received_at" in rows.columns else F.current_timestamp().alias("ingested_at"),
        F.to_json("message").alias("message"),
        F.to_date(F.timestamp_seconds(ts)).alias("event_date"),
    )


def with_reserved(extra: Column, reserved: Column) -> Column:
    """Producer fields with the reserved ones on top."""
    return F.map_concat(F.map_filter(extra, lambda k, _: ~F.array_contains(F.map_keys(reserved), k)), reserved)


def normalise_mail(items: DataFrame) -> DataFrame:
    """Mail items (body: JSON) to rows ordered by time; items without id go."""
    j = lambda path: F.get_json_object("body", path)
    address = F.coalesce(j("$.from.value[0].address"), j("$.from"))
    snippet = F.substring(F.trim(F.regexp_replace(F.coalesce(j("$.snippet"), j("$.text"), F.lit("")), r"\s+", " ")), 1, 1000)
    date = F.regexp_replace(F.coalesce(j("$.date"), j("$.Date")), r"^[A-Za-z]{3},\s*|\s*\([A-Z]+\)$", "")  # no weekday, no zone name
    when = F.coalesce(_epoch(date), F.unix_timestamp(F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss Z"))), F.lit(0))
    return (
        items.filter(F.coalesce(j("$.id"), F.lit("")) != "")
        .select(
            j("$.id").alias("upstream_id"),
            j("$.threadId").alias("thread_id"),
            j("$.subject").alias("subject"),
            address.alias("from"),
            j("$.from.value[0].name").alias("from_name"),
            F.when(F.instr(address, "@") > 0, F.lower(F.element_at(F.split(address, "@"), -1))).alias("from_domain"),
            F.from_json(j("$.labels"), "array<string>").alias("labels"),
            snippet.alias("snippet"),
            when.alias("ts"),
        )
        .orderBy("ts", "upstream_id")
    )
