"""The signal view over the events table, in Spark and in DuckDB: the same columns from the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import table


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, entity, name, ts, seq, lat, lon, acc, value, k and motion of every event."""
    e = table(spark, sf_dir, "events")
    entity = F.col("user_id") % 10
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    day = F.floor(t / 86400)
    return e.select(
        F.concat(F.lit("e"), F.col("event_id")).alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        entity.cast("string").alias("entity"),
        F.col("event_type").alias("name"),
        t.alias("ts"),
        F.col("event_id").alias("seq"),
        (F.lit(47.2) + F.lit(0.02) * ((entity + day) % 5) + F.lit(0.0001) * (F.col("event_id") % 7)).alias("lat"),
        (F.lit(8.5) + F.lit(0.0001) * (F.col("event_id") % 5)).alias("lon"),
        (F.lit(10) + F.col("event_id") % 120).cast("double").alias("acc"),
        F.col("value").alias("value"),
        F.get_json_object("props", "$.k").alias("k"),
    )


SIG = """sig AS (
  SELECT 'e' || event_id AS id, user_id::VARCHAR AS user_id, (user_id % 10)::VARCHAR AS entity, event_type AS name,
    floor(epoch_us(ts) / 1000000)::BIGINT AS ts, event_id AS seq,
    47.2::DOUBLE + 0.02::DOUBLE * (((user_id % 10) + floor(floor(epoch_us(ts) / 1000000) / 86400)::BIGINT) % 5) + 0.0001::DOUBLE * (event_id % 7) AS lat,
    8.5::DOUBLE + 0.0001::DOUBLE * (event_id % 5) AS lon, (10 + event_id % 120)::DOUBLE AS acc, value, json_extract_string(props, '$.k') AS k
  FROM events)"""

HAVERSINE = (
    "(CASE WHEN {a} + {b} + {c} + {d} IS NOT NULL THEN 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))) END)"
)


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return HAVERSINE.format(a=lat1, b=lat2, c=lon1, d=lon2)
