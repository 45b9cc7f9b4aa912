"""Stream sources and sinks: Kafka, and folders of files for tests and backfills."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.history import append_events

ENVELOPE = "name string, source_app string, source_type string, message string"


def read_raw_stream(spark: SparkSession, topic: str = "raw_sensors", servers: str | None = None, path: str | None = None, starting: str = "latest", most: int | None = None, schema: str = ENVELOPE) -> DataFrame:
    """The raw stream's envelopes, from a Kafka topic or from a folder of JSON files. most: offsets (or files) a trigger."""
    if servers is None:
        reader = spark.readStream.schema(schema)
        return (reader.option("maxFilesPerTrigger", most) if most else reader).json(path)
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting} | ({"maxOffsetsPerTrigger": str(most)} if most else {})
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("_e"), F.col("timestamp").alias("received_at")).select("_e.*", "received_at")


def read_persist_stream(spark: SparkSession, servers: str | None = None, path: str | None = None, topics: tuple[str, ...] = ("raw_sensors", "high_level_events")) -> DataFrame:
    """Raw and derived envelopes together, for the events table."""
    return read_raw_stream(spark, ",".join(topics), servers, path)


def derived_records(payloads: DataFrame, topics: dict[str, str]) -> DataFrame:
    """key, value and topic of wrapped derived events; each event name has its topic."""
    spark = payloads.sparkSession
    table = spark.createDataFrame(list(topics.items()), "name string, topic string")
    return payloads.join(F.broadcast(table), "name").select(
        F.get_json_object("message", "$.user_id").alias("key"), F.to_json(F.struct("name", "source_app", "source_type", "message")).alias("value"), "topic"
    )


def write_derived(payloads: DataFrame, topics: dict[str, str], checkpoint: str, servers: str | None = None, path: str | None = None, **trigger):
    """Derived events to Kafka, or appended to a folder."""
    records = derived_records(payloads, topics)
    if servers is not None:
        writer = records.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
    else:
        writer = records.writeStream.format("json").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def persist_events(rows: DataFrame, path: str, checkpoint: str, **trigger):
    """Table rows (operators.ingest.shape_for_table) added to the events table, about every second; a batch that is retried
    replaces itself. The checkpoint's name tells streams apart that fill the same table."""
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def append(batch: DataFrame, number: int) -> None:
        append_events(batch, path, f"{stream}-{number}")

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
