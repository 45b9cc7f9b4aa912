"""Schemas of events, evidence and derived payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.settings import KIND_FIELD

#: Evidence that travels with a decision; `parts` is the evidence of a derived source.
PART = "struct<id: string, name: string, ts: bigint, lat: double, lon: double, acc: double, motion: array<string>, kind: string>"
SOURCE = PART[:-1] + f", parts: array<{PART}>>"
#: An event on its way through the router; `sources` is what a derived one cites, with the parts of these.
EVENT = PART[:-1] + f", sources: array<{SOURCE}>>"
DECISION = f"user_id string, seq bigint, sub int, name string, kind string, id string, ts bigint, score double, sources array<{SOURCE}>"

PLACE = "struct<lat: double, lon: double, spread_m: double, label: string, distance_m: double, everyday: boolean, categories: array<string>>"
PAYLOAD = (
    f"id string, name string, {KIND_FIELD} string, user_id string, timestamp bigint, "
    "derived_from array<struct<id: string, name: string, timestamp: bigint>>, "
    "interval struct<started_at: bigint, ended_at: bigint, duration_seconds: bigint>, "
    f"place {PLACE}, "
    f"journey struct<origin: {PLACE}, destination: {PLACE}, straight_line_m: double, path_m: double, mode: string>, "
    "vehicle struct<evidence: array<string>, confirmed: boolean>, "
    "support struct<level: string, evidence_kinds: array<string>>, "
    f"pauses array<struct<started_at: bigint, ended_at: bigint, place: {PLACE}, duration_seconds: bigint>>"
)
PAYLOAD_FIELDS = ["id", "name", KIND_FIELD, "user_id", "timestamp", "derived_from", "interval", "place", "journey", "vehicle", "support", "pauses"]
REQUIRED = ["id", "name", KIND_FIELD, "user_id", "timestamp"]

#: The entity of events without one.
NO_USER = "_no_user_id"


def entity(df: DataFrame, column: str = "user_id"):
    """The key that events are grouped by."""
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(NO_USER))


def contract_violations(payloads: DataFrame, column: str = "message") -> DataFrame:
    """Rows of JSON payloads with unknown or missing fields, with their names."""
    keys = F.json_object_keys(F.col(column))
    unknown = F.array_except(keys, F.array(*map(F.lit, PAYLOAD_FIELDS)))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), keys)
    return payloads.withColumns({"unknown": unknown, "missing": missing}).filter(
        keys.isNull() | (F.size("unknown") > 0) | (F.size("missing") > 0)
    )
