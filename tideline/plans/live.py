"""From the stream's envelopes to derived envelopes, in one piece for batch and stream: envelope, router, capabilities with
place names, envelope. Both forms share every step but the router's, which has its batch and its keyed stateful form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import capabilities
from tideline.operators.places import match_places
from tideline.plans import router
from tideline.plans.definitions import Definition
from tideline.staging import staged
from tideline.streaming.router import route_stream


def from_envelopes(envelopes: DataFrame) -> DataFrame:
    """Router input of envelopes (name, message as JSON and, where it is known, received_at): id, user_id, name, ts, lat, lon,
    acc, motion, arrival_seq. Events without a whole number as timestamp have no place in time and go. arrival_seq is the
    time of receipt in microseconds, else the event's time; equal ones are ordered by event time and id."""
    j = lambda k: F.get_json_object("message", f"$.{k}")
    number = j("timestamp").try_cast("double")
    ts = F.when(number == F.floor(number), number.try_cast("bigint"))
    arrival = F.unix_micros(F.col("received_at").cast("timestamp")) if "received_at" in envelopes.columns else ts * 1_000_000
    return envelopes.select(
        j("id").alias("id"),
        j("user_id").alias("user_id"),
        "name",
        ts.alias("ts"),
        *[j(c).try_cast("double").alias(c) for c in ("lat", "lon", "acc")],
        F.from_json(j("motion"), "array<string>").alias("motion"),
        arrival.alias("arrival_seq"),
    ).filter("ts is not null and name is not null")


def with_place_names(payloads: DataFrame, places: DataFrame) -> DataFrame:
    """Payloads with the names of place, of both ends of journey, and of pauses."""
    spots = {"place": F.col("place"), "origin": F.col("journey.origin"), "destination": F.col("journey.destination")}
    points = None
    for role, spot in spots.items():
        p = payloads.filter(spot.isNotNull()).select("id", F.lit(role).alias("role"), F.lit(-1).alias("i"), spot.alias("_p"))
        points = p if points is None else points.unionByName(p)
    inner = payloads.select("id", F.lit("pause").alias("role"), F.posexplode("pauses").alias("i", "_q")).select("id", "role", "i", F.col("_q.place").alias("_p"))
    points = points.unionByName(inner).distinct().select(F.concat_ws(":", "role", "i", "id").alias("key"), "id", "role", "i", F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"))
    found = match_places(points.select("key", "id", "role", "i", "lat", "lon"), places, "key").filter("label is not null")
    name = F.struct("label", "distance_m", "everyday", "categories")
    per = found.groupBy(F.col("id").alias("_id")).agg(
        *[F.max(F.when(F.col("role") == r, name)).alias(f"_{r}") for r in spots], F.map_from_entries(F.collect_list(F.when(F.col("role") == "pause", F.struct("i", name.alias("n"))))).alias("_pauses")
    )  # an event has few pauses

    def named(spot, n):
        return F.when(spot.isNotNull(), F.struct(spot["lat"].alias("lat"), spot["lon"].alias("lon"), spot["spread_m"].alias("spread_m"), *[n[c].alias(c) for c in ("label", "distance_m", "everyday", "categories")]))

    joined = payloads.join(per, F.col("id") == F.col("_id"), "left")
    j = F.col("journey")
    journey = F.struct(named(j["origin"], F.col("_origin")).alias("origin"), named(j["destination"], F.col("_destination")).alias("destination"), *[j[c].alias(c) for c in ("straight_line_m", "path_m", "mode")])
    pause = lambda p, i: F.struct(p["started_at"].alias("started_at"), p["ended_at"].alias("ended_at"), named(p["place"], F.try_element_at("_pauses", i)).alias("place"), p["duration_seconds"].alias("duration_seconds"))
    return joined.withColumns({"place": named(F.col("place"), F.col("_place")), "journey": F.when(j.isNotNull(), journey), "pauses": F.when(F.col("pauses").isNotNull(), F.transform("pauses", pause))}).select(payloads.columns)


def payloads(decisions: DataFrame, definitions: list[Definition], places: DataFrame | None = None) -> DataFrame:
    """Decisions with the capabilities that their definitions declare, as payloads."""
    declared = {d.name: tuple(d.capabilities) for d in definitions}
    shaped, _ = capabilities.shape(decisions, declared)
    return shaped if places is None else with_place_names(shaped, places)


def derive(envelopes: DataFrame, definitions: list[Definition], places: DataFrame | None = None) -> DataFrame:
    """Derived envelopes of a batch of raw ones. Decisions are written once: place names are looked up from them several times."""
    decisions = staged(router.run(from_envelopes(envelopes), definitions), "decisions")
    return capabilities.wrapped(payloads(decisions, definitions, places))


def derive_stream(
    envelopes: DataFrame, definitions: list[Definition], write: Callable[[DataFrame, int], None], checkpoint: str, places: Callable[[], DataFrame] | None = None, **trigger
):
    """Starts a stream of derived envelopes; write(batch, number) puts each micro-batch away and has to replace a batch that is
    retried. places: asked for the place book before each micro-batch (sources.history.PlaceBook.current reloads it)."""

    def put(decisions: DataFrame, number: int) -> None:
        # written once, so that a micro-batch is routed once however often its decisions are read
        write(capabilities.wrapped(payloads(staged(decisions, "decisions"), definitions, places() if places else None)), number)

    routed = route_stream(from_envelopes(envelopes), definitions)
    return routed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
