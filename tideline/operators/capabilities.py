"""Capabilities of a derived event, read from its evidence: column expressions over an array of sources (schema.SOURCE).

register_capability(name) adds one: a function of the sources column that returns a column. Place names need the place
book and are joined on afterwards (operators.places)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.geo import haversine_m
from tideline.functions.schema import PLACE
from tideline.settings import KIND_FIELD, OWN_SOURCE

CAPABILITIES: dict[str, Callable[[Column], Column]] = {}

PAUSE_RADIUS_M, PAUSE_SECONDS = 60, 120


def register_capability(name: str):
    def add(make: Callable[[Column], Column]):
        CAPABILITIES[name] = make
        return make

    return add


def located(sources: Column) -> Column:
    return F.filter(sources, lambda s: s["lat"].isNotNull() & s["lon"].isNotNull())


def by_time(sources: Column) -> Column:
    """Sources in time order; equal times keep their order."""
    numbered = F.transform(sources, lambda s, i: F.struct(s["ts"].alias("t"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(numbered, lambda a, b: F.when((a["t"] < b["t"]) | ((a["t"] == b["t"]) & (a["i"] < b["i"])), -1).otherwise(1)), lambda x: x["s"])


def lineage(sources: Column) -> Column:
    return F.transform(sources, lambda s: F.struct(s["id"].alias("id"), s["name"].alias("name"), s["ts"].alias("timestamp")))


@register_capability("interval")
def interval(sources: Column) -> Column:
    """From the first to the last located source, or source if none is located."""
    used = F.transform(F.when(F.size(located(sources)) > 0, located(sources)).otherwise(sources), lambda s: s["ts"])
    a, b = F.array_min(used), F.array_max(used)
    return F.when(F.size(sources) > 0, F.struct(a.alias("started_at"), b.alias("ended_at"), (b - a).alias("duration_seconds")))


def _mean(points: Column, axis: str) -> Column:
    return F.try_divide(F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[axis]), F.size(points))


def _unnamed(lat: Column, lon: Column, spread: Column) -> Column:
    return F.struct(
        lat.alias("lat"), lon.alias("lon"), spread.alias("spread_m"), F.lit(None).alias("label"), F.lit(None).alias("distance_m"), F.lit(None).alias("everyday"), F.lit(None).alias("categories")
    ).cast(PLACE)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is named there."""
    return F.transform(F.array(value), use)[0]


def centre(points: Column) -> Column:
    """Mean position and the largest distance from it."""

    def of(ps: Column, mean: Column) -> Column:
        spread = F.array_max(F.transform(ps, lambda p: haversine_m(mean["lat"], mean["lon"], p["lat"], p["lon"])))
        return F.when(F.size(ps) > 0, _unnamed(mean["lat"], mean["lon"], F.round(spread, 1)))

    return bound(points, lambda ps: bound(F.struct(_mean(ps, "lat").alias("lat"), _mean(ps, "lon").alias("lon")), lambda mean: of(ps, mean)))


@register_capability("place")
def place(sources: Column) -> Column:
    return centre(located(sources))


def mode(sources: Column) -> Column:
    """The most frequent way of moving but standing; the first seen of equals."""
    ways = F.filter(F.flatten(F.transform(located(sources), lambda s: F.coalesce(s["motion"], F.array().cast("array<string>")))), lambda m: m.isNotNull() & (m != "stationary"))
    counted = F.transform(F.array_distinct(ways), lambda m: F.struct(F.size(F.filter(ways, lambda x: x == m)).alias("n"), (-F.array_position(ways, m)).alias("first"), m.alias("m")))
    return F.when(F.size(ways) > 0, F.array_max(counted)["m"])


@register_capability("journey")
def journey(sources: Column) -> Column:
    points = by_time(located(sources))
    n = F.size(points)
    first, last = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
    legs = F.zip_with(F.slice(points, F.lit(1), n - 1), F.slice(points, F.lit(2), n - 1), lambda a, b: haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]))
    path = F.aggregate(legs, F.lit(0.0), lambda acc, x: acc + x)
    straight = haversine_m(first["lat"], first["lon"], last["lat"], last["lon"])
    end = lambda p: _unnamed(p["lat"], p["lon"], F.lit(0.0))
    return F.when(
        n >= 2,
        F.struct(end(first).alias("origin"), end(last).alias("destination"), F.round(straight, 1).alias("straight_line_m"), F.round(path, 1).alias("path_m"), mode(sources).alias("mode")),
    )


def _names_by_first(rows: Column) -> Column:
    """Distinct names of rows (ts, name) by their first time, then name."""
    firsts = F.transform(
        F.array_distinct(F.transform(rows, lambda r: r["name"])),
        lambda n: F.struct(F.array_min(F.transform(F.filter(rows, lambda r: r["name"] == n), lambda r: r["ts"])).alias("t"), n.alias("n")),
    )
    return F.transform(F.array_sort(firsts), lambda x: x["n"])


@register_capability("vehicle")
def vehicle(sources: Column) -> Column:
    names = _names_by_first(F.filter(sources, lambda s: s["lat"].isNull() | s["lon"].isNull()))
    return F.when(F.size(names) > 0, F.struct(names.alias("evidence"), (F.size(names) >= 2).alias("confirmed")))


@register_capability("support")
def support(sources: Column) -> Column:
    """Geometry, and derived sources that aren't evidence of another source already."""
    inner = F.flatten(F.filter(F.transform(sources, lambda s: F.transform(s["parts"], lambda p: p["id"])), lambda x: x.isNotNull()))
    claims = F.filter(sources, lambda s: s["kind"].isNotNull() & ~F.coalesce(F.array_contains(inner, s["id"]), F.lit(False)))
    points = located(sources)
    geometry = F.transform(F.slice(points, 1, 1), lambda s: F.struct(F.array_min(F.transform(points, lambda p: p["ts"])).alias("ts"), F.lit("geometry").alias("name")))
    kinds = _names_by_first(F.concat(geometry, F.transform(claims, lambda s: F.struct(s["ts"].alias("ts"), s["name"].alias("name")))))
    level = F.when(F.size(kinds) >= 2, "corroborated").otherwise("single_source")
    return F.when(F.size(kinds) > 0, F.struct(level.alias("level"), kinds.alias("evidence_kinds")))


_PAUSE = "struct<first: int, last: int, t0: bigint, t1: bigint>"
_WALK = f"struct<lat: double, lon: double, n: int, first: int, t0: bigint, t1: bigint, i: int, begun: int, kept: array<{_PAUSE}>>"


@register_capability("pauses")
def pauses(sources: Column) -> Column:
    """Places between origin and destination where one stayed: clusters around a running centre, the outer two left out. The fold
    holds one running centre; of a cluster that ends only its bounds stay, and only if it was long enough, so that a step costs the
    same however many points there are. A pause's place comes from a second look at its points."""
    def fold(acc, p):
        near = (acc["n"] > 0) & (haversine_m(acc["lat"], acc["lon"], p["lat"], p["lon"]) <= PAUSE_RADIUS_M)
        n = F.when(near, acc["n"] + 1).otherwise(1)
        # the first cluster is the origin; the one that is open at the end is the destination
        stays = ~near & (acc["begun"] >= 2) & (acc["t1"] - acc["t0"] >= PAUSE_SECONDS)
        ended = F.array(F.struct(acc["first"].alias("first"), acc["i"].alias("last"), acc["t0"].alias("t0"), acc["t1"].alias("t1")))
        return F.struct(
            F.when(near, acc["lat"] + (p["lat"] - acc["lat"]) / n).otherwise(p["lat"]).alias("lat"),
            F.when(near, acc["lon"] + (p["lon"] - acc["lon"]) / n).otherwise(p["lon"]).alias("lon"),
            n.alias("n"),
            F.when(near, acc["first"]).otherwise(acc["i"] + 1).alias("first"),
            F.when(near, acc["t0"]).otherwise(p["ts"]).alias("t0"),
            p["ts"].alias("t1"),
            (acc["i"] + 1).alias("i"),
            (acc["begun"] + F.when(near, 0).otherwise(1)).alias("begun"),
            F.when(stays, F.concat(acc["kept"], ended)).otherwise(acc["kept"]).alias("kept"),
        ).cast(_WALK)

    zero = F.struct(*[F.lit(0).alias(c) for c in ("lat", "lon", "n", "first", "t0", "t1", "i", "begun")], F.array().alias("kept")).cast(_WALK)

    def pause(points: Column, k: Column) -> Column:
        place = centre(F.slice(points, k["first"], k["last"] - k["first"] + 1))
        return F.struct(k["t0"].alias("started_at"), k["t1"].alias("ended_at"), place.alias("place"), (k["t1"] - k["t0"]).alias("duration_seconds"))

    def of(points: Column) -> Column:
        found = bound(F.aggregate(points, zero, fold)["kept"], lambda kept: F.when(F.size(kept) > 0, F.transform(kept, lambda k: pause(points, k))))
        return F.when(F.size(points) >= 3, found)

    return bound(F.transform(by_time(located(sources)), lambda s: F.struct(s["lat"].alias("lat"), s["lon"].alias("lon"), s["ts"].alias("ts"))), of)


def shape(decisions: DataFrame, declared: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """Decisions (schema.DECISION) to payloads with the capabilities that each name declares, and rejected rows: those with
    a source without id."""
    broken = F.exists("sources", lambda s: s["id"].isNull())
    columns = {"derived_from": lineage(F.col("sources"))}
    for c, make in CAPABILITIES.items():
        names = [n for n, cs in declared.items() if c in cs]
        columns[c] = F.when(F.col("name").isin(names), make(F.col("sources"))) if names else F.lit(None)
    good = decisions.filter(~broken).withColumns(columns)
    return good.select("id", "name", F.col("kind").alias(KIND_FIELD), "user_id", F.col("ts").alias("timestamp"), *columns), decisions.filter(broken)


def wrapped(payloads: DataFrame) -> DataFrame:
    """The stream's envelope: name, source_app, source_type and the payload as JSON; absent capabilities stay out."""
    return payloads.select("name", F.lit(OWN_SOURCE).alias("source_app"), F.lit("kafka").alias("source_type"), F.to_json(F.struct(*payloads.columns)).alias("message"))
