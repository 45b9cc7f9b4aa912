"""The router: all definitions over entities' events in arrival order, derived events fed on to the definitions that read them.

Definitions don't feed each other in circles, so they are stages: each reads raw events and what earlier stages derived, in one order.
A derived event comes after the raw event that caused it and before the next one; among those that one raw event causes, first come
those that it sets off itself, in the order of definitions, then those that these set off. `path` holds that order: the number of
steps, the path of the event that set it off, the place of the definition, and its place there.

A stage is plans.detect.detected: cut at reset points, folded in parallel. What several stages or variants read is written once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.schema import DECISION, EVENT, PART, SOURCE, entity
from tideline.plans.definitions import Definition, Plan
from tideline.plans.detect import ROW, SEGMENT, detected
from tideline.staging import staged

COLUMNS = ["user_id", "seq", "sub", "name", "kind", "id", "ts", "score", "sources"]
EVENT_COLUMNS = ["id", "name", "ts", "lat", "lon", "acc", "motion"]
_TYPES = {"lat": "double", "lon": "double", "acc": "double", "motion": "array<string>"}


def with_arrival(events: DataFrame) -> DataFrame:
    """events with arrival_seq: their place in an entity's arrival order (arrival, event time, id)."""
    first = F.col("ingested_at") if "ingested_at" in events.columns else F.col("ts")
    order = Window.partitionBy("user_id").orderBy(first, "ts", "id")
    return events.withColumn("arrival_seq", F.row_number().over(order).cast("long"))


def event_rows(events: DataFrame, names: list[str]) -> DataFrame:
    """Events (user_id, id, name, ts, arrival_seq and, where there are any, lat, lon, acc, motion) as rows of stages."""
    have = set(events.columns)
    columns = [F.col(c) if c in have else F.lit(None).cast(_TYPES[c]).alias(c) for c in EVENT_COLUMNS]
    event = F.struct(*columns, F.lit(None).alias("kind"), F.lit(None).alias("sources")).cast(EVENT)
    ts = F.col("ts").cast("long")
    return events.filter(F.col("name").isin(names)).select(
        entity(events).alias("user_id"),
        F.struct(F.col("arrival_seq").cast("long").alias("seq"), ts.alias("ts"), F.col("id").alias("id")).alias("o"),
        F.array().cast("array<int>").alias("path"),
        event.alias("event"),
        ts.alias("lo"),
        ts.alias("hi"),
    )


def minted(name: str):
    """The same evidence always gives the same id, so retries and replays don't duplicate events."""
    ids = F.array_sort(F.transform("sources", lambda s: F.coalesce(s["id"], F.lit("None"))))
    return F.sha2(F.concat_ws(":", "user_id", F.lit(name), F.col("ts").cast("string"), ids), 256)


def decided(rows: DataFrame, d: Definition, plan: Plan, segment: int) -> DataFrame:
    """ROW and score of what one definition derives."""
    found = detected(rows, plan.folds[d.name], segment)
    place = list(plan.definitions).index(d.name)  # readers of one event are in the order of definitions
    steps = F.when(F.size("path") == 0, F.lit(1)).otherwise(F.element_at("path", 1) + 1)
    path = F.concat(F.array(steps), F.col("path"), F.array(F.lit(place), F.col("k")))
    bare = lambda e: F.struct(*[e[c].alias(c) for c in (*EVENT_COLUMNS, "kind")])
    cited = lambda e: F.struct(*[e[c].alias(c) for c in (*EVENT_COLUMNS, "kind")], F.transform(e["sources"], bare).cast(f"array<{PART}>").alias("parts"))
    found = found.withColumn("sources", F.transform("sources", cited).cast(f"array<{SOURCE}>"))
    located = F.filter("sources", lambda s: s["lat"].isNotNull() & s["lon"].isNotNull())
    times = F.transform(F.when(F.size(located) > 0, located).otherwise(F.col("sources")), lambda s: s["ts"])
    event = F.struct(minted(d.name).alias("id"), F.lit(d.name).alias("name"), F.col("ts").alias("ts"), *[F.lit(None).alias(c) for c in ("lat", "lon", "acc", "motion")], F.lit(d.engine).alias("kind"), F.col("sources"))
    return found.select(
        "user_id", "o", path.alias("path"), event.cast(EVENT).alias("event"), F.coalesce(F.array_min(times), "ts").alias("lo"), F.coalesce(F.array_max(times), "ts").alias("hi"), "score"
    )


def run(events: DataFrame, definitions: list[Definition], variants: dict[str, list[Definition]] | None = None, segment: int = SEGMENT) -> DataFrame:
    """Decisions over events (user_id, id, name, ts, arrival_seq and, where there are any, lat, lon, acc, motion).

    With variants the result has a `variant` column. What variants have in common is derived once: a definition whose
    configuration and all whose inputs are the same in several variants is one stage for them all."""
    sets = variants or {"": definitions}
    plans = {k: Plan(d) for k, d in sets.items()}
    raw = event_rows(events, sorted({n for p in plans.values() for n in p.external_inputs()}))
    made: dict[tuple, DataFrame] = {}
    signs = {k: signatures(p) for k, p in plans.items()}
    uses = [s for x in signs.values() for s in x.values()]
    if len(set(uses)) > 1:
        raw = staged(raw, "events")  # each of several stages reads its names from there
    out = []
    for k, plan in plans.items():
        for name in plan.order:
            if (sign := signs[k][name]) in made:
                continue
            d, reads = plan.definitions[name], plan.folds[name].reads
            inputs = [made[signs[k][n]].select(ROW) for n in sorted(reads) if n in plan.definitions]
            if reads - set(plan.definitions):
                inputs.insert(0, raw.filter(F.col("event.name").isin(sorted(reads - set(plan.definitions)))))
            found = decided(reduce(DataFrame.unionByName, inputs), d, plan, segment)
            made[sign] = staged(found, f"derived-{name}") if plan.consumers.get(name) or uses.count(sign) > 1 else found
        every = [made[signs[k][n]] for n in plan.order]
        if every:
            derived = reduce(DataFrame.unionByName, every)
            out.append(derived.withColumn("variant", F.lit(k)) if variants else derived)
    if not out:
        return events.sparkSession.createDataFrame([], DECISION + (", variant string" if variants else ""))
    keys = (["variant"] if variants else []) + ["user_id", "o"]
    ranked = reduce(DataFrame.unionByName, out).withColumn("sub", F.row_number().over(Window.partitionBy(*keys).orderBy("path")) - 1)
    columns = ["user_id", F.col("o.seq").alias("seq"), F.col("sub").cast("int").alias("sub"), "event.name", "event.kind", "event.id", "event.ts", "score", "event.sources"]
    return ranked.select(*columns, *(["variant"] if variants else []))


def signatures(plan: Plan) -> dict[str, tuple]:
    """What each definition's result depends on: its detector and configuration, its place, and the same of the definitions that it
    reads."""
    found: dict[str, tuple] = {}
    for name in plan.order:
        d, reads = plan.definitions[name], sorted(plan.folds[name].reads)
        found[name] = (name, list(plan.definitions).index(name), d.engine, repr(sorted(d.engine_config.items())), tuple(found.get(n) for n in reads))
    return found
