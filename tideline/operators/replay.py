"""Replay of definitions over history, comparison of what two runs derive, and scoring against known drives."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.schema import DECISION, SOURCE, entity
from tideline.operators.sessions import overlapping, pair_sessions
from tideline.plans import router
from tideline.plans.definitions import Definition, Plan, with_overrides

MATCH_SECONDS, REAL_SECONDS, MISS_SECONDS, EARLY_SECONDS, PAD_SECONDS, NEAR_SECONDS = 120, 120, 900, 120, 120, 600


def _stands_alone(d: Definition, definitions: list[Definition]) -> bool:
    """Whether d pairs sessions of outside events, and no other definition reads its end event or what it makes."""
    if d.engine != "session_window":
        return False
    readers, made = Plan(definitions).consumers, {x.name for x in definitions}
    start, end = d.engine_config["start_event"], d.engine_config["end_event"]
    return start != end and not {start, end} & made and readers[end] == [d.name] and d.name not in readers


def session_decisions(rows: DataFrame, d: Definition) -> DataFrame:
    """The decisions of a session definition over outside events, by windows: the same rows as the router's."""
    c, have = d.engine_config, set(rows.columns)
    types = {"lat": "double", "lon": "double", "acc": "double", "motion": "array<string>"}
    columns = [F.col(x) if x in have else F.lit(None).cast(types[x]).alias(x) for x in router.EVENT_COLUMNS]
    order = F.struct("arrival_seq", "ts", F.col("id").isNull().alias("no_id"))
    keyed = rows.select(entity(rows).alias("user_id"), order.alias("_at"), *columns)
    found = pair_sessions(keyed, c["start_event"], c["end_event"], c.get("max_duration_seconds", 21600), "_at", whole=True)
    source = lambda e: F.struct(*[F.col(f"{e}.{x}").alias(x) for x in router.EVENT_COLUMNS], F.lit(None).alias("kind"), F.lit(None).alias("parts")).cast(SOURCE)
    ids = F.array_sort(F.array(*[F.coalesce(F.col(x), F.lit("None")) for x in ("start_id", "end_id")]))
    minted = F.sha2(F.concat_ws(":", "user_id", F.lit(d.name), "ended_at", ids), 256)
    values = {"user_id": F.col("user_id"), "seq": F.col("end_seq.arrival_seq"), "sub": F.lit(0), "name": F.lit(d.name), "kind": F.lit(d.engine), "id": minted,
              "ts": F.col("ended_at"), "score": F.lit(1.0), "sources": F.array(source("start_event"), source("end_event"))}
    kinds = dict(part.split(" ", 1) for part in DECISION.split(", sources ")[0].split(", ")) | {"sources": f"array<{SOURCE}>"}
    return found.select(*[v.cast(kinds[k]).alias(k) for k, v in values.items()])


def replay(events: DataFrame, definitions: list[Definition], variants: dict[str, dict[str, dict]] | None = None) -> DataFrame:
    """Decisions from empty state in canonical order. variants: overrides of engine_config by definition name, by variant name;
    all run over the union of their inputs, with the variant as a column. Session definitions that stand alone are paired by
    windows, all others go through the router."""
    rows = events if "arrival_seq" in events.columns else router.with_arrival(events)
    sets = {k: with_overrides(definitions, v) for k, v in variants.items()} if variants else {"": definitions}
    alone = {d.name for d in definitions if all(_stands_alone(x, ds) for ds in sets.values() for x in ds if x.name == d.name)}
    tagged = lambda df, k: df.withColumn("variant", F.lit(k)) if variants else df
    out = [tagged(session_decisions(rows, d), k) for k, ds in sets.items() for d in ds if d.name in alone]
    rest = {k: [d for d in ds if d.name not in alone] for k, ds in sets.items()}
    if any(rest.values()):
        out.append(router.run(rows, next(iter(rest.values())), rest if variants else None))
    return reduce(DataFrame.unionByName, out)


def counts(decisions: DataFrame, *keys: str) -> DataFrame:
    return decisions.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"))


def diff(left: DataFrame, right: DataFrame, keys: list[str] | None = None, seconds: int = MATCH_SECONDS) -> DataFrame:
    """(keys..., ts, change): what only left has (`removed`) and only right has (`added`). In time order each left time takes the
    first unused right time within `seconds`. Groups are a name's (and user's) times. Both sides run past each other in time
    order, so that of a group only the unused times of the last `seconds` are held."""
    keys = keys or ["user_id", "name"]

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, unused = None, {"removed": deque(), "added": deque()}
        for pdf in batches:
            out = []
            for *key, t, side in pdf[[*keys, "ts", "_side"]].itertuples(index=False, name=None):
                if key != group:
                    out += [(*group, at, change) for change, times in unused.items() for at in times] if group else []
                    group, unused = key, {"removed": deque(), "added": deque()}
                for change, times in unused.items():
                    while times and times[0] < t - seconds:
                        out.append((*key, times.popleft(), change))
                other = unused["added" if side == "removed" else "removed"]
                if other:
                    other.popleft()
                else:
                    unused[side].append(int(t))
            yield pd.DataFrame(out, columns=[*keys, "ts", "change"])
        if group:
            yield pd.DataFrame([(*group, at, change) for change, times in unused.items() for at in times], columns=[*keys, "ts", "change"])

    schema = ", ".join(f"{k} string" for k in keys) + ", ts long, change string"
    columns = [*[F.col(k).cast("string").alias(k) for k in keys], F.col("ts").cast("long").alias("ts")]  # both sides may come from one replay
    both = left.select(*columns, F.lit("removed").alias("_side")).unionByName(right.select(*columns, F.lit("added").alias("_side")))
    return both.repartition(*keys).sortWithinPartitions(*keys, "ts", "_side").mapInPandas(match, schema)


def nearest(points: DataFrame, marks: DataFrame, keys: list[str], within: int) -> DataFrame:
    """points (id, at) with the signed distance `offset` to the nearest mark (at) within `within` seconds; null without one.
    Marks meet points in time buckets of that width and the two beside."""
    p = points.withColumn("_b", F.explode(F.array(*[F.floor(F.col("at") / within) + d for d in (-1, 0, 1)])))
    m = marks.select(*keys, F.col("at").alias("_m")).withColumn("_b", F.floor(F.col("_m") / within))
    near = p.join(m, [*keys, "_b"]).withColumn("_d", F.col("_m") - F.col("at")).filter(F.abs("_d") <= within)
    best = near.groupBy("id").agg(F.min_by("_d", F.struct(F.abs("_d"), F.col("_d"))).alias("offset"))
    return points.join(best, "id", "left")


def missed_drives(drives: DataFrame, spans: DataFrame, within: int = MISS_SECONDS) -> DataFrame:
    """Drives (user_id, begin, finish) without a span (user_id, lo, hi) that starts within `within` of the begin, or without one
    that ends within `within` of the finish."""
    d = drives.withColumn("id", F.concat_ws(":", "user_id", "begin"))
    starts = nearest(d.select("id", "user_id", F.col("begin").alias("at")), spans.select("user_id", F.col("lo").alias("at")), ["user_id"], within).select("id", F.col("offset").alias("_s"))
    ends = nearest(d.select("id", "user_id", F.col("finish").alias("at")), spans.select("user_id", F.col("hi").alias("at")), ["user_id"], within).select("id", F.col("offset").alias("_e"))
    return d.join(starts, "id").join(ends, "id").filter("_s is null or _e is null").select("user_id", "begin", "finish")


def end_errors(drives: DataFrame, spans: DataFrame, within: int = MISS_SECONDS) -> DataFrame:
    """Drives with the signed distance of the nearest span end."""
    d = drives.select(F.concat_ws(":", "user_id", "finish", "begin").alias("id"), "user_id", F.col("finish").alias("at"))
    return nearest(d, spans.select("user_id", F.col("hi").alias("at")), ["user_id"], within).filter("offset is not null")


def score(drives: DataFrame, spans: DataFrame) -> DataFrame:
    """One row: real and junk spans, drives, missed drives, mean end error, early closes."""
    lengths = spans.agg(F.count_if(F.col("hi") - F.col("lo") >= REAL_SECONDS).alias("real"), F.count_if(F.col("hi") - F.col("lo") < REAL_SECONDS).alias("junk"))
    total = drives.agg(F.count(F.lit(1)).alias("drives"))
    missed = missed_drives(drives, spans).agg(F.count(F.lit(1)).alias("missed"))
    errors = end_errors(drives, spans).agg(F.avg("offset").alias("mean_end_error"), F.count_if(F.col("offset") < -EARLY_SECONDS).alias("early_closes"))
    return lengths.crossJoin(total).crossJoin(missed).crossJoin(errors)  # one row each


def signatures(decisions: DataFrame) -> DataFrame:
    """How often each set of contributors made each event."""
    names = F.array_join(F.array_sort(F.transform("sources", lambda s: s["name"])), "+")
    return decisions.groupBy("name", names.alias("signature")).agg(F.count(F.lit(1)).alias("n"))


def vehicle_judgment(spans: DataFrame, drives: DataFrame, marks: DataFrame) -> DataFrame:
    """spans (id, user_id, lo, hi, confirmed, n_evidence) judged by the user's own drives: own, verdict (confirmed, one_sided,
    absent for own ones; leaked, clean for others), and the distance of the nearest boundary mark (user_id, at)."""
    own = overlapping(spans, drives.select("user_id", "begin", "finish"), ["user_id"], ("lo", "hi"), ("begin", "finish"), PAD_SECONDS).select("id").distinct().withColumn("own", F.lit(True))
    j = spans.join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    mine = F.when(F.col("confirmed"), "confirmed").when(F.col("n_evidence") > 0, "one_sided").otherwise("absent")
    verdict = F.when(F.col("own"), mine).otherwise(F.when(F.col("n_evidence") > 0, "leaked").otherwise("clean"))
    near = nearest(spans.select("id", "user_id", F.col("lo").alias("at")), marks, ["user_id"], NEAR_SECONDS).select("id", "offset")
    return j.withColumn("verdict", verdict).join(near, "id")


def vehicle_summary(judged: DataFrame) -> DataFrame:
    return judged.groupBy("own", "verdict").agg(F.count(F.lit(1)).alias("n"), F.percentile("offset", 0.5).alias("median_offset"))


def boundary_pairs(events: DataFrame, start: str, end: str, longest: int = 21600) -> DataFrame:
    """Boundaries paired in event time: the latest start wins, an end consumes it."""
    rows = events.filter(F.col("name").isin(start, end)).select("user_id", "name", "ts", "id")
    along = Window.partitionBy("user_id").orderBy("ts", "id")
    rows = rows.withColumns({"_prev": F.lag("name").over(along), "_t": F.lag("ts").over(along)})
    return rows.filter((F.col("name") == end) & (F.col("_prev") == start) & (F.col("ts") - F.col("_t") <= longest)).select("user_id", F.col("_t").alias("lo"), F.col("ts").alias("hi"))
