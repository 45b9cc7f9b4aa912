"""Sessions, co-occurrence and fusion in native form: windows and array folds. Only thinning runs in Python workers, as a
stream that holds the last time kept.

Events: user_id (the entity), id, name, ts (epoch seconds), seq (arrival order)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.geo import haversine_m, is_implausible_jump
from tideline.staging import staged


def pair_sessions(events: DataFrame, start: str, end: str, max_duration: int = 21600, order: str = "seq", whole: bool = False) -> DataFrame:
    """(user_id, start_id, started_at, end_id, ended_at, start_seq, end_seq): the latest start takes the first end by arrival
    that lies after it in time; an end that doesn't leaves the start open. An episode is what follows one start. whole: also
    start_event and end_event, the two rows as structs."""
    row = [F.struct("*").alias("_row")] if whole else []
    rows = events.filter(F.col("name").isin(start, end)).select("user_id", "id", "ts", F.col(order).alias("_o"), (F.col("name") == start).alias("_starts"), *row)
    return _paired(rows, ["user_id"], max_duration, whole)


def pair_kinds(events: DataFrame, kinds: dict[str, tuple[str, str]], max_duration: int = 21600, order: str = "seq") -> DataFrame:
    """What pair_sessions gives of each kind (its start and end), with `kind`. An event has a row for each kind that it starts or
    ends, so one scan, shuffle and sort serve all kinds, and no task holds the sorts of several."""
    roles = {n: [(k, n == s) for k, (s, e) in kinds.items() if n in (s, e)] for pair in kinds.values() for n in pair}
    role = lambda k, starts: F.struct(F.lit(k).alias("kind"), F.lit(starts).alias("starts"))
    of_name = F.create_map(*[x for n, found in roles.items() for x in (F.lit(n), F.array(*[role(*r) for r in found]))])
    rows = events.filter(F.col("name").isin(list(roles))).select("user_id", "id", "ts", F.col(order).alias("_o"), F.explode(F.try_element_at(of_name, F.col("name"))).alias("_r"))
    return _paired(rows.select("user_id", F.col("_r.kind").alias("kind"), "id", "ts", "_o", F.col("_r.starts").alias("_starts")), ["user_id", "kind"], max_duration)


def _paired(rows: DataFrame, keys: list[str], max_duration: int, whole: bool = False) -> DataFrame:
    row = ["_row"] if whole else []
    along = Window.partitionBy(*keys).orderBy("_o", "id")
    rows = rows.withColumn("_episode", F.sum(F.col("_starts").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.when(F.col("_starts"), F.struct("id", "ts", "_o", *row))
    rows = rows.withColumn("_s", F.last(own, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.filter(~F.col("_starts") & F.col("_s").isNotNull() & (F.col("ts") > F.col("_s.ts")))
    first = ends.groupBy(*keys, "_episode").agg(F.min_by(F.struct("id", "ts", F.col("_o").alias("o"), "_s", *row), F.struct("_o", "id")).alias("_e"))
    return first.select(
        *keys,
        F.col("_e._s.id").alias("start_id"),
        F.col("_e._s.ts").alias("started_at"),
        F.col("_e.id").alias("end_id"),
        F.col("_e.ts").alias("ended_at"),
        F.col("_e._s._o").alias("start_seq"),
        F.col("_e.o").alias("end_seq"),
        *([F.col("_e._s._row").alias("start_event"), F.col("_e._row").alias("end_event")] if whole else []),
    ).filter(F.col("ended_at") - F.col("started_at") <= max_duration)


def in_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """events (user_id, seq, ...) that arrive from a session's start_seq to its end_seq, with the session as _in. Sessions (of
    pair_sessions) of a user don't overlap, so an event can only be in the last that began before it: one window over both,
    and no join of a user's events with all the user's sessions."""
    marks = sessions.select("user_id", F.col("start_seq").alias("seq"), F.struct("*").alias("_session"))
    along = Window.partitionBy("user_id").orderBy("seq", F.col("_session").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.filter("user_id is not null").unionByName(marks.filter("user_id is not null"), allowMissingColumns=True)
    rows = rows.withColumn("_in", F.last("_session", ignorenulls=True).over(along))
    return rows.filter(F.col("_session").isNull() & (F.col("seq") <= F.col("_in.end_seq"))).drop("_session")


def validated_sessions(
    events: DataFrame,
    sessions: DataFrame,
    ping: str = "location_ping",
    min_displacement_m: float = 300,
    min_fixes: int = 3,
    min_coverage_ratio: float = 0.5,
    max_accuracy_m: float = 100,
    max_speed_kmh: float = 400,
) -> DataFrame:
    """sessions (of pair_sessions) without those that their fixes refute; the sequential guards are a fold over a session's
    fixes."""
    fixes = events.filter((F.col("name") == ping) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("user_id", "seq", "ts", "lat", "lon", "acc")
    fixes = fixes.filter(F.col("acc").isNull() | (F.col("acc") <= max_accuracy_m))
    inside = in_sessions(fixes, sessions.select("user_id", "start_id", "end_id", "start_seq", "end_seq", "started_at"))
    inside = inside.filter((F.col("seq") > F.col("_in.start_seq")) & (F.col("seq") < F.col("_in.end_seq")) & (F.col("ts") >= F.col("_in.started_at")))
    tracks = inside.groupBy("user_id", F.col("_in.start_id").alias("start_id"), F.col("_in.end_id").alias("end_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("seq").cast("long").alias("q"), F.col("ts").cast("long").alias("t"), "lat", "lon"))).alias("_f")
    )
    box = "struct<n: int, south: double, north: double, west: double, east: double, t0: bigint, t1: bigint, lat: double, lon: double>"

    def fold(acc, f):
        late = f["t"] < acc["t1"]
        wild = is_implausible_jump(acc["lat"], acc["lon"], acc["t1"], f["lat"], f["lon"], f["t"], max_speed_kmh)
        skip = F.coalesce((acc["n"] > 0) & (late | wild), F.lit(False))
        grown = F.struct(
            (acc["n"] + 1).alias("n"),
            F.least(acc["south"], f["lat"]).alias("south"),
            F.greatest(acc["north"], f["lat"]).alias("north"),
            F.least(acc["west"], f["lon"]).alias("west"),
            F.greatest(acc["east"], f["lon"]).alias("east"),
            F.least(acc["t0"], f["t"]).alias("t0"),
            F.greatest(acc["t1"], f["t"]).alias("t1"),
            f["lat"].alias("lat"),
            f["lon"].alias("lon"),
        ).cast(box)
        return F.when(skip, acc).otherwise(grown)

    zero = F.struct(F.lit(0).alias("n"), *[F.lit(None).alias(c) for c in ("south", "north", "west", "east", "t0", "t1", "lat", "lon")]).cast(box)
    judged = sessions.join(tracks, ["user_id", "start_id", "end_id"], "left").withColumn("_x", F.aggregate(F.coalesce("_f", F.array().cast("array<struct<q:bigint,t:bigint,lat:double,lon:double>>")), zero, fold))
    duration = F.greatest(F.lit(1), F.col("ended_at") - F.col("started_at"))
    extent = haversine_m(F.col("_x.south"), F.col("_x.west"), F.col("_x.north"), F.col("_x.east"))
    refuted = (F.col("_x.n") >= min_fixes) & ((F.col("_x.t1") - F.col("_x.t0")) / duration >= min_coverage_ratio) & (extent < min_displacement_m)
    return judged.withColumns({"n_fixes": F.col("_x.n"), "extent_m": extent}).filter(~F.coalesce(refuted, F.lit(False))).drop("_f", "_x")


def thinned(times: DataFrame, keys: list[str]) -> DataFrame:
    """times (keys, ts, gap) without those that lie less than gap, one for all of a key's rows, after the last one kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last = None, None
        for pdf in batches:
            own = pdf[keys]
            ts, gap = pdf["ts"].to_numpy(np.int64), pdf["gap"].to_numpy(np.int64)
            new = ~(own.eq(own.shift()) | (own.isna() & own.shift().isna())).all(axis=1).to_numpy()
            new[:1] = True
            heads, kept = np.flatnonzero(new), []
            for a, b in zip(heads, [*heads[1:], len(pdf)], strict=True):
                key = tuple(None if pd.isna(x) else x for x in own.iloc[a])
                at = a if key != last_key else a + np.searchsorted(ts[a:b], last + gap[a])
                while at < b:
                    kept.append(at)
                    last = ts[at]
                    at += np.searchsorted(ts[at:b], last + gap[a])
                last_key = key
            yield pdf.iloc[kept][[*keys, "ts"]]

    rows = times.select(*keys, F.col("ts").cast("long").alias("ts"), F.greatest(F.col("gap"), F.lit(1)).cast("long").alias("gap")).filter("ts is not null")
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "ts")
    return ordered.mapInPandas(run, rows.drop("gap").schema)


def cooled(candidates: DataFrame, cooldown: int) -> DataFrame:
    """Candidates (user_id, ts, ...) that fire: at least `cooldown` after the last that fired."""
    fired = thinned(candidates.select("user_id", "ts", F.lit(cooldown).alias("gap")), ["user_id"])
    return candidates.join(fired, ["user_id", "ts"], "left_semi")


def decaying_scores(events: DataFrame, weights: dict[str, float], window: int, half_life: float | None) -> DataFrame:
    """(user_id, id, name, ts, seq, score): each contributor scored by the latest sighting of every name within the window;
    weights halve every half_life (not at all without one). For arrival in time order."""
    rows = events.filter(F.col("name").isin(list(weights))).select("user_id", "id", "name", "ts", "seq")
    recent = Window.partitionBy("user_id").orderBy("ts").rangeBetween(-window, 0)
    score = F.lit(0.0)
    for name, weight in weights.items():
        age = (F.col("ts") - F.max(F.when(F.col("name") == name, F.col("ts"))).over(recent)).cast("double")
        part = F.lit(float(weight)) if half_life is None else F.lit(float(weight)) * F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half_life)
        score = score + F.when(age.isNotNull(), part).otherwise(0.0)
    return rows.withColumn("score", score)


def decaying_window(events, weights, threshold, window, half_life=None, cooldown=1800) -> DataFrame:
    """(user_id, ts, score) of what fires, once a moment; half_life defaults to half the window. Events of one second score the same."""
    scored = decaying_scores(events, weights, window, window / 2 if half_life is None else half_life)
    moments = scored.filter(F.col("score") >= threshold).select("user_id", "ts", F.round("score", 3).alias("score"))
    return cooled(moments.distinct(), cooldown)


def weighted_window(events, weights, threshold, window, cooldown=1800, max_age=None) -> DataFrame:
    """(user_id, ts, score) of what fires, each name counting from its earliest sighting until that expires. A sighting within
    the life of an earlier one is no new start, so the starts of a name are themselves a thinning of its times."""
    max_age = max_age or {}
    rows = events.filter(F.col("name").isin(list(weights))).select("user_id", "name", "ts")
    # A start opens where the one before has expired.
    cap = F.create_map(*[x for n in weights for x in (F.lit(n), F.lit(int(max_age.get(n, window))))])
    starts = thinned(rows.withColumn("gap", F.try_element_at(cap, F.col("name")) + 1), ["user_id", "name"])
    opened = starts.select("user_id", F.col("name").alias("_name"), "ts")
    moments = rows.select("user_id", "ts", F.lit(None).cast("string").alias("_name")).unionByName(opened)
    so_far = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    score, present = F.lit(0.0), F.lit(0)
    for name, weight in weights.items():
        start = F.max(F.when(F.col("_name") == name, F.col("ts"))).over(so_far)
        here = F.col("ts") - start <= int(max_age.get(name, window))
        score = score + F.when(here, float(weight)).otherwise(0.0)
    scored = moments.withColumn("score", score).filter("_name is null").select("user_id", "ts", "score").distinct()
    return cooled(scored.filter(F.col("score") >= threshold), cooldown)


def drive_sessions(events: DataFrame, connect: str, disconnect: str, shortest: int = 180) -> DataFrame:
    """(user_id, begin, finish): the first connect of a burst to the next disconnect."""
    rows = events.filter(F.col("name").isin(connect, disconnect)).select("user_id", "id", "name", "ts", "seq")
    before = Window.partitionBy("user_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_episode", F.coalesce(F.sum((F.col("name") == disconnect).cast("int")).over(before), F.lit(0)))
    out = rows.groupBy("user_id", "_episode").agg(
        F.min(F.when(F.col("name") == connect, F.col("ts"))).alias("begin"), F.max(F.when(F.col("name") == disconnect, F.col("ts"))).alias("finish")
    )
    return out.filter((F.col("begin").isNotNull()) & (F.col("finish") - F.col("begin") >= shortest)).select("user_id", "begin", "finish")


#: Time cells come in sizes, each STEP times the one before. A span lies in cells of the first size that isn't shorter than it.
STEP, SIZES = 8, 8


def size_of(lo: Column, hi: Column, width: int) -> Column:
    """Which size of cells a span lies in; one shorter than `width` in the first."""
    size = F.lit(SIZES - 1)
    for k in reversed(range(SIZES - 1)):
        size = F.when(hi - lo <= width * STEP**k, k).otherwise(size)
    return size


def in_cells(df: DataFrame, lo: Column, hi: Column, sizes: Column, width: int) -> DataFrame:
    """df with a row for each cell (_size, _cell) of these sizes that [lo, hi] touches: of a size that isn't shorter, two at most,
    however long the span. Makes an overlap an equality join with a check."""
    wide = F.element_at(F.array(*[F.lit(width * STEP**k) for k in range(SIZES)]), F.col("_size") + 1)
    sized = df.withColumn("_size", F.explode(sizes))
    return sized.withColumn("_cell", F.explode(F.sequence(F.floor(lo / wide), F.floor(hi / wide)))).withColumn("_wide", wide)


def sizes_in(*spans: tuple[DataFrame, Column, Column], width: int) -> DataFrame:
    """One row: the sizes (_sizes, SIZES at most) that some span lies in."""
    every = reduce(DataFrame.unionByName, [df.select(size_of(lo, hi, width).alias("_s")) for df, lo, hi in spans])
    return F.broadcast(every.agg(F.collect_set("_s").alias("_sizes")))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], pad: int = 0, width: int = 86400) -> DataFrame:  # noqa: E741
    """Pairs whose closed spans overlap within `pad` seconds on both sides. A pair meets in cells of the longer one's size, and counts
    at the first cell that both touch. A span has rows for its own size and for each larger one that occurs."""
    a = staged(left.withColumns({"_l0": F.col(l[0]) - pad, "_l1": F.col(l[1]) + pad}), "spans")
    b = staged(right.withColumns({"_r0": F.col(r[0]), "_r1": F.col(r[1])}), "spans")
    l0, l1, r0, r1 = (F.col(c) for c in ("_l0", "_l1", "_r0", "_r1"))
    sizes = sizes_in((a, l0, l1), (b, r0, r1), width=width)  # one row
    larger = lambda own: F.filter("_sizes", lambda s: s >= F.col(own))
    a = in_cells(a.withColumn("_ls", size_of(l0, l1, width)).crossJoin(sizes), l0, l1, larger("_ls"), width).drop("_sizes")
    b = in_cells(b.withColumn("_rs", size_of(r0, r1, width)).crossJoin(sizes), r0, r1, larger("_rs"), width).drop("_sizes", "_wide")
    first = F.floor(F.greatest(l0, r0) / F.col("_wide"))
    met = a.join(b, [*keys, "_size", "_cell"]).filter((F.col("_size") == F.greatest("_ls", "_rs")) & (l0 <= r1) & (r0 <= l1) & (F.col("_cell") == first))
    return met.drop("_size", "_cell", "_wide", "_ls", "_rs", "_l0", "_l1", "_r0", "_r1")


def fuse_claims(primary: DataFrame, secondary: DataFrame, ticks: DataFrame | None = None, pad: int = 300, shortest: int = 0) -> DataFrame:
    """(user_id, p_id, s_id) of primary spans (p_id, p_lo, p_hi) and secondary ones (s_id, s_lo, s_hi). Primary spans, by their
    ends, each take the oldest secondary one that overlaps and isn't taken; s_id is null where there is none. Secondary spans
    that no primary one overlaps stand alone (p_id null), if they last `shortest` seconds and no tick (user_id, ts) falls into
    them or `pad` seconds behind. The taking streams over a user's pairs and holds the ids that are taken."""
    pairs = staged(overlapping(primary, secondary, ["user_id"], ("p_lo", "p_hi"), ("s_lo", "s_hi"), pad), "pairs")

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user = served = None
        taken: set = set()
        for pdf in batches:
            out = []
            for u, p, s in zip(pdf["user_id"], pdf["p_id"], pdf["s_id"], strict=True):
                if u != user:
                    user, served, taken = u, None, set()
                if p != served and s not in taken:
                    served = p
                    taken.add(s)
                    out.append((u, p, s))
            yield pd.DataFrame(out, columns=["user_id", "p_id", "s_id"])

    keyed = pairs.select("user_id", "p_hi", "p_id", "s_hi", "s_id").repartition("user_id").sortWithinPartitions("user_id", "p_hi", "p_id", "s_hi", "s_id")
    taken = keyed.select("user_id", "p_id", "s_id").mapInPandas(take, pairs.select("user_id", "p_id", "s_id").schema)
    paired = primary.select("user_id", "p_id").join(taken, ["user_id", "p_id"], "left")
    alone = secondary.filter(F.col("s_hi") - F.col("s_lo") >= shortest).join(pairs.select("user_id", "s_id"), ["user_id", "s_id"], "left_anti")
    if ticks is not None:
        at = ticks.select("user_id", F.col("ts").alias("t_lo"), F.col("ts").alias("t_hi"))
        vetoed = overlapping(alone.withColumn("_end", F.col("s_hi") + pad), at, ["user_id"], ("s_lo", "_end"), ("t_lo", "t_hi"))
        alone = alone.join(vetoed.select("user_id", "s_id"), ["user_id", "s_id"], "left_anti")
    return paired.unionByName(alone.select("user_id", "s_id"), allowMissingColumns=True)
