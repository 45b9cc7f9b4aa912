"""One definition over histories: cut at reset points, folded in parallel, put together again.

Rows: user_id, o (arrival_seq, ts, id: the raw event that caused the row), path (the place of a derived event among all that one raw
event causes; empty for the raw event itself), event, lo, hi (the span of its evidence).

A user's history is cut where the fold's state is provably void: at each start of a session, or where nothing that comes later is
dated within the fold's `silence` of what came before. Folds that follow fixes also have to be sure that the fix behind the cut is
accepted: it has to be reachable in the time that passed from wherever the user was before. Cuts are found by windows; segments of
about SEGMENT rows then go to different tasks, whichever user they are of. What the rows behind a cut set off, and what a leg knows of
the time before its cut, is handed on by one more window. Claims wait across silences, so fusion isn't cut; its ticks are handled as
arrays in batches, so that a user's history is never held.

Evidence stays in Arrow arrays; a batch's is taken at once, and only claims, which cite what others cite, become Python objects."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.geo import EARTH_RADIUS_M
from tideline.functions.schema import EVENT
from tideline.operators import folds
from tideline.operators.folds import FIXES, ITSELF, NEXT, Fired, Fold, Rows, Stays, Trips

#: Rows of a segment, about: it goes on to the first cut behind so many.
SEGMENT = 10_000
ORDER = "struct<seq: bigint, ts: bigint, id: string>"
ROW = ["user_id", "o", "path", "event", "lo", "hi"]
#: A row that tells of a segment: o and path of its first row taken, `second` those of its second, ts the time of the last.
TAKEN = 1
#: A leg whose time before the departure lies in the segment before.
EARLIER = -(2**62)
_OUT = f"user_id string, segment long, told int, o {ORDER}, path array<int>, k int, ts long, score double, sources array<{EVENT}>, leg struct<begin: bigint, moves: bigint, extent: double, before: bigint, settled: bigint>, second struct<o: {ORDER}, path: array<int>>"


# --- cuts --------------------------------------------------------------------------------------------------------------


def segmented(rows: DataFrame, fold: Fold, size: int = SEGMENT) -> DataFrame:
    """rows with `segment`: rows of a user with the same number are folded together. One sort of a user's rows serves all windows."""
    along = Window.partitionBy("user_id").orderBy("o", "path")
    so_far, before = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    fixes = isinstance(fold, (Stays, Trips))
    if fold.restart is not None:
        marked = rows.withColumn("_cut", F.col("event.name") == fold.restart)
    elif fold.silence is None:
        return rows.withColumn("segment", F.lit(0).cast("long"))
    elif fixes:
        ts, lat, lon = (F.col(f"event.{c}") for c in ("ts", "lat", "lon"))
        waited = ts - F.max(ts).over(before)
        dlat = F.greatest(F.abs(lat - F.min(lat).over(before)), F.abs(lat - F.max(lat).over(before)))
        dlon = F.greatest(F.abs(lon - F.min(lon).over(before)), F.abs(lon - F.max(lon).over(before)))
        # no way is longer than one along a meridian and a circle of latitude, nor than half around the earth
        farthest = F.least(F.radians(dlat + dlon), F.lit(math.pi)) * EARTH_RADIUS_M
        marked = rows.withColumn("_cut", (waited > fold.silence) & (farthest <= waited * (fold.fastest / 3.6)))
    else:
        # events count however late they come: what is dated less than `silence` after earlier ones isn't cut off from them
        late = F.min("event.ts").over(Window.partitionBy("user_id").orderBy(F.col("o").desc(), F.col("path").desc()).rowsBetween(Window.unboundedPreceding, 0))
        marked = rows.withColumn("_least", late).withColumn("_cut", F.col("_least") - F.max("event.ts").over(before) > fold.silence)
    numbered = marked.withColumn("_n", F.floor(F.row_number().over(along) / size))
    segment = F.coalesce(F.last(F.when(F.col("_cut"), F.col("_n")), ignorenulls=True).over(so_far), F.lit(-1))
    return numbered.withColumn("segment", segment.cast("long")).select(*rows.columns, "segment")


# --- folding -----------------------------------------------------------------------------------------------------------


class Places:
    """Numbers of a history's events that may still be cited, as places in the frame: the batch at hand, behind what the batches
    before it left over. So Arrow takes and joins a batch's evidence at once, and not what each history or firing has."""

    def __init__(self):
        self.at, self.first = np.zeros(0, np.int64), 0

    def add(self, at: np.ndarray) -> None:
        self.at = np.concatenate([self.at, at]) if len(self.at) else at

    def keep(self, needed: list[tuple[int, int]]) -> None:
        least = min((a for a, _ in needed), default=self.first + len(self.at))
        if least > self.first:
            self.at, self.first = self.at[least - self.first :], least

    def range(self, a: int, b: int) -> np.ndarray:
        return self.at[a - self.first : b - self.first]


class Frame:
    def __init__(self, events: pa.Array):
        self.events = events
        self.name = pc.struct_field(events, "name").to_numpy(zero_copy_only=False)
        self.ts = pc.cast(pc.struct_field(events, "ts"), pa.int64()).to_numpy(zero_copy_only=False)

    def evidence(self, fired: Fired, places: Places, ping: str | None) -> tuple[float, np.ndarray | list[dict]]:
        """Score and evidence of what fired: places, or events themselves where they are what others cite."""
        if fired.score is None or any(how not in (ITSELF, FIXES) for _, _, how in fired.cites):
            score, events = folds.cited(fired, lambda k: self.events[int(places.at[k - places.first])].as_py(), ping)
            return score, [e if "sources" in e else e | {"sources": e.get("parts")} for e in events]
        found, sort = [], False
        for a, b, how in fired.cites:
            at = places.range(a, b)
            if how == FIXES:
                at, sort = at[self.name[at] == ping], True
            found.append(at)
        at = np.concatenate(found) if len(found) > 1 else found[0] if found else np.zeros(0, np.int64)
        return fired.score, at[np.argsort(self.ts[at], kind="stable")] if sort else at


def columns_of(batch: pa.RecordBatch) -> Rows:
    event = batch.column("event")
    numbers = lambda c, kind: pc.cast(pc.struct_field(event, c), kind).to_numpy(zero_copy_only=False)
    return Rows(
        pc.struct_field(event, "name").to_numpy(zero_copy_only=False), numbers("ts", pa.int64()), *[numbers(c, pa.float64()) for c in ("lat", "lon", "acc")],
        batch.column("lo").to_numpy(), batch.column("hi").to_numpy(),
    )


def parts_of(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple[tuple, int, int]]:
    """Stretches of a batch with the same keys: from, to."""
    values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
    new = np.zeros(max(0, batch.num_rows - 1), bool)
    for v in values:
        new |= v[1:] != v[:-1]
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield tuple(v[a] for v in values), a, b


_LEG = pa.struct([("begin", pa.int64()), ("moves", pa.int64()), ("extent", pa.float64()), ("before", pa.int64()), ("settled", pa.int64())])


class Output:
    """Rows of _OUT. at: the position in the batch of the row that set something off, or (o, path) as Python values, or None."""

    def __init__(self, schema: pa.Schema):
        self.o, self.path, self.event = (schema.field(c).type for c in ("o", "path", "event"))
        self.rows, self.sources, self.size = [], [], 0

    def add(self, key: tuple, told: int, at, k: int = 0, ts: int | None = None, score: float | None = None, sources: np.ndarray | list[dict] | None = None, leg: folds.Leg | None = None, second: tuple | None = None) -> None:
        known = leg and {"begin": leg.begin, "moves": leg.moves, "extent": leg.extent, "before": leg.before, "settled": leg.settled}
        self.rows.append((*key, told, at, k, ts, score, known, second and {"o": second[0], "path": second[1]}))
        self.sources.append(sources)
        self.size += 1 if sources is None else len(sources)

    def evidence(self, events: pa.Array) -> pa.Array:
        made = [e for s in self.sources if isinstance(s, list) for e in s]
        places, n = [np.zeros(0, np.int64)], len(events)
        for s in self.sources:
            if isinstance(s, list):
                places.append(np.arange(n, n + len(s)))
                n += len(s)
            elif s is not None:
                places.append(s)
        every = pa.concat_arrays([events, pa.array(made, self.event)]) if made else events
        return every.take(pa.array(np.concatenate(places)))

    def batch(self, batch: pa.RecordBatch | None, events: pa.Array) -> pa.RecordBatch:
        """events: of the frame."""
        users, segments, told, at, k, ts, score, leg, second = zip(*self.rows, strict=True)
        here = [x if isinstance(x, int) else None for x in at]
        places = {}
        for i, (c, kind) in enumerate((("o", self.o), ("path", self.path))):
            column = pa.nulls(len(at), kind) if batch is None else batch.column(c).take(pa.array(here, pa.int64()))
            given = pa.array([x[i] if isinstance(x, tuple) else None for x in at], kind)
            places[c] = pc.if_else(pa.array([isinstance(x, tuple) for x in at]), given, column)
        offsets = np.cumsum([0, *(0 if s is None else len(s) for s in self.sources)])
        evidence = self.evidence(events)
        out = pa.RecordBatch.from_arrays(
            [pa.array(users, pa.string()), pa.array(segments, pa.int64()), pa.array(told, pa.int32()), places["o"], places["path"], pa.array(k, pa.int32()), pa.array(ts, pa.int64()),
             pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), evidence), pa.array(leg, _LEG), pa.array(second, pa.struct([("o", self.o), ("path", self.path)]))],
            ["user_id", "segment", "told", "o", "path", "k", "ts", "score", "sources", "leg", "second"],
        )
        self.rows, self.sources, self.size = [], [], 0
        return out


#: Evidence rows that a task hands on at once, about.
MOST_EVIDENCE = 50_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys in as many partitions as the session shuffles to: joined up by their bytes, small rows that take long would run
    in few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def folded(rows: DataFrame, fold: Fold) -> DataFrame:
    """_OUT over rows with segments. told 0: what fires (of Trips: legs); NEXT, AFTER_NEXT: what the rows behind the cut set off;
    TAKEN: a row a segment, of folds to which something behind a cut matters."""
    trips, hands_on = isinstance(fold, Trips), isinstance(fold, (Stays, Trips))
    ping = getattr(fold, "ping", None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, places, taken, last, out, frame = None, {}, Places(), [], None, None, None

        def advance(batch: pa.RecordBatch, columns: Rows, at: int, offset: int) -> None:
            """columns: of the batch's rows from `at` on; offset: where the batch begins in the frame."""
            nonlocal last
            if trips:
                use = columns.fixes(fold.ping, fold.accuracy)
                use = use[folds.credible(folds.Track(columns.ts[use], columns.lat[use], columns.lon[use]), state.get("last"), fold.fastest)]
                first = state.get("next", 0)
                legs, kept = fold.legs(state, columns, first + np.arange(len(use)), use), use.tolist()
                state["next"] = first + len(use)
            else:
                fired, kept = fold.advance(state, columns)
            places.add(np.array(kept, np.int64) + (offset + at))
            if hands_on and kept:
                for row in kept[: 2 - len(taken)]:
                    taken.append((batch.column("o")[at + row].as_py(), batch.column("path")[at + row].as_py()))
                last = int(columns.ts[kept[-1]])
            if trips:
                for leg in legs:
                    out.add(key, 0, at + leg.row, ts=leg.end, sources=places.range(leg.a, leg.b + 1), leg=leg)
            else:
                k, before = 0, None
                for x in fired:
                    k, before = (k + 1 if x.row == before else 0), x.row
                    score, sources = frame.evidence(x, places, ping)
                    out.add(key, 0, at + x.row, k, x.ts, score, sources)
            places.keep(fold.needed(state))

        def end() -> None:
            if key is None or not hands_on:
                return
            if trips and (leg := fold.over(state)) is not None:
                out.add(key, NEXT, None, ts=leg.end, sources=places.range(leg.a, leg.b + 1), leg=leg)
            for x in fold.ended(state):
                score, sources = frame.evidence(x, places, ping)
                out.add(key, x.row, None, 0, x.ts, score, sources)
            if taken:
                out.add(key, TAKEN, taken[0], ts=last, second=taken[1] if len(taken) > 1 else None)

        for batch in batches:
            out, columns, events = out or Output(batch.schema), columns_of(batch), batch.column("event")
            offset = len(frame.events) if frame else 0
            frame = Frame(pa.concat_arrays([frame.events, events]) if offset else events)
            for here, a, b in parts_of(batch, "user_id", "segment"):
                if here != key:
                    end()
                    key, places, taken, last = here, Places(), [], None
                    state = {"earlier": EARLIER} if trips and here[1] >= 0 else {}
                advance(batch, columns.part(a, b), a, offset)
                if out.size > MOST_EVIDENCE:
                    yield out.batch(batch, frame.events)
            if out.rows:
                yield out.batch(batch, frame.events)
            frame = Frame(frame.events.take(pa.array(places.at)))
            places.at = np.arange(len(places.at))
        end()
        if out is not None and out.rows:
            yield out.batch(None, frame.events)

    keys = ["user_id", "segment"]
    ordered = dealt(rows.select(*keys, "o", "path", "event", "lo", "hi"), *keys).sortWithinPartitions(*keys, "o", "path")
    return ordered.mapInArrow(run, _OUT)


def put_together(found: DataFrame) -> DataFrame:
    """What fired, with the rows that set it off: those behind a cut are known from the segments that follow. Legs also learn the
    time before their departure where it lies in the segment before."""
    taken, at = F.col("told") == TAKEN, F.struct("o", "path")
    forth = Window.partitionBy("user_id").orderBy("segment").rangeBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("user_id").orderBy(F.col("segment").desc()).rangeBetween(Window.unboundedPreceding, -1)
    near = lambda v, w: F.last(F.when(taken, v), ignorenulls=True).over(w)
    rows = found.withColumn("_earlier", near(F.col("ts"), forth)).withColumn("_next", near(at, back))
    rows = rows.withColumn("_after", near(F.coalesce("second", "_next"), back)).filter(~taken)
    behind = F.when(F.col("told") == NEXT, F.col("_next")).when(F.col("told") == folds.AFTER_NEXT, F.col("_after")).otherwise(at)
    before = F.when(F.col("leg.before") == EARLIER, F.col("_earlier")).otherwise(F.col("leg.before"))
    leg = F.when(F.col("leg").isNotNull(), F.col("leg").withField("before", before))
    out = rows.withColumn("_at", behind).filter("_at.o is not null")
    return out.select("user_id", F.col("_at.o").alias("o"), F.col("_at.path").alias("path"), "k", "ts", "score", "sources", leg.alias("leg"))


def judged(legs: DataFrame, marks: DataFrame, fold: Trips) -> DataFrame:
    """Legs that are trips, with the marks that corroborate them. Legs and marks of a user pass in order of arrival; marks are few."""
    of_leg = legs.select("user_id", "o", "path", "ts", "sources", "leg", F.lit(None).cast(EVENT).alias("event"))
    both = of_leg.unionByName(marks.select("user_id", "o", "path", F.col("event.ts").alias("ts"), "event"), allowMissingColumns=True)
    schema = f"user_id string, o {ORDER}, path array<int>, k int, ts long, score double, sources array<{EVENT}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, state, places, left = None, {}, Places(), None
        for batch in batches:
            rows, found, score = [], [], []
            ts, leg, own = batch.column("ts").to_pylist(), batch.column("leg").to_pylist(), batch.column("sources")
            users, offsets, events = batch.column("user_id").to_pylist(), own.offsets.to_numpy(), batch.column("event")
            # the marks that may still count, the batch's rows, and behind them what legs cite
            begin = len(left) if left is not None else 0
            frame = pa.concat_arrays([left, events, own.values] if begin else [events, own.values])
            cited_from, times = begin + batch.num_rows, pc.struct_field(frame, "ts").to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                if users[i] != user:
                    user, state, places = users[i], {}, Places()
                if leg[i] is None:
                    fold.mark(state, ts[i], state.setdefault("next", 0))
                    places.add(np.array([begin + i], np.int64))
                    state["next"] += 1
                else:
                    x = folds.Leg(i, 0, 0, leg[i]["begin"], ts[i], leg[i]["moves"], leg[i]["extent"], leg[i]["before"], leg[i]["settled"])
                    trip, cited = fold.judged(state, x)
                    if trip:
                        at = np.concatenate([np.arange(offsets[i], offsets[i + 1]) + cited_from, places.at[np.array([k for _, k in cited], np.int64) - places.first]])
                        rows.append(i)
                        found.append(at[np.argsort(times[at], kind="stable")])
                        score.append(float(x.moves))
                places.keep([(k, k + 1) for _, k in state.get("marks", [])])
            left = frame.take(pa.array(places.at))
            places.at = np.arange(len(places.at))
            if rows:
                at = pa.array(rows)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), frame.take(pa.array(np.concatenate(found))))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(at) for c in ("user_id", "o", "path")], pa.array([0] * len(rows), pa.int32()), batch.column("ts").take(at), pa.array(score), lists],
                    ["user_id", "o", "path", "k", "ts", "score", "sources"],
                )

    return dealt(both, "user_id").sortWithinPartitions("user_id", "o", "path").mapInArrow(run, schema)


def detected(rows: DataFrame, fold: Fold, size: int = SEGMENT) -> DataFrame:
    """(user_id, o, path, k, ts, score, sources) of what a fold makes of rows; o, path: the row that set it off, k: its place there."""
    rows = rows.filter(F.col("event.name").isin(sorted(fold.reads)))
    if isinstance(fold, (Stays, Trips)):
        e = F.col("event")
        marks = rows.filter(e["name"] != fold.ping)
        fixes = rows.filter((e["name"] == fold.ping) & e["lat"].isNotNull() & e["lon"].isNotNull() & (e["acc"].isNull() | (e["acc"] <= fold.accuracy)))
        found = put_together(folded(segmented(fixes, fold, size), fold))
        return judged(found, marks, fold) if isinstance(fold, Trips) else found.drop("leg")
    return folded(segmented(rows, fold, size), fold).filter("told = 0").select("user_id", "o", "path", "k", "ts", "score", "sources")
