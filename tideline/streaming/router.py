"""The router over a stream: one keyed stateful operator, the same folds and the same results as the batch form.

Rows of a micro-batch are sorted by arrival and folded as columns, definition after definition. State is kept apart by what changes:
a map holds each definition's small state of numbers; a list a definition holds the events that it may still cite. These are appended
when they arrive and rewritten only when most of the list isn't needed any more, so what a micro-batch writes depends on its own
events, not on how long a stay has been open; the list is read only when something fires. Nothing is dropped for being late: every
detector has its own rule for late events. Expiry follows events, never the clock of the machine; ttl_ms may bound idle entities' state
besides."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tideline.functions.schema import DECISION, entity
from tideline.operators import folds
from tideline.plans.definitions import Definition, Plan
from tideline.plans.router import COLUMNS, EVENT_COLUMNS

#: State stores on disk, so that entities' state needn't fit in memory.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: A list of events is rewritten once over half of it, and so many, aren't needed.
SPARE = 64


def mint_id(user: str, name: str, ts: int, sources: list[dict]) -> str:
    """The id of router.minted."""
    parts = [str(user), name, str(ts), *sorted(str(s.get("id")) for s in sources)]
    return hashlib.sha256(":".join(parts).encode()).hexdigest()


def trimmed(event: dict, depth: int) -> dict:
    """An event with what it cites, so many levels deep."""
    own = event.get("sources") if depth else None
    return {k: event.get(k) for k in (*EVENT_COLUMNS, "kind")} | ({"sources": [trimmed(s, depth - 1) for s in own]} if own else {})


def as_source(event: dict) -> dict:
    e = trimmed(event, 1)
    return e | {"parts": e.pop("sources", None)}


def _clean(row: dict) -> dict:
    ev = {k: (None if isinstance(v, float) and v != v else v) for k, v in row.items()}
    if ev.get("motion") is not None:
        ev["motion"] = list(ev["motion"])
    ev["ts"] = int(ev["ts"])
    return ev


class EventList:
    """The events that a definition may still cite, by number, in a list state."""

    def __init__(self, state):
        self.state, self.cache = state, None

    def event(self, number: int, new: dict[int, dict]) -> dict:
        if number in new:
            return new[number]
        if self.cache is None:
            self.cache = {n: json.loads(e) for n, e in self.state.get()} if self.state.exists() else {}
        return self.cache[number]

    def update(self, held: int, new: dict[int, dict], needed: list[tuple[int, int]]) -> int:
        """Takes in what is needed of new, and returns how many events are held then."""
        if held > 2 * sum(b - a for a, b in needed) + SPARE:
            wanted = {k for a, b in needed for k in range(a, b)}
            kept = [(n, e) for n, e in self.state.get() if n in wanted] + [(n, json.dumps(e)) for n, e in new.items() if n in wanted]
            self.state.put(kept) if kept else self.state.clear()
            return len(kept)
        rows = [(n, json.dumps(e)) for n, e in new.items() if any(a <= n < b for a, b in needed)]
        if rows:
            self.state.appendList(rows)
        return held + len(rows)


class RouterProcessor(StatefulProcessor):
    """State: `folds`, a text of numbers for each definition and how many events its list holds; `order`, the latest arrival; and a
    list of events for each definition."""

    def __init__(self, definitions: list[Definition], ttl_ms: int | None = None):
        self.definitions, self.ttl_ms = definitions, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.plan = Plan(self.definitions)
        self.folds = handle.getMapState("folds", "name string", "state string, held long", self.ttl_ms)
        self.order = handle.getValueState("order", "seq long", self.ttl_ms)
        self.lists = {name: handle.getListState(f"events{i}", "number long, event string", self.ttl_ms) for i, name in enumerate(self.plan.definitions)}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["arrival_seq", "ts", "id"], kind="stable")
        latest = self.order.get()[0] if self.order.exists() else 0
        seqs = [max(latest, int(s)) for s in pdf["arrival_seq"].cummax()]
        stream = [((i, []), _clean(e)) for i, e in enumerate(pdf[EVENT_COLUMNS].to_dict("records"))]
        out = []
        for place, name in sorted(enumerate(self.plan.definitions), key=lambda x: self.plan.order.index(x[1])):
            made = self._advance(key[0], name, place, [x for x in stream if x[1]["name"] in self.plan.folds[name].reads])
            out += made
            stream = sorted(stream + [(at, e) for at, e, _ in made], key=lambda x: x[0]) if self.plan.consumers.get(name) else stream
        self.order.update((seqs[-1],))
        out.sort(key=lambda x: x[0])
        found, sub, last = [], 0, None
        for (i, _), e, score in out:
            sub, last = (sub + 1 if i == last else 0), i
            found.append((key[0], seqs[i], sub, e["name"], e["kind"], e["id"], e["ts"], score, [as_source(s) for s in e["sources"]]))
        yield pd.DataFrame(found, columns=COLUMNS)

    def _advance(self, user: str, name: str, place: int, inputs: list) -> list[tuple[tuple, dict, float]]:
        """What a definition derives: (its place in the stream, the event, score)."""
        if not inputs:
            return []
        fold, events = self.plan.folds[name], EventList(self.lists[name])
        text, held = self.folds.getValue((name,)) if self.folds.containsKey((name,)) else ("{}", 0)
        state = json.loads(text)
        first = state.get("next", 0)
        fired, kept = fold.advance(state, folds.rows_of([e for _, e in inputs]))
        new = {first + k: trimmed(inputs[row][1], 2) for k, row in enumerate(kept)}
        out, again, before = [], 0, None
        for x in fired:
            again, before = (again + 1 if x.row == before else 0), x.row
            score, sources = folds.cited(x, lambda k: events.event(k, new), getattr(fold, "ping", None))
            i, path = inputs[x.row][0]
            derived = {"id": mint_id(user, name, x.ts, sources), "name": name, "ts": x.ts, "kind": self.plan.definitions[name].engine, "sources": sources}
            out.append(((i, [path[0] + 1 if path else 1, *path, place, again]), derived, score))
        held = events.update(held, new, fold.needed(state))
        self.folds.updateValue((name,), (json.dumps(state), held))
        return out

    def close(self) -> None:
        pass


def route_stream(events: DataFrame, definitions: list[Definition], ttl_ms: int | None = None) -> DataFrame:
    """Decisions over a streaming DataFrame of events with arrival_seq."""
    names = Plan(definitions).external_inputs()
    rows = events.filter(F.col("name").isin(names)).withColumn("user_id", entity(events)).select("user_id", "arrival_seq", *EVENT_COLUMNS)
    return rows.groupBy("user_id").transformWithStateInPandas(
        RouterProcessor(definitions, ttl_ms), outputStructType=DECISION, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
    )
