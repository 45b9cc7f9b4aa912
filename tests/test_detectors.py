"""The detectors on literal rows, and as folds over pieces of random histories."""

import json
import random

import pytest

from tideline.operators import folds
from tideline.operators.folds import Fired, Fold, make_detector, register_detector
from tideline.plans.definitions import STANDARD, Definition, Plan, load_definitions, with_overrides
from tideline.plans import router
from tideline.streaming.router import EventList, mint_id

T = 1_700_000_000
HOME, NEAR, AWAY, EDGE = (47.20694, 8.57468), (47.20702, 8.57472), (47.19507, 8.52435), (47.20784, 8.57468)
n_made = [0]


def ev(name, ts, at=None, **more):
    n_made[0] += 1
    return {"id": f"x{n_made[0]}", "name": name, "ts": ts, "lat": at and at[0], "lon": at and at[1], "acc": 10 if at else None} | more


def fold(engine, config, events, cuts=()):
    """What fires as (position, (ts, score, sources)); events in pieces, the state as a text in between."""
    machine, state, store, out = make_detector(engine, config), {}, [], []
    events = [(i, e) for i, e in enumerate(events) if e["name"] in machine.reads]
    for a, b in zip([0, *cuts], [*cuts, len(events)], strict=True):
        if part := events[a:b]:
            state = json.loads(json.dumps(state))
            fired, kept = machine.advance(state, folds.rows_of([e for _, e in part]))
            store += [part[k][1] for k in kept]
            for x in fired:
                score, sources = folds.cited(x, store.__getitem__, getattr(machine, "ping", None))
                out.append((part[x.row][0], (x.ts, score, sources)))
            assert all(0 <= a <= b <= len(store) for a, b in machine.needed(state))
    return out


def feed(engine, config, events):
    """(time of the event that fired, decision) of all that fires, the same for a whole history and event by event."""
    out = fold(engine, config, events)
    assert fold(engine, config, events, range(1, len(events))) == out
    return [(events[i]["ts"], d) for i, d in out]


def names(*rows):
    return [ev(n, t) for n, t in rows]


def test_weighted_window():
    c = {"weights": {"a": 5, "b": 5}, "threshold": 10, "window_seconds": 600, "cooldown_seconds": 0}
    [(at, (ts, score, sources))] = feed("weighted_window", c, names(("a", T), ("b", T + 10)))
    assert (at, ts, score, len(sources)) == (T + 10, T + 10, 10, 2)
    assert not feed("weighted_window", c, names(("a", T), ("b", T + 800)))
    assert len(feed("weighted_window", c | {"cooldown_seconds": 600}, names(("a", T), ("b", T + 10), ("a", T + 20), ("b", T + 30)))) == 1
    assert not feed("weighted_window", c | {"max_age_seconds": {"a": 60}}, names(("a", T), ("b", T + 120)))
    # the second sighting starts nothing while the first lives
    assert not feed("weighted_window", c, names(("a", T), ("a", T + 500), ("b", T + 700)))


def test_decaying_window():
    c = {"weights": {"a": 6, "b": 6}, "threshold": 10, "window_seconds": 600, "cooldown_seconds": 0}
    [(_, (_, score, _))] = feed("decaying_window", c | {"half_life_seconds": 100}, names(("a", 100), ("b", 100)))
    assert score == 12
    assert not feed("decaying_window", c | {"half_life_seconds": 50}, names(("a", 100), ("b", 300)))


@pytest.mark.parametrize(
    ("rows", "longest", "spans"),
    [
        ([("in", 1000), ("out", 1600)], 3600, [(1000, 1600)]),
        ([("in", 1000), ("out", 2000)], 100, []),
        ([("out", 1000)], 3600, []),
        ([("in", 2000), ("out", 1985)], 3600, []),
        ([("in", 2000), ("out", 2000)], 3600, []),
        ([("in", 2000), ("out", 1985), ("out", 2600)], 3600, [(2000, 2600)]),
    ],
)
def test_session_window(rows, longest, spans):
    fired = feed("session_window", {"start_event": "in", "end_event": "out", "max_duration_seconds": longest}, names(*rows))
    assert [(d[2][0]["ts"], d[2][1]["ts"]) for _, d in fired] == spans


def test_session_gated_window():
    c = {"gate_event": "in", "gate_weight": 4, "threshold": 10, "window_seconds": 600, "weights": {"off": 6, "lock": 5, "power": 5}}
    [(_, (_, score, sources))] = feed("session_gated_window", c, names(("in", T), ("off", T + 800)))
    assert score == 10 and [s["name"] for s in sources] == ["off"]
    assert len(feed("session_gated_window", c, names(("off", T), ("lock", T + 10)))) == 1
    for rows in ([("off", T)], [("in", T), ("lock", T + 5)], [("in", T), ("power", T + 300)]):
        assert not feed("session_gated_window", c, names(*rows))
    assert not feed("session_gated_window", c | {"max_open_seconds": 100}, names(("in", T), ("off", T + 500)))
    assert len(feed("session_gated_window", c | {"cooldown_seconds": 0}, names(("in", T), ("off", T + 100), ("off", T + 5000)))) == 1


def validated(fixes, end=600, **more):
    c = {"start_event": "in", "end_event": "out", "location_event": "location_ping"} | more
    events = [ev("in", T)] + [ev("location_ping", T + t, at, **kw) for t, at, kw in fixes] + [ev("out", T + end)]
    return len(feed("validated_session_window", c, events))


def test_validated_session_window():
    assert validated([(10, HOME, {}), (300, AWAY, {}), (590, AWAY, {})]) == 1
    still = [(10, HOME, {}), (300, NEAR, {}), (600, HOME, {}), (900, NEAR, {})]
    assert validated(still, 918) == 0
    assert validated([(10, HOME, {})]) == 1  # too few to judge
    assert validated([(10, HOME, {}), (20, HOME, {}), (30, HOME, {})], 3600) == 1  # too short a part to judge
    three = [(10, HOME, {}), (300, NEAR, {}), (580, HOME, {})]
    assert validated([*three, (590, AWAY, {"acc": 500})]) == 0
    assert validated([*three, (581, AWAY, {"acc": 5})]) == 0  # an impossible jump
    assert validated([(10, HOME, {}), (300, (47.216, 8.57468), {}), (590, HOME, {})]) == 1  # extent, not net displacement
    assert validated([(-7200, HOME, {}), (300, HOME, {}), (590, NEAR, {})]) == 1  # the old fix doesn't count


def stays(fixes, **more):
    c = {"radius_m": 60, "min_dwell_seconds": 300, "max_accuracy_m": 100} | more
    return [(at - T, d[0] - T, d[1]) for at, d in feed("stay_window", c, [ev("location_ping", T + t, p) for t, p in fixes])]


def test_stay_window():
    assert stays([(0, HOME), (300, NEAR), (600, HOME), (900, AWAY)]) == [(900, 600, 3)]
    assert stays([(0, HOME), (600, HOME), (300, NEAR), (601, AWAY), (4000, AWAY)]) == [(4000, 600, 2)]
    held = {"break_fixes": 3, "rejoin_max_hole_seconds": 7200, "departure_distance_m": 500}
    away = [(1500, AWAY), (1510, AWAY), (1520, AWAY), (1530, AWAY)]
    assert stays([(0, HOME), (600, HOME), (700, EDGE), (800, HOME), (1400, HOME), *away], **held) == [(1530, 1400, 4)]
    assert stays([(0, HOME), (600, HOME), (4900, NEAR), (5000, HOME), (6000, AWAY), (6010, AWAY), (6020, AWAY), (6030, AWAY)], **held) == [(6030, 5000, 4)]
    assert stays([(0, HOME), (600, HOME), (7900, NEAR), (8000, HOME)], **held) == [(8000, 600, 2)]
    assert stays([(0, HOME), (600, HOME)], **held) == []  # nothing is flushed at the end


def between(a, b, x):
    return a[0] + (b[0] - a[0]) * x, a[1] + (b[1] - a[1]) * x


def a_trip(start=0):
    jitter = (HOME[0] + 0.00005, HOME[1])
    sit = [(start + 60 * i, HOME if i % 2 else jitter) for i in range(3)]
    leg = [(start + 300 + 60 * i, between(HOME, AWAY, (i + 1) / 7)) for i in range(6)]
    last = start + 600
    return sit + leg, [(last + 60, AWAY), (last + 180, AWAY), (last + 390, AWAY)]


TRIP = {"min_duration_seconds": 120}


def trips(fixes, **more):
    return feed("trip_window", TRIP | more, [ev("location_ping", T + t, p, motion=["stationary"]) for t, p in fixes])


def test_trip_window():
    leg, arrival = a_trip()
    [(at, (ts, _, sources))] = trips(leg + arrival)
    assert (at - T, ts - T, sources[0]["ts"] - T, sources[-1]["ts"] - T) == (990, 660, 120, 660)
    wander = [(60 * i, (HOME[0] + 0.0004 * (i % 2), HOME[1])) for i in range(20)]
    assert not trips(wander)
    assert not trips(leg[:5] + [(t, AWAY) for t in (460, 800, 1200)], min_fixes=9)
    blackout = trips(leg + [(leg[-1][0] + 5000, AWAY)], max_gap_seconds=600)
    assert [d[0] - T for _, d in blackout] == [leg[-1][0]]


def test_trip_corroboration():
    leg, arrival = a_trip()
    c = TRIP | {"corroborating_events": ["mark"], "corroboration_pad_seconds": 60}
    rows = [ev("location_ping", T + t, p) for t, p in leg + arrival]
    inside, outside = ev("mark", T + 80), ev("mark", T + 20)
    [(_, d)] = feed("trip_window", c, sorted([*rows, inside, outside], key=lambda e: e["ts"]))
    assert [s["id"] for s in d[2] if s["name"] == "mark"] == [inside["id"]]
    early = ev("mark", T + 62)  # before the departure's pad, after the fix before it
    [(_, d)] = feed("trip_window", c | {"corroboration_pad_seconds": 0, "corroboration_gap_tolerant": True}, sorted([*rows, early], key=lambda e: e["ts"]))
    assert [s["id"] for s in d[2] if s["name"] == "mark"] == [early["id"]]


FUSE = {"primary_event": "trip", "secondary_event": "car_trip", "tick_event": "location_ping", "secondary_timeout_seconds": 1800}


def claim(name, lo, hi, located):
    at = HOME if located else None
    return ev(name, hi, kind="x", sources=[ev("p" if located else "got_in", lo, at), ev("p" if located else "got_out", hi, at)])


def test_claim_fusion():
    secondary, primary = claim("car_trip", T - 60, T + 620, False), claim("trip", T, T + 600, True)
    [(_, (ts, _, sources))] = feed("claim_fusion", FUSE, [secondary, primary])
    assert ts == T + 600 and secondary["id"] in [s["id"] for s in sources]
    [(_, (_, _, sources))] = feed("claim_fusion", FUSE, [primary, secondary])  # late: taken in, not emitted again
    assert secondary["id"] not in [s["id"] for s in sources]
    ticks = [ev("location_ping", T + 620 + 1801, HOME), ev("location_ping", T + 620 + 1900, HOME)]
    [(at, (ts, _, sources))] = feed("claim_fusion", FUSE, [secondary, *ticks])  # alone, after two later events
    assert at == T + 2520 and ts == T + 620 and sources[0]["id"] == secondary["id"] and len(sources) == 3
    assert not feed("claim_fusion", FUSE, [secondary, ev("location_ping", T + 100, HOME), *ticks])  # fixes ran through it
    assert not feed("claim_fusion", FUSE | {"min_secondary_span_seconds": 1000}, [secondary, *ticks])


def frame(spark, users):
    """users: their events, in arrival order."""
    rows = [(u, e["id"], e["name"], e["ts"], k, e["lat"], e["lon"], e["acc"] and float(e["acc"])) for u, es in users.items() for k, e in enumerate(es)]
    return spark.createDataFrame(rows, "user_id string, id string, name string, ts long, arrival_seq long, lat double, lon double, acc double").repartition(4)


def test_router_feeds_derived_events_back_first(spark):
    plan = Plan(STANDARD)
    assert "trip" not in plan.external_inputs() and "location_ping" in plan.external_inputs()
    rows = names(("device_connected_to_carplay", T), ("car_lock_state_change", T + 5), ("device_disconnected_from_carplay", T + 900), ("car_lock_state_change", T + 910))
    out = router.run(frame(spark, {"u": rows}), STANDARD).orderBy("seq", "sub").collect()
    assert [r["name"] for r in out] == ["got_into_the_car", "got_out_the_car", "car_trip"]
    assert [p["name"] for p in out[2]["sources"][0]["parts"]] == ["device_connected_to_carplay", "car_lock_state_change"]
    for r in out:  # the same id wherever it is made
        assert r["id"] == mint_id("u", r["name"], r["ts"], [s.asDict() for s in r["sources"]])


def history(g, n):
    """Sitting, walking and driving, with silences, vague and wild fixes, late events."""
    out, t, lat, lon, mode = [], T, 47.2, 8.5, "sit"
    for k in range(n):
        mode = g.choice(["sit", "drive", "walk"]) if g.random() < 0.06 else mode
        t += g.choice([5, 30, 60, 60, 120, 300]) if g.random() < 0.93 else g.choice([700, 2000, 8000, 30000])
        step = {"sit": 0, "drive": 0.01, "walk": 0.0006}[mode]
        lat, lon = lat + g.uniform(-0.1, 1) * step, lon + g.uniform(-0.5, 1) * step
        name = g.choice(["location_ping"] * 6 + ["device_connected_to_carplay", "car_lock_state_change", "car_driver_door_opened", "device_disconnected_from_carplay"])
        off = g.choice([0.3, 2, -40]) if g.random() < 0.03 else g.gauss(0, 0.0002)
        ts = t - (g.choice([50, 400, 9000]) if g.random() < 0.05 else 0)
        at = (lat + off, lon + g.gauss(0, 0.0002)) if name == "location_ping" else None
        out.append(ev(name, ts, at, acc=at and g.choice([5, 10, None, 90, 200])))
    return out


@pytest.mark.parametrize("d", STANDARD, ids=lambda d: d.name)
def test_folds_of_pieces_are_the_fold_of_the_whole(d):
    g = random.Random(d.name)
    for n in (300, 900):
        events = history(g, n)
        if d.name in ("car_trip", "got_out_the_car", "trip", "journey"):
            made = {"car_trip": ["got_into_the_car", "got_out_the_car"], "got_out_the_car": ["got_into_the_car"], "trip": ["got_into_the_car", "got_out_the_car"], "journey": ["trip", "car_trip"]}[d.name]
            for k in range(0, n, 9):
                name = g.choice(made)
                events[k] = claim(name, events[k]["ts"] - g.randrange(900), events[k]["ts"], g.random() < 0.5) if d.name == "journey" else ev(name, events[k]["ts"])
        out = fold(d.engine, d.engine_config, events)
        assert out and out == fold(d.engine, d.engine_config, events, sorted(g.randrange(n // 2) for _ in range(7)))


def test_segments_of_a_hot_user_give_what_the_whole_gives(spark):
    from tideline.plans import detect

    g = random.Random(4)
    users = {f"u{k}": history(g, 60) for k in range(8)} | {"hot": history(g, 1500)}
    events = frame(spark, users)
    rows = lambda size: sorted(map(repr, router.run(events, STANDARD, segment=size).collect()))
    want = rows(10**9)
    assert {n for n in (d.name for d in STANDARD) if any(f"name='{n}'" in r for r in want)} == {d.name for d in STANDARD}
    assert rows(40) == want
    plan = Plan(STANDARD)
    raw = router.event_rows(events, ["location_ping"]).filter("event.lat is not null and (event.acc is null or event.acc <= 100)")
    for name in ("stay", "trip"):
        assert detect.segmented(raw, plan.folds[name], 40).filter("user_id = 'hot'").select("segment").distinct().count() > 3


def test_evidence_named_twice_keeps_its_first_place():
    e = {k: ev(k, T) | {"id": k} for k in "ab"}
    claimed = ev("trip", T + 9, sources=[e["a"], e["b"], e["a"]])
    [(_, (_, score, sources))] = feed("claim_fusion", FUSE, [claimed])
    assert [s["id"] for s in sources] == ["a", "b"] and score == 2


class Listed:
    """A list state that counts what is written."""

    def __init__(self):
        self.rows, self.written = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows, self.written = list(rows), self.written + sum(len(r[1]) for r in rows)

    def appendList(self, rows):
        self.rows += rows
        self.written += sum(len(r[1]) for r in rows)

    def clear(self):
        self.rows = []


def test_an_open_stay_costs_a_batch_its_own_events_only():
    stay = next(d for d in STANDARD if d.name == "stay")
    machine, state, store, held, written, sizes = make_detector(stay.engine, stay.engine_config), {}, Listed(), 0, [], []
    for batch in range(60):
        events = [ev("location_ping", T + 600 * batch + 60 * k, HOME) | {"id": f"x{batch:03}{k}"} for k in range(10)]
        first, before = state.get("next", 0), store.written
        _, kept = machine.advance(state, folds.rows_of(events))
        held = EventList(store).update(held, {first + k: events[r] for k, r in enumerate(kept)}, machine.needed(state))
        written.append(store.written - before)
        sizes.append(len(json.dumps(state)))
    assert held == 600 and max(written[1:]) <= min(written[1:]) + 10 and max(sizes[5:]) < sizes[5] + 60
    away = [ev("location_ping", T + 36000 + 300 * k, AWAY) for k in range(6)]
    _, kept = machine.advance(state, folds.rows_of(away))
    for _ in range(2):  # the stay is final, its events go
        fired, kept = machine.advance(state, folds.rows_of([ev("location_ping", T + 90000, AWAY)]))
    assert EventList(store).update(held, {}, machine.needed(state)) < 20


def test_definitions(tmp_path):
    (tmp_path / "b.json").write_text('{"name": "b", "engine": "session_window", "engine_config": {"start_event": "x", "end_event": "y"}}')
    (tmp_path / "a.json").write_text('{"name": "a", "engine": "session_window", "enabled": false}')
    (tmp_path / "c.json").write_text('{"name": "c", "engine": "session_window", "colour": 1}')
    found, rejected = load_definitions(str(tmp_path))
    assert [d.name for d in found] == ["b"] and list(rejected) == ["c.json"]
    with pytest.raises(ValueError, match="unknown detector"):
        Plan([Definition("z", "no_such")])
    loop = [Definition(a, "session_window", {"start_event": b, "end_event": "e"}) for a, b in (("p", "q"), ("q", "p"))]
    with pytest.raises(ValueError, match="circle"):
        Plan(loop)
    changed = with_overrides(STANDARD, {"stay": {"radius_m": 80}})
    assert next(d for d in changed if d.name == "stay").engine_config["radius_m"] == 80
    with pytest.raises(ValueError, match="no definition"):
        with_overrides(STANDARD, {"nope": {}})


def test_own_detector():
    class Every(Fold):
        def advance(self, state, rows):
            first = state.get("next", 0)
            state["next"] = first + len(rows.ts)
            return [Fired(k, int(t), 1.0, [(first + k, first + k + 1, folds.ITSELF)]) for k, t in enumerate(rows.ts)], list(range(len(rows.ts)))

        def needed(self, state):
            return []

    register_detector("every")(lambda c: Every({c["name"]}))
    assert len(feed("every", {"name": "a"}, names(("a", 1), ("a", 2)))) == 2


def test_evidence_of_what_fires_is_places_in_a_frame():
    import numpy as np
    import pyarrow as pa

    from tideline.operators.folds import FIXES, ITSELF, Fired
    from tideline.plans.detect import Frame, Places

    frame = Frame(pa.array([{"id": str(i), "name": "ping" if i % 2 else "x", "ts": 10 - i} for i in range(6)]))
    places = Places()
    places.add(np.arange(1, 4))
    places.add(np.arange(4, 6))
    places.keep([(1, 3)])
    assert places.range(1, 5).tolist() == [2, 3, 4, 5]
    score, at = frame.evidence(Fired(0, 0, 1.0, [(1, 2, ITSELF), (3, 5, ITSELF)]), places, None)
    assert score == 1.0 and at.tolist() == [2, 4, 5]
    assert frame.evidence(Fired(0, 0, 1.0, [(1, 5, FIXES)]), places, "ping")[1].tolist() == [5, 3]
