"""Column operators on literal rows, and native forms against the step functions."""

import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideline.functions.geo import accurate_enough, haversine_m, implied_speed_kmh, is_implausible_jump
from tideline.functions.schema import SOURCE, contract_violations
from tideline.operators import capabilities, ingest, lineage, places, process, quality, replay, sessions, spend, telemetry, timeline
from tideline.operators import folds
from tideline.plans import router
from tideline.sources.table import Conflict, EventsTable
from tideline.plans.definitions import Definition

T = 1_700_000_000


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_geo(spark):
    lit = F.lit
    r = one(
        spark,
        F.round(haversine_m(lit(47.20694), lit(8.57468), lit(47.19507), lit(8.52435)), 0).alias("d"),
        implied_speed_kmh(lit(1.0), lit(1.0), lit(0), lit(1.0), lit(1.0), lit(0)).alias("still"),
        implied_speed_kmh(lit(1.0), lit(1.0), lit(0), lit(1.1), lit(1.0), lit(0)).alias("jump"),
        is_implausible_jump(lit(47.0), lit(8.0), lit(0), lit(47.001), lit(8.0), lit(60)).alias("walk"),
        accurate_enough(lit(None).cast("double"), 100).alias("none"),
        accurate_enough(lit(101.0), 100).alias("vague"),
    )
    none = lit(None).cast("double")
    nulls = one(spark, *[haversine_m(*[none if i == j else lit(1.0) for j in range(4)]).alias(f"d{i}") for i in range(4)])
    assert set(nulls) == {None}
    assert 4000 < r.d < 4050 and r.still == 0 and r.jump == float("inf") and not r.walk and r.none and not r.vague


def random_events(seed, users=6, n=60, kinds="abc"):
    g = random.Random(seed)
    rows = []
    for u in range(users):
        t = T
        for _ in range(n):
            t += g.choice([1, 30, 100, 300, 700])
            rows.append((f"u{u}", f"e{len(rows)}", g.choice(kinds), t, len(rows)))
    return rows


def stepped(rows, engine, config):
    out = []
    for user in {r[0] for r in rows}:
        machine = folds.make_detector(engine, config)
        events = [dict(zip(("user_id", "id", "name", "ts", "seq", "lat", "lon", "acc"), r)) for r in rows if r[0] == user and r[2] in machine.reads]  # noqa: B905
        fired, kept = machine.advance({}, folds.rows_of(events))
        for x in fired:
            score, sources = folds.cited(x, lambda k: events[kept[k]], getattr(machine, "ping", None))
            out.append((user, events[x.row]["ts"], (x.ts, score, sources)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_native_forms_agree_with_the_folds(spark, seed):
    rows = random_events(seed)
    events = spark.createDataFrame(rows, "user_id string, id string, name string, ts bigint, seq bigint")
    w = {"a": 5, "b": 4, "c": 3}
    got = {(r.user_id, r.ts) for r in sessions.weighted_window(events, w, 9, 600, 900, {"a": 200}).collect()}
    assert got == {(u, t) for u, t, _ in stepped(rows, "weighted_window", {"weights": w, "threshold": 9, "window_seconds": 600, "cooldown_seconds": 900, "max_age_seconds": {"a": 200}})}
    got = {(r.user_id, r.ts, r.score) for r in sessions.decaying_window(events, w, 7, 600, 250, 900).collect()}
    want = {(u, t, d[1]) for u, t, d in stepped(rows, "decaying_window", {"weights": w, "threshold": 7, "window_seconds": 600, "half_life_seconds": 250, "cooldown_seconds": 900})}
    assert got == want
    late = [(u, i, n, t - random.Random(s).choice([0, 0, 400]), s) for u, i, n, t, s in rows]
    events = spark.createDataFrame(late, "user_id string, id string, name string, ts bigint, seq bigint")
    got = {(r.user_id, r.start_id, r.end_id) for r in sessions.pair_sessions(events, "a", "b", 1000).collect()}
    assert got == {(u, d[2][0]["id"], d[2][1]["id"]) for u, _, d in stepped(late, "session_window", {"start_event": "a", "end_event": "b", "max_duration_seconds": 1000})}


def test_decaying_window_fires_once_a_moment(spark):
    rows = [("u", f"e{i}", "ab"[i % 2], T + 100 * (i // 4), i) for i in range(12)]
    events = spark.createDataFrame(rows, "user_id string, id string, name string, ts bigint, seq bigint")
    got = sorted(tuple(r) for r in sessions.decaying_window(events, {"a": 5, "b": 4}, 7, 600, 250, 200).collect())
    assert got == [("u", T, 9.0), ("u", T + 200, 9.0)]


def test_validated_sessions_agree_with_the_folds(spark):
    g = random.Random(5)
    rows = [(*r, 47.2 + g.choice([0, 0.0005, 0.02]), 8.5, g.choice([10.0, 300.0])) for r in random_events(5, kinds="abpppp")]
    schema = "user_id string, id string, name string, ts bigint, seq bigint, lat double, lon double, acc double"
    events = spark.createDataFrame(rows, schema)
    pairs = sessions.pair_sessions(events, "a", "b", 5000)
    got = {(r.start_id, r.end_id) for r in sessions.validated_sessions(events, pairs, "p", 300, 2, 0.3).collect()}
    config = {"start_event": "a", "end_event": "b", "max_duration_seconds": 5000, "location_event": "p", "min_fixes": 2, "min_coverage_ratio": 0.3}
    want = {(d[2][0]["id"], d[2][1]["id"]) for _, _, d in stepped(rows, "validated_session_window", config)}
    assert got == want and len(got) < pairs.count()


def sources(spark, rows):
    """rows: (id, name, ts, lat, lon, motion, kind, parts)"""
    full = [(i, n, t, la, lo, None, m, k, [(p, "x", 0, None, None, None, None, None) for p in ps] if ps else None) for i, n, t, la, lo, m, k, ps in rows]
    return spark.createDataFrame([(full,)], f"sources array<{SOURCE}>")


def src(i, t, at=None, name="p", motion=None, kind=None, parts=None):
    return i, name, t, at and at[0], at and at[1], motion, kind, parts


def capability(spark, name, *rows):
    return sources(spark, rows).select(capabilities.CAPABILITIES[name](F.col("sources")).alias("c")).first().c


def test_interval_and_place(spark):
    c = capability(spark, "interval", src("a", 300), src("b", 100), src("c", 200))
    assert tuple(c) == (100, 300, 200)
    c = capability(spark, "interval", src("a", 300), src("b", 100, (47.0, 8.0)), src("c", 200, (47.0, 8.0)))
    assert tuple(c) == (100, 200, 100)
    assert capability(spark, "place", src("a", 1)) is None
    c = capability(spark, "place", src("a", 1, (47.0, 8.0)), src("b", 2, (47.002, 8.0)))
    assert round(c.lat, 6) == 47.001 and 110 < c.spread_m < 112 and c.label is None


def test_journey_mode_and_vehicle(spark):
    c = capability(spark, "journey", src("b", 20, (47.0, 8.01), motion=["driving"]), src("a", 10, (47.0, 8.0), motion=["stationary", "walking"]), src("c", 30, (47.0, 8.0), motion=["walking", "driving"]))
    assert c.origin.lon == 8.0 and c.straight_line_m == 0 and c.path_m > 1500 and c.mode == "driving"
    assert capability(spark, "journey", src("a", 1, (47.0, 8.0))) is None
    c = capability(spark, "vehicle", src("a", 20, name="out"), src("b", 10, name="in"), src("c", 5, (47.0, 8.0)))
    assert list(c.evidence) == ["in", "out"] and c.confirmed
    assert capability(spark, "vehicle", src("c", 5, (47.0, 8.0))) is None


def test_support(spark):
    place = src("p", 10, (47.0, 8.0))
    assert tuple(capability(spark, "support", place)) == ("single_source", ["geometry"])
    claim = src("q", 20, name="car_trip", kind="session", parts=["i", "o"])
    inner = src("i", 15, name="got_in", kind="weighted")
    assert tuple(capability(spark, "support", place, claim, inner)) == ("corroborated", ["geometry", "car_trip"])
    assert capability(spark, "support", src("z", 1)) is None


def test_pauses(spark):
    at = lambda x: (47.2 + x, 8.5)
    leg = [src("a", 0, at(0)), src("b", 100, at(0.005)), src("c", 300, at(0.0115)), src("d", 480, at(0.0115)), src("e", 600, at(0.017)), src("f", 700, at(0.02))]
    [p] = capability(spark, "pauses", *leg)
    assert (p.started_at, p.ended_at, p.duration_seconds) == (300, 480, 180)
    assert capability(spark, "pauses", *leg[:2]) is None


def test_spans_of_any_length_have_few_rows(spark):
    from tideline.operators import spend

    g = random.Random(9)
    length = lambda: int(10 ** g.uniform(0, 9.5)) if g.random() < 0.2 else g.choice([0, 60, 86_400, 200_000])
    make = lambda n, tag: [(g.choice("uv"), f"{tag}{k}", lo := g.randrange(3_000_000), lo + length()) for k in range(n)]
    a, b = make(60, "a"), make(60, "b")
    left, right = spark.createDataFrame(a, "user_id string, p string, l0 long, l1 long"), spark.createDataFrame(b, "user_id string, q string, r0 long, r1 long")
    got = sorted((r.p, r.q) for r in sessions.overlapping(left, right, ["user_id"], ("l0", "l1"), ("r0", "r1"), 50).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] - 50 <= y[3] and y[2] <= x[3] + 50)
    lo, hi = F.col("l0"), F.col("l1")
    cells = sessions.in_cells(left, lo, hi, F.array(sessions.size_of(lo, hi, 86_400)), 86_400).groupBy("p").count()
    assert cells.agg(F.max("count")).first()[0] <= 2
    points = [(f"t{k}", g.choice("uv"), g.randrange(4_000_000)) for k in range(80)]
    found = spend.innermost(spark.createDataFrame(points, "id string, user_id string, ts long"), right.withColumnsRenamed({"q": "span_id", "r0": "lo", "r1": "hi"}), ["user_id"])
    for r in found.collect():
        around = [(y[3] - y[2], y[1]) for y in b if y[0] == r.user_id and y[2] <= r.ts <= y[3]]
        assert r.span_id == (min(around)[1] if around else None)
    assert found.count() == 80


def test_supersession_sweep_equals_pairs(spark):
    from tideline.operators import timeline

    g, rules = random.Random(6), [("car_trip", "journey"), ("car_trip", "trip"), ("trip", "journey")]
    rows = []
    for k in range(400):
        lo = g.randrange(20_000)
        span = (lo, lo + g.choice([0, 5, 100, 900])) if g.random() < 0.9 else (None, None)
        rows.append((f"s{k}", g.choice("uv"), g.choice(["car_trip", "trip", "journey", "stay"]), lo, *span))
    frame = spark.createDataFrame(rows, "id string, user_id string, name string, ts bigint, lo bigint, hi bigint")
    spans = [tuple(r) for r in frame.filter(timeline.is_span()).select("id", "user_id", "name", "lo", "hi").collect()]
    want = {a[0] for a in spans for b in spans if (a[2], b[2]) in rules and a[1] == b[1] and b[3] <= a[4] and a[3] <= b[4]}
    assert {r.id for r in timeline.superseded(frame, rules).collect()} == want and 20 < len(want) < len(spans)
    assert "Join" not in plan_of(timeline.superseded(frame, rules)).replace("BroadcastHashJoin", "")


def test_pauses_of_a_very_long_way(spark):
    """100,000 points in one array: each step costs the same."""
    at = F.when(F.col("id") % 5000 < 4000, F.floor(F.col("id") / 5000) * 0.01).otherwise(F.col("id") * 0.001)
    points = spark.range(100_000).select(F.struct(F.col("id").cast("string").alias("id"), F.lit("p").alias("name"), (F.col("id") * 10).alias("ts"), (at + 10).alias("lat"), F.lit(8.5).alias("lon")).alias("s"))
    rows = points.agg(F.sort_array(F.collect_list("s")).alias("sources"))
    found = rows.select(F.explode(capabilities.pauses(F.col("sources"))).alias("p")).select("p.*").collect()
    assert [(p.started_at, p.ended_at) for p in found] == [(50_000 * k, 50_000 * k + 39_990) for k in range(1, 20)]


def test_shape_and_contract(spark):
    d = sources(spark, [src("a", 1), src("b", 5)]).select(
        F.lit("u").alias("user_id"), F.lit(1).alias("seq"), F.lit(0).alias("sub"), F.lit("car_trip").alias("name"), F.lit("session").alias("kind"), F.lit("id1").alias("id"), F.lit(5).cast("long").alias("ts"), F.lit(1.0).alias("score"), "sources"
    )
    good, bad = capabilities.shape(d, {"car_trip": ("interval",)})
    r = good.first()
    assert r.interval.duration_seconds == 4 and r.place is None and [x.id for x in r.derived_from] == ["a", "b"] and bad.count() == 0
    w = capabilities.wrapped(good)
    assert "journey" not in w.first().message
    assert contract_violations(w).count() == 0
    assert contract_violations(spark.createDataFrame([('{"id": "x", "colour": 1}',)], "message string")).first().unknown == ["colour"]


def test_places(spark):
    book = spark.createDataFrame(
        [("home", 47.2, 8.5, 100.0, True, ["a"]), ("yard", 47.2003, 8.5, 200.0, None, []), (None, 47.2, 8.5, 100.0, None, [])], "name string, lat double, lon double, radius_m double, everyday boolean, categories array<string>"
    )
    pts = spark.createDataFrame([("1", 47.20001, 8.5), ("2", 47.2011, 8.5), ("3", 48.0, 8.5), ("4", None, None)], "id string, lat double, lon double")
    got = {r.id: (r.label, r.everyday, r.categories) for r in places.match_places(pts, book, "id").collect()}
    assert got == {"1": ("home", True, ["a"]), "2": ("yard", False, None), "3": (None, None, None), "4": (None, None, None)}


@pytest.mark.parametrize("correlate", [False, True])
def test_first_evidence_by_time(spark, correlate):
    """Stages and candidates with ties, gaps of days and nulls, against a look at every candidate."""
    g = random.Random(5)
    when = lambda: T + g.choice([0, 7200, 90_000, 900_000]) + g.randrange(0, 4000, 25)
    w = [(f"k{i}", g.choice(["a", "b", "c", None]), when(), g.choice(["x", "y", None])) for i in range(150)] + [("early", "a", 100, "x"), ("open", "a", None, "x")]
    c = [(g.choice(["a", "b", None]), f"e{i:03}", when(), g.choice(["x", "y", None])) for i in range(120)]
    want = {}
    for key, event, look, have in w:
        if event is None or correlate and have is None:
            continue
        start = max(0, look - 900) if look is not None else 0
        fits = [(ts, i) for e, i, ts, v in c if e == event and ts >= start and (not correlate or v == have)]
        if fits:
            want[key] = min(fits)
    waiting = spark.createDataFrame(w, "key string, event string, look_from bigint, correlate string")
    found = process.match_evidence(waiting, spark.createDataFrame(c, "event string, id string, ts bigint, correlate string"), correlate=correlate).collect()
    assert {r.key: (r.evidence_ts, r.evidence_id) for r in found} == want and len(found) == len(want) > 40


def test_places_of_every_size(spark):
    """Circles of 30 m to half the globe, over poles and the date line, against every pair's distance."""
    g = random.Random(31)
    spots = [(90.0, 0.0), (-89.99, 17.0), (0.0, 180.0), (10.0, -179.999), (0.0, 0.0), (-45.0, 179.99), (89.0, -180.0)]
    spots += [(g.uniform(-90, 90), g.uniform(-180, 180)) for _ in range(60)]
    radii = [30.0, 400.0, 2_000.0, 40_000.0, 200_000.0, 1_500_000.0, 9_000_000.0, 19_000_000.0, 25_000_000.0]
    book = [(f"p{i}", lat, lon, g.choice(radii), True, []) for i, (lat, lon) in enumerate(spots)] + [("none", 1.0, 1.0, None, True, [])]
    pts = [(f"q{i}", max(-90.0, min(90.0, lat + g.uniform(-1, 1) * 10 ** g.uniform(-4, 1))), lon) for i, (lat, lon) in enumerate(spots * 4)]
    pts = [(k, lat, (lon + g.uniform(-1, 1) * 10 ** g.uniform(-4, 1) + 180) % 360 - 180) for k, lat, lon in pts] + [("null", None, 1.0)]
    p = spark.createDataFrame(pts, "id string, lat double, lon double")
    b = spark.createDataFrame(book, "name string, lat double, lon double, radius_m double, everyday boolean, categories array<string>")
    pairs = p.join(b.select("name", F.col("lat").alias("plat"), F.col("lon").alias("plon"), "radius_m").hint("broadcast"), F.lit(True), "left")
    pairs = pairs.withColumn("d", haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))).filter("d <= radius_m")
    want = {r.id: r.label for r in pairs.filter("lat is not null").groupBy("id").agg(F.min_by("name", F.struct("d", "name")).alias("label")).collect()}
    got = {r.id: r.label for r in places.match_places(p, b, "id").collect()}
    assert len(want) > 200 and got == {k: want.get(k) for k, _, _ in pts}
    cells = places.covering_cells(b.dropna().select(F.col("name").alias("p_label"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.col("radius_m").alias("p_radius")))
    assert cells.groupBy("p_label").count().agg(F.max("count")).first()[0] <= 12
    assert places.match_places(p, b.limit(0), "id").filter("label is not null").count() == 0


@pytest.mark.parametrize("levels", [1, 3])
def test_deep_closure(spark, levels):
    """Jumps against a search level by level, on random graphs with circles."""
    g = random.Random(17)
    pairs = {(g.randrange(40), g.randrange(40)) for _ in range(55)} | {(100 + i, 101 + i) for i in range(70)}
    links = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "child_id string, parent_id string")
    roots = [0, 1, 2, 3, 100, 150, 999]
    want = set()
    for root in roots:
        far, front, n = {}, {root}, 0
        while front:
            n += 1
            front = {b for a, b in pairs if a in front} - set(far)
            far.update(dict.fromkeys(front, n))
        want |= {(str(root), str(k), d) for k, d in far.items()}
    got = lineage.closure(links, spark.createDataFrame([(str(r),) for r in roots], "id string"), levels=levels)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_closure_of_a_long_chain(spark):
    """10,000 links deep: some fourteen rounds of jumps, not 10,000 levels."""
    links = spark.range(10_000).select(F.col("id").cast("string").alias("child_id"), (F.col("id") + 1).cast("string").alias("parent_id"))
    got = lineage.closure(links, spark.createDataFrame([("0",)], "id string"), levels=1)
    assert got.agg(F.count("*"), F.max("distance"), F.sum(F.abs(F.col("id").cast("int") - F.col("distance")))).first()[:] == (10_000, 10_000, 0)


def test_lineage(spark):
    ev = spark.createDataFrame([("a", "raw", 1), ("b", "mid", 2), ("c", "top", 3), ("d", "mid", 4)], "id string, name string, ts bigint")
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "gone")], "child_id string, parent_id string")
    d = lineage.depths(ev, links)
    assert {r.id: r.depth for r in d.collect()} == {"a": 1, "b": 2, "c": 3, "d": 1}
    assert [(r.name, r.depth, r.depths) for r in lineage.depth_by_type(ev, d).collect()] == [("top", 3, [3]), ("mid", 1, [1, 2]), ("raw", 1, [1])]
    up = lineage.closure(links, spark.createDataFrame([("c",)], "id string"))
    assert {(r.id, r.distance) for r in up.collect()} == {("b", 1), ("a", 1)}
    down = lineage.closure(links, spark.createDataFrame([("a",)], "id string"), up=False)
    assert {r.id for r in down.collect()} == {"b", "c"}
    loop = spark.createDataFrame([("x", "y"), ("y", "x")], "child_id string, parent_id string")
    assert {r.id for r in lineage.closure(loop, spark.createDataFrame([("x",)], "id string")).collect()} == {"x", "y"}


def test_telemetry(spark):
    m = spark.createDataFrame(
        [("v", 1, '{"data": [{"name": "d", "value": "true", "timestamp": "2024-01-01T00:00:00Z"}, {"id": "e", "value": 5}]}'), ("v", 2, '{"data": {"d": {"value": false, "timestamp": 1704067200000}}}'), ("v", 3, '{"d": "maybe", "f": null}')],
        "device string, arrival_seq bigint, body string",
    )
    u = telemetry.unnest(m)
    got = {(r.arrival_seq, r.descriptor): (r.value, r.stamp) for r in u.collect()}
    assert got == {(1, "d"): ("true", "2024-01-01T00:00:00Z"), (1, "e"): ("5", None), (2, "d"): ("false", "1704067200000"), (3, "d"): ("maybe", None), (3, "f"): (None, None)}
    t = u.select(telemetry.epoch_seconds(F.col("stamp"), F.lit(7).cast("long")).alias("t")).distinct().collect()
    assert {r.t for r in t} == {1704067200, 7}
    e = telemetry.edges(u.filter("descriptor = 'd'"), telemetry.to_boolean(F.col("value")), ["device", "descriptor"])
    assert [(r.arrival_seq, r.state) for r in e.collect()] == [(2, False)]
    assert telemetry.edges(u.filter("descriptor = 'd'"), telemetry.to_boolean(F.col("value")), ["device"], both=False).count() == 0
    r = one(spark, telemetry.to_locked(F.lit("SECURED")).alias("a"), telemetry.to_locked(F.lit("SELECTIVE_LOCKED")).alias("b"), telemetry.to_number(F.lit("true")).alias("c"), telemetry.to_number(F.lit(" 4.5")).alias("d"))
    assert tuple(r) == (True, None, None, 4.5)
    v = spark.createDataFrame([("v", "d", 1, None), ("v", "d", 2, "x"), ("v", "d", 3, None), ("v", "d", 4, None)], "device string, descriptor string, arrival_seq bigint, value string")
    assert [x.arrival_seq for x in telemetry.states_changed(v, F.col("value"), ["device"]).orderBy("arrival_seq").collect()] == [2, 3]
    assert [x.first_seq for x in telemetry.vocabulary(v).collect()] == [1]


def test_ingest(spark):
    raw = spark.createDataFrame(
        [
            (" /sensors/app/x", '{"payload": {"event_name": "a", "user_id": "u", "timestamp": 5, " extra ": "q"}}', "1"),
            ("/sensors/app", '{"payload": "{\\"event_name\\": \\"b\\", \\"user_id\\": \\"u\\"}"}', "2"),
            ("/sensors/app", '{"payload": ""}', "3"),
            ("/sensors/app", '{"payload": {"event_name": "c"}}', "4"),
            ("/sensors", "{}", "5"),
            ("/other/app", "{}", "6"),
        ],
        "path string, body string, source_key string",
    )
    good, bad = ingest.parse_path(raw)
    assert [r.source_key for r in bad.collect()] == ["5"]
    ok, rejected = ingest.shape_standard(ingest.route_by_domain(good))
    assert {r.source_key: r.reason for r in rejected.collect()} == {"3": "no event_name", "4": "no user_id"}
    rows = {r.name: r for r in ingest.shape_for_table(ingest.enrich(ok)).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].ts == 5 and rows["a"].event_class == "raw" and '"extra"' in rows["a"].message
    again = {r.name: r.id for r in ingest.shape_for_table(ingest.enrich(ok)).collect()}
    assert again["a"] == rows["a"].id
    r = one(spark, ingest.with_reserved(F.create_map(F.lit("user_id"), F.lit("evil"), F.lit("x"), F.lit("1")), F.create_map(F.lit("user_id"), F.lit("u"))).alias("m"))
    assert r.m == {"user_id": "u", "x": "1"}


def test_points(spark):
    body = """{"locations": [
      {"geometry": {"coordinates": [8.5, 47.2]}, "properties": {"device_id": "u", "timestamp": "2024-01-01T01:00:00+0100", "horizontal_accuracy": 5, "speed": 10, "battery_level": 0.5, "motion": ["driving"]}},
      {"geometry": {"coordinates": [8.5, 47.2]}, "properties": {"device_id": "u", "timestamp": "2024-01-01T00:00:01Z", "speed": -1, "motion": "walking"}},
      {"geometry": {"coordinates": [8.5, 47.2]}, "properties": {"device_id": "u", "timestamp": "2024-01-01T00:00:02Z", "horizontal_accuracy": "bad"}},
      {"geometry": {"coordinates": [8.5, 47.2]}, "properties": {"device_id": "", "timestamp": "2024-01-01T00:00:02Z"}},
      {"geometry": {"coordinates": [8.5]}, "properties": {"device_id": "u", "timestamp": "2024-01-01T00:00:02Z"}},
      {"geometry": {"coordinates": [8.5, 47.2]}, "properties": {"device_id": "u", "timestamp": "soon"}}]}"""
    rows = spark.createDataFrame([(body,), ('{"no": 1}',)], "body string")
    got = [(r.ts, r.lat, r.lon, r.acc, r.vel, r.batt, r.motion) for r in ingest.explode_locations(rows).orderBy("ts").collect()]
    assert got == [(1704067200, 47.2, 8.5, 5.0, 36, 50, ["driving"]), (1704067201, 47.2, 8.5, None, None, None, ["walking"])]


def test_mail(spark):
    rows = spark.createDataFrame(
        [('{"id": "1", "from": {"value": [{"address": "A@x@Mail.ORG", "name": "A"}]}, "snippet": " a \\n b ", "date": "Mon, 1 Jan 2024 00:00:05 +0000"}',), ('{"id": "2", "Date": "never"}',), ('{"subject": "no id"}',)], "body string"
    )
    got = [(r.upstream_id, r.from_domain, r.snippet, r.ts) for r in ingest.normalise_mail(rows).collect()]
    assert got == [("2", None, "", 0), ("1", "mail.org", "a b", 1704067205)]


@pytest.mark.parametrize(
    ("text", "amount", "reason"),
    [
        ("1,234.56", "1234.56", None), ("1.234,56", "1234.56", None), ("1.234.567", "1234567", None), ("1,234,567", "1234567", None), ("$ 12.5", "12.5", None), ("12,50 EUR", "12.50", None),
        ("1,234", None, "ambiguous"), ("1.234", None, "ambiguous"), ("-3", "-3", None), ("", None, "empty"), (None, None, "empty"), ("a.b", None, "not a number"), ("CHF 1'234.50", "1234.50", None), ("0.5", "0.5", None),
    ],
)
def test_amounts(spark, text, amount, reason):
    r = one(spark, process.cleaned_amount(F.lit(text).cast("string")).alias("a")).a
    assert (r.amount is None) == (amount is None) and (amount is None or r.amount == Decimal(amount)) and r.reason == reason


def test_business_days(spark):
    days = [date(2024, 1, d) for d in range(1, 29)]
    rows = [(a, b) for a in days for b in days]
    df = spark.createDataFrame(rows, "a date, b date").withColumn("n", process.business_days(F.col("a"), F.col("b")))
    for r in df.collect():
        want = sum(1 for i in range((r.b - r.a).days + 1) if date.fromordinal(r.a.toordinal() + i).weekday() < 5)
        assert r.n == want, (r.a, r.b)


def test_process(spark):
    log = spark.createDataFrame(
        [("1", "bill", "k", "opened", 10, 1, '{"a": "x", "id": "1"}'), ("2", "bill", "k", "opened", 12, 2, "{}"), ("3", "bill", "k", "sent", 20, 3, "{}"), ("4", "bill", "v", "opened", 5, 4, "{}"), ("5", "bill", "v", "void", 6, 5, "{}")],
        "id string, process string, cycle_key string, stage string, ts bigint, arrival bigint, body string",
    )
    cy = process.cycles(log, "opened")
    assert {(r.cycle_key, r.opened_at, str(r.context)) for r in cy.collect()} == {("k", 10, "{'a': 'x'}"), ("v", 5, "{}")}
    ms = process.milestones(log)
    assert {(r.cycle_key, r.stage, r.id) for r in ms.collect()} == {("k", "opened", "2"), ("k", "sent", "3"), ("v", "opened", "4"), ("v", "void", "5")}
    st = spark.createDataFrame([("bill", "opened", 0, []), ("bill", "sent", 1, ["opened"]), ("bill", "paid", 2, ["opened", "sent"]), ("bill", "closed", 3, ["paid"])], "process string, stage string, position int, after array<string>")
    got = {(r.cycle_key, r.stage): (r.state, r.look_from, r.status) for r in process.frontier(cy, ms, st).collect()}
    assert got["k", "paid"] == ("ready", 20, "waiting") and got["k", "closed"][0] == "blocked" and got["v", "sent"] == ("inert", None, "voided")

    def find(ready, stage):  # whatever is ready has evidence: later stages open in the same run
        return ready.select("process", "cycle_key", (F.col("look_from") + 1).alias("evidence_ts"))

    done = process.advance(cy, ms, [("sent", ["opened"]), ("paid", ["opened", "sent"]), ("closed", ["paid"])], find, 99)
    assert {(r.stage, r.ts) for r in done.filter("cycle_key = 'k'").collect()} == {("opened", 12), ("sent", 20), ("paid", 21), ("closed", 22)}


def test_evidence(spark):
    w = spark.createDataFrame([("1", "mail", 1000, "a", "007"), ("2", "mail", 1000, None, "9")], "key string, event string, look_from bigint, correlate string, mention string")
    c = spark.createDataFrame([("mail", "m0", 50, "a", "Nr 7"), ("mail", "m1", 200, "a", "Nr 7 paid"), ("mail", "m2", 150, "b", "Nr 7"), ("mail", "m3", 300, "a", "Nr 8")], "event string, id string, ts bigint, correlate string, text string")
    got = [(r.key, r.evidence_id) for r in process.match_evidence(w, c, correlate=True, mention=True).collect()]
    assert got == [("1", "m1")]


def test_sequences_and_lines(spark):
    k = spark.createDataFrame([("01-2024",), ("12-2024",), ("3-2024",), ("2-2025",), ("07-2025",)], "key string")
    assert {(r.year, r.next) for r in process.next_sequence(k).collect()} == {(2024, 13), (2025, 8)}
    lines = spark.createDataFrame([("a", Decimal("1.005"), False), ("a", Decimal("2"), None), ("a", Decimal("9"), True)], "k string, amount decimal(18,4), echoed boolean")
    assert [(r.total, r.n_lines) for r in process.line_totals(lines, ["k"]).collect()] == [(Decimal("3.01"), 2)]
    d = process.document_fields(spark.createDataFrame([(3, 1709251200, None), (112, 1709251200, date(2024, 2, 20))], "n int, t bigint, e date"), "n", "t", "e").collect()
    assert [(r.document_no, r.month_start, r.month_end) for r in d] == [("03-2024", date(2024, 2, 1), date(2024, 2, 29)), ("112-2024", date(2024, 2, 1), date(2024, 2, 29))]


def test_timeline_text(spark):
    lit = F.lit
    r = one(
        spark,
        timeline.label(lit(None).cast("string"), lit("payment")).alias("a"), timeline.label(lit(None).cast("string"), lit("car_lock_state")).alias("b"), timeline.label(lit("Home"), lit("stay")).alias("c"),
        timeline.duration_text(lit(59 * 60)).alias("d"), timeline.duration_text(lit(7200)).alias("e"), timeline.duration_text(lit(7260)).alias("f"),
        timeline.route_text(lit("A"), lit("B")).alias("g"), timeline.route_text(lit("A"), lit(None).cast("string")).alias("h"), timeline.visibility(lit(2.5), lit(2), lit(False)).alias("i"), timeline.visibility(lit(9.0), lit(1), lit(True)).alias("j"),
    )
    assert tuple(r) == ("Paid", "Car Lock State", "Home", "59 min", "2 h", "2 h 1 min", "to B", "from A", 1.0, 0.0)


def test_spend_edges(spark):
    with pytest.raises(ValueError, match="1 to 90"):
        spend.bounds(date(2024, 1, 1), 0)
    pay = spark.createDataFrame([("p", "u", 1704067200, Decimal("5.00"), "m")], "id string, user_id string, ts bigint, amount decimal(18,2), merchant string")
    stays = spark.createDataFrame([("u", "s1", 1704067200, 1704070800, 1704070800, "A"), ("u", "s2", 1704060000, 1704067200, 1704067200, "B"), ("u", "s3", 1704067000, 1704067300, 1704067100, "C")], "user_id string, span_id string, lo bigint, hi bigint, emitted_at bigint, label string")
    r = spend.report(pay, stays, date(2024, 1, 1), 2).first()
    assert r.matched == 1 and r.merchants[0].who == "A" and r.delta is None and [d.n for d in r.by_day] == [0, 1]


def test_quality_null_semantics(spark):
    from tideline.operators import quality

    rows = spark.createDataFrame(
        [("s", "n", "u", 0.0, 5.0, '{"timestamp": "5", "n8n_polled_at": "x"}'), ("s", "n", None, 0.0, 50.0, '{"n8n_polled_at": 20, "derived_kind": "z"}'), ("s", "n", "w", 0.0, 2.0, '{"timestamp": 1.5}')],
        "source_app string, name string, user_id string, occurred_at double, ingested_at double, message string",
    )
    got = [(r.polled_at, r.bad_timestamp, r.derived_fields, r.bad_user) for r in quality.with_contract_flags(quality.with_latency(rows), ["u"]).orderBy("ingested_at").collect()]
    assert got == [(None, False, False, True), (None, True, False, False), (20.0, False, True, False)]


def test_history(spark, tmp_path):
    from tideline.sources import history

    rows = spark.createDataFrame(
        [(f"i{k}", "u", "a" if k % 2 else "trip", "raw" if k % 2 else "derived", 1704067200 + k, datetime(2024, 1, 1, 0, 0, k), datetime(2024, 1, 1, 0, 0, 20 - k), '{"lat": 1.5}', date(2024, 1, 1)) for k in range(8)],
        "id string, user_id string, name string, event_class string, ts bigint, occurred_at timestamp, ingested_at timestamp, message string, event_date date",
    )
    ev = str(tmp_path / "events")
    history.append_events(rows, ev)
    table = EventsTable(spark, ev)
    table.replace(rows.limit(0), rows.limit(0), spark.createDataFrame([("i0", "i1"), ("zz", "i1")], "child_id string, parent_id string"))
    span = datetime(2024, 1, 1), datetime(2024, 1, 2)
    scan = history.scan_signals(history.read_events(spark, ev), "u", *span, ["a"])
    assert [(r.id, r.arrival_seq, r.lat) for r in scan.orderBy("arrival_seq").collect()] == [("i7", 1, 1.5), ("i5", 2, 1.5), ("i3", 3, 1.5), ("i1", 4, 1.5)]
    fresh = rows.filter("id = 'i0'").withColumn("id", F.lit("new"))
    links = spark.createDataFrame([("new", "i1")], "child_id string, parent_id string")
    with pytest.raises(history.HistoryExists):
        history.rederive(spark, ev, fresh, links, ["trip"], *span)
    assert history.rederive(spark, ev, fresh, links, ["trip"], *span, replace=True) == {"trip": 4}
    assert {r.id for r in history.read_events(spark, ev).collect()} == {"i1", "i3", "i5", "i7", "new"}
    assert {r.child_id for r in table.lineage().collect()} == {"zz", "new"}


def day_rows(spark, *ids, day=1):
    rows = [(i, date(2024, 1, day)) for i in ids]
    return spark.createDataFrame(rows, "id string, event_date date")


def ids_of(df):
    return sorted(r.id for r in df.collect())


def test_a_write_that_breaks_off_leaves_the_old_state(spark, tmp_path, monkeypatch):
    table = EventsTable(spark, str(tmp_path))
    links = lambda *c: spark.createDataFrame([(x, "r") for x in c], "child_id string, parent_id string")
    table.append(day_rows(spark, "a", "b"), "s", 1)
    table.replace(day_rows(spark), day_rows(spark, "c"), links("c"))
    state = lambda: (ids_of(table.read()), sorted(r.child_id for r in table.lineage().collect()))
    assert state() == (["a", "b", "c"], ["c"])

    def broken(*_):
        raise OSError("gone")

    whole = EventsTable._write
    for fails in (1, 2, 3, 4, 5):  # at each write, the last of which is the entry itself
        calls = []
        with monkeypatch.context() as m:
            m.setattr(EventsTable, "_write", lambda self, rows, kind: broken() if len(calls) == fails - 1 else calls.append(1) or whole(self, rows, kind))
            if fails == 5:
                m.setattr(EventsTable, "_put", broken)
            with pytest.raises(OSError, match="gone"):
                table.replace(day_rows(spark, "a", "c"), day_rows(spark, "d"), links("d"))
        assert state() == (["a", "b", "c"], ["c"])
    table.replace(day_rows(spark, "a", "c"), day_rows(spark, "d"), links("d"))
    assert state() == (["b", "d"], ["d"])
    assert not table.append(day_rows(spark, "x"), "s", 1) and table.append(day_rows(spark, "x"), "s", 2)  # retried, and next
    assert state() == (["b", "d", "x"], ["d"])
    assert table.vacuum(0) > 0 and state() == (["b", "d", "x"], ["d"])


def test_compaction_leaves_few_files_and_older_readers(spark, tmp_path, monkeypatch):
    from tideline.sources import table as module

    monkeypatch.setattr(module, "SNAPSHOT", 4)
    table = EventsTable(spark, str(tmp_path))
    for k in range(9):
        table.append(day_rows(spark, f"a{k}").unionByName(day_rows(spark, f"b{k}", day=2)), "s", k)
    old, want = table.read(), ids_of(table.read())
    assert len(want) == 18 and len(table.read(date(2024, 1, 2), date(2024, 1, 2)).inputFiles()) == 9
    assert table.compact() == 16
    assert ids_of(table.read()) == want == ids_of(old) and len(table.read().inputFiles()) == 2
    assert ids_of(table.read(version=3)) == ["a0", "a1", "a2", "b0", "b1", "b2"]
    assert ids_of(table.read(date(2024, 1, 2))) == [f"b{k}" for k in range(9)] and ids_of(table.read(date(2025, 1, 1))) == []
    [entry] = [f for f in table.state()["live"]["events"] if f.endswith("01-01")]
    other = EventsTable(spark, str(tmp_path))
    other.append(day_rows(spark, "n"), "s", 9)
    other.compact(date(2024, 1, 1))  # meanwhile
    with pytest.raises(Conflict):
        table._commit({"events": {}}, [entry])
    taken = max(table._versions())
    assert not table._put(taken, "{}") and ids_of(table.read()) == sorted([*want, "n"])


def test_rederiving_empties_a_day(spark, tmp_path):
    from tideline.sources import history

    rows = spark.createDataFrame(
        [(f"d{k}", "u", "trip", "derived", 1704067200 + 86400 * k, datetime(2024, 1, 1 + k), datetime(2024, 1, 1 + k), "{}", date(2024, 1, 1 + k)) for k in range(2)],
        "id string, user_id string, name string, event_class string, ts bigint, occurred_at timestamp, ingested_at timestamp, message string, event_date date",
    )
    ev = str(tmp_path / "events")
    history.append_events(rows, ev)
    table = EventsTable(spark, ev)
    table.replace(rows.limit(0), rows.limit(0), spark.createDataFrame([("d0", "x"), ("d1", "x")], "child_id string, parent_id string"))
    fresh, links = rows.filter("id = 'd1'").withColumn("id", F.lit("new")), spark.createDataFrame([("new", "x")], "child_id string, parent_id string")
    for _ in range(2):  # again gives the same
        history.rederive(spark, ev, fresh, links, ["trip"], datetime(2024, 1, 1), datetime(2024, 1, 9), replace=True)
        assert [r.id for r in history.read_events(spark, ev).collect()] == ["new"] and [r.child_id for r in table.lineage().collect()] == ["new"]


def test_fusing_claims_in_turn(spark):
    p = spark.createDataFrame([("u", "p1", 0, 100), ("u", "p2", 90, 200), ("u", "p3", 5000, 5100)], "user_id string, p_id string, p_lo long, p_hi long")
    s = spark.createDataFrame([("u", "s1", 0, 50), ("u", "s2", 60, 150), ("u", "s3", 9000, 9500), ("u", "s4", 9000, 9010), ("u", "s5", 20000, 20500)], "user_id string, s_id string, s_lo long, s_hi long")
    ticks = spark.createDataFrame([("u", 20510), ("u", 8999)], "user_id string, ts long")
    got = {(r.p_id, r.s_id) for r in sessions.fuse_claims(p, s, ticks, pad=20, shortest=100).collect()}
    assert got == {("p1", "s1"), ("p2", "s2"), ("p3", None), (None, "s3")}


def test_fractions_of_seconds(spark):
    from tideline.operators.ingest import _epoch

    texts = ["2024-01-01T00:00:00.123456Z", "2024-01-01T00:00:00.1+0100", "2024-01-01T00:00:00+01:00", "2024-01-01T00:00:00.123456789Z", "2024-01-01T00:00:00Z", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.e for r in df.select(_epoch(F.col("t")).alias("e")).collect()] == [1704067200, 1704063600, 1704063600, 1704067200, 1704067200, None]


def test_long_chains_and_circles(spark):
    from tideline.operators import lineage

    chain = [(f"c{k}", f"c{k - 1}") for k in range(1, 6)] + [("x", "y"), ("y", "x"), ("z", "y"), ("z", "c5")]
    links = spark.createDataFrame(chain, "child_id string, parent_id string")
    events = spark.createDataFrame([(i,) for i in sorted({a for p in chain for a in p})], "id string")
    assert {r.id: r.depth for r in lineage.depths(events, links).collect()} == {f"c{k}": k + 1 for k in range(6)} | {"x": 1, "y": 1, "z": 7}
    up = lineage.closure(links, spark.createDataFrame([("z",)], "id string"))
    assert {(r.id, r.distance) for r in up.collect()} == {("y", 1), ("c5", 1), ("x", 2), ("c4", 2), ("c3", 3), ("c2", 4), ("c1", 5), ("c0", 6)}


def test_place_book_reloads(spark):
    from tideline.sources.history import PlaceBook, load_places

    rows = spark.createDataFrame([("a", 1.0, 2.0, 50.0, True, ["x"], True, "poi"), ("b", 1.0, 2.0, 50.0, True, ["x"], False, "poi"), ("c", 1.0, 2.0, 50.0, True, ["x"], True, "area")], "name string, lat double, lon double, radius_m double, everyday boolean, categories array<string>, enabled boolean, kind string")
    assert [r.name for r in load_places(spark, rows).collect()] == ["a"]
    now, calls = [0.0], []

    def load():
        calls.append(now[0])
        if len(calls) == 2:
            raise OSError("down")
        return rows.limit(len(calls))

    book = PlaceBook(load, 10, lambda: now[0])
    first = book.current()
    now[0] = 11
    assert book.current() is first and isinstance(book.error, OSError)
    now[0] = 15
    assert book.current() is first and len(calls) == 2
    now[0] = 22
    assert book.current() is not first and book.error is None
    still = PlaceBook(lambda: rows, 0, lambda: now[0])
    now[0] = 1e9
    assert still.current() is still.book


def test_signals(spark):
    moving, door, fuel = "vehicle.isMoving", "vehicle.cabin.door.row1.driver.isOpen", "vehicle.drivetrain.fuelSystem.level"
    rows = [(moving, "false"), (moving, "moving"), (moving, "?"), (moving, "moving"), (moving, "0"), (door, "open"), (door, "closed"), (door, "open"), (fuel, "18"), (fuel, "18"), (fuel, "17.5"), (telemetry.LOCK, "UNLOCKED"), (telemetry.LOCK, "SECURED"), ("other", "a"), ("other", None)]
    u = spark.createDataFrame([("v", i, d, v) for i, (d, v) in enumerate(rows)], "device string, arrival_seq bigint, descriptor string, value string")
    got = [(r.arrival_seq, r.signal) for r in telemetry.signals(u).orderBy("arrival_seq").collect()]
    assert got == [(1, "car_started_moving"), (4, "car_stopped_moving"), (7, "car_driver_door_opened"), (8, "car_fuel_level"), (10, "car_fuel_level"), (12, "car_locked"), (14, "car_state_change")]


@pytest.fixture
def few_rows_a_batch(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "16")
    yield
    spark.conf.set(name, before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def whole_keys(df):
    """Whether a plan hands a Python worker all of a key's rows as one frame, or makes one array of them."""
    return any(x in plan_of(df) for x in ("FlatMapGroupsInPandas", "FlatMapCoGroupsInPandas", "collect_list", "collect_set"))


def test_router_carries_state_over_batches(spark, few_rows_a_batch):
    rows = random_events(7, users=2, n=200)
    events = spark.createDataFrame(rows, "user_id string, id string, name string, ts bigint, arrival_seq bigint")
    config = {"start_event": "a", "end_event": "b", "max_duration_seconds": 1000}
    variants = {"x": [Definition("out", "session_window", config)], "y": [Definition("out", "session_window", config | {"max_duration_seconds": 100})]}
    out = router.run(events, [], variants)
    assert not whole_keys(out)
    got = {(r.variant, r.user_id, r.ts, r.sources[0].id, r.sources[1].id) for r in out.collect()}
    want = {(v, u, d[0], d[2][0]["id"], d[2][1]["id"]) for v, ds in variants.items() for u, _, d in stepped(rows, "session_window", ds[0].engine_config)}
    assert got == want and {r[0] for r in got} == {"x", "y"}


def test_diff_takes_the_first_unused_time(spark, few_rows_a_batch):
    g = random.Random(3)
    sides = [[(u, "n", T + g.randrange(9000)) for u in ("u", "v", "w") if u != skip for _ in range(70)] for skip in ("v", "w")]
    left, right = (spark.createDataFrame(s, "user_id string, name string, ts bigint").repartition(3) for s in sides)
    out = replay.diff(left, right, seconds=60)
    assert not whole_keys(out)
    want = []
    for u in ("u", "v", "w"):
        theirs = sorted(t for k, _, t in sides[1] if k == u)
        for t in sorted(t for k, _, t in sides[0] if k == u):
            near = next((x for x in theirs if abs(x - t) <= 60), None)
            if near is None:
                want.append((u, "n", t, "removed"))
            else:
                theirs.remove(near)
        want += [(u, "n", x, "added") for x in theirs]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_thinning_carries_the_last_time_over_batches(spark, few_rows_a_batch):
    rows = random_events(9, users=2, n=200)
    events = spark.createDataFrame(rows, "user_id string, id string, name string, ts bigint, seq bigint")
    w = {"a": 5, "b": 4, "c": 3}
    config = {"weights": w, "threshold": 7, "window_seconds": 600, "cooldown_seconds": 900}
    weighted = sessions.weighted_window(events, w, 7, 600, 900)
    decaying = sessions.decaying_window(events, w, 7, 600, 250, 900)
    assert not whole_keys(weighted) and not whole_keys(decaying)
    assert {(r.user_id, r.ts) for r in weighted.collect()} == {(u, t) for u, t, _ in stepped(rows, "weighted_window", config)}
    assert {(r.user_id, r.ts) for r in decaying.collect()} == {(u, t) for u, t, _ in stepped(rows, "decaying_window", config | {"half_life_seconds": 250})}


def test_replay_pairs_sessions_as_the_router_does(spark):
    rows = [(None if u == "u0" else u, None if s % 17 == 0 else i, n, t, s, 47.0 + s % 3, None) for u, i, n, t, s in random_events(21, users=4, n=300)]
    events = spark.createDataFrame(rows, "user_id string, id string, name string, ts bigint, arrival_seq bigint, lat double, lon double")
    alone = Definition("s", "session_window", {"start_event": "a", "end_event": "b", "max_duration_seconds": 900})
    fed = Definition("t", "session_window", {"start_event": "a", "end_event": "c", "max_duration_seconds": 900})
    after = Definition("w", "weighted_window", {"weights": {"t": 5, "a": 5}, "threshold": 10, "window_seconds": 600, "cooldown_seconds": 60})
    for definitions in ([alone], [alone, fed, after], [fed, after]):
        out = replay.replay(events, definitions)
        want = router.run(events, definitions)
        assert out.columns == want.columns and [f.dataType for f in out.schema] == [f.dataType for f in want.schema]
        assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
    assert "MapInPandas" not in plan_of(replay.replay(events, [alone]))
    out = replay.replay(events, [alone, fed, after], {"x": {}, "y": {"s": {"max_duration_seconds": 100}}})
    assert "variant" in out.columns
    n = {(r.variant, r.name): r.n for r in replay.counts(out, "variant").collect()}
    assert n["x", "s"] > n["y", "s"] > 0 and n["x", "t"] == n["y", "t"] > 0


def test_events_meet_the_session_they_arrive_in(spark):
    rows = random_events(31, users=3, n=300, kinds="abcc")
    events = spark.createDataFrame(rows, "user_id string, id string, name string, ts bigint, seq bigint")
    pairs = sessions.pair_sessions(events, "a", "b", 2000)
    got = {(r.id, r._in.start_id) for r in sessions.in_sessions(events, pairs).collect()}
    want = {(i, p.start_id) for p in pairs.collect() for u, i, _, _, s in rows if u == p.user_id and p.start_seq <= s <= p.end_seq}
    assert got == want and got
    assert sessions.in_sessions(events, pairs.limit(0)).count() == 0


def test_percentiles_are_exact(spark):
    g = random.Random(8)
    values = {"a": [g.gauss(0, 50) for _ in range(500)], "b": [float(g.randrange(4)) for _ in range(300)], "c": [-7.25], None: [1.0, 2.0], "d": [None]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, value double").repartition(5)
    got = {r.k: (r.p50, r.p95) for r in quality.percentiles(rows, ["k"], [0.5, 0.95]).collect()}
    for k in ("a", "b", "c", None):
        v = sorted(values[k])
        for p, found in zip((0.5, 0.95), got[k], strict=True):
            at = p * (len(v) - 1)
            lo, hi = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
            assert found == pytest.approx(lo + (hi - lo) * (at - int(at)))
    assert "d" not in got


def test_kinds_of_sessions_in_one_pass(spark):
    rows = random_events(37, users=3, n=200)
    rows = [(None if u == "u0" else u, i, n, t - random.Random(s).choice([0, 0, 400]), s) for u, i, n, t, s in rows]
    events = spark.createDataFrame(rows, "user_id string, id string, name string, ts bigint, seq bigint")
    kinds = {"x": ("a", "b"), "y": ("c", "b"), "z": ("b", "a"), "none": ("d", "a")}
    found = sessions.pair_kinds(events, kinds, 1500)
    got = sorted(repr((r.kind, *(r[c] for c in found.columns if c != "kind"))) for r in found.collect())
    assert got == sorted(repr((k, *r)) for k, (s, e) in kinds.items() for r in sessions.pair_sessions(events, s, e, 1500).collect()) and got


def test_superseded_sweeps_spans_that_one_pass_makes(spark):
    rows = [(f"{n}{i}", f"u{i % 2}", n, T + 50 * i, T + 50 * i, T + 50 * i + w) for i in range(20) for n, w in (("car_trip", 40), ("trip", 90 - 30 * (i % 3)), ("journey", 10))]
    events = spark.createDataFrame([(u, f"e{i}", n, T + 9 * i, i) for i, (u, n) in enumerate([("u", "a"), ("u", "b"), ("u", "c")] * 20)], "user_id string, id string, name string, ts bigint, seq bigint")
    spans = spark.createDataFrame(rows, "id string, user_id string, name string, ts bigint, lo bigint, hi bigint")
    want = {a[0] for a in rows for b in rows if (a[2], b[2]) in timeline.REPLACED_BY and a[1] == b[1] and a[4] <= b[5] and b[4] <= a[5]}
    assert {r.id for r in timeline.superseded(spans).collect()} == want and want
    pairs = sessions.pair_kinds(events, {"trip": ("a", "b"), "journey": ("b", "c")})
    made = pairs.select(F.concat("kind", "start_id").alias("id"), "user_id", F.col("kind").alias("name"), F.col("started_at").alias("lo"), F.col("ended_at").alias("hi"))
    plan = plan_of(timeline.superseded(made))
    assert plan.split("AdaptiveSparkPlan")[-1].count("Scan ExistingRDD") == 1 and "Union" not in plan
