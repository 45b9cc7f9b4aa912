"""Streams give what batches give."""

import json

import pytest
from pyspark.sql import functions as F

from tideline.plans import router
from tideline.plans.definitions import Definition
from tideline.plans.views import signals
from tideline.streaming.changes import changes_stream
from tideline.streaming.router import STATE_STORE, route_stream

DEFINITIONS = [
    Definition("trip", "trip_window", {"location_event": "view", "settle_radius_m": 200, "max_gap_seconds": 86400, "max_duration_seconds": 172800, "min_fixes": 1}),
    Definition("car_trip", "session_window", {"start_event": "signup", "end_event": "purchase", "max_duration_seconds": 259200}),
    Definition("journey", "claim_fusion", {"primary_event": "trip", "secondary_event": "car_trip", "tick_event": "error", "secondary_timeout_seconds": 86400}),
]


@pytest.fixture(scope="module")
def store(spark):
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.read.schema(df.schema).parquet(str(tmp_path / name))


def test_router_stream_is_the_batch(spark, sf, store, tmp_path):
    ev = signals(spark, sf).drop("user_id").withColumnRenamed("entity", "user_id").withColumnRenamed("seq", "arrival_seq").withColumn("motion", F.lit(None).cast("array<string>"))
    want = {(r.user_id, r.name, r.ts, r.id) for r in router.run(ev, DEFINITIONS).collect()}
    for i in range(3):  # three files, a micro-batch each, in arrival order
        ev.filter((F.col("arrival_seq") >= 400 * i) & (F.col("arrival_seq") < 400 * (i + 1))).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = {(r.user_id, r.name, r.ts, r.id) for r in run(spark, route_stream(stream, DEFINITIONS), tmp_path, "out").collect()}
    assert got == want and {n for _, n, _, _ in got} == {"trip", "car_trip", "journey"}


def test_changes_stream(spark, store, tmp_path):
    rows = [("v", "d", i, v) for i, v in enumerate(["a", "a", None, "b", "b", None, None])]
    schema = "device string, descriptor string, arrival_seq long, value string"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"), ignoreNullFields=False)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    every = [r.arrival_seq for r in run(spark, changes_stream(read()), tmp_path, "all").orderBy("arrival_seq").collect()]
    assert every == [2, 3, 5]
    known = [r.arrival_seq for r in run(spark, changes_stream(read(), first=True, skip_null=True), tmp_path, "known").orderBy("arrival_seq").collect()]
    assert known == [0, 3]


def test_live_path_is_the_batch(spark, sf, store, tmp_path):
    from tideline.plans import live, reports
    from tideline.plans.definitions import STANDARD

    raw, places = reports.envelopes(spark, sf), reports._places(spark)
    want = {r.message for r in live.derive(raw, STANDARD, places).collect()}
    assert any('"label"' in m for m in want) and any('"support"' in m for m in want)
    for low, high in ((0, 400), (400, 2000)):
        part = raw.filter((F.unix_seconds("received_at") >= low) & (F.unix_seconds("received_at") < high))
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    put = lambda batch, n: batch.write.mode("overwrite").json(str(tmp_path / "out" / f"n={n}"))
    live.derive_stream(stream, STANDARD, put, str(tmp_path / "cp"), lambda: places, availableNow=True).awaitTermination(180)
    assert {r.message for r in spark.read.json(str(tmp_path / "out")).collect()} == want
    # a book that changes while the stream runs names what is derived from then on
    books, asked = [places, places.withColumn("name", F.concat(F.lit("new "), "name"))], []
    book = lambda: asked.append(1) or books[len(asked) > 1]
    live.derive_stream(stream, STANDARD, lambda b, n: b.write.mode("overwrite").json(str(tmp_path / "out2" / f"n={n}")), str(tmp_path / "cp2"), book, availableNow=True).awaitTermination(180)
    old, new = ([r.message for r in spark.read.json(str(tmp_path / "out2" / f"n={n}")).collect()] for n in (0, 1))
    named = lambda ms: [m for m in ms if '"label":"' in m]
    assert named(old) and named(new) and not any('"label":"new ' in m for m in old) and all('"label":"new ' in m for m in named(new))


def test_a_retried_batch_adds_nothing(spark, tmp_path):
    from tideline.sources import history

    rows = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "id string, event_date string").withColumn("event_date", F.to_date("event_date"))
    for batch in ("7", "7", "8"):
        history.append_events(rows, str(tmp_path / "ev"), batch)
    assert history.read_events(spark, str(tmp_path / "ev")).count() == 4


def test_sinks(spark, tmp_path):
    from tideline.operators import ingest
    from tideline.sources import history, streams

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.json").write_text(json.dumps({"path": "/sensors/app", "body": json.dumps({"payload": {"event_name": "a", "user_id": "u", "timestamp": 1704067200}}), "source_key": "1"}) + "\n")
    raw = spark.readStream.schema("path string, body string, source_key string").json(str(tmp_path / "raw"))
    rows = ingest.shape_for_table(ingest.enrich(ingest.shape_standard(ingest.parse_path(raw)[0])[0]))
    streams.persist_events(rows, str(tmp_path / "events"), str(tmp_path / "cp"), availableNow=True).awaitTermination(120)
    [r] = history.read_events(spark, str(tmp_path / "events")).collect()
    assert r.name == "a" and str(r.event_date) == "2024-01-01"
    (tmp_path / "env").mkdir()
    (tmp_path / "env" / "a.json").write_text(json.dumps({"name": "trip", "source_app": "tideline", "source_type": "kafka", "message": '{"user_id": "u"}'}) + "\n")
    env = streams.read_raw_stream(spark, path=str(tmp_path / "env"))
    streams.write_derived(env, {"trip": "high_level_events"}, str(tmp_path / "cp2"), path=str(tmp_path / "out"), availableNow=True).awaitTermination(120)
    [r] = spark.read.json(str(tmp_path / "out")).collect()
    assert (r.key, r.topic) == ("u", "high_level_events")
