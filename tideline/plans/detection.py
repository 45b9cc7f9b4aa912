"""Queries: sessions, co-occurrence, fusion, the keyed detectors and the router, telemetry changes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tideline.functions.geo import haversine_m, is_implausible_jump
from tideline.operators import replay, sessions, telemetry
from tideline.plans import detection_sql, router
from tideline.plans.definitions import Definition
from tideline.plans.views import SIG, haversine_sql, signals

LONGEST = 259_200
SLOW = 0.5
WEIGHTS = {"click": 6, "view": 4, "error": 4}


def session_window(spark, sf_dir):
    return sessions.pair_sessions(signals(spark, sf_dir), "signup", "purchase", LONGEST).select("user_id", "start_id", "started_at", "end_id", "ended_at")


PAIRS = f"""e AS (SELECT *, sum(CASE WHEN name = 'signup' THEN 1 ELSE 0 END) OVER w AS episode FROM sig WHERE name IN ('signup', 'purchase')
    WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
pairs AS (
  SELECT s.user_id, s.id AS start_id, s.ts AS started_at, p.id AS end_id, p.ts AS ended_at, s.seq AS start_seq, p.seq AS end_seq
  FROM (SELECT * FROM e WHERE name = 'signup') s
  JOIN (SELECT * FROM e WHERE name = 'purchase') p ON p.user_id = s.user_id AND p.episode = s.episode AND p.ts > s.ts
  QUALIFY row_number() OVER (PARTITION BY s.user_id, s.episode ORDER BY p.seq) = 1),
sessions AS (SELECT * FROM pairs WHERE ended_at - started_at <= {LONGEST})"""


def session_interval(spark, sf_dir):
    s = session_window(spark, sf_dir)
    return s.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("ended_at") - F.col("started_at")).alias("total_seconds"), F.max(F.col("ended_at") - F.col("started_at")).alias("longest")
    )


def cooccurrence_score(spark, sf_dir):
    scored = sessions.decaying_scores(signals(spark, sf_dir), WEIGHTS, 86_400, None)
    return scored.filter("score >= 10").select("user_id", "id", "ts", F.col("score").cast("long").alias("score"))


_SCORES = ", ".join(
    f"max(CASE WHEN name = '{n}' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS t_{n}" for n in WEIGHTS
)


def decaying_window(spark, sf_dir):
    fired = sessions.decaying_window(signals(spark, sf_dir), WEIGHTS, 8, 86_400, cooldown=86_400)
    return fired.select("user_id", "ts", "score")


def weighted_window(spark, sf_dir):
    return sessions.weighted_window(signals(spark, sf_dir), WEIGHTS, 10, 86_400, cooldown=86_400).select("user_id", "ts", F.col("score").cast("long").alias("score"))


_STARTS = """c AS (SELECT user_id, name, ts FROM sig WHERE name IN ('click', 'view', 'error')),
st AS (
  SELECT user_id, name, min(ts) AS ts FROM c GROUP BY 1, 2
  UNION ALL
  SELECT st.user_id, st.name, (SELECT min(c.ts) FROM c WHERE c.user_id = st.user_id AND c.name = st.name AND c.ts > st.ts + 86400)
  FROM st WHERE st.ts IS NOT NULL),"""

_COOL = """f AS (
  SELECT user_id, min(ts) AS ts FROM cand GROUP BY 1
  UNION ALL
  SELECT f.user_id, (SELECT min(cand.ts) FROM cand WHERE cand.user_id = f.user_id AND cand.ts >= f.ts + 86400) FROM f WHERE f.ts IS NOT NULL)"""


def validated_session_window(spark, sf_dir):
    """`view` events are the fixes; the speed limit is low, as they are hours apart."""
    s = signals(spark, sf_dir)
    pairs = sessions.pair_sessions(s, "signup", "purchase", LONGEST)
    kept = sessions.validated_sessions(s, pairs, "view", min_displacement_m=2500, min_fixes=2, min_coverage_ratio=0.2, max_speed_kmh=SLOW)
    return kept.select("user_id", "start_id", "end_id", F.col("n_fixes").cast("long").alias("n_fixes"))


def claim_pairing(spark, sf_dir):
    """Sessions as primary spans, click-to-purchase spans as secondary ones, errors as ticks."""
    s = signals(spark, sf_dir)
    p = sessions.pair_sessions(s, "signup", "purchase", LONGEST).select("user_id", F.col("start_id").alias("p_id"), F.col("started_at").alias("p_lo"), F.col("ended_at").alias("p_hi"))
    q = sessions.pair_sessions(s, "click", "purchase", LONGEST).select("user_id", F.col("start_id").alias("s_id"), F.col("started_at").alias("s_lo"), F.col("ended_at").alias("s_hi"))
    ticks = s.filter("name = 'error'").select("user_id", "ts")
    return sessions.fuse_claims(p, q, ticks, 300, 3600)


def haversine_legs(spark, sf_dir):
    s = signals(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("seq")
    leg = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return s.withColumn("leg", leg).groupBy("user_id").agg(F.count("leg").alias("n"), F.round(F.coalesce(F.sum("leg"), F.lit(0.0)), 2).alias("path_m"), F.round(F.coalesce(F.max("leg"), F.lit(0.0)), 3).alias("longest_m"))


def implausible_jumps(spark, sf_dir):
    """Against the fix before (the lag form, not the last accepted one)."""
    s = signals(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("seq")
    bad = is_implausible_jump(F.lag("lat").over(w), F.lag("lon").over(w), F.lag("ts").over(w), F.col("lat"), F.col("lon"), F.col("ts"), 0.1)
    return s.withColumn("bad", bad).filter("bad").select("user_id", "id")


def _readings(spark, sf_dir):
    return signals(spark, sf_dir).select(F.col("user_id").alias("device"), F.col("name").alias("descriptor"), F.col("seq").alias("arrival_seq"), F.col("k").alias("value"))


def edge_changes(spark, sf_dir):
    r = _readings(spark, sf_dir)
    parity = F.when(F.col("value").cast("int") % 3 == 0, F.lit(None)).otherwise(F.col("value").cast("int") % 2 == 1)
    return telemetry.edges(r, parity, ["device", "descriptor"]).select("device", "descriptor", "arrival_seq", "state")


def reading_changes(spark, sf_dir):
    r = _readings(spark, sf_dir)
    return telemetry.readings_changed(r, telemetry.to_number(F.col("value")), ["device", "descriptor"]).select("device", "descriptor", "arrival_seq", "reading")


def state_changes(spark, sf_dir):
    r = _readings(spark, sf_dir)
    value = F.when(F.col("value").cast("int") % 5 != 0, F.col("value"))
    return telemetry.states_changed(r, value, ["device", "descriptor"]).select("device", "descriptor", "arrival_seq", "state")


def vocabulary(spark, sf_dir):
    return telemetry.vocabulary(_readings(spark, sf_dir))


def telemetry_updates(spark, sf_dir):
    """Each event as a message of one update, in the three forms that messages have, read back and coerced."""
    s = signals(spark, sf_dir)
    value = F.element_at(F.array(*map(F.lit, ("open", "Closed", "3.5", "secured", "unlocked"))), F.col("k").cast("int") % 5 + 1)
    stamp = F.when(F.col("seq") % 3 == 0, ((F.col("ts") + 1) * 1000).cast("string")).otherwise(F.date_format(F.timestamp_seconds(F.col("ts") + 2), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    listed = F.format_string('{"data": [{"name": "%s", "value": "%s", "timestamp": "%s"}]}', "name", value, stamp)
    mapped = F.format_string('{"data": {"%s": {"value": "%s", "timestamp": "%s"}}}', "name", value, stamp)
    body = F.when(F.col("seq") % 3 == 0, listed).when(F.col("seq") % 3 == 1, mapped).otherwise(F.format_string('{"%s": "%s"}', "name", value))
    updates = telemetry.unnest(s.select(F.col("user_id").alias("device"), F.col("seq").alias("arrival_seq"), body.alias("body")))
    v = F.col("value")
    return updates.select(
        "device", "arrival_seq", "descriptor", telemetry.to_boolean(v).alias("flag"), telemetry.to_locked(v).alias("locked"), telemetry.to_number(v).alias("number"),
        telemetry.epoch_seconds(F.col("stamp"), F.lit(0).cast("bigint")).alias("at"),
    )


_R = "r AS (SELECT user_id AS device, name AS descriptor, seq AS arrival_seq, k AS value FROM sig)"


def drive_sessions(spark, sf_dir):
    return sessions.drive_sessions(signals(spark, sf_dir), "view", "error", 180)


DRIVES = """d0 AS (SELECT *, coalesce(sum(CASE WHEN name = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep
  FROM sig WHERE name IN ('view', 'error')),
drives AS (
  SELECT user_id, min(CASE WHEN name = 'view' THEN ts END) AS begin, max(CASE WHEN name = 'error' THEN ts END) AS finish FROM d0 GROUP BY user_id, ep
  HAVING min(CASE WHEN name = 'view' THEN ts END) IS NOT NULL AND max(CASE WHEN name = 'error' THEN ts END) - min(CASE WHEN name = 'view' THEN ts END) >= 180)"""


def _envelopes(spark, sf_dir):
    return signals(spark, sf_dir).withColumnRenamed("seq", "arrival_seq").withColumn("motion", F.lit(None).cast("array<string>"))


def _decisions(spark, sf_dir, *definitions):
    """The keyed detectors over users; the evidence is summed up."""
    out = router.run(_envelopes(spark, sf_dir), list(definitions))
    return out.select("user_id", "name", "ts", "score", F.size("sources").alias("n_sources"), "id")


GATED = Definition("out", "session_gated_window", {"gate_event": "signup", "gate_weight": 4, "max_open_seconds": 604800, "window_seconds": 172800, "threshold": 10, "cooldown_seconds": 3600, "weights": {"click": 6, "view": 5, "error": 5}})
STAY = Definition("stay", "stay_window", {"location_event": "view", "radius_m": 5000, "max_gap_seconds": 604800, "break_fixes": 2, "rejoin_max_hole_seconds": 259200, "departure_distance_m": 9000})
TRIP = Definition("trip", "trip_window", {"location_event": "view", "settle_radius_m": 2500, "max_gap_seconds": 604800, "max_duration_seconds": 1209600, "settle_seconds": 3600, "min_fixes": 1, "corroborating_events": ["signup"], "corroboration_pad_seconds": 3600})
SESSION = Definition("car_trip", "session_window", {"start_event": "signup", "end_event": "purchase", "max_duration_seconds": LONGEST})
JOURNEY = Definition("journey", "claim_fusion", {"primary_event": "trip", "secondary_event": "car_trip", "tick_event": "error", "secondary_timeout_seconds": 86400})


def session_gated_window(spark, sf_dir):
    return _decisions(spark, sf_dir, GATED)


def stay_window(spark, sf_dir):
    return _decisions(spark, sf_dir, STAY)


def trip_window(spark, sf_dir):
    return _decisions(spark, sf_dir, TRIP)


def claim_fusion(spark, sf_dir):
    return _decisions(spark, sf_dir, TRIP, SESSION, JOURNEY).filter("name = 'journey'")


def router_full(spark, sf_dir):
    return _decisions(spark, sf_dir, GATED, STAY, TRIP, SESSION, JOURNEY)


#: Overrides of a variant: the gate counts for less and the cooldown is longer, so that firings go and others come.
STRICTER = {"out": {"gate_weight": 3, "threshold": 9, "cooldown_seconds": 172800}}


def router_variants(spark, sf_dir):
    """Five definitions under two variants, of which one differs in one definition: the four others are derived once."""
    definitions = [GATED, STAY, TRIP, SESSION, JOURNEY]
    out = replay.replay(_envelopes(spark, sf_dir), definitions, {"base": {}, "stricter": STRICTER})
    return out.select("variant", "user_id", "name", "ts", "score", F.size("sources").alias("n_sources"), "id")


def variant_changes(spark, sf_dir):
    """What the stricter variant removes and adds, per user."""
    definitions = [GATED]
    out = replay.replay(_envelopes(spark, sf_dir), definitions, {"base": {}, "stricter": STRICTER}).select("variant", "user_id", "name", "ts")
    return replay.diff(out.filter("variant = 'base'").drop("variant"), out.filter("variant = 'stricter'").drop("variant"))


QUERIES = {
    f.__name__: f
    for f in (
        session_window, session_interval, cooccurrence_score, decaying_window, weighted_window, validated_session_window, claim_pairing,
        haversine_legs, implausible_jumps, edge_changes, reading_changes, state_changes, vocabulary, telemetry_updates, drive_sessions,
        session_gated_window, stay_window, trip_window, claim_fusion, router_full, router_variants, variant_changes,
    )
}

_LAGS = "l AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(ts) OVER w AS ts0 FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY seq))"
_D = haversine_sql("lat0", "lon0", "lat", "lon")
_STEP = haversine_sql("r.lat", "r.lon", "f.lat", "f.lon")
_DECAY = " + ".join(f"coalesce({float(w)} * pow(0.5, (ts - t_{n}) / 43200.0::DOUBLE), 0)" for n, w in WEIGHTS.items())
_WEIGHT = " + ".join(
    f"CASE WHEN c.ts - (SELECT max(st.ts) FROM st WHERE st.user_id = c.user_id AND st.name = '{n}' AND st.ts <= c.ts) <= 86400 THEN {w} ELSE 0 END" for n, w in WEIGHTS.items()
)

_S = detection_sql
_GATED, _STAYS, _TRIPS = _S.gated(GATED.engine_config), _S.stays(STAY.engine_config), _S.trips(TRIP.engine_config)
_STRICT = _S.gated(GATED.engine_config | STRICTER["out"], "strict")
_CLAIMS = f"""{PAIRS}, {_TRIPS}, pt AS (SELECT user_id, seq, ts, ids, score, lo, hi, {_S.MINT.format(name="trip")} AS id FROM trips_out),
    sc AS (SELECT *, 1.0 AS score, {_S.MINT.format(name="car_trip")} AS id FROM (
      SELECT user_id, end_seq AS seq, ended_at AS ts, [start_id, end_id] AS ids, started_at AS lo, ended_at AS hi FROM sessions)),
    {_S.journeys(JOURNEY.engine_config, "pt", "sc")}"""
_REST = " UNION ALL ".join(_S.out(n, t) for n, t in (("stay", "stays_out"), ("trip", "trips_out"), ("car_trip", "sc"), ("journey", "journeys_out")))

ORACLE = {
    "session_gated_window": f"WITH RECURSIVE {SIG}, {_GATED} {_S.out('out', 'gated_out')}",
    "stay_window": f"WITH RECURSIVE {SIG}, {_STAYS} {_S.out('stay', 'stays_out')}",
    "trip_window": f"WITH RECURSIVE {SIG}, {_TRIPS} {_S.out('trip', 'trips_out')}",
    "claim_fusion": f"WITH RECURSIVE {SIG}, {_CLAIMS} {_S.out('journey', 'journeys_out')}",
    "router_full": f"WITH RECURSIVE {SIG}, {_GATED}, {_STAYS}, {_CLAIMS} {_S.out('out', 'gated_out')} UNION ALL {_REST}",
    # times of one user are an hour apart at least, so no two can take the same
    "variant_changes": f"""WITH RECURSIVE {SIG}, {_GATED}, {_STRICT}
        SELECT user_id, 'out' AS name, ts, 'removed' AS change FROM gated_out a WHERE NOT EXISTS (SELECT 1 FROM strict_out b WHERE b.user_id = a.user_id AND abs(b.ts - a.ts) <= 120)
        UNION ALL SELECT user_id, 'out', ts, 'added' FROM strict_out a WHERE NOT EXISTS (SELECT 1 FROM gated_out b WHERE b.user_id = a.user_id AND abs(b.ts - a.ts) <= 120)""",
    "router_variants": f"""WITH RECURSIVE {SIG}, {_GATED}, {_STRICT}, {_STAYS}, {_CLAIMS}, shared AS ({_REST})
        SELECT 'base' AS variant, * FROM ({_S.out("out", "gated_out")}) UNION ALL SELECT 'stricter', * FROM ({_S.out("out", "strict_out")})
        UNION ALL SELECT 'base', * FROM shared UNION ALL SELECT 'stricter', * FROM shared""",
    "session_window": f"WITH {SIG}, {PAIRS} SELECT user_id, start_id, started_at, end_id, ended_at FROM sessions",
    "session_interval": f"""WITH {SIG}, {PAIRS} SELECT user_id, count(*) AS n, sum(ended_at - started_at)::BIGINT AS total_seconds, max(ended_at - started_at) AS longest
        FROM sessions GROUP BY user_id""",
    "cooccurrence_score": f"""WITH {SIG}, s AS (SELECT *, {_SCORES} FROM sig WHERE name IN ('click', 'view', 'error')),
        x AS (SELECT user_id, id, ts, ({" + ".join(f"CASE WHEN t_{n} IS NULL THEN 0 ELSE {w} END" for n, w in WEIGHTS.items())})::BIGINT AS score FROM s)
        SELECT * FROM x WHERE score >= 10""",
    "decaying_window": f"""WITH RECURSIVE {SIG}, s AS (SELECT *, {_SCORES} FROM sig WHERE name IN ('click', 'view', 'error')),
        cand AS MATERIALIZED (SELECT user_id, ts, {_DECAY} AS score FROM s WHERE {_DECAY} >= 8), {_COOL}
        SELECT DISTINCT cand.user_id, cand.ts, round(score, 3) AS score FROM cand JOIN f ON f.user_id = cand.user_id AND f.ts = cand.ts""",
    "weighted_window": f"""WITH RECURSIVE {SIG}, {_STARTS} cand AS MATERIALIZED (SELECT * FROM (SELECT user_id, ts, ({_WEIGHT})::BIGINT AS score FROM c) WHERE score >= 10), {_COOL}
        SELECT DISTINCT cand.user_id, cand.ts, score FROM cand JOIN f ON f.user_id = cand.user_id AND f.ts = cand.ts""",
    "validated_session_window": f"""WITH RECURSIVE {SIG}, {PAIRS},
        fx AS (SELECT s.start_id, x.ts, x.lat, x.lon, row_number() OVER (PARTITION BY s.start_id ORDER BY x.seq) AS i
               FROM sessions s JOIN (SELECT * FROM sig WHERE name = 'view' AND acc <= 100) x
                 ON x.user_id = s.user_id AND x.seq > s.start_seq AND x.seq < s.end_seq AND x.ts >= s.started_at),
        r AS (SELECT start_id, i, 1 AS n, lat AS south, lat AS north, lon AS west, lon AS east, ts AS t0, ts AS t1, lat, lon FROM fx WHERE i = 1
              UNION ALL
              SELECT r.start_id, f.i, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN least(south, f.lat) ELSE south END, CASE WHEN ok THEN greatest(north, f.lat) ELSE north END,
                CASE WHEN ok THEN least(west, f.lon) ELSE west END, CASE WHEN ok THEN greatest(east, f.lon) ELSE east END, t0, CASE WHEN ok THEN f.ts ELSE t1 END,
                CASE WHEN ok THEN f.lat ELSE r.lat END, CASE WHEN ok THEN f.lon ELSE r.lon END
              FROM r JOIN fx f ON f.start_id = r.start_id AND f.i = r.i + 1,
                LATERAL (SELECT f.ts >= t1 AND NOT ({_STEP} > 0 AND (f.ts <= t1 OR {_STEP} / (f.ts - t1) * 3.6 > {SLOW})) AS ok)),
        t AS (SELECT s.user_id, s.start_id, s.end_id, s.ended_at - s.started_at AS dur, l.* EXCLUDE (start_id)
              FROM sessions s LEFT JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY i DESC) = 1) l ON l.start_id = s.start_id)
        SELECT user_id, start_id, end_id, coalesce(n, 0)::BIGINT AS n_fixes FROM t
        WHERE NOT coalesce(n >= 2 AND (t1 - t0) / greatest(1, dur)::DOUBLE >= 0.2 AND {haversine_sql("south", "west", "north", "east")} < 2500, false)""",
    "claim_pairing": f"""WITH RECURSIVE {SIG}, {PAIRS},
        e2 AS (SELECT *, sum(CASE WHEN name = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS episode FROM sig WHERE name IN ('click', 'purchase')),
        q AS (SELECT s.user_id, s.id AS s_id, s.ts AS s_lo, p.ts AS s_hi FROM (SELECT * FROM e2 WHERE name = 'click') s JOIN (SELECT * FROM e2 WHERE name = 'purchase') p
              ON p.user_id = s.user_id AND p.episode = s.episode AND p.ts > s.ts QUALIFY row_number() OVER (PARTITION BY s.user_id, s.episode ORDER BY p.seq) = 1),
        q1 AS (SELECT * FROM q WHERE s_hi - s_lo <= {LONGEST}),
        o AS (SELECT a.user_id, a.start_id AS p_id, q.s_id, q.s_hi FROM sessions a JOIN q1 q ON q.user_id = a.user_id AND a.started_at - 300 <= q.s_hi AND q.s_lo <= a.ended_at + 300),
        c AS (SELECT a.user_id, a.start_id AS p_id, row_number() OVER (PARTITION BY a.user_id ORDER BY a.ended_at, a.start_id) AS i, coalesce(l.ids, []) AS ids
              FROM sessions a LEFT JOIN (SELECT p_id, list(s_id ORDER BY s_hi, s_id) AS ids FROM o GROUP BY 1) l ON l.p_id = a.start_id),
        g AS (SELECT user_id, 0::BIGINT AS i, NULL::VARCHAR AS p_id, NULL::VARCHAR AS s_id, []::VARCHAR[] AS taken FROM (SELECT DISTINCT user_id FROM sessions)
              UNION ALL
              SELECT c.user_id, c.i, c.p_id, pick, CASE WHEN pick IS NULL THEN g.taken ELSE list_append(g.taken, pick) END
              FROM g JOIN c ON c.user_id = g.user_id AND c.i = g.i + 1, LATERAL (SELECT list_filter(c.ids, lambda x: NOT list_contains(g.taken, x))[1] AS pick))
        SELECT user_id, p_id, s_id FROM g WHERE i > 0
        UNION ALL
        SELECT q.user_id, NULL, q.s_id FROM q1 q WHERE q.s_hi - q.s_lo >= 3600 AND NOT EXISTS (SELECT 1 FROM o WHERE o.s_id = q.s_id)
          AND NOT EXISTS (SELECT 1 FROM sig x WHERE x.user_id = q.user_id AND x.name = 'error' AND x.ts BETWEEN q.s_lo AND q.s_hi + 300)""",
    "haversine_legs": f"WITH {SIG}, {_LAGS} SELECT user_id, count({_D}) AS n, round(coalesce(sum({_D}), 0), 2) AS path_m, round(coalesce(max({_D}), 0), 3) AS longest_m FROM l GROUP BY user_id",
    "implausible_jumps": f"WITH {SIG}, {_LAGS} SELECT user_id, id FROM l WHERE {_D} > 0 AND (ts - ts0 <= 0 OR {_D} / (ts - ts0) * 3.6 > 0.1)",
    "edge_changes": f"""WITH {SIG}, {_R}, b AS (SELECT *, value::INT % 2 = 1 AS state FROM r WHERE value::INT % 3 <> 0),
        c AS (SELECT *, lag(state) OVER (PARTITION BY device, descriptor ORDER BY arrival_seq) AS prev FROM b)
        SELECT device, descriptor, arrival_seq, state FROM c WHERE prev IS NOT NULL AND prev <> state""",
    "reading_changes": f"""WITH {SIG}, {_R}, c AS (SELECT *, value::DOUBLE AS reading, lag(value::DOUBLE) OVER (PARTITION BY device, descriptor ORDER BY arrival_seq) AS prev FROM r WHERE value IS NOT NULL)
        SELECT device, descriptor, arrival_seq, reading FROM c WHERE prev IS NULL OR prev <> reading""",
    "state_changes": f"""WITH {SIG}, {_R}, b AS (SELECT *, CASE WHEN value::INT % 5 <> 0 THEN value END AS state FROM r),
        c AS (SELECT *, lag(state) OVER w AS prev, row_number() OVER w AS n FROM b WINDOW w AS (PARTITION BY device, descriptor ORDER BY arrival_seq))
        SELECT device, descriptor, arrival_seq, state FROM c WHERE n > 1 AND state IS DISTINCT FROM prev""",
    "vocabulary": f"WITH {SIG}, {_R} SELECT descriptor, min(arrival_seq) AS first_seq, arg_min(value, arrival_seq) AS first_value FROM r GROUP BY descriptor",
    "telemetry_updates": f"""WITH {SIG} SELECT user_id AS device, seq AS arrival_seq, name AS descriptor, CASE k::INT % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag,
        CASE k::INT % 5 WHEN 3 THEN true WHEN 4 THEN false END AS locked, CASE WHEN k::INT % 5 = 2 THEN 3.5::DOUBLE END AS number, CASE seq % 3 WHEN 0 THEN ts + 1 WHEN 1 THEN ts + 2 ELSE 0 END AS at FROM sig""",
    "drive_sessions": f"WITH {SIG}, {DRIVES} SELECT user_id, begin, finish FROM drives",
}
