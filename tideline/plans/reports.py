"""Queries: evidence, places, lineage, spend, timeline, source quality, processes, replay and ingest."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.schema import contract_violations
from tideline.operators import capabilities, ingest, lineage, places, process, quality, replay, sessions, spend, timeline
from tideline.plans import live
from tideline.plans.definitions import STANDARD
from tideline.plans.detection import DRIVES, LONGEST, PAIRS, SESSION
from tideline.plans.views import SIG, haversine_sql, signals
from tideline.session import table
from tideline.settings import KIND_FIELD

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- evidence: sessions with the events inside them as sources -------------------------------------------------------


def _evidence(spark, sf_dir) -> DataFrame:
    """Each session with its own two events and the user's views between them as located sources."""
    s = signals(spark, sf_dir)
    pairs = sessions.pair_sessions(s, "signup", "purchase", LONGEST)
    way = F.when(F.col("seq") % 3 == 0, F.array(F.lit("stationary"))).when(F.col("seq") % 3 == 1, F.array(F.lit("walking"))).otherwise(F.array(F.lit("driving")))
    inside = s.filter(F.col("name").isin("signup", "view", "purchase", "error")).select("user_id", "seq", "id", "name", "ts", "lat", "lon", "acc", way.alias("motion"))
    rows = sessions.in_sessions(inside, pairs).withColumns({c: F.col(f"_in.{c}") for c in ("start_id", "started_at", "ended_at")})
    plain = F.col("name") != "view"
    source = F.struct(
        F.col("seq").alias("q"), "id", "name", "ts", F.when(~plain, F.col("lat")).alias("lat"), F.when(~plain, F.col("lon")).alias("lon"), "acc", F.when(~plain, F.col("motion")).alias("motion"),
        F.when(F.col("name") == "error", F.lit("session_window")).alias("kind"), F.lit(None).cast("array<struct<id:string,name:string,ts:bigint,lat:double,lon:double,acc:double,motion:array<string>,kind:string>>").alias("parts"),
    )
    grouped = rows.groupBy("user_id", "start_id", "started_at", "ended_at").agg(F.sort_array(F.collect_list(source)).alias("_s"))
    return grouped.withColumn("sources", F.transform("_s", lambda x: x.dropFields("q"))).drop("_s")


_EV = f"""WITH {SIG}, {PAIRS}, ev AS (
  SELECT s.user_id, s.start_id, s.started_at, s.ended_at, x.id, x.name, x.ts, x.seq, CASE WHEN x.name = 'view' THEN lat END AS lat, CASE WHEN x.name = 'view' THEN lon END AS lon,
    CASE WHEN x.name = 'view' THEN CASE x.seq % 3 WHEN 0 THEN 'stationary' WHEN 1 THEN 'walking' ELSE 'driving' END END AS motion
  FROM sessions s JOIN sig x ON x.user_id = s.user_id AND x.seq BETWEEN s.start_seq AND s.end_seq AND x.name IN ('signup', 'view', 'purchase', 'error')) """


@query(_EV + """SELECT start_id, min(CASE WHEN lat IS NOT NULL OR nl = 0 THEN ts END) AS started_at, max(CASE WHEN lat IS NOT NULL OR nl = 0 THEN ts END) AS ended_at
    FROM (SELECT *, count(lat) OVER (PARTITION BY start_id) AS nl FROM ev) GROUP BY start_id""")
def evidence_interval(spark, sf_dir):
    e = _evidence(spark, sf_dir).withColumn("_i", capabilities.interval(F.col("sources")))
    return e.select("start_id", "_i.started_at", "_i.ended_at")


@query(_EV + f""", c AS (SELECT start_id, avg(lat) AS clat, avg(lon) AS clon FROM ev WHERE lat IS NOT NULL GROUP BY start_id)
    SELECT c.start_id, round(any_value(clat), 6) AS lat, round(any_value(clon), 6) AS lon, round(max({haversine_sql("clat", "clon", "ev.lat", "ev.lon")}), 1) AS spread_m
    FROM c JOIN ev ON ev.start_id = c.start_id AND ev.lat IS NOT NULL GROUP BY c.start_id""")
def evidence_place(spark, sf_dir):
    e = _evidence(spark, sf_dir).withColumn("_p", capabilities.place(F.col("sources"))).filter("_p is not null")
    return e.select("start_id", F.round("_p.lat", 6).alias("lat"), F.round("_p.lon", 6).alias("lon"), "_p.spread_m")


@query(_EV + f""", l AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, first_value(lat) OVER w AS a, first_value(lon) OVER w AS b,
      row_number() OVER (PARTITION BY start_id ORDER BY ts DESC, seq DESC) AS r FROM ev WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY start_id ORDER BY ts, seq))
    SELECT start_id, round(max(CASE WHEN r = 1 THEN lat END), 6) AS to_lat, round(max(a), 6) AS from_lat, round(max(CASE WHEN r = 1 THEN {haversine_sql("a", "b", "lat", "lon")} END), 1) AS straight_line_m,
      round(sum(CASE WHEN lat0 IS NULL THEN 0 ELSE {haversine_sql("lat0", "lon0", "lat", "lon")} END), 1) AS path_m FROM l GROUP BY start_id HAVING count(*) >= 2""")
def journey_endpoints(spark, sf_dir):
    e = _evidence(spark, sf_dir).withColumn("_j", capabilities.journey(F.col("sources"))).filter("_j is not null")
    return e.select("start_id", F.round("_j.destination.lat", 6).alias("to_lat"), F.round("_j.origin.lat", 6).alias("from_lat"), "_j.straight_line_m", "_j.path_m")


@query(_EV + """, m AS (SELECT start_id, motion, count(*) AS n, min(seq) AS f FROM ev WHERE motion IS NOT NULL AND motion <> 'stationary' GROUP BY 1, 2)
    SELECT start_id, motion AS mode FROM m QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY n DESC, f) = 1""")
def motion_mode(spark, sf_dir):
    return _evidence(spark, sf_dir).select("start_id", capabilities.mode(F.col("sources")).alias("mode")).filter("mode is not null")


@query(_EV + """, n AS (SELECT start_id, name, min(ts) AS t FROM ev WHERE lat IS NULL GROUP BY 1, 2)
    SELECT start_id, string_agg(name, ',' ORDER BY t, name) AS evidence, count(*) >= 2 AS confirmed FROM n GROUP BY start_id""")
def vehicle_evidence(spark, sf_dir):
    e = _evidence(spark, sf_dir).withColumn("_v", capabilities.vehicle(F.col("sources"))).filter("_v is not null")
    return e.select("start_id", F.array_join("_v.evidence", ",").alias("evidence"), "_v.confirmed")


@query(_EV + """, n AS (SELECT start_id, name, min(ts) AS t FROM ev WHERE name = 'error' GROUP BY 1, 2
      UNION ALL SELECT start_id, 'geometry', min(ts) FROM ev WHERE lat IS NOT NULL GROUP BY 1)
    SELECT start_id, string_agg(name, ',' ORDER BY t, name) AS kinds, CASE WHEN count(*) >= 2 THEN 'corroborated' ELSE 'single_source' END AS level FROM n GROUP BY start_id""")
def support_level(spark, sf_dir):
    e = _evidence(spark, sf_dir).withColumn("_v", capabilities.support(F.col("sources"))).filter("_v is not null")
    return e.select("start_id", F.array_join("_v.evidence_kinds", ",").alias("kinds"), "_v.level")


@query(f"""WITH RECURSIVE {SIG}, p AS MATERIALIZED (
      SELECT user_id, floor(ts / 2592000)::BIGINT AS period, ts, lat, lon, row_number() OVER (PARTITION BY user_id, floor(ts / 2592000)::BIGINT ORDER BY ts, id) AS i FROM sig),
    r AS (SELECT DISTINCT user_id, period, 0::BIGINT AS i, 0::BIGINT AS ts, 0::DOUBLE AS lat, 0::DOUBLE AS mlat, 0::DOUBLE AS mlon, 0::BIGINT AS n, 0::BIGINT AS c FROM p
      UNION ALL
      SELECT p.user_id, p.period, p.i, p.ts, p.lat, CASE WHEN near THEN r.mlat + (p.lat - r.mlat) / (r.n + 1) ELSE p.lat END, CASE WHEN near THEN r.mlon + (p.lon - r.mlon) / (r.n + 1) ELSE p.lon END,
        CASE WHEN near THEN r.n + 1 ELSE 1 END, CASE WHEN near THEN r.c ELSE r.c + 1 END
      FROM r JOIN p ON p.user_id = r.user_id AND p.period = r.period AND p.i = r.i + 1, LATERAL (SELECT r.n > 0 AND {haversine_sql("r.mlat", "r.mlon", "p.lat", "p.lon")} <= 60 AS near)),
    k AS (SELECT user_id, period, c, min(ts) AS started_at, max(ts) AS ended_at, round(avg(lat), 6) AS lat, max(c) OVER (PARTITION BY user_id, period) AS last FROM r WHERE i > 0 GROUP BY user_id, period, c)
    SELECT user_id, period, started_at, ended_at, ended_at - started_at AS duration_seconds, lat FROM k WHERE c > 1 AND c < last AND ended_at - started_at >= 120""")
def journey_pauses(spark, sf_dir):
    """Pauses among a user's events of 30 days."""
    s = signals(spark, sf_dir)
    source = F.struct("ts", "id", "name", "lat", "lon")
    spans = s.groupBy("user_id", F.floor(F.col("ts") / 2_592_000).alias("period")).agg(F.sort_array(F.collect_list(source)).alias("sources"))
    e = spans.select("user_id", "period", F.explode(capabilities.pauses(F.col("sources"))).alias("_p"))
    return e.select("user_id", "period", "_p.started_at", "_p.ended_at", "_p.duration_seconds", F.round("_p.place.lat", 6).alias("lat"))


# --- places ----------------------------------------------------------------------------------------------------------


def _places(spark):
    rows = [(f"place{i}", 47.2 + 0.02 * i + 0.0003, 8.5002, {0: 40.0, 3: 20.0}.get(i, 100.0), i == 0, ["home"] if i == 0 else [], True, "poi") for i in range(5)]
    return spark.createDataFrame(rows, "name string, lat double, lon double, radius_m double, everyday boolean, categories array<string>, enabled boolean, kind string")


PLACES = """places AS (SELECT 'place' || i AS name, 47.2::DOUBLE + 0.02::DOUBLE * i + 0.0003::DOUBLE AS lat, 8.5002::DOUBLE AS lon, CASE i WHEN 0 THEN 40.0 WHEN 3 THEN 20.0 ELSE 100.0 END::DOUBLE AS radius_m, i = 0 AS everyday
  FROM range(5) r(i))"""
_MATCH = f"""m AS (SELECT sig.id, sig.lat AS slat, sig.lon AS slon, p.name AS label, p.everyday, {haversine_sql("sig.lat", "sig.lon", "p.lat", "p.lon")} AS d, p.radius_m FROM sig JOIN places p ON true),
  best AS (SELECT * FROM m WHERE d <= radius_m QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, label) = 1)"""


@query(f"""WITH {SIG}, {PLACES}, {_MATCH} SELECT sig.id, label, round(d, 1) AS distance_m, everyday, CASE WHEN everyday THEN 'home' END AS category FROM sig LEFT JOIN best ON best.id = sig.id""")
def place_match(spark, sf_dir):
    s = signals(spark, sf_dir).select("id", "lat", "lon")
    found = places.match_places(s, _places(spark).filter("enabled and kind = 'poi'"), "id")
    return found.select("id", "label", "distance_m", "everyday", F.array_join("categories", ",").alias("category"))


@query(f"""WITH {SIG}, {PLACES}, {_MATCH} SELECT round(floor(sig.lat / 0.001) * 0.001, 6) AS cell_lat, round(floor(sig.lon / 0.001) * 0.001, 6) AS cell_lon, count(*) AS stays, sum(seq)::BIGINT AS seconds
    FROM sig LEFT JOIN best ON best.id = sig.id WHERE label IS NULL GROUP BY 1, 2""")
def unlabelled(spark, sf_dir):
    s = signals(spark, sf_dir).select("id", "lat", "lon", F.col("seq").alias("duration_seconds"))
    return places.unlabelled(places.match_places(s, _places(spark), "id"))


# --- lineage: sessions, the day's first session of a user, and raw events --------------------------------------------


def _graph(spark, sf_dir):
    """Events and edges: a session comes from its two events, a day from its sessions."""
    s = sessions.pair_sessions(signals(spark, sf_dir), "signup", "purchase", LONGEST)
    part = lambda i, n, t: F.struct(F.col(i).alias("id"), F.lit(n).alias("name"), F.col(t).alias("timestamp"))
    one = s.select(F.concat(F.lit("s"), "start_id").alias("id"), "user_id", F.lit("session").alias("name"), F.col("ended_at").alias("ts"), F.array(part("start_id", "signup", "started_at"), part("end_id", "purchase", "ended_at")).alias("derived_from"))
    day = F.floor(F.col("ts") / 86400)
    two = one.groupBy("user_id", day.alias("day")).agg(F.max("ts").alias("ts"), F.collect_list(F.struct("id", "name", F.col("ts").alias("timestamp"))).alias("derived_from"))
    two = two.select(F.concat_ws(":", F.lit("d"), "user_id", "day").alias("id"), "user_id", F.lit("day").alias("name"), "ts", "derived_from")
    events = one.unionByName(two)
    raw = signals(spark, sf_dir).filter("name in ('signup', 'purchase')").select("id", "user_id", "name", "ts")
    return events, raw, lineage.edges(events)


_G = f"""{SIG}, {PAIRS}, ses AS (SELECT 's' || start_id AS id, user_id, 'session' AS name, ended_at AS ts, start_id, end_id FROM sessions),
  dy AS (SELECT 'd:' || user_id || ':' || (ts // 86400) AS id, user_id, 'day' AS name, max(ts) AS ts FROM ses GROUP BY user_id, ts // 86400),
  links AS (SELECT id AS child_id, start_id AS parent_id FROM ses UNION SELECT id, end_id FROM ses UNION SELECT 'd:' || user_id || ':' || (ts // 86400), id FROM ses),
  ev AS (SELECT id, user_id, name, ts FROM ses UNION ALL SELECT id, user_id, name, ts FROM dy UNION ALL SELECT id, user_id, name, ts FROM sig WHERE name IN ('signup', 'purchase'))"""


@query(f"WITH {_G} SELECT child_id, parent_id FROM links")
def lineage_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[2]


@query(f"""WITH RECURSIVE {_G}, d AS (SELECT id, 1 AS depth FROM ev UNION SELECT l.child_id, d.depth + 1 FROM d JOIN links l ON l.parent_id = d.id)
    SELECT name, max(depth) AS deepest, count(*) AS n FROM (SELECT d.id, max(depth) AS depth FROM d GROUP BY d.id) x JOIN ev ON ev.id = x.id GROUP BY name""")
def derivation_depth(spark, sf_dir):
    events, raw, links = _graph(spark, sf_dir)
    every = events.select("id", "user_id", "name", "ts").unionByName(raw)
    d = lineage.depths(every, links)
    return every.join(d, "id").groupBy("name").agg(F.max("depth").alias("deepest"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {_G}, d AS (SELECT id, 1 AS depth FROM ev UNION SELECT l.child_id, d.depth + 1 FROM d JOIN links l ON l.parent_id = d.id),
    x AS (SELECT ev.id, ev.name, ev.ts, m.depth FROM (SELECT id, max(depth) AS depth FROM d GROUP BY id) m JOIN ev ON ev.id = m.id),
    newest AS (SELECT name, depth FROM x QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC, id DESC) = 1)
    SELECT x.name, any_value(newest.depth)::INT AS depth, string_agg(DISTINCT x.depth::VARCHAR, ',' ORDER BY x.depth::VARCHAR) AS depths, max(x.depth)::INT AS deepest FROM x JOIN newest ON newest.name = x.name GROUP BY x.name""")
def depths_of_types(spark, sf_dir):
    events, raw, links = _graph(spark, sf_dir)
    every = events.select("id", "user_id", "name", "ts").unionByName(raw)
    found = lineage.depth_by_type(every, lineage.depths(every, links))
    return found.select("name", F.col("depth").cast("int").alias("depth"), F.array_join(F.transform("depths", lambda d: d.cast("string")), ",").alias("depths"), F.col("deepest").cast("int").alias("deepest"))


@query(f"""WITH RECURSIVE {_G}, r AS (SELECT id AS root, id, 0 AS distance FROM dy UNION SELECT r.root, l.parent_id, r.distance + 1 FROM r JOIN links l ON l.child_id = r.id)
    SELECT root, distance, count(*) AS n FROM (SELECT root, id, min(distance) AS distance FROM r WHERE distance > 0 GROUP BY 1, 2) GROUP BY 1, 2""")
def lineage_closure(spark, sf_dir):
    events, _, links = _graph(spark, sf_dir)
    up = lineage.closure(links, events.filter("name = 'day'").select("id"))
    return up.groupBy("root", "distance").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_G} SELECT l.child_id, e.name, count(*) AS n, min(e.ts) AS first_ts, max(e.ts) AS last_ts, count(*) >= 2 AS collapsed, CASE WHEN count(*) < 2 THEN string_agg(l.parent_id, ',' ORDER BY l.parent_id) END AS ids
    FROM links l JOIN ev e ON e.id = l.parent_id GROUP BY 1, 2""")
def grouped_children(spark, sf_dir):
    events, raw, links = _graph(spark, sf_dir)
    every = events.select("id", "user_id", "name", "ts").unionByName(raw)
    return lineage.grouped_children(links, every, 2).withColumn("ids", F.array_join("ids", ","))


@query(f"WITH {_G} SELECT count(*) AS n, count(DISTINCT parent_id) AS ids FROM links WHERE child_id IN (SELECT id FROM ses)")
def absorbed_contributors(spark, sf_dir):
    events, _, links = _graph(spark, sf_dir)
    spans = events.filter("name = 'session'").select("id")
    n = lineage.absorbed(links, spans).agg(F.count(F.lit(1)).alias("ids"))
    return links.join(spans.withColumnRenamed("id", "child_id"), "child_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).crossJoin(n)


# --- windowed reads and spend ----------------------------------------------------------------------------------------

AS_OF, DAYS = date(2024, 1, 28), 14


def _pay(spark, sf_dir):
    s = signals(spark, sf_dir).filter("name = 'purchase'")
    body = F.to_json(F.struct(F.round("value", 2).cast("decimal(18,2)").cast("string").alias("amount"), F.col("k").alias("merchant")))
    rows = s.withColumn("message", body)
    return spend.payments(rows, "purchase")


def _stays(spark, sf_dir):
    """Six hours from each click, labelled by the click's place."""
    s = signals(spark, sf_dir).filter("name = 'click'")
    return s.select("user_id", F.col("id").alias("span_id"), F.col("ts").alias("lo"), (F.col("ts") + 21600).alias("hi"), (F.col("ts") + 21600).alias("emitted_at"), F.concat(F.lit("place"), F.col("seq") % 3).alias("label"))


_B = spend.bounds(AS_OF, DAYS)
_PAY = f"""{SIG}, pay AS (SELECT id, user_id, ts, round(value, 2)::DECIMAL(18,2) AS amount, k AS merchant FROM sig WHERE name = 'purchase'),
  now_ AS (SELECT * FROM pay WHERE ts >= {_B["start"]} AND ts < {_B["end"]}),
  loc AS (SELECT p.*, c.id AS span_id, 'place' || (c.seq % 3) AS label FROM now_ p LEFT JOIN sig c ON c.name = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts AND p.ts <= c.ts + 21600
      AND c.ts + 21600 < {_B["end"] + 86400} QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY c.id) = 1)"""


@query("SELECT DISTINCT user_id::VARCHAR AS user_id FROM events")
def entities(spark, sf_dir):
    return spend.entities(signals(spark, sf_dir))


@query(f"WITH {SIG} SELECT id, user_id, name, ts FROM sig WHERE ts >= {_B['start']}")
def user_window(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("occurred_at", F.timestamp_seconds("ts"))
    return spend.trailing_days(s, None, AS_OF, DAYS).select("id", "user_id", "name", "ts")


@query(f"WITH {_PAY} SELECT id, amount, merchant, span_id, label FROM loc")
def located_payments(spark, sf_dir):
    pay = _pay(spark, sf_dir).filter((F.col("ts") >= _B["start"]) & (F.col("ts") < _B["end"]))
    return spend.located_payments(pay, _stays(spark, sf_dir), _B["end"]).select("id", "amount", "merchant", "span_id", "label")


@query(f"""WITH {_PAY} SELECT (DATE '1970-01-01' + d::INT)::DATE AS day, count(id) AS n, coalesce(sum(amount), 0)::DECIMAL(28,2) AS total
    FROM range({_B["start"] // 86400}, {_B["end"] // 86400}) r(d) LEFT JOIN now_ ON now_.ts // 86400 = d GROUP BY d""")
def spend_by_day(spark, sf_dir):
    return spend.by_day(_pay(spark, sf_dir), _B["start"], _B["end"])


@query(f"WITH {_PAY} SELECT coalesce(label, merchant) AS who, bool_or(label IS NOT NULL) AS placed, count(*) AS n, sum(amount)::DECIMAL(28,2) AS total FROM loc GROUP BY 1 ORDER BY total DESC, who LIMIT 8")
def spend_merchants(spark, sf_dir):
    pay = _pay(spark, sf_dir).filter((F.col("ts") >= _B["start"]) & (F.col("ts") < _B["end"]))
    return spend.merchants(spend.located_payments(pay, _stays(spark, sf_dir), _B["end"]))


@query(f"""WITH {_PAY}, t AS (SELECT sum(amount)::DECIMAL(28,2) AS total, count(*) AS n, count(label) AS matched FROM loc),
    p AS (SELECT coalesce(sum(amount), 0)::DECIMAL(28,2) AS prev_total FROM pay WHERE ts >= {_B["previous"]} AND ts < {_B["start"]})
    SELECT total, n, matched, prev_total, round(CASE WHEN prev_total <> 0 THEN (total - prev_total)::DOUBLE / prev_total::DOUBLE END, 6) AS delta, {DAYS} AS n_days FROM t, p""")
def spend_report(spark, sf_dir):
    r = spend.report(_pay(spark, sf_dir), _stays(spark, sf_dir), AS_OF, DAYS)
    return r.select("total", "n", "matched", "prev_total", F.round(F.col("delta").cast("double"), 6).alias("delta"), F.size("by_day").alias("n_days"))


@query("""WITH u AS (SELECT user_id::VARCHAR AS user_id, event_id, json_extract_string(props, '$.k')::INT AS k FROM events WHERE event_type = 'click')
    SELECT e.user_id, coalesce(u.k, 0) AS level FROM (SELECT DISTINCT user_id::VARCHAR AS user_id FROM events) e
    LEFT JOIN (SELECT user_id, arg_max(k, event_id) AS k FROM u GROUP BY user_id) u ON u.user_id = e.user_id""")
def preferences(spark, sf_dir):
    s = signals(spark, sf_dir)
    log = s.filter("name = 'click'").select("user_id", F.create_map(F.lit("trip"), F.col("k").cast("int")).alias("level"), F.array(F.col("k")).alias("hidden"), F.col("seq").alias("updated_at"))
    return spend.latest_preferences(log, s).select("user_id", F.coalesce(F.try_element_at("level", F.lit("trip")), F.lit(0)).alias("level"))


# --- timeline: sessions of three kinds as spans, everything else as moments -------------------------------------------


def _timeline(spark, sf_dir):
    s = signals(spark, sf_dir)
    pairs = sessions.pair_kinds(s, {"car_trip": ("signup", "purchase"), "trip": ("view", "purchase"), "journey": ("click", "error")}, 43_200)
    spans = pairs.select(
        F.concat("kind", F.lit(":"), "start_id").alias("id"), "user_id", F.col("kind").alias("name"), F.col("ended_at").alias("ts"), F.col("started_at").alias("lo"), F.col("ended_at").alias("hi"),
        (F.col("start_seq") % 4 == 0).alias("everyday"), F.when(F.col("start_seq") % 3 == 0, "driving").when(F.col("start_seq") % 3 == 1, "walking").alias("mode"), F.lit(None).cast("decimal(18,2)").alias("amount"),
    )
    moments = s.select(
        "id", "user_id", F.when(F.col("name") == "purchase", "payment").otherwise(F.col("name")).alias("name"), "ts", F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"),
        F.lit(None).cast("boolean").alias("everyday"), F.lit(None).cast("string").alias("mode"), F.when(F.col("name") == "purchase", F.round("value", 2).cast("decimal(18,2)")).alias("amount"),
    )
    return spans.unionByName(moments)


def _kind(name: str, start: str, end: str) -> str:
    return f"""{name}_e AS (SELECT *, sum(CASE WHEN name = '{start}' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ep FROM sig WHERE name IN ('{start}', '{end}')),
  {name}_s AS (SELECT '{name}:' || a.id AS id, a.user_id, '{name}' AS name, b.ts, a.ts AS lo, b.ts AS hi, a.seq % 4 = 0 AS everyday, CASE a.seq % 3 WHEN 0 THEN 'driving' WHEN 1 THEN 'walking' END AS mode
    FROM (SELECT * FROM {name}_e WHERE name = '{start}') a JOIN (SELECT * FROM {name}_e WHERE name = '{end}') b ON b.user_id = a.user_id AND b.ep = a.ep AND b.ts > a.ts
    QUALIFY row_number() OVER (PARTITION BY a.user_id, a.ep ORDER BY b.seq) = 1)"""


_TL = f"""WITH {SIG}, {_kind("car_trip", "signup", "purchase")}, {_kind("trip", "view", "purchase")}, {_kind("journey", "click", "error")},
  spans AS (SELECT * FROM (SELECT * FROM car_trip_s UNION ALL SELECT * FROM trip_s UNION ALL SELECT * FROM journey_s) WHERE hi - lo <= 43200),
  gone AS (SELECT DISTINCT a.id FROM spans a JOIN spans b ON b.user_id = a.user_id AND ((a.name = 'car_trip' AND b.name IN ('journey', 'trip')) OR (a.name = 'trip' AND b.name = 'journey'))
    AND a.lo <= b.hi AND b.lo <= a.hi),
  standing AS (SELECT * FROM spans WHERE id NOT IN (SELECT id FROM gone)),
  mo AS (SELECT id, user_id, CASE WHEN name = 'purchase' THEN 'payment' ELSE name END AS name, ts, CASE WHEN name = 'purchase' THEN round(value, 2)::DECIMAL(18,2) END AS amount FROM sig),
  host AS (SELECT m.id, m.user_id, m.name, m.ts, s.id AS host_id FROM mo m LEFT JOIN spans s ON s.user_id = m.user_id AND s.lo <= m.ts AND m.ts <= s.hi
    QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY s.hi - s.lo, s.id) = 1) """


@query(_TL + "SELECT id, host_id FROM host")
def innermost_host(spark, sf_dir):
    return timeline.hosts(_timeline(spark, sf_dir)).select("id", "host_id")


@query(_TL + "SELECT id, name, ts FROM host WHERE host_id IS NULL")
def orphans(spark, sf_dir):
    return timeline.orphans(_timeline(spark, sf_dir)).select("id", "name", "ts")


@query(_TL + "SELECT id FROM gone")
def superseded(spark, sf_dir):
    return timeline.superseded(_timeline(spark, sf_dir))


@query(_TL + """, d AS (SELECT user_id, lo // 86400 AS day, sum(hi - lo)::BIGINT AS driving_seconds FROM standing WHERE mode IS NULL OR mode = 'driving' GROUP BY 1, 2),
  p AS (SELECT user_id, ts // 86400 AS day, sum(amount)::DECIMAL(28,2) AS spent FROM mo WHERE name = 'payment' GROUP BY 1, 2)
  SELECT coalesce(d.user_id, p.user_id) AS user_id, (DATE '1970-01-01' + coalesce(d.day, p.day)::INT)::DATE AS day, coalesce(driving_seconds, 0) AS driving_seconds, coalesce(spent, 0)::DECIMAL(28,2) AS spent
  FROM d FULL JOIN p ON p.user_id = d.user_id AND p.day = d.day""")
def daily_totals(spark, sf_dir):
    return timeline.daily_totals(_timeline(spark, sf_dir))


@query(_TL + """, g AS (SELECT user_id, lo // 86400 AS day, lo, max(hi) OVER (PARTITION BY user_id, lo // 86400 ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start FROM standing)
  SELECT user_id, (DATE '1970-01-01' + day::INT)::DATE AS day, gap_start, lo AS gap_end FROM g WHERE lo - gap_start > 2700""")
def quiet_gaps(spark, sf_dir):
    return timeline.quiet_gaps(timeline.standing(_timeline(spark, sf_dir)).select("user_id", "lo", "hi"))


@query(_TL + """, x AS (SELECT user_id, lo, hi FROM spans UNION ALL SELECT user_id, lo, lo FROM spans UNION ALL SELECT user_id, hi, hi FROM spans UNION ALL SELECT user_id, ts, ts FROM mo UNION ALL SELECT user_id, ts, ts FROM mo),
  g AS (SELECT user_id, lo // 86400 AS day, lo, max(hi) OVER (PARTITION BY user_id, lo // 86400 ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start FROM x)
  SELECT user_id, (DATE '1970-01-01' + day::INT)::DATE AS day, gap_start, lo AS gap_end FROM g WHERE lo - gap_start > 3000""")
def silences(spark, sf_dir):
    return timeline.silences(_timeline(spark, sf_dir))


@query(_TL + "SELECT user_id, id, name, lo, hi FROM standing QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY hi DESC, id DESC) = 1")
def last_journey(spark, sf_dir):
    return timeline.latest_journey(_timeline(spark, sf_dir))


@query(_TL + """SELECT id, user_id, (DATE '1970-01-01' + (lo // 86400)::INT)::DATE AS day, row_number() OVER (PARTITION BY user_id, lo // 86400 ORDER BY lo, id) AS place_in_day
  FROM standing WHERE NOT coalesce(everyday, false)""")
def day_spine(spark, sf_dir):
    return timeline.day_spine(_timeline(spark, sf_dir)).select("id", "user_id", "day", "place_in_day")


@query(_TL + """, a AS (SELECT user_id, name, ts FROM spans UNION ALL SELECT user_id, name, ts FROM mo)
  SELECT user_id, (DATE '1970-01-01' + (ts // 86400)::INT)::DATE AS day, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM a GROUP BY user_id, ts // 86400""")
def days_present(spark, sf_dir):
    return timeline.days_present(_timeline(spark, sf_dir)).withColumn("names", F.array_join("names", ","))


@query("""WITH d(name, depth) AS (VALUES ('click', 1), ('view', 2), ('error', 5), ('purchase', 3)), n AS (SELECT DISTINCT user_id::VARCHAR AS user_id, event_type AS name FROM events),
  o AS (SELECT user_id::VARCHAR AS user_id, arg_max(json_extract_string(props, '$.k')::INT, event_id) AS k FROM events WHERE event_type = 'click' GROUP BY 1)
  SELECT n.user_id, n.name, CASE WHEN n.name = 'view' AND o.k IS NOT NULL THEN greatest(1, least(o.k, 5)) WHEN depth IS NULL THEN 5 ELSE greatest(1, least(5 - depth + 1, 5)) END::INT AS lane
  FROM n LEFT JOIN d ON d.name = n.name LEFT JOIN o ON o.user_id = n.user_id""")
def level_ladder(spark, sf_dir):
    s = signals(spark, sf_dir)
    depth = spark.createDataFrame([("click", 1), ("view", 2), ("error", 5), ("purchase", 3)], "name string, depth int")
    log = s.filter("name = 'click'").select("user_id", F.create_map(F.lit("view"), F.col("k").cast("int")).alias("level"), F.array().cast("array<string>").alias("hidden"), F.col("seq").alias("updated_at"))
    overrides = log.groupBy("user_id").agg(F.max_by("level", "updated_at").alias("level"))
    return timeline.ladder(depth, overrides, s.select("user_id", "name").distinct())


@query(f"WITH {SIG} SELECT id, CASE WHEN seq % 4 = 0 THEN 'place' || (seq % 3) WHEN name = 'purchase' THEN 'Purchase' ELSE upper(name[1]) || name[2:] END AS label, "
       "CASE WHEN (round((seq * 37 % 90000) / 60.0)) < 60 THEN round((seq * 37 % 90000) / 60.0)::INT || ' min' WHEN round((seq * 37 % 90000) / 60.0)::INT % 60 = 0 THEN (round((seq * 37 % 90000) / 60.0)::INT // 60) || ' h' "
       "ELSE (round((seq * 37 % 90000) / 60.0)::INT // 60) || ' h ' || (round((seq * 37 % 90000) / 60.0)::INT % 60) || ' min' END AS lasted FROM sig")
def event_labels(spark, sf_dir):
    s = signals(spark, sf_dir)
    place = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("place"), F.col("seq") % 3))
    return s.select("id", timeline.label(place, F.col("name")).alias("label"), timeline.duration_text(F.col("seq") * 37 % 90000).alias("lasted"))


@query(f"WITH {SIG} SELECT id, CASE WHEN seq % 11 = 0 THEN 0 ELSE greatest(0, least(1, (seq % 70) / 10.0::DOUBLE - (seq % 5 + 1) + 1)) END::DOUBLE AS opacity FROM sig")
def level_visibility(spark, sf_dir):
    s = signals(spark, sf_dir)
    return s.select("id", timeline.visibility((F.col("seq") % 70) / F.lit(10.0), F.col("seq") % 5 + 1, F.col("seq") % 11 == 0).alias("opacity"))


# --- source quality --------------------------------------------------------------------------------------------------


def _bodies(spark, sf_dir):
    """Events with a JSON body: polled a while after they occurred, ingested some time later; sources are event types."""
    s = signals(spark, sf_dir)
    k = F.col("k").cast("int")
    body = F.when(k % 4 == 0, F.concat(F.lit('{"timestamp": "'), F.col("ts"), F.lit('"}'))).otherwise(
        F.concat(F.lit('{"timestamp": '), F.col("ts"), F.lit(', "n8n_polled_at": '), F.col("ts") + k, F.lit(', "upstream_id": "u'), F.floor(F.col("seq") / 3), F.lit('", "backfill": '), F.when(k % 5 == 0, "true").otherwise("false"), F.lit("}"))
    )
    return s.select("id", "user_id", "name", F.col("name").alias("source_app"), F.col("ts").cast("double").alias("occurred_at"), (F.col("ts") + k + (F.col("seq") % 30)).cast("double").alias("ingested_at"), body.alias("message"))


_BODY = f"""WITH {SIG}, b AS (SELECT id, name AS source_app, ts::DOUBLE AS occurred_at, (ts + k::INT + seq % 30)::DOUBLE AS ingested_at, CASE WHEN k::INT % 4 <> 0 THEN (ts + k::INT)::DOUBLE END AS polled_at,
    k::INT % 4 = 0 AS bad_timestamp, k::INT % 4 <> 0 AND k::INT % 5 = 0 AS backfill, CASE WHEN k::INT % 4 <> 0 THEN 'u' || (seq // 3) END AS upstream_id FROM sig) """
_AS_OF = 1706745600


@query(_BODY + f"""SELECT source_app, count(*) AS n, count(polled_at) AS stamped, count(*) FILTER (backfill) AS backfilled, count(*) FILTER (bad_timestamp) AS bad_timestamps, count(upstream_id) AS with_upstream_id,
    round(({_AS_OF} - max(ingested_at)) / 3600, 4) AS age_hours, round(quantile_cont(ingested_at - occurred_at, 0.5) FILTER (NOT backfill), 4) AS e2e_p50,
    round(quantile_cont(polled_at - occurred_at, 0.95) FILTER (NOT backfill), 4) AS trigger_p95, round(quantile_cont(ingested_at - polled_at, 0.95) FILTER (NOT backfill), 4) AS pipeline_p95 FROM b GROUP BY source_app""")
def source_latency(spark, sf_dir):
    rows = quality.with_contract_flags(quality.with_latency(quality.without(_bodies(spark, sf_dir))))
    s = quality.by_source(rows, _AS_OF)
    return s.select("source_app", "n", "stamped", "backfilled", "bad_timestamps", "with_upstream_id", F.round("age_hours", 4).alias("age_hours"), F.round("e2e_s_p50", 4).alias("e2e_p50"), F.round("trigger_s_p95", 4).alias("trigger_p95"), F.round("pipeline_s_p95", 4).alias("pipeline_p95"))


@query(_BODY + """SELECT source_app, upstream_id, count(*) AS copies, min(ingested_at) AS first_seen, max(ingested_at) AS last_seen FROM b WHERE upstream_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1
    ORDER BY copies DESC, last_seen DESC, source_app, upstream_id LIMIT 20""")
def duplicates(spark, sf_dir):
    return quality.duplicates(quality.with_latency(_bodies(spark, sf_dir)))


@query(_BODY + f""", s AS (SELECT source_app, count(*) AS n, count(*) FILTER (backfill) AS bf, count(polled_at) AS st, ({_AS_OF} - max(ingested_at)) / 3600 AS age, quantile_cont(polled_at - occurred_at, 0.95) FILTER (NOT backfill) AS t95,
    quantile_cont(ingested_at - polled_at, 0.95) FILTER (NOT backfill) AS p95, count(*) FILTER (bad_timestamp) AS bad, count(upstream_id) AS up FROM b GROUP BY source_app)
    SELECT source_app, 'stale' AS problem, round(age, 4)::DOUBLE AS value FROM s WHERE age > 24 UNION ALL SELECT source_app, 'unstamped', (n - bf - st)::DOUBLE FROM s WHERE st < n - bf
    UNION ALL SELECT source_app, 'slow_trigger', t95 FROM s WHERE t95 > 900 UNION ALL SELECT source_app, 'slow_pipeline', p95 FROM s WHERE p95 > 10 UNION ALL SELECT source_app, 'contract', bad::DOUBLE FROM s WHERE bad > 0
    UNION ALL SELECT source_app, 'no_upstream_ids', n::DOUBLE FROM s WHERE up = 0
    UNION ALL SELECT source_app, 'redundant_rows', sum(c - 1)::DOUBLE FROM (SELECT source_app, count(*) AS c FROM b WHERE upstream_id IS NOT NULL GROUP BY source_app, upstream_id HAVING count(*) > 1) GROUP BY source_app""")
def source_problems(spark, sf_dir):
    rows = quality.with_contract_flags(quality.with_latency(_bodies(spark, sf_dir)))
    every = rows.filter("upstream_id is not null").groupBy("source_app", "upstream_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return quality.problems(quality.by_source(rows, _AS_OF), every).withColumn("value", F.round("value", 4))


@query(f"""WITH {SIG} SELECT id, CASE WHEN seq % 3 = 0 THEN 'extra' ELSE '' END AS unknown, CASE WHEN seq % 5 = 0 THEN 'id' ELSE '' END AS missing FROM sig WHERE seq % 3 = 0 OR seq % 5 = 0""")
def payload_violations(spark, sf_dir):
    """Events as payloads, some without their id and some with a field that no payload has."""
    s = signals(spark, sf_dir)
    body = F.to_json(F.struct(F.when(F.col("seq") % 5 != 0, F.col("id")).alias("id"), "name", F.lit("x").alias(KIND_FIELD), "user_id", F.col("ts").alias("timestamp"), F.when(F.col("seq") % 3 == 0, F.lit("x")).alias("extra")))
    bad = contract_violations(s.select("id", body.alias("message")))
    return bad.select("id", F.array_join("unknown", ",").alias("unknown"), F.array_join("missing", ",").alias("missing"))


# --- processes: a cycle a user, stages from event types ---------------------------------------------------------------

_STAGES = [("opened", []), ("collected", ["opened"]), ("checked", ["collected"]), ("sent", ["collected", "checked"])]


def _cycle():
    """A cycle a user and week."""
    return F.concat_ws("-", "user_id", F.floor(F.col("ts") / 604_800))


def _log(spark, sf_dir):
    s = signals(spark, sf_dir)
    stage = F.create_map(*[F.lit(x) for kv in (("signup", "opened"), ("view", "collected"), ("click", "checked"), ("purchase", "sent"), ("error", "void")) for x in kv])
    name = F.when((F.col("name") == "error") & (F.col("k").cast("int") > 3), "view").otherwise(F.col("name"))  # few errors void a cycle
    body = F.to_json(F.struct(F.col("k"), F.col("id"), F.col("name")))
    return s.withColumn("stage", F.try_element_at(stage, name)).select("id", F.lit("billing").alias("process"), _cycle().alias("cycle_key"), "stage", "ts", F.col("seq").alias("arrival"), body.alias("body"))


def _stages(spark):
    return spark.createDataFrame([("billing", s, i, a) for i, (s, a) in enumerate(_STAGES)], "process string, stage string, position int, after array<string>")


_LOG = f"""WITH {SIG}, lg AS (SELECT id, user_id || '-' || (ts // 604800) AS cycle_key, CASE name WHEN 'signup' THEN 'opened' WHEN 'view' THEN 'collected' WHEN 'click' THEN 'checked' WHEN 'purchase' THEN 'sent' ELSE CASE WHEN k::INT > 3 THEN 'collected' ELSE 'void' END END AS stage, ts, seq FROM sig),
  ms AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY cycle_key, stage ORDER BY seq DESC) = 1),
  cy AS (SELECT cycle_key, min(ts) AS opened_at, arg_min(id, seq) AS genesis_id FROM lg WHERE stage = 'opened' GROUP BY 1),
  st(stage, position) AS (VALUES ('opened', 0), ('collected', 1), ('checked', 2), ('sent', 3)), af(stage, a) AS (VALUES ('collected', 'opened'), ('checked', 'collected'), ('sent', 'collected'), ('sent', 'checked')) """


@query(_LOG + "SELECT cycle_key, genesis_id, opened_at FROM cy")
def cycles(spark, sf_dir):
    return process.cycles(_log(spark, sf_dir), "opened").select("cycle_key", "genesis_id", "opened_at")


@query(_LOG + "SELECT cycle_key, stage, id, ts FROM ms")
def latest_milestones(spark, sf_dir):
    return process.milestones(_log(spark, sf_dir)).select("cycle_key", "stage", "id", "ts")


_FRONT = _LOG + """, x AS (SELECT cy.cycle_key, st.stage, cy.opened_at, EXISTS (SELECT 1 FROM ms WHERE ms.cycle_key = cy.cycle_key AND ms.stage = st.stage) AS done,
      EXISTS (SELECT 1 FROM ms WHERE ms.cycle_key = cy.cycle_key AND ms.stage = 'void') AS voided,
      NOT EXISTS (SELECT 1 FROM af WHERE af.stage = st.stage AND NOT EXISTS (SELECT 1 FROM ms WHERE ms.cycle_key = cy.cycle_key AND ms.stage = af.a)) AS ready,
      (SELECT max(ms.ts) FROM ms JOIN af ON af.a = ms.stage WHERE ms.cycle_key = cy.cycle_key AND af.stage = st.stage) AS pt FROM cy, st),
  fr AS (SELECT cycle_key, stage, CASE WHEN done THEN 'done' WHEN voided THEN 'inert' WHEN ready THEN 'ready' ELSE 'blocked' END AS state, CASE WHEN NOT done AND ready AND NOT voided THEN coalesce(pt, opened_at) END AS look_from,
    CASE WHEN voided THEN 'voided' WHEN bool_and(done) OVER (PARTITION BY cycle_key) THEN 'complete' ELSE 'waiting' END AS status FROM x) """


@query(_FRONT + "SELECT cycle_key, stage, state, look_from, status FROM fr")
def cycle_frontier(spark, sf_dir):
    log = _log(spark, sf_dir)
    return process.frontier(process.cycles(log, "opened"), process.milestones(log), _stages(spark)).select("cycle_key", "stage", "state", "look_from", "status")


@query(_FRONT + """SELECT fr.cycle_key, fr.stage, min(sig.ts) AS evidence_ts FROM fr JOIN sig ON sig.name = 'error' AND sig.user_id || '-' || (sig.ts // 604800) = fr.cycle_key AND sig.ts >= fr.look_from - 900
    AND contains('order ' || sig.seq, (fr.look_from % 10)::VARCHAR) WHERE fr.state = 'ready' GROUP BY 1, 2""")
def evidence_match(spark, sf_dir):
    log = _log(spark, sf_dir)
    f = process.frontier(process.cycles(log, "opened"), process.milestones(log), _stages(spark)).filter("state = 'ready'")
    waiting = f.select(F.concat_ws("/", "cycle_key", "stage").alias("key"), "cycle_key", "stage", F.lit("error").alias("event"), "look_from", F.col("cycle_key").alias("correlate"), (F.col("look_from") % 10).cast("string").alias("mention"))
    c = signals(spark, sf_dir).filter("name = 'error'").select(F.col("name").alias("event"), "id", "ts", _cycle().alias("correlate"), F.concat(F.lit("Order "), "seq").alias("text"))
    return waiting.join(process.match_evidence(waiting, c, correlate=True, mention=True), "key").select("cycle_key", "stage", "evidence_ts")


_RUN_AT = 1_800_000_000


@query(_LOG + f""", lv AS (SELECT * FROM cy WHERE NOT EXISTS (SELECT 1 FROM ms WHERE ms.cycle_key = cy.cycle_key AND ms.stage = 'void')),
    c AS (SELECT user_id || '-' || (ts // 604800) AS cycle_key, ts FROM sig WHERE name <> 'signup'), m0 AS (SELECT cycle_key, stage, ts FROM ms),
    m1 AS (SELECT * FROM m0 UNION ALL SELECT lv.cycle_key, 'collected', min(c.ts) FROM lv JOIN m0 o ON o.cycle_key = lv.cycle_key AND o.stage = 'opened' JOIN c ON c.cycle_key = lv.cycle_key AND c.ts >= o.ts - 900
      WHERE NOT EXISTS (SELECT 1 FROM m0 x WHERE x.cycle_key = lv.cycle_key AND x.stage = 'collected') GROUP BY 1),
    m2 AS (SELECT * FROM m1 UNION ALL SELECT lv.cycle_key, 'checked', min(c.ts) FROM lv JOIN m1 o ON o.cycle_key = lv.cycle_key AND o.stage = 'collected' JOIN c ON c.cycle_key = lv.cycle_key AND c.ts >= o.ts - 900
      WHERE NOT EXISTS (SELECT 1 FROM m1 x WHERE x.cycle_key = lv.cycle_key AND x.stage = 'checked') GROUP BY 1)
    SELECT * FROM m2 UNION ALL SELECT lv.cycle_key, 'sent', {_RUN_AT} FROM lv WHERE EXISTS (SELECT 1 FROM m2 x WHERE x.cycle_key = lv.cycle_key AND x.stage = 'collected')
      AND EXISTS (SELECT 1 FROM m2 x WHERE x.cycle_key = lv.cycle_key AND x.stage = 'checked') AND NOT EXISTS (SELECT 1 FROM m2 x WHERE x.cycle_key = lv.cycle_key AND x.stage = 'sent')""")
def process_run(spark, sf_dir):
    """A run over all cycles: collected and checked need an event after their predecessors, sent follows by itself."""
    log = _log(spark, sf_dir)
    c = signals(spark, sf_dir).filter("name <> 'signup'").select(F.lit("step").alias("event"), "id", "ts", _cycle().alias("correlate"))

    def find(ready, stage):
        if stage == "sent":
            return ready.select("process", "cycle_key", F.lit(None).cast("bigint").alias("evidence_ts"))
        waiting = ready.select(F.col("cycle_key").alias("key"), F.lit("step").alias("event"), "look_from", F.col("cycle_key").alias("correlate"))
        found = process.match_evidence(waiting, c, correlate=True).select(F.col("key").alias("cycle_key"), "evidence_ts")
        return ready.select("process", "cycle_key").join(found, "cycle_key")

    return process.advance(process.cycles(log, "opened"), process.milestones(log), _STAGES, find, _RUN_AT).select("cycle_key", "stage", "ts")


@query("""WITH k AS (SELECT lpad((o_orderkey % 97)::VARCHAR, 2, '0') || '-' || year(o_orderdate) AS key, (o_orderkey % 97)::INT AS n, year(o_orderdate)::INT AS year FROM orders)
    SELECT year, max(n) + 1 AS next FROM k GROUP BY year""")
def next_sequence(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.concat_ws("-", F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), F.year("o_orderdate").cast("string"))
    return process.next_sequence(o.select(key.alias("key")))


@query("""SELECT l_orderkey, round(sum(l_extendedprice::DECIMAL(18,4)), 2)::DECIMAL(28,2) AS total, count(*) AS n_lines FROM lineitem WHERE l_linenumber % 5 <> 4 GROUP BY l_orderkey""")
def line_totals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,4)").alias("amount"), (F.col("l_linenumber") % 5 == 4).alias("echoed"))
    return process.line_totals(lines, ["l_orderkey"])


@query("""SELECT o_orderkey, (SELECT count(*) FROM range(0, greatest(0, (o_orderkey % 40 - 3)::BIGINT + 1)) r(i) WHERE isodow(o_orderdate::DATE + i::INT) < 6)::INT AS days FROM orders""")
def business_days(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("a", F.to_date("o_orderdate"))
    return o.select("o_orderkey", process.business_days(F.col("a"), F.date_add("a", (F.col("o_orderkey") % 40 - 3).cast("int"))).alias("days"))


@query("""WITH w AS (SELECT o_orderkey, o_totalprice::DECIMAL(10,2) AS rate, (SELECT count(*) FROM range(0, greatest(0, (o_orderkey % 40 - 3)::BIGINT + 1)) r(i) WHERE isodow(o_orderdate::DATE + i::INT) < 6)::INT AS days FROM orders)
    SELECT o_orderkey, days, (rate * days)::DECIMAL(18,2) AS amount, (days * 8)::INT AS hours FROM w""")
def worked_days(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.col("o_totalprice").cast("decimal(10,2)").alias("rate"))
    lines = process.worked_days_line(o.withColumn("b", F.date_add("a", (F.col("o_orderkey") % 40 - 3).cast("int"))), "a", "b", "rate")
    return lines.select("o_orderkey", "days", "amount", "hours")


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE + 20 ELSE o_orderdate::DATE END AS e FROM orders)
    SELECT o_orderkey, lpad((o_orderkey % 97)::VARCHAR, 2, '0') || '-' || year(e) AS document_no, e AS document_date, date_trunc('month', d - INTERVAL 1 MONTH)::DATE AS month_start, last_day((d - INTERVAL 1 MONTH)::DATE) AS month_end FROM o""")
def document_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("a", F.to_date("o_orderdate"))
    rows = o.select("o_orderkey", (F.col("o_orderkey") % 97).alias("n"), F.unix_timestamp(F.col("a").cast("timestamp")).alias("opened"), F.when(F.col("o_orderkey") % 3 == 0, F.date_add("a", 20)).alias("until"))
    return process.document_fields(rows, "n", "opened", "until").select("o_orderkey", "document_no", "document_date", "month_start", "month_end")


@query("""WITH t AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS v FROM orders), i AS (SELECT *, (v::BIGINT - CASE WHEN v::BIGINT > v THEN 1 ELSE 0 END) AS w FROM t),
  s AS (SELECT o_orderkey, v, w, lpad(((v - w) * 100)::INT::VARCHAR, 2, '0') AS c FROM i)
  SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 AND w BETWEEN 1000 AND 999999 THEN NULL WHEN o_orderkey % 4 = 2 THEN w::DECIMAL(28,2) ELSE v::DECIMAL(28,2) END AS amount,
    CASE WHEN o_orderkey % 4 = 2 AND w BETWEEN 1000 AND 999999 THEN 'ambiguous' END AS reason FROM s""")
def amount_cleaning(spark, sf_dir):
    """Order totals as text in four spellings, read back."""
    o = table(spark, sf_dir, "orders").withColumn("v", F.col("o_totalprice").cast("decimal(18,2)"))
    us = F.format_number("v", 2)
    eu = F.translate(us, ",.", ".,")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("$ "), us)).when(F.col("o_orderkey") % 4 == 1, F.concat(eu, F.lit(" EUR"))).when(F.col("o_orderkey") % 4 == 2, F.format_number(F.floor("v"), 0)).otherwise(F.col("v").cast("string"))
    judged = o.withColumn("_a", process.cleaned_amount(text))
    return judged.select("o_orderkey", F.col("_a.amount").cast("decimal(28,2)").alias("amount"), "_a.reason")


# --- replay ----------------------------------------------------------------------------------------------------------

_SPANS = f"""spans AS (SELECT user_id, started_at AS lo, ended_at AS hi FROM sessions)"""


def _spans(spark, sf_dir):
    return sessions.pair_sessions(signals(spark, sf_dir), "signup", "purchase", LONGEST).select("user_id", F.col("started_at").alias("lo"), F.col("ended_at").alias("hi"))


@query(f"""WITH {SIG}, {PAIRS}, {DRIVES}, {_SPANS} SELECT user_id, begin, finish FROM drives d
    WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.user_id = d.user_id AND abs(s.lo - d.begin) <= 90000) OR NOT EXISTS (SELECT 1 FROM spans s WHERE s.user_id = d.user_id AND abs(s.hi - d.finish) <= 90000)""")
def missed_drives(spark, sf_dir):
    return replay.missed_drives(sessions.drive_sessions(signals(spark, sf_dir), "view", "error"), _spans(spark, sf_dir), 90_000)


@query(f"""WITH {SIG}, {PAIRS}, {DRIVES}, {_SPANS} SELECT d.user_id, d.finish AS at, arg_min(s.hi - d.finish, abs(s.hi - d.finish) * 2 + CASE WHEN s.hi > d.finish THEN 1 ELSE 0 END) AS "offset"
    FROM drives d JOIN spans s ON s.user_id = d.user_id AND abs(s.hi - d.finish) <= 90000 GROUP BY d.user_id, d.finish""")
def end_error(spark, sf_dir):
    found = replay.end_errors(sessions.drive_sessions(signals(spark, sf_dir), "view", "error"), _spans(spark, sf_dir), 90_000)
    return found.select("user_id", "at", "offset")


@query(f"""WITH {SIG}, b AS (SELECT user_id, name, ts, lag(name) OVER w AS n0, lag(ts) OVER w AS t0 FROM sig WHERE name IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, id))
    SELECT user_id, t0 AS lo, ts AS hi FROM b WHERE name = 'purchase' AND n0 = 'signup' AND ts - t0 <= {LONGEST}""")
def boundary_pairs(spark, sf_dir):
    return replay.boundary_pairs(signals(spark, sf_dir), "signup", "purchase", LONGEST)


@query(f"""WITH {SIG}, {PAIRS}, {DRIVES}, {_SPANS},
    er AS (SELECT arg_min(s.hi - d.finish, abs(s.hi - d.finish) * 2 + CASE WHEN s.hi > d.finish THEN 1 ELSE 0 END) AS o FROM drives d JOIN spans s ON s.user_id = d.user_id AND abs(s.hi - d.finish) <= 900 GROUP BY d.user_id, d.begin, d.finish)
    SELECT (SELECT count(*) FROM spans WHERE hi - lo >= 120) AS "real", (SELECT count(*) FROM spans WHERE hi - lo < 120) AS junk, (SELECT count(*) FROM drives) AS drives,
      (SELECT count(*) FROM drives d WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.user_id = d.user_id AND abs(s.lo - d.begin) <= 900) OR NOT EXISTS (SELECT 1 FROM spans s WHERE s.user_id = d.user_id AND abs(s.hi - d.finish) <= 900)) AS missed,
      (SELECT round(avg(o), 4) FROM er) AS mean_end_error, (SELECT count(*) FROM er WHERE o < -120) AS early_closes""")
def drive_score(spark, sf_dir):
    found = replay.score(sessions.drive_sessions(signals(spark, sf_dir), "view", "error"), _spans(spark, sf_dir))
    return found.withColumn("mean_end_error", F.round("mean_end_error", 4))


@query(f"""WITH {SIG}, {PAIRS} SELECT user_id, 'car_trip' AS name, ended_at AS ts, 'removed' AS change FROM sessions WHERE ended_at - started_at > 86400""")
def replay_diff(spark, sf_dir):
    """Sessions of at most a day against sessions of at most three, by replay of a variant."""
    events = signals(spark, sf_dir).withColumnRenamed("seq", "arrival_seq")
    out = replay.replay(events, [SESSION], {"now": {}, "short": {"car_trip": {"max_duration_seconds": 86_400}}})
    now, short = (out.filter(F.col("variant") == v) for v in ("now", "short"))
    return replay.diff(now, short)


@query(f"""WITH {SIG}, {PAIRS} SELECT 'now' AS variant, 'car_trip' AS name, count(*) AS n FROM sessions UNION ALL SELECT 'short', 'car_trip', count(*) FROM sessions WHERE ended_at - started_at <= 86400""")
def replay_counts(spark, sf_dir):
    events = signals(spark, sf_dir).withColumnRenamed("seq", "arrival_seq")
    return replay.counts(replay.replay(events, [SESSION], {"now": {}, "short": {"car_trip": {"max_duration_seconds": 86_400}}}), "variant")


@query(f"""WITH {SIG}, {PAIRS} SELECT 'car_trip' AS name, 'purchase+signup' AS signature, count(*) AS n FROM sessions""")
def contributor_signatures(spark, sf_dir):
    return replay.signatures(replay.replay(signals(spark, sf_dir).withColumnRenamed("seq", "arrival_seq"), [SESSION]))


@query(f"""WITH {SIG}, {PAIRS}, {DRIVES}, o AS (SELECT s.start_id, EXISTS (SELECT 1 FROM drives d WHERE d.user_id = s.user_id AND s.started_at - 120 <= d.finish AND d.begin <= s.ended_at + 120) AS own, s.start_seq % 3 AS e FROM sessions s)
    SELECT own, CASE WHEN own THEN CASE e WHEN 2 THEN 'confirmed' WHEN 1 THEN 'one_sided' ELSE 'absent' END ELSE CASE WHEN e > 0 THEN 'leaked' ELSE 'clean' END END AS verdict, count(*) AS n FROM o GROUP BY 1, 2""")
def vehicle_judgment(spark, sf_dir):
    s = signals(spark, sf_dir)
    spans = sessions.pair_sessions(s, "signup", "purchase", LONGEST).select(
        F.col("start_id").alias("id"), "user_id", F.col("started_at").alias("lo"), F.col("ended_at").alias("hi"), (F.col("start_seq") % 3 == 2).alias("confirmed"), (F.col("start_seq") % 3).alias("n_evidence")
    )
    marks = s.filter("name = 'click'").select("user_id", F.col("ts").alias("at"))
    return replay.vehicle_summary(replay.vehicle_judgment(spans, sessions.drive_sessions(s, "view", "error"), marks)).select("own", "verdict", "n")


# --- ingest: the events table as HTTP bodies -------------------------------------------------------------------------


@query(f"WITH {SIG} SELECT user_id, ts, round(lat, 6) AS lat, round(lon, 6) AS lon, acc, round((seq % 50) * 3.6)::BIGINT AS vel FROM sig WHERE seq % 7 <> 0")
def normalise_points(spark, sf_dir):
    """Each event as a batch of two points, one of them without a device."""
    s = signals(spark, sf_dir)
    stamp = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    point = lambda device: F.struct(
        F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(device.alias("device_id"), stamp.alias("timestamp"), F.when(F.col("seq") % 7 == 0, F.lit("x")).otherwise(F.col("acc").cast("string")).alias("horizontal_accuracy"), (F.col("seq") % 50).cast("string").alias("speed")).alias("properties"),
    )
    raw = s.select(F.lit("/sensors/overland").alias("path"), F.col("id").alias("source_key"), F.to_json(F.struct(F.array(point(F.col("user_id")), point(F.lit(""))).alias("locations"))).alias("body"))
    good, _ = ingest.parse_path(raw)
    batched, _ = ingest.route_by_app(ingest.route_by_domain(good), ["overland"])
    return ingest.explode_locations(batched).select("user_id", "ts", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "acc", "vel")


@query(f"WITH {SIG} SELECT id, user_id, name, ts, CASE WHEN seq % 5 = 0 THEN 'derived' ELSE 'raw' END AS event_class, 'app' || (seq % 3) AS source_app FROM sig WHERE seq % 11 <> 0 AND seq % 13 <> 0")
def normalise_signals(spark, sf_dir):
    s = signals(spark, sf_dir)
    domain = F.when(F.col("seq") % 13 == 0, "other").otherwise("sensors")
    fields = F.to_json(
        F.struct(F.when(F.col("seq") % 11 != 0, F.col("name")).alias("event_name"), "user_id", F.col("ts").alias("timestamp"), F.col("id").alias("id"), F.when(F.col("seq") % 5 == 0, F.lit("x")).alias(KIND_FIELD))
    )
    payload = F.when(F.col("seq") % 2 == 0, fields).otherwise(F.to_json(F.struct(fields.alias("p"))))
    body = F.when(F.col("seq") % 2 == 0, F.concat(F.lit('{"payload": '), fields, F.lit("}"))).otherwise(F.to_json(F.struct(fields.alias("payload"))))
    raw = s.select(F.concat(F.lit("/"), domain, F.lit("/app"), F.col("seq") % 3, F.lit("/x")).alias("path"), body.alias("body"), F.col("id").alias("source_key"), F.timestamp_seconds("ts").alias("received_at"))
    good, _ = ingest.shape_standard(ingest.route_by_app(ingest.route_by_domain(ingest.parse_path(raw)[0]), [])[1])
    return ingest.shape_for_table(ingest.enrich(good)).select("id", "user_id", "name", "ts", "event_class", "source_app")


@query("""SELECT 'c' || conv_id || '-' || turn AS upstream_id, 'example.org' AS from_domain, left(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1000) AS snippet, (1704067200 + turn * 60)::BIGINT AS ts
    FROM conversations WHERE conv_id % 9 <> 0""")
def normalise_mail(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60), "d MMM yyyy HH:mm:ss Z")
    ident = F.when(F.col("conv_id") % 9 != 0, F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn"))
    sender = F.struct(F.array(F.struct(F.lit("Ann").alias("name"), F.lit("a@b@Example.org").alias("address"))).alias("value"))
    body = F.to_json(F.struct(ident.alias("id"), sender.alias("from"), F.coalesce("text", F.lit("")).alias("snippet"), F.concat(F.lit("Mon, "), stamp).alias("date")))
    return ingest.normalise_mail(c.select(body.alias("body"))).select("upstream_id", "from_domain", "snippet", "ts")


# --- the live path ----------------------------------------------------------------------------------------------------

_ROLE = {"signup": "device_connected_to_carplay", "purchase": "device_disconnected_from_carplay", "view": "location_ping", "click": "car_lock_state_change", "error": "car_driver_door_opened"}


def envelopes(spark, sf_dir) -> DataFrame:
    """The events as raw envelopes under the standard definitions' names. Their month is told as two and a half hours, so that
    windows of minutes hold several."""
    s = signals(spark, sf_dir)
    role = F.create_map(*[F.lit(x) for kv in _ROLE.items() for x in kv])
    moves = F.col("name") == "view"
    at = (F.lit(1704067200) + (F.col("ts") - 1704067200) / 300).cast("bigint")
    body = F.struct("id", "user_id", at.alias("timestamp"), *[F.when(moves, F.col(c)).alias(c) for c in ("lat", "lon", "acc")])
    return s.select(
        F.try_element_at(role, F.col("name")).alias("name"), F.lit("app").alias("source_app"), F.lit("http_server").alias("source_type"), F.to_json(body).alias("message"), F.timestamp_seconds("seq").alias("received_at")
    )


@query()
def live_events(spark, sf_dir):
    """Raw envelopes through the standard definitions to derived envelopes with capabilities and place names."""
    return live.derive(envelopes(spark, sf_dir), STANDARD, _places(spark))


QUERIES, ORACLE = Q, SQL
