"""DuckDB equivalents of the keyed detectors: recursion over a user's events, one a step, with the detector's state in its columns."""

from __future__ import annotations

from tideline.plans.views import haversine_sql

MINT = "sha256(concat_ws(':', user_id, '{name}', ts::VARCHAR, array_to_string(list_sort(ids), ':')))"
_OUT = "user_id, '{name}' AS name, ts, score::DOUBLE AS score, len(ids)::INTEGER AS n_sources, " + MINT + " AS id"


def _numbered(name: str, names: tuple[str, ...], where: str = "true") -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i FROM sig WHERE name IN ({listed}) AND {where})"


def out(name: str, table: str) -> str:
    """The rows of a detector's CTE as the queries give them."""
    return f"SELECT {_OUT.format(name=name)} FROM {table}"


def gated(c: dict, name: str = "gated") -> str:
    """CTEs that end in `name`_out (user_id, seq, ts, score, ids)."""
    w, kinds = c["weights"], list(c["weights"])
    fresh = ", ".join(f"CASE WHEN x.name = '{k}' THEN x.ts WHEN x.ts - r.t_{k} <= {c['window_seconds']} THEN r.t_{k} END AS t_{k}, CASE WHEN x.name = '{k}' THEN x.id ELSE r.i_{k} END AS i_{k}" for k in kinds)
    total = " + ".join(f"CASE WHEN f.t_{k} IS NULL THEN 0 ELSE {w[k]} END" for k in kinds)
    after = ", ".join(f"CASE WHEN g.gate_event THEN r.t_{k} WHEN NOT g.fires THEN f.t_{k} END, CASE WHEN g.gate_event THEN r.i_{k} WHEN NOT g.fires THEN f.i_{k} END" for k in kinds)
    ids = ", ".join(f"CASE WHEN f.t_{k} IS NOT NULL THEN f.i_{k} END" for k in kinds)
    latest = "greatest(" + ", ".join(f"f.t_{k}" for k in kinds) + ")"
    return f"""{_numbered(name + "_e", (*kinds, c["gate_event"]))},
{name}_r AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS gate, {", ".join(f"NULL::BIGINT AS t_{k}, NULL::VARCHAR AS i_{k}" for k in kinds)}, 0::BIGINT AS last,
    0::BIGINT AS seq, false AS fired, NULL::BIGINT AS ts, 0 AS score, []::VARCHAR[] AS ids FROM {name}_e
  UNION ALL
  SELECT x.user_id, x.i, CASE WHEN g.gate_event THEN x.ts WHEN g.open AND NOT g.fires THEN r.gate END, {after}, CASE WHEN g.fires THEN x.ts ELSE r.last END,
    x.seq, g.fires, {latest}, g.score, list_filter([{ids}], lambda v: v IS NOT NULL)
  FROM {name}_r r JOIN {name}_e x ON x.user_id = r.user_id AND x.i = r.i + 1,
    LATERAL (SELECT {fresh}) f,
    LATERAL (SELECT x.name = '{c["gate_event"]}' AS gate_event, coalesce(x.ts - r.gate <= {c["max_open_seconds"]}, false) AS open) o,
    LATERAL (SELECT o.gate_event, o.open, {total} + CASE WHEN o.open THEN {c["gate_weight"]} ELSE 0 END AS score) s,
    LATERAL (SELECT s.gate_event, s.open, s.score, NOT s.gate_event AND s.score >= {c["threshold"]} AND x.ts - r.last >= {c["cooldown_seconds"]} AS fires) g),
{name}_out AS (SELECT user_id, seq, ts, score, ids FROM {name}_r WHERE fired)"""


def _off(visit: str, fix: str) -> str:
    return haversine_sql(f"{visit}.sy / {visit}.n", f"{visit}.sx / {visit}.n", f"{fix}.lat", f"{fix}.lon")


def _follows(last: str, fix: str, fastest: float = 400.0) -> str:
    d = haversine_sql(f"{last}.lat", f"{last}.lon", f"{fix}.lat", f"{fix}.lon")
    return f"({fix}.ts >= {last}.ts AND NOT ({d} > 0 AND ({fix}.ts <= {last}.ts OR {d} / ({fix}.ts - {last}.ts) * 3.6 > {fastest})))"


_VISIT = "STRUCT(n BIGINT, sy DOUBLE, sx DOUBLE, since BIGINT, ts BIGINT, lat DOUBLE, lon DOUBLE, prev BIGINT, ids VARCHAR[], looks BIGINT)"
_FIX = "STRUCT(ts BIGINT, lat DOUBLE, lon DOUBLE, id VARCHAR)"


def _new(f: str) -> str:
    return f"{{'n': 1::BIGINT, 'sy': {f}.lat, 'sx': {f}.lon, 'since': {f}.ts, 'ts': {f}.ts, 'lat': {f}.lat, 'lon': {f}.lon, 'prev': NULL::BIGINT, 'ids': [{f}.id], 'looks': 0::BIGINT}}::{_VISIT}"


def _with(v: str, f: str) -> str:
    return f"{{'n': {v}.n + 1, 'sy': {v}.sy + {f}.lat, 'sx': {v}.sx + {f}.lon, 'since': {v}.since, 'ts': {f}.ts, 'lat': {f}.lat, 'lon': {f}.lon, 'prev': {v}.ts, 'ids': list_append({v}.ids, {f}.id), 'looks': 0::BIGINT}}::{_VISIT}"


def _looked(v: str, looks: str) -> str:
    return f"{{'n': {v}.n, 'sy': {v}.sy, 'sx': {v}.sx, 'since': {v}.since, 'ts': {v}.ts, 'lat': {v}.lat, 'lon': {v}.lon, 'prev': {v}.prev, 'ids': {v}.ids, 'looks': {looks}}}::{_VISIT}"


def stays(c: dict, name: str = "stays") -> str:
    """CTEs that end in `name`_out (user_id, seq, ts, score, ids)."""
    radius, dwell, quiet = c.get("radius_m", 60), c.get("min_dwell_seconds", 300), c.get("max_gap_seconds", 3600)
    strays, hole, far = c.get("break_fixes", 1), c.get("rejoin_max_hole_seconds", 0), c.get("departure_distance_m", 500)
    fix = "{'ts': x.ts, 'lat': x.lat, 'lon': x.lon, 'id': x.id}"
    near = f"s.ss[2].ts - s.ss[1].ts <= {quiet} AND {haversine_sql('s.ss[1].lat', 's.ss[1].lon', 's.ss[2].lat', 's.ss[2].lon')} <= {radius}"
    return f"""{_numbered(name + "_e", (c["location_event"],), "acc <= 100")},
{name}_r AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS seq, NULL::{_VISIT} AS here, NULL::{_VISIT} AS held, []::{_FIX}[] AS strays, NULL::{_VISIT} AS final FROM {name}_e
  UNION ALL
  SELECT x.user_id, x.i, x.seq,
    CASE k.what WHEN 'begin' THEN {_new("x")} WHEN 'late' THEN r.here WHEN 'back' THEN {_with("r.held", "x")} WHEN 'inside' THEN {_with("r.here", "x")} WHEN 'wait' THEN r.here
      ELSE CASE WHEN len(s.ss) < 2 THEN {_new("s.ss[1]")} WHEN {near} THEN {_with("(" + _new("s.ss[1]") + ")", "s.ss[2]")} ELSE {_new("s.ss[2]")} END END,
    CASE WHEN k.what IN ('begin', 'late') THEN r.held WHEN k.what = 'back' THEN NULL WHEN k.what = 'inside' AND m.settled THEN NULL WHEN k.what = 'leave' AND m.stayed THEN {_looked("r.here", "0::BIGINT")} ELSE h.held END,
    CASE WHEN k.what = 'wait' THEN s.ss WHEN k.what = 'late' THEN r.strays ELSE [] END,
    CASE WHEN k.what IN ('begin', 'late', 'back') THEN NULL WHEN k.what = 'inside' AND m.settled THEN h.held WHEN k.what = 'leave' AND m.stayed THEN coalesce(h.held, h.gone) ELSE h.gone END
  FROM {name}_r r JOIN {name}_e x ON x.user_id = r.user_id AND x.i = r.i + 1,
    LATERAL (SELECT r.held IS NOT NULL AND (x.ts - r.held.ts > {hole} OR {_off("r.held", "x")} > {far}) AS away, r.held IS NOT NULL AND {_off("r.held", "x")} <= {radius} AND r.held.looks <= {strays} AS near) a,
    LATERAL (SELECT CASE WHEN a.away THEN r.held END AS gone, CASE WHEN NOT a.away AND r.held IS NOT NULL THEN {_looked("r.held", "r.held.looks + 1")} END AS held) h,
    LATERAL (SELECT coalesce(x.ts - r.here.ts > {quiet}, false) AS silent, coalesce({_off("r.here", "x")} <= {radius}, false) AS inside) p,
    LATERAL (SELECT CASE WHEN p.silent THEN [{fix}::{_FIX}] ELSE list_append(r.strays, {fix}::{_FIX}) END AS ss) s,
    LATERAL (SELECT CASE WHEN r.here IS NULL THEN 'begin' WHEN NOT {_follows("r.here", "x")} THEN 'late' WHEN a.near AND NOT a.away THEN 'back' WHEN p.inside AND NOT p.silent THEN 'inside'
      WHEN NOT p.silent AND len(s.ss) < {strays} AND x.ts - s.ss[1].ts < {dwell} THEN 'wait' ELSE 'leave' END AS what) k,
    LATERAL (SELECT coalesce(h.held IS NOT NULL AND x.ts - r.here.since >= {dwell}, false) AS settled, coalesce(r.here.ts - r.here.since >= {dwell}, false) AS stayed) m),
{name}_out AS (SELECT user_id, seq, final.ts AS ts, final.n AS score, final.ids AS ids FROM {name}_r WHERE final IS NOT NULL)"""


def trips(c: dict, name: str = "trips") -> str:
    """CTEs that end in `name`_out (user_id, seq, ts, score, ids, lo, hi)."""
    radius, settle, quiet = c["settle_radius_m"], c.get("settle_seconds", 300), c["max_gap_seconds"]
    longest, pad, ping, other = c["max_duration_seconds"], c.get("corroboration_pad_seconds", 0), c["location_event"], c["corroborating_events"][0]
    fix, none = f"{{'ts': x.ts, 'lat': x.lat, 'lon': x.lon, 'id': x.id}}::{_FIX}", f"[]::{_FIX}[]"
    base_last = f"{{'ts': r.base.ts, 'lat': r.base.lat, 'lon': r.base.lon, 'id': r.base.ids[-1]}}::{_FIX}"
    lowest = lambda f, v: f"list_{f}(list_transform(q.path, lambda z: z.{v}))"
    extent = haversine_sql(lowest("min", "lat"), lowest("min", "lon"), lowest("max", "lat"), lowest("max", "lon"))
    return f"""{name}_e AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i FROM sig WHERE (name = '{ping}' AND acc <= 100) OR name = '{other}'),
{name}_r AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS seq, NULL::{_FIX} AS last, NULL::{_VISIT} AS base, {none} AS way, NULL::{_VISIT} AS rest, {none} AS rested, {none} AS marks, {none} AS leg, {none} AS cited, 0::BIGINT AS moves FROM {name}_e
  UNION ALL
  SELECT x.user_id, x.i, x.seq,
    CASE WHEN k.what IN ('mark', 'late') THEN r.last ELSE {fix} END,
    CASE k.what WHEN 'mark' THEN r.base WHEN 'late' THEN r.base WHEN 'begin' THEN {_new("x")} WHEN 'silence' THEN {_new("x")} WHEN 'stay' THEN {_with("r.base", "x")} WHEN 'arrive' THEN {_with("r.rest", "x")}
      WHEN 'long' THEN {_new("x")} END,
    CASE k.what WHEN 'mark' THEN r.way WHEN 'late' THEN r.way WHEN 'depart' THEN [{base_last}, {fix}] WHEN 'rest' THEN r.way WHEN 'on' THEN list_concat(r.way, r.rested) ELSE {none} END,
    CASE k.what WHEN 'mark' THEN r.rest WHEN 'late' THEN r.rest WHEN 'rest' THEN {_with("r.rest", "x")} WHEN 'on' THEN {_new("x")} END,
    CASE k.what WHEN 'mark' THEN r.rested WHEN 'late' THEN r.rested WHEN 'rest' THEN list_append(r.rested, {fix}) WHEN 'on' THEN [{fix}] ELSE {none} END,
    CASE WHEN k.what = 'mark' THEN list_append(list_filter(r.marks, lambda z: x.ts - z.ts <= {longest}), {fix}) WHEN len(q.path) > 0 THEN list_filter(r.marks, lambda z: z.ts > q.path[-1].ts + {pad}) ELSE r.marks END,
    CASE WHEN t.trip THEN q.path ELSE {none} END,
    CASE WHEN t.trip THEN list_filter(r.marks, lambda z: z.ts BETWEEN q.path[1].ts - {pad} AND q.path[-1].ts + {pad}) ELSE {none} END, q.moves
  FROM {name}_r r JOIN {name}_e x ON x.user_id = r.user_id AND x.i = r.i + 1,
    LATERAL (SELECT CASE WHEN x.name = '{other}' THEN 'mark' WHEN r.last IS NULL THEN 'begin' WHEN NOT {_follows("r.last", "x")} THEN 'late' WHEN x.ts - r.last.ts > {quiet} THEN 'silence'
      WHEN len(r.way) = 0 THEN CASE WHEN {_off("r.base", "x")} <= {radius} THEN 'stay' ELSE 'depart' END
      WHEN r.rest IS NOT NULL AND {_off("r.rest", "x")} <= {radius} THEN CASE WHEN x.ts - r.rest.since >= {settle} THEN 'arrive' ELSE 'rest' END
      WHEN x.ts - r.way[1].ts >= {longest} THEN 'long' ELSE 'on' END AS what) k,
    LATERAL (SELECT CASE WHEN len(r.way) = 0 THEN {none} WHEN k.what = 'arrive' OR k.what = 'silence' AND r.rest IS NOT NULL THEN list_append(r.way, r.rested[1]) WHEN k.what = 'silence' THEN r.way
      WHEN k.what = 'long' THEN list_append(list_concat(r.way, r.rested), {fix}) ELSE {none} END AS path,
      CASE WHEN k.what = 'long' THEN len(r.way) + len(r.rested) - 1 ELSE len(r.way) - 1 END AS moves) q,
    LATERAL (SELECT len(q.path) > 0 AND q.moves >= {c["min_fixes"]} AND q.path[-1].ts - q.path[1].ts >= {c.get("min_duration_seconds", 180)} AND {extent} >= {c.get("min_distance_m", 500)} AS trip) t),
{name}_out AS (
  SELECT user_id, seq, leg[-1].ts AS ts, moves AS score, list_transform(list_concat(leg, cited), lambda z: z.id) AS ids,
    list_min(list_transform(list_concat(leg, cited), lambda z: z.ts)) AS lo, list_max(list_transform(list_concat(leg, cited), lambda z: z.ts)) AS hi
  FROM {name}_r WHERE len(leg) > 0)"""


def journeys(c: dict, primary: str, secondary: str, name: str = "journeys") -> str:
    """CTEs that end in `name`_out. primary: (user_id, seq, ts, ids, lo, hi, id), secondary: the same, tables."""
    pad, timeout, horizon = c.get("pair_pad_seconds", 300), c.get("secondary_timeout_seconds", 1800), c.get("recent_horizon_seconds", 21600)
    shortest, span, wait = c.get("min_secondary_span_seconds", 0), "STRUCT(lo BIGINT, hi BIGINT)", "STRUCT(lo BIGINT, hi BIGINT, ts BIGINT, id VARCHAR, ids VARCHAR[], ticked BOOLEAN)"
    touch = lambda a: f"greatest({a}.lo, x.lo) - least({a}.hi, x.hi) <= {pad}"
    return f"""{name}_e AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i FROM (
    SELECT user_id, seq, 'p' AS what, ts, lo, hi, id, ids FROM {primary} UNION ALL SELECT user_id, seq, 's', ts, lo, hi, id, ids FROM {secondary}
    UNION ALL SELECT user_id, seq, 't', ts, ts, ts, id, [] FROM sig WHERE name = '{c["tick_event"]}')),
{name}_r AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS seq, []::{wait}[] AS waiting, []::{span}[] AS served, 0::BIGINT AS clock, 0::BIGINT AS ticked, NULL::BIGINT AS ts, 0::BIGINT AS score, []::VARCHAR[] AS ids FROM {name}_e
  UNION ALL
  SELECT x.user_id, x.i, x.seq,
    CASE WHEN x.what = 'p' THEN list_filter(r.waiting, lambda z: z.id IS DISTINCT FROM p.took.id) WHEN d.due THEN q.now[2:] ELSE q.now END,
    CASE WHEN x.what = 'p' THEN list_append(list_filter(r.served, lambda z: x.ts - z.hi <= {horizon}), {{'lo': x.lo, 'hi': x.hi}}::{span}) ELSE r.served END,
    CASE WHEN x.what = 'p' THEN r.clock ELSE greatest(r.clock, x.ts) END,
    CASE WHEN x.what = 't' THEN greatest(r.ticked, x.ts) ELSE r.ticked END,
    CASE WHEN x.what = 'p' THEN x.ts WHEN d.due AND NOT q.now[1].ticked AND q.now[1].hi - q.now[1].lo >= {shortest} THEN q.now[1].hi END,
    CASE WHEN x.what = 'p' THEN len(u.ids) ELSE 1 + len(q.now[1].ids) END,
    CASE WHEN x.what = 'p' THEN u.ids ELSE list_prepend(q.now[1].id, q.now[1].ids) END
  FROM {name}_r r JOIN {name}_e x ON x.user_id = r.user_id AND x.i = r.i + 1,
    LATERAL (SELECT list_filter(r.waiting, lambda z: {touch("z")})[1] AS took) p,
    LATERAL (SELECT list_distinct(CASE WHEN p.took IS NULL THEN x.ids ELSE list_append(x.ids, p.took.id) END) AS ids) u,
    LATERAL (SELECT CASE WHEN x.what = 's' AND len(list_filter(r.served, lambda z: {touch("z")})) = 0
        THEN list_append(r.waiting, {{'lo': x.lo, 'hi': x.hi, 'ts': x.ts, 'id': x.id, 'ids': x.ids, 'ticked': r.ticked >= x.lo}}::{wait})
      WHEN x.what = 't' THEN list_transform(r.waiting, lambda z: {{'lo': z.lo, 'hi': z.hi, 'ts': z.ts, 'id': z.id, 'ids': z.ids, 'ticked': z.ticked OR x.ts BETWEEN z.lo AND z.hi + {pad}}}::{wait})
      ELSE r.waiting END AS now) q,
    LATERAL (SELECT x.what <> 'p' AND len(q.now) > 0 AND q.now[1].ts + {timeout} < r.clock AS due) d),
{name}_out AS (SELECT user_id, seq, ts, score, ids FROM {name}_r WHERE ts IS NOT NULL AND i > 0)"""
