"""Detectors as folds over columns of an entity's events.

A fold takes any number of events at once, as columns in arrival order, and carries a small state of plain numbers from call to
call, so the same fold serves a whole history, a segment of one, and the micro-batches of a stream. Long stretches are decided by
array operations: where a centre is left, how long fixes follow each other, which ticks fall into a span. Python runs once a visit,
stray, sighting or claim.

Evidence isn't held in the state. A fold numbers the events that it may cite later, in order, and says which of them it still needs;
whoever runs it holds these events (an array in batches, a list state in streams). What fires cites ranges of numbers.

`silence`: after so many seconds without an event that the fold reads, its state is void, so histories may be cut there (see
plans.detect). What the first events behind a cut set off is given by ended()."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from tideline.functions.geo import EARTH_RADIUS_M, MAX_SPEED_KMH, distance, jump

#: How cited events are taken: themselves; those of them that are fixes; what they themselves cite, else themselves; only what they cite.
ITSELF, FIXES, OWN_EVIDENCE, PARTS = 0, 1, 2, 3
#: Rows that set off what ended() gives: the first that the next segment takes, the second taken after the cut.
NEXT, AFTER_NEXT = -1, -2


@dataclass
class Rows:
    """Events of one entity in arrival order. lo, hi: the span of an event's evidence."""

    name: np.ndarray
    ts: np.ndarray
    lat: np.ndarray
    lon: np.ndarray
    acc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def part(self, a: int, b: int) -> Rows:
        return Rows(self.name[a:b], self.ts[a:b], self.lat[a:b], self.lon[a:b], self.acc[a:b], self.lo[a:b], self.hi[a:b])

    def fixes(self, name: str, accuracy: float) -> np.ndarray:
        """Positions of located events of that name; vague ones aren't."""
        return np.flatnonzero((self.name == name) & ~np.isnan(self.lat) & ~np.isnan(self.lon) & ~(self.acc > accuracy))


@dataclass
class Fired:
    """row: position of the event that set it off, or NEXT, AFTER_NEXT. score: None where it is the number of cited events, each
    counted once by id. cites: (from, to, how)."""

    row: int
    ts: int
    score: float | None
    cites: list[tuple[int, int, int]]


class Fold:
    silence: int | None = None
    #: Histories can be cut at each event of this name.
    restart: str | None = None

    def __init__(self, reads):
        self.reads = frozenset(reads)

    def advance(self, state: dict, rows: Rows) -> tuple[list[Fired], list[int]]:
        """What fires, and the positions of the rows that get the next numbers. state is changed in place."""
        raise NotImplementedError

    def needed(self, state: dict) -> list[tuple[int, int]]:
        """Ranges of numbers that may still be cited."""
        raise NotImplementedError

    def ended(self, state: dict) -> list[Fired]:
        return []


DETECTORS: dict[str, Callable[[dict], Fold]] = {}


def register_detector(name: str):
    """Adds a detector: a function of its configuration that returns a Fold."""

    def add(make: Callable[[dict], Fold]):
        DETECTORS[name] = make
        return make

    return add


def make_detector(name: str, config: dict) -> Fold:
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {name!r}; known: {sorted(DETECTORS)}")
    return DETECTORS[name](config)


# --- co-occurrence -----------------------------------------------------------------------------------------------------


class Cooccurrence(Fold):
    """Weights of the names seen lately reach a threshold. A sighting lives for `lives` (by name) and gives way to a later one as
    `renewed` says. half: weights halve in that time. gate: (event, weight, how long it stands open); firing closes it and
    forgets all sightings."""

    def __init__(self, c: dict, renewed: Callable[[int, int], bool], lives: dict[str, int], half: float | None = None, gate: tuple[str, float, int] | None = None):
        super().__init__({*c["weights"], *([gate[0]] if gate else [])})
        self.weights, self.threshold, self.cooldown = c["weights"], c["threshold"], c.get("cooldown_seconds", 1800)
        self.renewed, self.lives, self.half, self.gate = renewed, lives, half, gate
        self.silence = max([self.cooldown, *lives.values(), *([gate[2]] if gate else [])])

    def advance(self, state, rows):
        seen, number, fired, kept = state.setdefault("seen", {}), state.get("next", 0), [], []
        for row, (name, now) in enumerate(zip(rows.name, rows.ts.tolist(), strict=True)):
            if self.gate and name == self.gate[0]:
                state["gate"] = now
                continue
            if name not in self.weights:
                continue
            for old in [n for n, (t, _) in seen.items() if now - t > self.lives[n]]:
                del seen[old]
            if name not in seen or self.renewed(now, seen[name][0]):
                seen[name] = [now, number]
                number += 1
                kept.append(row)
            score = float(sum(self.weights[n] * (1 if self.half is None else 0.5 ** (max(0, now - t) / self.half)) for n, (t, _) in seen.items()))
            if self.gate and state.get("gate") is not None:
                if now - state["gate"] <= self.gate[2]:
                    score += self.gate[1]
                else:
                    state["gate"] = None
            if score < self.threshold or now - state.get("fired", 0) < self.cooldown:
                continue
            fired.append(Fired(row, max(t for t, _ in seen.values()), round(score, 3) if self.half else score, [(k, k + 1, ITSELF) for _, k in seen.values()]))
            state["fired"] = now
            if self.gate:
                state["gate"] = None
                seen.clear()
        state["next"] = number
        return fired, kept

    def needed(self, state):
        return [(k, k + 1) for _, k in state.get("seen", {}).values()]


@register_detector("weighted_window")
def weighted_window(c: dict) -> Fold:
    """Each name counts from its earliest sighting until that expires."""
    ages = c.get("max_age_seconds") or {}
    return Cooccurrence(c, lambda now, then: False, {n: ages.get(n, c["window_seconds"]) for n in c["weights"]})


@register_detector("decaying_window")
def decaying_window(c: dict) -> Fold:
    """Each name counts by its latest sighting, less the older that is."""
    window = c["window_seconds"]
    return Cooccurrence(c, lambda now, then: now > then, dict.fromkeys(c["weights"], window), c.get("half_life_seconds", window / 2))


@register_detector("session_gated_window")
def session_gated_window(c: dict) -> Fold:
    """Latest sightings, and a standing weight while the gate is open. The gate alone fires nothing and is no evidence."""
    gate = (c["gate_event"], c["gate_weight"], c.get("max_open_seconds", 21600))
    return Cooccurrence(c, lambda now, then: now >= then, dict.fromkeys(c["weights"], c["window_seconds"]), gate=gate)


# --- what fixes have in common -----------------------------------------------------------------------------------------


def metres(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Great-circle distances of arrays of points."""
    y1, x1, y2, x2 = (np.radians(v) for v in (lat1, lon1, lat2, lon2))
    h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


class Track:
    """Fixes as arrays, with what depends on neighbours only: the way and the time from one to the next."""

    def __init__(self, ts: np.ndarray, lat: np.ndarray, lon: np.ndarray):
        self.ts, self.lat, self.lon = ts, lat, lon
        self.step, self.wait = np.zeros(len(ts)), np.zeros(len(ts), np.int64)
        self.step[1:] = metres(lat[:-1], lon[:-1], lat[1:], lon[1:])
        self.wait[1:] = np.diff(ts)

    def __len__(self) -> int:
        return len(self.ts)

    def __getitem__(self, at) -> Track:
        return Track(self.ts[at], self.lat[at], self.lon[at])

    def at(self, k: int) -> tuple[int, float, float]:
        return int(self.ts[k]), float(self.lat[k]), float(self.lon[k])

    def torn(self, fastest: float) -> np.ndarray:
        """Places where a fix can't come after the one before it: earlier, or too far off for any movement."""
        with np.errstate(divide="ignore", invalid="ignore"):
            wild = (self.step > 0) & ((self.wait <= 0) | (self.step / self.wait * 3.6 > fastest))
        return np.flatnonzero(((self.wait < 0) | wild) & (np.arange(len(self)) > 0))


def follows(last: tuple[int, float, float] | list, fix: tuple[int, float, float], fastest: float) -> bool:
    return fix[0] >= last[0] and not jump((last[1], last[2]), last[0], (fix[1], fix[2]), fix[0], fastest)


def credible(track: Track, last: tuple | list | None, fastest: float) -> np.ndarray:
    """Positions of fixes that follow the last one accepted. Stretches without a tear pass as a whole."""
    torn, at, out = track.torn(fastest), 0, []
    while at < len(track):
        if last is not None and not follows(last, track.at(at), fastest):
            at += 1
            continue
        k = np.searchsorted(torn, at, side="right")
        end = int(torn[k]) if k < len(torn) else len(track)
        out.append(np.arange(at, end))
        last, at = track.at(end - 1), end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Visit:
    """Fixes around their mean. parts: ranges of their numbers; before: the time of the fix before the last, else before the first."""

    n: int = 0
    lat: float = 0.0
    lon: float = 0.0
    since: int = 0
    last: list = field(default_factory=list)
    parts: list = field(default_factory=list)
    before: int | None = None
    box: list = field(default_factory=list)
    looks: int = 0

    @property
    def until(self) -> int:
        return self.last[0]

    @property
    def seconds(self) -> int:
        return self.last[0] - self.since

    def off(self, fix: tuple[int, float, float]) -> float:
        return distance((self.lat / self.n, self.lon / self.n), (fix[1], fix[2]))

    def take(self, track: Track, a: int, b: int, number: int) -> Visit:
        """With the fixes a to b, the first of which has this number."""
        y, x = track.lat[a:b], track.lon[a:b]
        if not self.n:
            self.since = int(track.ts[a])
        if b - a > 1 or self.n:
            self.before = int(track.ts[b - 2]) if b - a > 1 else self.until
        self.n, self.lat, self.lon = self.n + b - a, self.lat + float(y.sum()), self.lon + float(x.sum())
        box = [float(y.min()), float(y.max()), float(x.min()), float(x.max())]
        self.box = joined(self.box, box)
        self.last = list(track.at(b - 1))
        if self.parts and self.parts[-1][1] == number:
            self.parts[-1][1] = number + b - a
        else:
            self.parts.append([number, number + b - a])
        return self

    def reach(self, track: Track, at: int, end: int, radius: float) -> int:
        """Where in at..end the first fix lies outside, if each before it is taken. Looked for in stretches that double."""
        n, lat, lon, size = self.n, self.lat, self.lon, 16
        while at < end:
            stop = min(end, at + size)
            y, x = track.lat[at:stop], track.lon[at:stop]
            sums = [total + np.concatenate([[0.0], np.cumsum(v[:-1])]) for total, v in ((lat, y), (lon, x))]
            count = n + np.arange(stop - at)
            out = np.flatnonzero(metres(sums[0] / count, sums[1] / count, y, x) > radius)
            if len(out):
                return at + int(out[0])
            n, lat, lon, at, size = n + stop - at, lat + float(y.sum()), lon + float(x.sum()), stop, size * 2
        return end


def joined(a: list, b: list) -> list:
    """The box (south, north, west, east) around two."""
    return [min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])] if a else list(b)


def load(state: dict, key: str) -> Visit | None:
    return Visit(**state[key]) if state.get(key) else None


# --- sessions ----------------------------------------------------------------------------------------------------------


class Sessions(Fold):
    """The latest start and the first end after it in time. validated: unless enough fixes, over enough of the session, show that
    nobody went anywhere."""

    def __init__(self, c: dict, validated: bool):
        self.start, self.end, self.longest = c["start_event"], c["end_event"], c.get("max_duration_seconds", 21600)
        self.ping = c.get("location_event", "location_ping") if validated else None
        self.accuracy, self.fastest = c.get("max_accuracy_m", 100), c.get("max_speed_kmh", MAX_SPEED_KMH)
        self.fewest, self.share, self.moved = c.get("min_fixes", 3), c.get("min_coverage_ratio", 0.5), c.get("min_displacement_m", 300)
        super().__init__({self.start, self.end, *([self.ping] if validated else [])})
        self.restart = self.start

    def advance(self, state, rows):
        fired, kept, number = [], [], state.get("next", 0)
        marks = np.flatnonzero((rows.name == self.start) | (rows.name == self.end))
        fixes = rows.fixes(self.ping, self.accuracy) if self.ping else np.zeros(0, np.int64)
        done = 0
        for row in [*marks.tolist(), len(rows.ts)]:
            upto = int(np.searchsorted(fixes, row))
            if state.get("open") and done < upto:
                self._moved(state, rows, fixes[done:upto])
            done = upto
            if row == len(rows.ts):
                break
            now, opened = int(rows.ts[row]), state.get("open")
            if rows.name[row] == self.start:
                state["open"], state["track"] = [now, number], None
            elif opened and now > opened[0]:
                state["open"], track = None, state.pop("track", None)
                if now - opened[0] <= self.longest and not self._refuted(track, now - opened[0]):
                    fired.append(Fired(row, now, 1.0, [(opened[1], opened[1] + 1, ITSELF), (number, number + 1, ITSELF)]))
            else:
                continue
            kept.append(row)
            number += 1
        state["next"] = number
        return fired, kept

    def _moved(self, state: dict, rows: Rows, at: np.ndarray) -> None:
        at = at[rows.ts[at] >= state["open"][0]]
        track, seen = Track(rows.ts[at], rows.lat[at], rows.lon[at]), state.get("track")
        track = track[credible(track, seen and seen["last"], self.fastest)]
        if len(track):
            seen = seen or {"n": 0, "since": int(track.ts[0]), "box": []}
            box = [float(track.lat.min()), float(track.lat.max()), float(track.lon.min()), float(track.lon.max())]
            state["track"] = seen | {"n": seen["n"] + len(track), "box": joined(seen["box"], box), "last": list(track.at(-1))}

    def _refuted(self, track: dict | None, seconds: int) -> bool:
        if not track or track["n"] < self.fewest or (track["last"][0] - track["since"]) / max(1, seconds) < self.share:
            return False
        south, north, west, east = track["box"]
        return distance((south, west), (north, east)) < self.moved

    def needed(self, state):
        return [(state["open"][1], state["open"][1] + 1)] if state.get("open") else []


@register_detector("session_window")
def session_window(c: dict) -> Fold:
    return Sessions(c, validated=False)


@register_detector("validated_session_window")
def validated_session_window(c: dict) -> Fold:
    return Sessions(c, validated=True)


# --- stays -------------------------------------------------------------------------------------------------------------


class Stays(Fold):
    """Visits of some length. A visit ends when strays are several, go on for as long as a stay takes, or come after a silence.
    An ended one may be held back: a fix back inside soon reopens it, a fix far off or another stay makes it final."""

    def __init__(self, c: dict):
        self.ping = c.get("location_event", "location_ping")
        super().__init__({self.ping})
        self.radius, self.dwell, self.quiet = c.get("radius_m", 60), c.get("min_dwell_seconds", 300), c.get("max_gap_seconds", 3600)
        self.accuracy, self.fastest = c.get("max_accuracy_m", 100), c.get("max_speed_kmh", MAX_SPEED_KMH)
        self.strays, self.hole, self.far = c.get("break_fixes", 1), c.get("rejoin_max_hole_seconds", 0), c.get("departure_distance_m", 500)
        self.silence = max(self.quiet, self.hole) if self.dwell > 0 else None

    def advance(self, state, rows):
        use = rows.fixes(self.ping, self.accuracy)
        track, number, fired, kept = Track(rows.ts[use], rows.lat[use], rows.lon[use]), state.get("next", 0), [], []
        here, held, strays = load(state, "here"), load(state, "held"), state.get("strays", [])
        stops = np.union1d(track.torn(self.fastest), np.flatnonzero(track.wait > self.quiet))
        at = 0
        while at < len(track):
            fix = track.at(at)
            if here is None:
                here, end = Visit().take(track, at, at + 1, number), at + 1
            elif not follows(here.last, fix, self.fastest):
                at += 1
                continue
            elif held is None and not strays and fix[0] - here.until <= self.quiet and here.off(fix) <= self.radius:
                k = np.searchsorted(stops, at, side="right")
                end = here.reach(track, at, int(stops[k]) if k < len(stops) else len(track), self.radius)
                end = max(end, at + 1)  # the array's rounding may differ from the number's
                here.take(track, at, end, number)
            else:
                here, held, strays, final = self._next(here, held, strays, fix, number)
                if final is not None:
                    fired.append(self._stay(int(use[at]), final))
                end = at + 1
            kept += use[at:end].tolist()
            number += end - at
            at = end
        state.update(next=number, here=here and vars(here), held=held and vars(held), strays=strays)
        return fired, kept

    @staticmethod
    def _stay(row: int, v: Visit) -> Fired:
        return Fired(row, v.until, float(v.n), [(a, b, ITSELF) for a, b in v.parts])

    @staticmethod
    def _with(v: Visit, stray: list) -> Visit:
        ts, lat, lon, number = stray
        return v.take(Track(np.array([ts]), np.array([lat]), np.array([lon])), 0, 1, number)

    def _next(self, here: Visit, held: Visit | None, strays: list, fix: tuple, number: int) -> tuple[Visit, Visit | None, list, Visit | None]:
        """The visit one is on, the one held back, strays, and a visit that is final, after a fix that decides something."""
        final, new = None, [*fix, number]
        if held is not None:
            off, held.looks = held.off(fix), held.looks + 1
            if fix[0] - held.until > self.hole or off > self.far:
                final, held = held, None
            elif off <= self.radius and held.looks <= self.strays + 1:
                return self._with(held, new), None, [], None
        silent = fix[0] - here.until > self.quiet
        if not silent and here.off(fix) <= self.radius:
            self._with(here, new)
            settled = held is not None and here.seconds >= self.dwell
            return here, None if settled else held, [], held if settled else final
        strays = [new] if silent else [*strays, new]
        if not silent and len(strays) < self.strays and fix[0] - strays[0][0] < self.dwell:
            return here, held, strays, final
        following = self._with(Visit(), strays[0])
        for s in strays[1:]:
            near = s[0] - following.until <= self.quiet and following.off(s) <= self.radius
            following = self._with(following if near else Visit(), s)
        if here.seconds < self.dwell:
            return following, held, [], final
        if self.hole <= 0:
            return following, None, [], here
        here.looks = 0
        if len(strays) == 1 and fix[0] - here.until <= self.hole and here.off(fix) <= self.radius:
            return self._with(here, new), None, [], held or final
        return following, here, [], held or final

    def needed(self, state):
        found = [tuple(p) for k in ("here", "held") if state.get(k) for p in state[k]["parts"]]
        return found + [(s[3], s[3] + 1) for s in state.get("strays", [])]

    def ended(self, state):
        here, held = load(state, "here"), load(state, "held")
        out = [self._stay(NEXT, held)] if held is not None else []
        if here is not None and here.seconds >= self.dwell:
            out.append(self._stay(NEXT if self.hole <= 0 else AFTER_NEXT, here))
        return out


@register_detector("stay_window")
def stay_window(c: dict) -> Fold:
    return Stays(c)


# --- trips -------------------------------------------------------------------------------------------------------------


@dataclass
class Leg:
    """A way from the last fix of a place (number a) to the first of the next place, or to the last seen (number b). before: time
    of the fix before the departure, None where that isn't known here; settled: time until which the next place was seen, if any."""

    row: int
    a: int
    b: int
    begin: int
    end: int
    moves: int
    extent: float
    before: int | None
    settled: int | None


class Trips(Fold):
    """Legs between places, in two layers: where places are left and reached, and which legs are trips, with what corroborates them."""

    def __init__(self, c: dict):
        self.ping, self.others = c.get("location_event", "location_ping"), frozenset(c.get("corroborating_events", ()))
        super().__init__({self.ping, *self.others})
        self.radius, self.settle, self.quiet = c.get("settle_radius_m", 60), c.get("settle_seconds", 300), c.get("max_gap_seconds", 1800)
        self.longest, self.pad, self.tolerant = c.get("max_duration_seconds", 21600), c.get("corroboration_pad_seconds", 0), c.get("corroboration_gap_tolerant", False)
        self.accuracy, self.fastest = c.get("max_accuracy_m", 100), c.get("max_speed_kmh", MAX_SPEED_KMH)
        self.fewest, self.shortest, self.nearest = c.get("min_fixes", 4), c.get("min_duration_seconds", 180), c.get("min_distance_m", 500)
        self.silence = self.quiet

    # legs: state has `base`, the visit where one is, or `way` and `rest`, the visit that may become the next place

    def legs(self, state: dict, rows: Rows, number: np.ndarray, use: np.ndarray) -> list[Leg]:
        """use: positions of credible fixes, number: of each."""
        track, out = Track(rows.ts[use], rows.lat[use], rows.lon[use]), []
        if not len(track):
            return out
        base, way, rest, last = load(state, "base"), state.get("way"), load(state, "rest"), state.get("last")
        if last:
            track.wait[0], track.step[0] = track.ts[0] - last[0], distance((last[1], last[2]), track.at(0)[1:])
        silent = np.flatnonzero(track.wait > self.quiet)
        # fixes within the radius of the one before, and those after a silence, end a run of fixes that each leave the last one
        slow = np.union1d(np.flatnonzero(track.step <= self.radius), silent)

        def after(marks: np.ndarray, at: int) -> int:
            k = np.searchsorted(marks, at)
            return int(marks[k]) if k < len(marks) else len(track)

        def one(k: int) -> Visit:
            return Visit().take(track, k, k + 1, int(number[k]))

        def closed(k: int, rest: Visit | None) -> None:
            box = joined(way["box"], [rest_first[1], rest_first[1], rest_first[2], rest_first[2]] if rest else way["box"])
            out.append(
                Leg(int(use[k]), way["a"], rest.parts[0][0] if rest else way["b"], way["begin"], rest.since if rest else way["end"], way["moves"],
                    distance((box[0], box[2]), (box[1], box[3])), way["before"], rest.until if rest else None)
            )

        rest_first = state.get("rest_first")
        at = 0
        while at < len(track):
            if track.wait[at] > self.quiet and (base is not None or way):
                if way:
                    closed(at, rest)
                base, way, rest = one(at), None, None
                base.before = int(track.ts[at] - track.wait[at])
                at += 1
            elif base is None and not way:
                base, at = one(at), at + 1
                base.before = state.get("earlier")
            elif base is not None:
                end = base.reach(track, at, after(silent, at), self.radius)
                if end > at:
                    base.take(track, at, end, int(number[at]))
                    base.parts = [[int(number[end - 1]), int(number[end - 1]) + 1]]  # only the last fix is cited
                at = end
                if at < len(track) and track.wait[at] <= self.quiet:
                    y, x = base.last[1:]
                    way = {"a": base.parts[0][0], "b": int(number[at]), "begin": base.until, "end": int(track.ts[at]), "moves": 1, "before": base.before,
                           "box": joined([y, y, x, x], one(at).box)}
                    base, at = None, at + 1
            else:
                if rest is not None:
                    # an arrival is known at the first fix that makes the rest long enough
                    end = rest.reach(track, at, after(silent, at), self.radius)
                    due = at + int(np.searchsorted(track.ts[at:end], rest.since + self.settle))
                    if due < end:
                        rest.take(track, at, due + 1, int(number[at]))
                        closed(due, rest)
                        base, way, rest, at = rest, None, None, due + 1
                        base.parts = [[int(number[at - 1]), int(number[at - 1]) + 1]]
                        if base.n == 1:
                            base.before = None
                        continue
                    if end > at:
                        rest.take(track, at, end, int(number[at]))
                        at = end
                        continue
                    way |= {"b": rest.parts[-1][1] - 1, "end": rest.until, "moves": way["moves"] + rest.n, "box": joined(way["box"], rest.box)}
                    # each fix until then leaves the one before: all but the last are part of the way
                    far = min(after(slow, at + 1), at + max(1, int(np.searchsorted(track.ts[at:], way["begin"] + self.longest)) + 1)) - 1
                    if far > at:
                        run = Visit().take(track, at, far, int(number[at]))
                        way |= {"b": int(number[far - 1]), "end": run.until, "moves": way["moves"] + run.n, "box": joined(way["box"], run.box)}
                        at = far
                rest, rest_first = one(at), list(track.at(at))
                if track.ts[at] - way["begin"] >= self.longest:
                    closed(at, rest)
                    base, way, rest = rest, None, None
                at += 1
        state.update(base=base and vars(base), way=way, rest=rest and vars(rest), rest_first=rest_first, last=list(track.at(-1)))
        return out

    def over(self, state: dict) -> Leg | None:
        """The leg that a silence closes."""
        way, rest = state.get("way"), load(state, "rest")
        if not way:
            return None
        y, x = state["rest_first"][1:] if rest else (way["box"][0], way["box"][2])
        box = joined(way["box"], [y, y, x, x])
        extent = distance((box[0], box[2]), (box[1], box[3]))
        return Leg(NEXT, way["a"], rest.parts[0][0] if rest else way["b"], way["begin"], rest.since if rest else way["end"], way["moves"], extent, way["before"], rest.until if rest else None)

    # marks: state has those that a later leg may still cite, as [ts, number]

    def mark(self, state: dict, ts: int, number: int) -> None:
        state["marks"] = [m for m in state.get("marks", []) if ts - m[0] <= self.longest] + [[ts, number]]

    def judged(self, state: dict, leg: Leg) -> tuple[bool, list[list[int]]]:
        """Whether a leg is a trip, and the marks that it cites. Marks up to its end are used up either way."""
        lo, hi = leg.begin - self.pad, leg.end + self.pad
        if self.tolerant:
            lo, hi = min(lo, leg.before if leg.before is not None else lo), max(hi, leg.settled if leg.settled is not None else hi)
        marks = state.get("marks", [])
        state["marks"] = [m for m in marks if m[0] > leg.end + self.pad]
        trip = leg.moves >= self.fewest and leg.end - leg.begin >= self.shortest and leg.extent >= self.nearest
        return trip, [m for m in marks if lo <= m[0] <= hi] if trip else []

    def advance(self, state, rows):
        use = rows.fixes(self.ping, self.accuracy)
        use = use[credible(Track(rows.ts[use], rows.lat[use], rows.lon[use]), state.get("last"), self.fastest)]
        marks = np.flatnonzero(np.isin(rows.name, list(self.others))) if self.others else np.zeros(0, np.int64)
        kept = np.union1d(use, marks).astype(np.int64)
        first = state.get("next", 0)
        legs = self.legs(state, rows, first + np.searchsorted(kept, use), use)
        steps = sorted([(int(r), 0, None) for r in marks] + [(leg.row, 1, leg) for leg in legs], key=lambda s: s[:2])
        fired = []
        for row, _, leg in steps:
            if leg is None:
                self.mark(state, int(rows.ts[row]), first + int(np.searchsorted(kept, row)))
                continue
            trip, cited = self.judged(state, leg)
            if trip:
                fired.append(Fired(row, leg.end, float(leg.moves), [(leg.a, leg.b + 1, FIXES), *[(k, k + 1, ITSELF) for _, k in cited]]))
        state["next"] = first + len(kept)
        return fired, kept.tolist()

    def needed(self, state):
        base, way, rest = state.get("base"), state.get("way"), state.get("rest")
        found = [(k, k + 1) for _, k in state.get("marks", [])]
        if way:
            found.append((way["a"], rest["parts"][0][0] + 1 if rest else way["b"] + 1))
            if rest:
                found.append(tuple(rest["parts"][-1]))
        elif base:
            found.append(tuple(base["parts"][-1]))
        return found


@register_detector("trip_window")
def trip_window(c: dict) -> Fold:
    return Trips(c)


# --- fusion ------------------------------------------------------------------------------------------------------------


class Fusion(Fold):
    """Claims of two kinds as spans. A primary one fires at once, with the oldest waiting secondary one that it touches. A secondary
    one that touches a primary of late is part of that; else it waits, and fires alone when the clock, which lags an event behind, is
    past its time, unless it is short or a tick fell into it. One at most goes at an event."""

    def __init__(self, c: dict):
        self.primary, self.secondary, self.tick = c["primary_event"], c["secondary_event"], c["tick_event"]
        super().__init__({self.primary, self.secondary, self.tick})
        self.pad, self.timeout = c.get("pair_pad_seconds", 300), c.get("secondary_timeout_seconds", 1800)
        self.horizon, self.shortest = c.get("recent_horizon_seconds", 21600), c.get("min_secondary_span_seconds", 0)

    def advance(self, state, rows):
        fired, kept, number, done = [], [], state.get("next", 0), 0
        claims = np.flatnonzero((rows.name == self.primary) | (rows.name == self.secondary))
        for row in [*claims.tolist(), len(rows.ts)]:
            fired += self._ticks(state, rows.ts[done:row], done)
            done = row + 1
            if row == len(rows.ts):
                break
            lo, hi, now = int(rows.lo[row]), int(rows.hi[row]), int(rows.ts[row])
            waiting, served = state.setdefault("waiting", []), state.get("served", [])
            if rows.name[row] == self.primary:
                taken = next((w for w in waiting if self._touch(lo, hi, w["lo"], w["hi"])), None)
                cites = [(number, number + 1, OWN_EVIDENCE)]
                if taken is not None:
                    waiting.remove(taken)
                    cites.append((taken["number"], taken["number"] + 1, ITSELF))
                state["served"] = [s for s in served if now - s[1] <= self.horizon] + [[lo, hi]]
                fired.append(Fired(row, now, None, cites))
            else:
                if not any(self._touch(lo, hi, *s) for s in served):
                    waiting.append({"lo": lo, "hi": hi, "ts": now, "number": number, "ticked": state.get("ticked", 0) >= lo})
                fired += self._due(state, np.array([now]), row)
            kept.append(row)
            number += 1
        state["next"] = number
        return fired, kept

    def _touch(self, lo: int, hi: int, lo2: int, hi2: int) -> bool:
        return max(lo, lo2) - min(hi, hi2) <= self.pad

    def _ticks(self, state: dict, ts: np.ndarray, row: int) -> list[Fired]:
        if not len(ts):
            return []
        inside = {}
        for w in state.get("waiting", []):
            hit = np.flatnonzero((ts >= w["lo"]) & (ts <= w["hi"] + self.pad))
            inside[w["number"]] = int(hit[0]) if len(hit) else len(ts)
        out = self._due(state, ts, row, inside)
        for w in state.get("waiting", []):
            w["ticked"] = w["ticked"] or inside[w["number"]] < len(ts)
        state["ticked"] = max(state.get("ticked", 0), int(ts.max()))
        return out

    def _due(self, state: dict, ts: np.ndarray, row: int, inside: dict[int, int] | None = None) -> list[Fired]:
        """What waits no longer at events of these times, from `row` on; inside: the first of them that lies in a waiting span."""
        clock = np.maximum.accumulate(np.concatenate([[state.get("clock", 0)], ts]))
        state["clock"], at, out = int(clock[-1]), 0, []
        while waiting := state.get("waiting"):
            at = max(at, int(np.searchsorted(clock[:-1], waiting[0]["ts"] + self.timeout, side="right")))
            if at >= len(ts):
                break
            w = waiting.pop(0)
            ticked = w["ticked"] or (inside is not None and inside[w["number"]] <= at)
            if not ticked and w["hi"] - w["lo"] >= self.shortest:
                k = w["number"]
                out.append(Fired(row + at, w["hi"], -1.0, [(k, k + 1, ITSELF), (k, k + 1, PARTS)]))
            at += 1
        return out

    def needed(self, state):
        return [(w["number"], w["number"] + 1) for w in state.get("waiting", [])]


@register_detector("claim_fusion")
def claim_fusion(c: dict) -> Fold:
    return Fusion(c)


def span_of(event: dict) -> tuple[int, int]:
    """From the first to the last located source, else source, else the event itself."""
    sources = event.get("sources") or [event]
    times = sorted(s["ts"] for s in sources if s.get("lat") is not None and s.get("lon") is not None) or sorted(s["ts"] for s in sources)
    return times[0], times[-1]


def rows_of(events: list[dict]) -> Rows:
    spans = [span_of(e) for e in events]
    number = lambda key: np.array([np.nan if e.get(key) is None else float(e[key]) for e in events])
    return Rows(
        np.array([e["name"] for e in events], object), np.array([e["ts"] for e in events], np.int64), number("lat"), number("lon"), number("acc"),
        np.array([s[0] for s in spans], np.int64), np.array([s[1] for s in spans], np.int64),
    )


def cited(fired: Fired, event: Callable[[int], dict], ping: str | None) -> tuple[float, list[dict]]:
    """Score and evidence of what fired. event: the event of a number."""
    found = []
    for a, b, how in fired.cites:
        for k in range(a, b):
            e = event(k)
            own = e.get("sources") or []
            if how == FIXES:
                found += [e] if e["name"] == ping else []
            elif how == ITSELF:
                found.append(e)
            else:
                found += own or ([e] if how == OWN_EVIDENCE else [])
    if any(how == FIXES for _, _, how in fired.cites):
        found.sort(key=lambda e: e["ts"])
    if fired.score is None:
        first: dict = {}
        for e in found:
            first.setdefault(e.get("id"), e)
        found = list(first.values())
    return float(len(found)) if fired.score is None or fired.score < 0 else fired.score, found
