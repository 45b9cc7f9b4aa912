"""Event definitions: detectors declared as data. Read from a folder of YAML or JSON files, or the shipped ones."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from tideline.operators.folds import make_detector

CAPABILITIES = ("interval", "place", "journey", "vehicle", "support", "pauses")


@dataclass(frozen=True)
class Definition:
    name: str
    engine: str
    engine_config: dict = field(default_factory=dict)
    enabled: bool = True
    source_topic: str = "raw_sensors"
    sink_topic: str = "high_level_events"
    capabilities: tuple[str, ...] = ()

    @classmethod
    def of(cls, spec: dict) -> Definition:
        unknown = set(spec) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        bad = set(spec.get("capabilities") or ()) - set(CAPABILITIES)
        if bad:
            raise ValueError(f"unknown capabilities {sorted(bad)}")
        return cls(**spec | {"capabilities": tuple(spec.get("capabilities") or ())})


def load_definitions(folder: str) -> tuple[list[Definition], dict[str, str]]:
    """Enabled definitions in file-name order, and why each invalid file was left out."""
    found, rejected = [], {}
    for path in sorted(Path(folder).iterdir()):
        try:
            if path.suffix == ".json":
                spec = json.loads(path.read_text())
            elif path.suffix in (".yml", ".yaml"):
                import yaml

                spec = yaml.safe_load(path.read_text())
            else:
                continue
            d = Definition.of(spec)
            if d.enabled:
                found.append(d)
        except (ValueError, TypeError) as e:
            rejected[path.name] = str(e)
    return found, rejected


#: The names, thresholds and weights of the standard definitions.
STANDARD = [
    Definition(
        "car_trip",
        "validated_session_window",
        {
            "start_event": "got_into_the_car",
            "end_event": "got_out_the_car",
            "max_duration_seconds": 21600,
            "min_displacement_m": 300,
            "min_fixes": 3,
            "min_coverage_ratio": 0.5,
            "max_accuracy_m": 100,
        },
        capabilities=("interval",),
    ),
    Definition(
        "got_into_the_car",
        "weighted_window",
        {
            "threshold": 10,
            "window_seconds": 600,
            "cooldown_seconds": 600,
            "weights": {"device_connected_to_carplay": 6, "car_lock_state_change": 4, "car_driver_door_opened": 4},
        },
    ),
    Definition(
        "got_out_the_car",
        "session_gated_window",
        {
            "gate_event": "got_into_the_car",
            "gate_weight": 4,
            "max_open_seconds": 21600,
            "window_seconds": 300,
            "threshold": 10,
            "cooldown_seconds": 600,
            "weights": {"device_disconnected_from_carplay": 6, "car_lock_state_change": 5, "car_driver_door_opened": 5},
        },
    ),
    Definition(
        "journey",
        "claim_fusion",
        {
            "primary_event": "trip",
            "secondary_event": "car_trip",
            "tick_event": "location_ping",
            "pair_pad_seconds": 300,
            "secondary_timeout_seconds": 1800,
            "min_secondary_span_seconds": 120,
        },
        capabilities=("interval", "journey", "vehicle", "support", "pauses"),
    ),
    Definition(
        "stay",
        "stay_window",
        {
            "radius_m": 60,
            "min_dwell_seconds": 300,
            "max_accuracy_m": 100,
            "max_gap_seconds": 3600,
            "break_fixes": 3,
            "rejoin_max_hole_seconds": 7200,
            "departure_distance_m": 500,
        },
        capabilities=("interval", "place"),
    ),
    Definition(
        "trip",
        "trip_window",
        {
            "settle_radius_m": 60,
            "settle_seconds": 300,
            "min_distance_m": 500,
            "min_duration_seconds": 120,
            "min_fixes": 4,
            "max_gap_seconds": 1800,
            "max_duration_seconds": 21600,
            "max_accuracy_m": 100,
            "corroborating_events": ["got_into_the_car", "got_out_the_car"],
            "corroboration_pad_seconds": 60,
            "corroboration_gap_tolerant": True,
        },
        capabilities=("interval",),
    ),
]


def with_overrides(definitions: list[Definition], overrides: dict[str, dict]) -> list[Definition]:
    """A variant: shallow overrides of engine_config keys by definition name."""
    missing = set(overrides) - {d.name for d in definitions}
    if missing:
        raise ValueError(f"no definition named {sorted(missing)}")
    return [Definition(**(d.__dict__ | {"engine_config": d.engine_config | overrides.get(d.name, {})})) for d in definitions]


class Plan:
    """Which detector reads which event, what comes from outside, and an order in which each definition follows those it reads."""

    def __init__(self, definitions: list[Definition]):
        self.definitions = {d.name: d for d in definitions}
        self.folds = {d.name: make_detector(d.engine, d.engine_config) for d in definitions}
        self.consumers: dict[str, list[str]] = {}
        for d in definitions:
            for n in sorted(self.folds[d.name].reads):
                self.consumers.setdefault(n, []).append(d.name)
        self.order: list[str] = []
        while rest := [d for d in self.definitions if d not in self.order]:
            free = [d for d in rest if all(n in self.order or n not in self.definitions for n in self.folds[d].reads)]
            if not free:
                raise ValueError(f"definitions feed each other in a circle: {sorted(rest)}")
            self.order += free
        topics = {d.source_topic for d in definitions}
        if len(topics) > 1:
            raise ValueError(f"one external source topic only, not {sorted(topics)}")

    def external_inputs(self) -> list[str]:
        """Names that some definition reads and none makes."""
        return sorted(set(self.consumers) - set(self.definitions))
