"""What a deployment names for itself, from the JSON file that TIDELINE_SETTINGS names, where it is set.

kind_field: the payload field that says which detector derived an event. own_source: the source_app of derived events.
first_party: sources that the quality report leaves out unless asked."""

from __future__ import annotations

import json
import os
from functools import cache

DEFAULTS = {"kind_field": "derived_kind", "own_source": "tideline", "first_party": ["tideline", "relay"]}


@cache
def settings() -> dict:
    at = os.environ.get("TIDELINE_SETTINGS")
    if not at:
        return dict(DEFAULTS)
    with open(at, encoding="utf-8") as f:
        return DEFAULTS | json.load(f)


KIND_FIELD: str = settings()["kind_field"]
OWN_SOURCE: str = settings()["own_source"]
FIRST_PARTY: list[str] = settings()["first_party"]
