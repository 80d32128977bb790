"""Numbers-only metrics: what may leave the cluster carries no names."""

from __future__ import annotations

import json
import math


def numeric_only(value: object) -> object:
    """The numbers and flags of nested data; texts and what isn't finite go, and containers left empty."""
    if isinstance(value, bool) or (isinstance(value, (int, float)) and math.isfinite(value)):
        return value
    if isinstance(value, dict):
        kept = {str(k): numeric_only(v) for k, v in value.items()}
        return {k: v for k, v in kept.items() if v is not None} or None
    if isinstance(value, (list, tuple)):
        return [x for x in map(numeric_only, value) if x is not None] or None
    return None


def line(event: str, **values: float) -> str:
    """One log line; raises TypeError for a value that is not exactly an int, float or bool."""
    for k, v in values.items():
        if type(v) not in (int, float, bool):
            raise TypeError(f"{k} must be a number")
    return json.dumps({"event": event, **values}, sort_keys=True)
