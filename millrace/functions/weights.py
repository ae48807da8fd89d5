"""Event weights, with a named policy for types that are not known."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much each kind of event counts.
WEIGHTS: dict[str, int] = {"view": 1, "add_to_cart": 3, "purchase": 5}
CLICKSTREAM_WEIGHTS: dict[str, float] = {"view": 1.0, "addtocart": 3.0, "transaction": 5.0}
#: What an unknown type counts: collaborative filtering takes one, ALS zero; batch popularity drops it (null).
UNKNOWN: dict[str, float | None] = {"one": 1.0, "zero": 0.0, "drop": None}


def weight(event_type: Column, unknown: str, weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weight of an event as a double; null marks rows to drop."""
    out = F.lit(None).cast("double") if UNKNOWN[unknown] is None else F.lit(float(UNKNOWN[unknown]))
    for kind, value in weights.items():
        out = F.when(event_type == kind, F.lit(float(value))).otherwise(out)
    return out
