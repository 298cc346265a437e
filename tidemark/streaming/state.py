"""Streaming forms of per-service state and of windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOOKBACK = 3
COLUMNS = ("window_id", "ts_us", "decision", "top1_match", "family", "window_type")
OUTPUT = "service string, window_id string, suppressed boolean, incident_id string"
STATE = "window_ids array<string>, tops array<string>, families array<string>, types array<string>, incidents array<string>"


def _known(x: object) -> str | None:
    return None if x is None or isinstance(x, float) else str(x)


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["ts_us", "window_id"])
    old = state.get if state.exists else ([], [], [], [], [])
    recent = list(zip(*[list(x) for x in old], strict=True))
    out = []
    for r in rows.itertuples(index=False):
        window, top, family, kind = r.window_id, _known(r.top1_match), _known(r.family), _known(r.window_type)
        worthy, incident, hit = r.decision == "ticket_worthy", None, None
        if worthy and top is not None:
            for past in reversed(recent):
                if past[3] == "recovery_window":
                    break
                if past[1] == top and family is not None and past[2] == family:
                    hit = past
                    break
        if worthy:
            incident = (hit[4] or hit[0]) if hit else window
        out.append((key[0], window, hit is not None, incident))
        recent = [*recent, (window, top, family, kind, incident)][-LOOKBACK:]
    state.update(tuple(list(x) for x in zip(*recent, strict=True)))
    yield pd.DataFrame(out, columns=["service", "window_id", "suppressed", "incident_id"])


def suppressed_stream(decisions: DataFrame) -> DataFrame:
    """Decisions of a stream with suppression and inherited incident, by service.

    `decisions` is a streaming frame with service and COLUMNS. The state of a
    service is its last LOOKBACK decisions, so it has a fixed size. Rows of a
    micro-batch are taken in order of (ts_us, window_id); a row later than its
    batch is taken when it comes. An incident is named after its first window.
    """
    rows = decisions.filter("service is not null").select("service", *COLUMNS)
    return rows.groupBy("service").applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Counts in tumbling windows of event time; rows later than the watermark are dropped by the engine."""
    g = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start_at"), *keys, "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """A stream without repeated deliveries within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
