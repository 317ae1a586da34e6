"""State over streams of events: a series' baseline, a status that only goes forward, and points of a run series.

Each operator keeps a few values per key and answers every event in order of its time, so that what it says doesn't
depend on how the events are cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The stages of a run's status; a run that has ended stays as it ended.
PENDING, ENDED = "pending", ("success", "failure", "error")


def _sorted(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(order, kind="stable")


def _run(events: DataFrame, keys: list[str], step, out: str, state: str) -> DataFrame:
    return events.groupBy(*keys).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def with_baseline(events: DataFrame, key: str, value: str, usable: str, at: list[str]) -> DataFrame:
    """(key, *at, value, baseline, delta): each event's value against the latest usable one before it in its series;
    null for a series' first."""
    fields = [*at, value]
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: Any = state.get[0] if state.exists else None
        rows = []
        for row in _sorted(frames, at).itertuples(index=False):
            now = getattr(row, value)
            rows.append((own[0], *[getattr(row, f) for f in fields], known, None if known is None else now - known))
            known = now if getattr(row, usable) else known
        if known is not None:
            state.update((known,))
        made = pd.DataFrame(rows, columns=[key, *fields, "baseline", "delta"])
        yield made.astype({"baseline": "float64", "delta": "float64"})

    schema = ", ".join([f"{key} {kinds[key]}", *(f"{f} {kinds[f]}" for f in fields), "baseline double", "delta double"])
    return _run(events.select(key, *fields, usable), [key], step, schema, "known double")


def status_changes(events: DataFrame, key: str, said: str, at: list[str]) -> DataFrame:
    """(key, *at, was, became): the steps of each run's status. A run begins as pending; the first end stands, and
    events that would change nothing say nothing."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else None
        rows = []
        for row in _sorted(frames, at).itertuples(index=False):
            word = getattr(row, said)
            if status in ENDED or word == status or word not in (PENDING, *ENDED):
                continue
            if status is None and word != PENDING:
                rows.append((own[0], *[getattr(row, f) for f in at], None, PENDING))
                status = PENDING
            rows.append((own[0], *[getattr(row, f) for f in at], status, word))
            status = word
        if status is not None:
            state.update((status,))
        yield pd.DataFrame(rows, columns=[key, *at, "was", "became"]).astype({"was": "string", "became": "string"})

    schema = ", ".join([f"{key} {kinds[key]}", *(f"{f} {kinds[f]}" for f in at), "was string", "became string"])
    return _run(events.select(key, *at, said), [key], step, schema, "status string")


def numbered(events: DataFrame, key: str, at: list[str]) -> DataFrame:
    """(key, *at, point): each event's number in its series."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = _sorted(frames, at)[at].copy()
        rows.insert(0, key, own[0])
        rows["point"] = range(seen + 1, seen + 1 + len(rows))
        state.update((seen + len(rows),))
        yield rows

    schema = ", ".join([f"{key} {kinds[key]}", *(f"{f} {kinds[f]}" for f in at), "point long"])
    return _run(events.select(key, *at), [key], step, schema, "seen long")


def against_table(events: DataFrame, baselines: DataFrame, key: str, value: str) -> DataFrame:
    """Events joined with a table of baselines (key, baseline): a stream meets the table as it is when a batch runs."""
    rows = events.join(baselines, key, "left")
    return rows.withColumn("delta", F.col(value) - F.col("baseline"))
