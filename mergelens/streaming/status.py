"""The state machine of a request, as a batch over an event log and as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The state after an event in a state; any other event changes nothing.
MOVES = {
    (None, "enqueued"): "PENDING",
    ("PENDING", "started"): "REVIEWING",
    ("REVIEWING", "finished"): "COMPLETED",
    ("REVIEWING", "empty"): "COMPLETED",
    ("REVIEWING", "failed"): "FAILED",
    ("FAILED", "retried"): "PENDING",
}
OUT = "request_id string, status string, moves int, ignored int"


def step(status: str | None, event: str) -> tuple[str | None, bool]:
    """The next status, and whether the event moved it."""
    nxt = MOVES.get((status, event))
    return (status, False) if nxt is None else (nxt, True)


def final_status(events: DataFrame) -> DataFrame:
    """``request_id``, ``status``, ``moves``, ``ignored`` of a log of ``request_id``, ``at``, ``seq``, ``event``.

    Rows are sorted by request, time and number within a task and streamed through it.
    Null request ids are left out; null events change nothing."""
    clean = events.where("request_id IS NOT NULL").select("request_id", "at", "seq", "event")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, status, moves, ignored = None, None, 0, 0
        for frame in frames:
            out = []
            for request, event in zip(frame["request_id"], frame["event"]):
                if request != now:
                    if now is not None:
                        out.append((now, status, moves, ignored))
                    now, status, moves, ignored = request, None, 0, 0
                status, moved = step(status, event)
                moves, ignored = moves + moved, ignored + (not moved)
            yield pd.DataFrame(out, columns=["request_id", "status", "moves", "ignored"])
        if now is not None:
            yield pd.DataFrame([(now, status, moves, ignored)], columns=["request_id", "status", "moves", "ignored"])

    return clean.repartition("request_id").sortWithinPartitions("request_id", "at", "seq").mapInPandas(run, OUT)


def status_updates(events: DataFrame) -> DataFrame:
    """The same over a stream: a row per request and micro-batch that had events for it.

    Events of one micro-batch are put in order; those that come in a later one count after it."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, moves, ignored = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable")
        for event in rows["event"]:
            status, moved = step(status, event)
            moves, ignored = moves + moved, ignored + (not moved)
        state.update((status, moves, ignored))
        yield pd.DataFrame([(key[0], status, moves, ignored)], columns=["request_id", "status", "moves", "ignored"])

    return events.groupBy("request_id").applyInPandasWithState(update, OUT, "status string, moves int, ignored int", "update", GroupStateTimeout.NoTimeout)
