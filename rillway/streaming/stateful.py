"""Keyed state operators for streams: the ordered gate and the state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillway import schemas as S
from rillway.operators.fsm import move

TASK_TABLE = {(a, e): t for a, e, t in S.TASK_MOVES}


def ordered_gate(messages: DataFrame, window: int = S.REORDER_WINDOW) -> DataFrame:
    """Per partition lets offsets through in order; ``messages`` has partition and offset.

    A later offset waits in state and is marked early. Beyond ``window`` of them the hole is taken for lost:
    all that wait are released in order, marked forced, and the gate goes on after as many offsets as it let
    out. What comes after its turn is a redelivery and passes; what already waits is dropped. State never
    holds more than the window.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, held = state.get if state.exists else (0, [])
        waiting, out = set(held), []
        for offset in sorted_arrivals(frames):
            if offset < expected:
                out.append((key[0], offset, False, False))
            elif offset == expected:
                out.append((key[0], offset, False, False))
                expected += 1
                while expected in waiting:
                    waiting.remove(expected)
                    out.append((key[0], expected, True, False))
                    expected += 1
            elif offset not in waiting:
                waiting.add(offset)
                if len(waiting) > window:
                    out += [(key[0], o, True, True) for o in sorted(waiting)]
                    expected, waiting = min(waiting) + len(waiting), set()
        state.update((expected, sorted(waiting)))
        yield pd.DataFrame(out, columns=["partition", "offset", "early", "forced"])

    return messages.groupBy("partition").applyInPandasWithState(step, "partition long, offset long, early boolean, forced boolean", "expected long, held array<long>", "append", GroupStateTimeout.NoTimeout)


def sorted_arrivals(frames: Iterator[pd.DataFrame]) -> list[int]:
    """Offsets of a micro-batch as they came: by arrival where there is such a column."""
    rows = pd.concat(list(frames))
    return (rows.sort_values(["arrival", "offset"]) if "arrival" in rows else rows)["offset"].tolist()


def live_states(events: DataFrame) -> DataFrame:
    """Running state per subject, one row per micro-batch and subject. ``events``: subject, seq, event."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, pause, queue, done = state.get if state.exists else ("PENDING", [], [], 0)
        pause, queue = list(pause), list(queue)
        for event in pd.concat(list(frames)).sort_values("seq")["event"]:
            now, pause, queue, ok = move(now, pause, queue, event, TASK_TABLE)
            done += ok
        state.update((now, pause, queue, int(done)))
        yield pd.DataFrame([(key[0], now, int(done))], columns=["subject", "state", "accepted"])

    return events.groupBy("subject").applyInPandasWithState(step, "subject string, state string, accepted long", "state string, pause array<string>, queue array<string>, accepted long", "update", GroupStateTimeout.NoTimeout)
