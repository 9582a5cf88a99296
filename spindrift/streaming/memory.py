"""Stateful session memory on a stream: the last n turns of every session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: A turn with this role empties its session's memory.
RESET = "reset"


def last_turns_stream(turns: DataFrame, n: int = 20, key: str = "conv_id", idle: str | None = None) -> DataFrame:
    """(key, turn_count, turns) after each micro-batch; ``turns`` are the numbers of the kept turns.

    Turns are put in order of their number, equal numbers as they come; null
    roles and texts are kept as they are.  State holds n turns a session, and
    with ``idle`` (milliseconds) only as long as the session was last heard of.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, held = state.get if state.exists else (0, [])
        rows = [tuple(r) for r in held]
        text = lambda v: None if v is None or v != v else v
        for pdf in batches:
            rows += [(int(t), text(r), text(x)) for t, r, x in zip(pdf["turn"], pdf["role"], pdf["text"])]
            count += len(pdf)
        rows.sort(key=lambda r: r[0])
        if (at := max((i for i, r in enumerate(rows) if r[1] == RESET), default=-1)) >= 0:
            rows, count = rows[at + 1 :], len(rows) - at - 1
        rows = rows[-n:]
        state.update((int(count), rows))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({key: [k[0]], "turn_count": [count], "turns": ["|".join(str(r[0]) for r in rows)]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return turns.groupBy(key).applyInPandasWithState(update, f"{key} long, turn_count long, turns string", "count long, held array<struct<turn:long,role:string,text:string>>", "update", timeout)
