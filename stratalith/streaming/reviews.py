"""Reviews as a stream: created, then approved or rejected, or timed out when nobody answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "review_id long, status string, reviewer string, at timestamp"
STATE = "expires long"
ANSWERS = {"approve": "approved", "reject": "rejected"}


def review_states(events: DataFrame, late: str = "10 minutes", expiry_minutes: int = 60) -> DataFrame:
    """Each change of a review's state, from (review_id, ts, action, reviewer).

    Actions are create, approve and reject; an answer counts only while its review
    is pending, and one after the expiry counts as a timeout, at the expiry.
    Event time decides; events later than the watermark are left out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []

        def say(status: str, reviewer, ms: int):
            out.append((key[0], status, reviewer, pd.Timestamp(ms, unit="ms")))

        expires = state.get[0] if state.exists else None
        if state.hasTimedOut:
            say("timeout", None, expires)
            state.remove()
        else:
            for e in pd.concat(frames).sort_values("ts", kind="stable").itertuples():
                now = int(e.ts.timestamp() * 1000)
                if expires is not None and now > expires:
                    say("timeout", None, expires)
                    expires = None
                if e.action == "create" and expires is None:
                    expires = now + expiry_minutes * 60_000
                    say("pending", None, now)
                elif e.action in ANSWERS and expires is not None:
                    say(ANSWERS[e.action], e.reviewer, now)
                    expires = None
            if expires is not None:
                state.update((expires,))
                state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["review_id", "status", "reviewer", "at"])

    rows = events.select(F.col("review_id").cast("long"), "ts", "action", "reviewer").withWatermark("ts", late)
    return rows.groupBy("review_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def progress_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by time window and type; a window is given once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
