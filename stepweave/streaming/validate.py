"""Validation of steps as they arrive, in Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "episode_id string, num_steps long, n_first long, n_last long, goes_back long, out_of_place long, complete boolean, late long"
_STATE = "num_steps long, n_first long, n_last long, goes_back long, out_of_place long, last_ts double, last_step long, closed boolean, late long"


def _advance(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState, timeout_ms: int | None) -> Iterator[pd.DataFrame]:
    n, first, last, back, misplaced, ts, step, closed, late = state.get if state.exists else (0, 0, 0, 0, 0, float("-inf"), -1, False, 0)
    if state.hasTimedOut:
        state.remove()
        if not closed:
            yield _row(key[0], n, first, last, back, misplaced, False, late)
        return
    pdf = pd.concat(list(parts), ignore_index=True).sort_values("step_index", kind="stable")
    was = closed
    steps, times, ends = pdf["step_index"].to_numpy(), pdf["timestamp"].to_numpy(float), pdf["is_last"].to_numpy(bool)
    # what comes after the first last step is late
    used = 0 if closed else int(ends.argmax()) + 1 if ends.any() else len(pdf)
    late += len(pdf) - used
    if used:
        n, first, last = n + used, first + int(pdf["is_first"].to_numpy(bool)[:used].sum()), last + int(ends[:used].sum())
        back += int((times[:used] < np.append(ts, times[: used - 1])).sum())
        misplaced += int((steps[:used] != np.append(step, steps[: used - 1]) + 1).sum())
        ts, step, closed = times[used - 1], steps[used - 1], bool(ends[used - 1])
    state.update((n, first, last, back, misplaced, float(ts), int(step), closed, late))
    if timeout_ms:
        state.setTimeoutDuration(timeout_ms)
    if closed and (not was or late):
        yield _row(key[0], n, first, last, back, misplaced, True, late)


def _row(*values: Any) -> pd.DataFrame:
    return pd.DataFrame([values], columns=[c.split()[0] for c in RESULT.split(", ")])


def validate_stream(steps: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """A row for each episode once its last step has come, and again if steps come later (late).

    steps: a stream of episode_id, step_index, is_first, is_last, timestamp. State: a few numbers an episode. An episode that
    gets no steps for timeout_ms ends (as incomplete if its last step never came) and its state goes: a stream without end
    needs that. With None states stay and the query can idle, so that a trigger of what is available now comes to its end.
    """
    narrow = steps.select("episode_id", "step_index", "is_first", "is_last", "timestamp")
    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return narrow.groupBy("episode_id").applyInPandasWithState(lambda k, p, s: _advance(k, p, s, timeout_ms), RESULT, _STATE, "update", kind)


def window_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and kind; on a stream, events later than delay are left out."""
    at = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        at = at.withWatermark(ts, delay)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return at.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs of events with no gap of that length."""
    at = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        at = at.withWatermark(ts, delay)
    return at.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
