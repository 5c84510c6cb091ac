"""The hysteresis gate on a stream: an event goes out when it has closed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "clip_key long, start long, stop long, n_frames long"


def stream_events(frames: DataFrame, x: str, on: float, off: float, least: int) -> DataFrame:
    """Events of each clip as they close: clip_key, start, stop (exclusive), n_frames.

    Frames of a clip must arrive in order of frame_index. The state of a clip is
    the start and length of its open event; an event that is open at the end of
    the stream stays in the state.
    """
    if off > on:
        raise ValueError("off must not exceed on")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (-1, 0)
        closed = []
        rows = pd.concat(list(batches)).sort_values("frame_index")
        for frame, value in zip(rows["frame_index"], rows[x], strict=True):
            if start < 0:
                start, n = (int(frame), 1) if value >= on else (-1, 0)
            elif value >= off:
                n += 1
            else:
                if n >= least:
                    closed.append((key[0], start, start + n, n))
                start, n = -1, 0
        state.update((start, n))
        yield pd.DataFrame(closed, columns=["clip_key", "start", "stop", "n_frames"])

    return frames.groupBy("clip_key").applyInPandasWithState(step, EVENTS, "start long, n long", "append", GroupStateTimeout.NoTimeout)
