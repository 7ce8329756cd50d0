"""Points followed through streams of frames: state is each stream's last frame and where its points were last seen.

Frames come as rows (stream, frame, data) with whole images in row-major order. A stream's first frame only begins it.
Each later one is compared with the one before, as ``operators.flow`` compares two frames, and the points go on from
where they were found; a lost one (status 0) is looked for again where it was. Within a batch frames count in the
order of their numbers. A frame that is no later than the stream's last one comes too late and doesn't count, a
repeated one neither; nor does a frame without a number or an image of another size. With ``idle``, a
stream without a frame for so long loses its state and begins anew; such a query looks for idle streams for ever, so
it isn't for runs that end with what is there now.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import flow
from ..types import Criteria, Shape

SCHEMA = "stream long, frame long, id long, x double, y double, status int, error double"
STATE = "frame long, data array<double>, x array<double>, y array<double>"


def follow(frames: DataFrame, shape: Shape, points: Sequence[tuple[int, float, float]], win: tuple[int, int] = (5, 5), levels: int = 2, criteria: Criteria = Criteria(10, 0.03), min_eigen: float = 1e-4, idle: timedelta | None = None) -> DataFrame:
    """(stream, frame, id, x, y, status, error): the points (id, x, y) of a stream's first frame in each later one."""
    size, ids = (shape.rows, shape.cols), [p[0] for p in points]
    begin = np.array([p[1:] for p in points], float).reshape(-1, 2)

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        came = pd.concat(list(batches)).sort_values("frame", kind="stable")
        number, before, at, there = None, None, begin, np.ones(size, bool)
        if state.exists:
            number, data, x, y = state.get
            before, at = np.array(data, float).reshape(size), np.column_stack([x, y]).astype(float)
        for frame, data in zip(came["frame"], came["data"]):
            if number is not None and frame <= number:
                continue
            now = np.array(data, float).reshape(size)
            if before is not None:
                out = flow.tracked(before, now, there, there, np.column_stack([at, at]), win, levels, criteria, min_eigen)
                at = out[:, :2]
                yield pd.DataFrame({"stream": key[0], "frame": frame, "id": ids, "x": at[:, 0], "y": at[:, 1], "status": out[:, 2].astype("int32"), "error": np.where(out[:, 2] == 1, out[:, 3], np.nan)})
            before, number = now, frame
        state.update((int(number), before.ravel().tolist(), at[:, 0].tolist(), at[:, 1].tolist()))
        if idle:
            state.setTimeoutDuration(int(idle.total_seconds() * 1000))

    whole = F.expr(f"stream is not null and frame is not null and size(data) = {shape.rows * shape.cols} and not exists(data, v -> v is null)")
    known = frames.where(whole).selectExpr("cast(stream as long) stream", "cast(frame as long) frame", "transform(data, v -> cast(v as double)) data")
    return known.groupBy("stream").applyInPandasWithState(step, SCHEMA, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
