"""Face positions smoothed as they arrive: the same numbers as ``smooth_track``, kept as state of each track."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mediaspan.operators.selection import KEY, held_positions


def smooth_stream(samples: DataFrame, alpha: float = 0.15, deadband: float = 0.03, centre: float = 0.5, idle_ms: int | None = None) -> DataFrame:
    """``samples`` (streaming: media_id, at_ms, sample_id, x[, y], detected) with hold[, hold_y] and late.

    A track's samples must come in time order over micro-batches; within one they may come in any. A late sample (not after the last one by at_ms and sample_id) is
    given the position that is held by then, marked late, and changes nothing. The state of a track is its last sample and two numbers a coordinate; it is
    forgotten after ``idle_ms`` of processing time without samples, and a later sample begins anew (not for the availableNow trigger, which goes on while a
    state can time out). Null media ids are one track.
    """
    axes = [a for a in ("x", "y") if a in samples.columns]
    outputs = ["hold", "hold_y"][: len(axes)]
    kinds = dict(samples.dtypes)
    state_schema = "at_ms long, sample_id long, seen boolean, numbers array<double>"

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["at_ms", "sample_id"], kind="stable", ignore_index=True)
        if state.exists:
            at, sample, seen, numbers = state.get
            kept = (bool(seen), list(zip(numbers[::2], numbers[1::2])))
        else:
            at, sample, kept = None, None, (False, [(0.0, centre)] * len(axes))
        stamps = list(zip(rows["at_ms"], rows["sample_id"]))
        late = np.array([at is not None and s <= (at, sample) for s in stamps], bool)
        held = np.tile([hold for _, hold in kept[1]], (len(rows), 1))
        seats = rows[axes].to_numpy(float).clip(0.0, 1.0)
        found = rows["detected"].fillna(False).to_numpy(bool) & ~np.isnan(seats).any(axis=1)
        held[~late], kept = held_positions(seats[~late], found[~late], kept, alpha, deadband)
        if (~late).any():
            at, sample = stamps[-1]
        state.update((int(at), int(sample), kept[0], [float(n) for pair in kept[1] for n in pair]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({KEY: rows[KEY], "sample_id": rows["sample_id"], "at_ms": rows["at_ms"], **{name: held[:, j] for j, name in enumerate(outputs)}, "late": late})

    schema = f"{KEY} {kinds[KEY]}, sample_id {kinds['sample_id']}, at_ms {kinds['at_ms']}, " + ", ".join(f"{name} double" for name in outputs) + ", late boolean"
    rows = samples.select(KEY, "sample_id", "at_ms", "detected", *axes)
    return rows.groupBy(KEY).applyInPandasWithState(update, schema, state_schema, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
