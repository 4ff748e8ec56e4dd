"""Structured Streaming on track points: a stateful linker, sessions and windows. Beyond the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklark.operators.linking import Linker

LINKED = "movie long, channel string, frame int, x double, y double, track_no long"
STATE = "made long, tracks array<struct<t:long,frame:int,x:double,y:double>>, frame int"


def tumbling(points: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Points and mean x of each channel and time window; rows later than `late` are left out."""
    return points.withWatermark(time, late).groupBy(F.window(time, width), "channel").agg(F.count(F.lit(1)).alias("points"), F.avg("x").alias("mean_x"))


def sessions(points: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of points of a track without a pause of `gap`."""
    found = points.withWatermark(time, late).groupBy(F.session_window(time, gap), "track_id").agg(F.count(F.lit(1)).alias("points"))
    return found.select("track_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "points")


def linked_stream(detections: DataFrame, reach: float, memory: int) -> DataFrame:
    """The batch linker on a stream of (movie, channel, frame, x, y) whose frames come in order: state is the last place
    of the open tracks, which are forgotten after `memory` missed frames. Frames at or before the last one are late and
    start no link."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        linker, last = Linker(reach, memory), -1
        if state.exists:
            made, tracks, last = state.get
            linker.made, linker.last = made, {t["t"]: (t["frame"], t["x"], t["y"]) for t in map(_row, tracks)}
        rows = pd.concat(list(batches)).sort_values(["frame", "x", "y"])
        rows = rows[rows.frame > last]
        names = np.zeros(len(rows), np.int64)
        xy = rows[["x", "y"]].to_numpy(float)
        for frame, own in rows.reset_index(drop=True).groupby("frame", sort=True).indices.items():
            names[own], last = linker.step(int(frame), xy[own]), int(frame)
        state.update((linker.made, [(int(t), int(f), float(x), float(y)) for t, (f, x, y) in linker.last.items() if last - f <= memory], last))
        yield pd.DataFrame({"movie": key[0], "channel": key[1], "frame": rows.frame.to_numpy(), "x": xy[:, 0], "y": xy[:, 1], "track_no": names})

    return detections.groupBy("movie", "channel").applyInPandasWithState(step, LINKED, STATE, "append", "NoTimeout")


def _row(t) -> dict:
    return t if isinstance(t, dict) else t.asDict() if hasattr(t, "asDict") else dict(zip(("t", "frame", "x", "y"), t, strict=True))
