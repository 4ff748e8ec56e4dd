"""Ordered analytics of tracks: steps, gaps, turning angles, alignment.

A track is the rows that share the columns `by`, ordered by `frame`. All functions take and return DataFrames and use
one window partitioned by `by`, so a chain of them and an aggregation by track need one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACK = ("track_id",)


def last_wins(points: DataFrame, order: str, by: tuple[str, ...] = TRACK) -> DataFrame:
    """One row for each frame of a track: the last in `order`, as when later file rows replace earlier ones."""
    others = [c for c in points.columns if c not in {*by, "frame"}]
    return points.groupBy(*by, "frame").agg(F.max_by(F.struct(*others), order).alias("last")).select(*by, "frame", "last.*")


def steps(points: DataFrame, by: tuple[str, ...] = TRACK) -> DataFrame:
    """Adds dx, dy, step and gap (frames passed) from the row before, across gaps; null on a track's first row."""
    w = Window.partitionBy(*by).orderBy("frame")
    moved = points.withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w), "gap": F.col("frame") - F.lag("frame").over(w)})
    return moved.withColumn("step", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))


def consecutive_steps(points: DataFrame, last: int = 29, least: int = 3, by: tuple[str, ...] = TRACK) -> DataFrame:
    """The last `last` steps between neighbouring frames, numbered from 1, of tracks that have at least `least`."""
    close = steps(points, by).where("gap = 1")
    falling = Window.partitionBy(*by).orderBy(F.desc("frame"))
    kept = close.withColumns({"from_end": F.row_number().over(falling), "n_steps": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    kept = kept.where((F.col("from_end") <= last) & (F.col("n_steps") >= least))
    return kept.withColumn("step_no", F.least("n_steps", F.lit(last)).cast("int") - F.col("from_end") + 1).drop("from_end", "n_steps")


def turning_angle(dx: Column, dy: Column, before_x: Column, before_y: Column) -> Column:
    """Unsigned angle between two steps; null if one has no length."""
    size = F.sqrt(before_x * before_x + before_y * before_y) * F.sqrt(dx * dx + dy * dy)
    cosine = F.try_divide(before_x * dx + before_y * dy, size)
    return F.when(size > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def with_angles(moved: DataFrame, by: tuple[str, ...] = TRACK) -> DataFrame:
    """Adds the unsigned angle between each step and the step before it; takes what `steps` returns."""
    w = Window.partitionBy(*by).orderBy("frame")
    return moved.withColumn("angle", turning_angle(F.col("dx"), F.col("dy"), F.lag("dx").over(w), F.lag("dy").over(w)))


def with_signed_angles(moved: DataFrame, by: tuple[str, ...] = TRACK) -> DataFrame:
    """Adds the signed angle between a step and the one before it, 0 for the first step."""
    w = Window.partitionBy(*by).orderBy("frame")
    bx, by_ = F.lag("dx").over(w), F.lag("dy").over(w)
    cross, dot = bx * F.col("dy") - by_ * F.col("dx"), bx * F.col("dx") + by_ * F.col("dy")
    return moved.withColumn("signed_angle", F.coalesce(F.atan2(cross, dot), F.lit(0.0)))


def gaps(points: DataFrame, by: tuple[str, ...] = TRACK) -> DataFrame:
    """For each track its points, first and last frame, span, coverage of the span, and longest run of missing frames."""
    span = F.max("frame") - F.min("frame") + 1
    return steps(points, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"),
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        span.alias("frame_span"),
        (F.count(F.lit(1)) / span).alias("coverage"),
        F.coalesce(F.max(F.col("gap") - 1), F.lit(0)).alias("max_missing"),
    )


def aligned(points: DataFrame, frame_interval: float = 1.0, by: tuple[str, ...] = TRACK) -> DataFrame:
    """Adds displacement from the first point, distance from it, median-centred coordinates, elapsed time and the share of the track's time that has passed."""
    w = Window.partitionBy(*by).orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x0, y0 = F.first("x").over(w), F.first("y").over(w)
    first, last = F.min("frame").over(w), F.max("frame").over(w)
    every = Window.partitionBy(*by)
    return points.withColumns(
        {
            "from_start": F.sqrt((F.col("x") - x0) * (F.col("x") - x0) + (F.col("y") - y0) * (F.col("y") - y0)),
            "x_centred": F.col("x") - F.median("x").over(every),
            "y_centred": F.col("y") - F.median("y").over(every),
            "elapsed": (F.col("frame") - 1) * frame_interval,
            "time_share": (F.col("frame") - first) / F.greatest(last - first, F.lit(1)),
        }
    )


def turned(moved: DataFrame, theta: float, by: tuple[str, ...] = TRACK) -> DataFrame:
    """Steps rotated by `theta`, and the steps of the track run backwards (order reversed, signs flipped)."""
    c, s = F.cos(F.lit(theta)), F.sin(F.lit(theta))
    back = Window.partitionBy(*by).orderBy(F.desc("frame"))
    return moved.where("dx IS NOT NULL").select(
        *by,
        "frame",
        (F.col("dx") * c - F.col("dy") * s).alias("rotated_dx"),
        (F.col("dx") * s + F.col("dy") * c).alias("rotated_dy"),
        F.row_number().over(back).alias("reversed_no"),
        (-F.col("dx")).alias("reversed_dx"),
        (-F.col("dy")).alias("reversed_dy"),
    )


def islands(points: DataFrame, by: tuple[str, ...], least_span: int) -> DataFrame:
    """Blocks of frames without an empty frame between them: block number, first and last frame, detections; blocks that span fewer than `least_span` frames go."""
    frames = points.groupBy(*by, "frame").agg(F.count(F.lit(1)).alias("detections"))
    w = Window.partitionBy(*by).orderBy("frame")
    starts = F.when(F.col("frame") - F.lag("frame").over(w) == 1, 0).otherwise(1)
    numbered = frames.withColumn("starts", starts).withColumn("block", F.sum("starts").over(w))
    blocks = numbered.groupBy(*by, "block").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.sum("detections").alias("detections"))
    return blocks.where(F.col("last_frame") - F.col("first_frame") + 1 >= least_span)


def step_sequences(kept: DataFrame, length: int = 29, by: tuple[str, ...] = TRACK) -> DataFrame:
    """One row for each track from what `consecutive_steps` returns: `cartesian` (dx, dy), `polar` (size, signed angle to
    the step before, 0 at first) and `combined` (both), each padded with zeros to `length`, and n_steps, below which an
    entry is real."""
    w = Window.partitionBy(*by).orderBy("step_no")
    bx, by_ = F.lag("dx").over(w), F.lag("dy").over(w)
    angle = F.coalesce(F.atan2(bx * F.col("dy") - by_ * F.col("dx"), bx * F.col("dx") + by_ * F.col("dy")), F.lit(0.0))
    rows = kept.withColumn("angle", angle)
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    entry = F.struct("step_no", F.array(F.col("dx"), F.col("dy"), size, F.col("angle")).alias("v"))
    lists = rows.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n_steps"), F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["v"]).alias("v"))
    padded = F.concat("v", F.array_repeat(F.array_repeat(F.lit(0.0), 4), F.greatest(F.lit(0), F.lit(length) - F.col("n_steps"))))
    take = lambda *at: F.transform(padded, lambda e: F.array(*[e[k].cast("float") for k in at]))
    return lists.select(*by, "n_steps", take(0, 1).alias("cartesian"), take(2, 3).alias("polar"), take(0, 1, 2, 3).alias("combined"))


def summary(points: DataFrame, by: tuple[str, ...] = TRACK) -> DataFrame:
    """For each track its points, first and last frame and place, and the net and largest displacement from its start."""
    w = Window.partitionBy(*by).orderBy("frame")
    dx, dy = F.col("x") - F.first("x").over(w), F.col("y") - F.first("y").over(w)
    return points.withColumn("away", F.sqrt(dx * dx + dy * dy)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"),
        F.min("frame").alias("frame_start"),
        F.max("frame").alias("frame_end"),
        F.min_by("x", "frame").alias("start_x"),
        F.min_by("y", "frame").alias("start_y"),
        F.max_by("x", "frame").alias("end_x"),
        F.max_by("y", "frame").alias("end_y"),
        F.max_by("away", "frame").alias("net_displacement"),
        F.max("away").alias("max_displacement"),
    )
