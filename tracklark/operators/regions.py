"""Points, loci and objects against masks: membership, border rules, crops, valid pixels, signal clusters.

Masks are pixel rows (object columns, y, x); a frame without a mask has no rows. Only labels and hulls leave the plan:
places meet masks in equi-joins on the rounded place, and boxes are exploded to their pixels before they meet the image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklark.operators.features import hulls
from tracklark.operators.pixels import OBJECT, boundary, components, offsets, shifted
from tracklark.operators.spatial import dealt

# The share of the upper quartile below which border pixels are fill, and the size and number of clusters.
FILL_SHARE, LEAST_CLUSTER, MOST_CLUSTERS = 0.85, 10, 5


def place(column: str) -> Column:
    """The pixel that a coordinate falls on, halves to the even one; null if it is none."""
    return F.bround(column).try_cast("int")


def with_inside(points: DataFrame, mask: DataFrame, by: tuple[str, ...] = OBJECT, name: str = "inside") -> DataFrame:
    """Adds whether a point's (y, x) pixel belongs to the mask of its object; places out of the image do not.

    A mask without some of the columns `by` is shared by all objects.
    """
    on = [*(c for c in by if c in mask.columns), "mask_y", "mask_x"]
    there = mask.withColumnsRenamed({"y": "mask_y", "x": "mask_x"}).select(*on).distinct().withColumn(name, F.lit(True))
    found = points.withColumns({"mask_y": place("y"), "mask_x": place("x")}).join(there, on, "left")
    return found.withColumn(name, F.coalesce(name, F.lit(False))).drop("mask_y", "mask_x")


def on_mask_frames(loci: DataFrame, frames: DataFrame, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """Rows of loci (frames from 1) with what belongs to their mask frame (frame_0idx, from 0); rows without a mask go."""
    return loci.withColumn("frame_0idx", F.col("frame") - 1).join(frames, [*by, "frame_0idx"])


def border_distance(masks: DataFrame, height: int, width: int, by: tuple[str, ...] = ("fov", "obj")) -> DataFrame:
    """Pixels between each object and the nearest border of its image."""
    nearest = F.least(F.min("y"), F.min("x"), height - 1 - F.max("y"), width - 1 - F.max("x"))
    return masks.groupBy(*by).agg(nearest.alias("edge_dist"))


def off_border(masks: DataFrame, height: int, width: int, margin: int, by: tuple[str, ...] = ("fov", "obj")) -> DataFrame:
    """Pixels of the objects that are more than `margin` pixels away from the border; all with a negative margin."""
    if margin < 0:
        return masks
    kept = border_distance(masks, height, width, by).where(F.col("edge_dist") > margin)
    return masks.join(kept.select(*by), list(by), "left_semi")


def crop_boxes(masks: DataFrame, height: int, width: int, margin: int, by: tuple[str, ...] = ("fov",)) -> DataFrame:
    """The box of each object and a margin around it, cut at the image's borders; ends are exclusive."""
    return masks.groupBy(*by, "obj").agg(
        F.greatest(F.lit(0), F.min("y") - margin).alias("r0"),
        F.least(F.lit(height), F.max("y") + margin + 1).alias("r1"),
        F.greatest(F.lit(0), F.min("x") - margin).alias("c0"),
        F.least(F.lit(width), F.max("x") + margin + 1).alias("c1"),
    )


def crops(pixels: DataFrame, masks: DataFrame, height: int, width: int, margin: int, by: tuple[str, ...] = ("fov",)) -> DataFrame:
    """The pixels (by, obj, y, x, v) of each object's box; pixels that another object covers are 0."""
    boxes = crop_boxes(masks, height, width, margin, by)
    rows = boxes.withColumn("y", F.explode(F.sequence("r0", F.col("r1") - 1))).withColumn("x", F.explode(F.sequence("c0", F.col("c1") - 1)))
    covered = masks.groupBy(*by, "y", "x").agg(F.min("obj").alias("low"), F.max("obj").alias("high"))
    # Boxes make far more pixels than they have bytes, so the tasks that sort and join them must not be merged by size.
    found = dealt(rows.select(*by, "obj", "y", "x"), *by, "y", "x").join(pixels, [*by, "y", "x"]).join(covered, [*by, "y", "x"], "left")
    other = (F.col("low") != F.col("obj")) | (F.col("high") != F.col("obj"))
    return found.select(*by, "obj", "y", "x", F.when(F.coalesce(other, F.lit(False)), 0.0).otherwise(F.col("v")).alias("v"))


def eroded(mask: DataFrame, rounds: int, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """Mask pixels whose places within `rounds` city blocks are all in the mask."""
    near = lambda a, b: abs(a) + abs(b) <= rounds
    size = sum(near(a, b) for a in range(-rounds, rounds + 1) for b in range(-rounds, rounds + 1))
    votes = mask.select(*by, "y", "x", offsets(rounds, near).alias("o")).groupBy(*by, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(F.count(F.lit(1)).alias("votes"))
    return votes.where(F.col("votes") == size).select(*by, "y", "x")


def frames_of(mask: DataFrame, margin: int = 1, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """All places of each object's box and a margin around it, with the box's ends (inclusive)."""
    ends = mask.groupBy(*by).agg((F.min("y") - margin).alias("y0"), (F.max("y") + margin).alias("y1"), (F.min("x") - margin).alias("x0"), (F.max("x") + margin).alias("x1"))
    return ends.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1")))


def filled(mask: DataFrame, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """The mask and the background that no path of four-neighbours joins to the outside."""
    around = frames_of(mask, 1, by)
    empty = around.join(mask.select(*by, "y", "x"), [*by, "y", "x"], "left_anti")
    named = components(empty.select(*by, "y", "x"), by)
    # The first pixel of the frame is outside, and the frame's ring joins all that is.
    outside = around.groupBy(*by).agg(F.min("y0").alias("cy"), F.min("x0").alias("cx"))
    holes = named.join(outside, [*by, "cy", "cx"], "left_anti")
    return mask.select(*by, "y", "x").unionByName(holes.select(*by, "y", "x"))


def valid_pixels(pixels: DataFrame, share: float = FILL_SHARE, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """Pixels but for the fill of moved images: dark ones (below a share of the upper quartile) joined to the border."""
    level = pixels.groupBy(*by).agg(F.percentile("v", F.lit(0.75)).alias("upper"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    dark = pixels.join(level, list(by)).where(F.col("v") < F.col("upper") * share)
    named = components(dark.select(*by, "y", "x"), by).join(level, list(by))
    edge = (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1")) | (F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1"))
    fill = named.join(named.where(edge).select(*by, "cy", "cx").distinct(), [*by, "cy", "cx"], "left_semi")
    return pixels.join(fill.select(*by, "y", "x"), [*by, "y", "x"], "left_anti")


def signal_clusters(pixels: DataFrame, k: float, least: int = LEAST_CLUSTER, most: int = MOST_CLUSTERS, share: float = FILL_SHARE, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """The brightest components of valid pixels above mean + k standard deviations: rank, centre weighted by intensity,
    box (inclusive), mean intensity and size. Equal means rank by the first pixel."""
    valid = valid_pixels(pixels, share, by)
    level = valid.groupBy(*by).agg((F.avg("v") + k * F.stddev_pop("v")).alias("level"))
    bright = valid.join(level, list(by)).where(F.col("v") > F.col("level"))
    named = components(bright.select(*by, "y", "x"), by).join(bright, [*by, "y", "x"])
    found = named.groupBy(*by, "cy", "cx").agg(
        F.count(F.lit(1)).alias("size"),
        F.try_divide(F.sum(F.col("v") * F.col("y")), F.sum("v")).alias("centre_y"),
        F.try_divide(F.sum(F.col("v") * F.col("x")), F.sum("v")).alias("centre_x"),
        F.min("y").alias("r0"),
        F.max("y").alias("r1"),
        F.min("x").alias("c0"),
        F.max("x").alias("c1"),
        F.avg("v").alias("intensity"),
    )
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("intensity", 6)), "cy", "cx")
    return found.where(F.col("size") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("cy", "cx")


def box_sums(peaks: DataFrame, pixels: DataFrame, box: int, threshold: float, height: int, width: int, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """Peaks (y, x) off the border whose box of pixels sums to more than the threshold, with the sum."""
    half = box // 2
    inner = (F.col("y") >= half) & (F.col("y") < height - half) & (F.col("x") >= half) & (F.col("x") < width - half)
    spread = peaks.where(inner).select(*by, F.col("y").alias("py"), F.col("x").alias("px"), offsets(half).alias("o"))
    spread = spread.select(*by, "py", "px", (F.col("py") + F.col("o.dy")).alias("y"), (F.col("px") + F.col("o.dx")).alias("x"))
    sums = spread.join(pixels, [*by, "y", "x"]).groupBy(*by, "py", "px").agg(F.sum("v").alias("mass"))
    return sums.where(F.col("mass") > threshold).withColumnsRenamed({"py": "y", "px": "x"})


def first_frame_level(pixels: DataFrame, by: tuple[str, ...] = ("stack_id",)) -> DataFrame:
    """The threshold of each stack: mean plus half a standard deviation of the first frame's values that are not 0."""
    first = pixels.groupBy(*by).agg(F.min("t").alias("t"))
    lit = pixels.where("v <> 0").join(first, [*by, "t"])
    return lit.groupBy(*by).agg((F.avg("v") + 0.5 * F.stddev_samp("v")).alias("level"))


def solidity(mask: DataFrame, by: str = "img") -> DataFrame:
    """Pixels of each object over the area of the convex hull of their corners. Only boundary pixels go into the hull."""
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (0, 1) for b in (0, 1)]))
    corners = shifted(boundary(mask, (by,)), near, (by,))
    points = corners.select(F.col(by).alias("track_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("frame", F.lit(0))
    hull = hulls(points).select(F.col("track_id").alias(by), "hull_area")
    size = mask.groupBy(by).agg(F.count(F.lit(1)).alias("area"))
    return size.join(hull, by).select(by, "area", F.try_divide("area", "hull_area").alias("solidity"))


def one_component(mask: DataFrame, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """For each object the number of its components and whether it is one, as a static ROI has to be."""
    named = components(mask, by)
    return named.groupBy(*by).agg(F.count_distinct("cy", "cx").alias("components")).withColumn("connected", F.col("components") == 1)


def require_connected(mask: DataFrame, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """`mask`, or an error once a row is read whose object has several components."""
    found = one_component(mask, by)
    text = F.concat(F.lit("several components: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in by]))
    return mask.join(found, list(by)).where(F.when(F.col("connected"), F.lit(True)).otherwise(F.raise_error(text))).select(*mask.columns)
