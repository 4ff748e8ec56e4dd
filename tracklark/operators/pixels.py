"""Operators on pixel tables (object columns, y, x, v) and on planes (one row for each image).

Masks are the pixel rows themselves; set operations on masks are set operations on rows. Neighbourhoods are made by
exploding offsets and joining on the place, which is an equi-join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from math import pi

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklark.functions import kernels
from tracklark.operators.linking import spread

OBJECT = ("img",)
#: Windows of spots that are fitted together.
WINDOWS = 2048


def offsets(reach: int, keep: Callable[[int, int], bool] = lambda dy, dx: True) -> Column:
    """The (dy, dx) of a neighbourhood, to explode."""
    near = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if keep(a, b)]
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in near]))


def shifted(pixels: DataFrame, near: Column, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """Every place that lies at one of the offsets from a pixel, once."""
    return pixels.select(*by, "y", "x", near.alias("o")).select(*by, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()


def dilated(mask: DataFrame, rounds: int, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """All places within `rounds` city blocks of the mask."""
    return shifted(mask, offsets(rounds, lambda a, b: abs(a) + abs(b) <= rounds), by)


def boundary(mask: DataFrame, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """Mask pixels with a four-neighbour outside the mask."""
    near = mask.select(*by, "y", "x", offsets(1, lambda a, b: abs(a) + abs(b) == 1).alias("o"))
    there = mask.select(*by, F.col("y").alias("ny"), F.col("x").alias("nx"), F.lit(1).alias("there"))
    pairs = near.select(*by, "y", "x", (F.col("y") + F.col("o.dy")).alias("ny"), (F.col("x") + F.col("o.dx")).alias("nx")).join(there, [*by, "ny", "nx"], "left")
    return pairs.where(F.col("there").isNull()).select(*by, "y", "x").distinct()


def morphology(mask: DataFrame, um_per_px: float = 1.0, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """Area, centroid, box, crack-length perimeter, circularity, and axes, eccentricity and orientation from moments."""
    right, down = mask.select(*by, "y", (F.col("x") + 1).alias("x"), F.lit(1).alias("r")), mask.select(*by, (F.col("y") + 1).alias("y"), "x", F.lit(1).alias("d"))
    found = mask.select(*by, "y", "x").join(right, [*by, "y", "x"], "left").join(down, [*by, "y", "x"], "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("area"),
        F.avg("y").alias("cy"),
        F.avg("x").alias("cx"),
        F.min("y").alias("r0"),
        (F.max("y") + 1).alias("r1"),
        F.min("x").alias("c0"),
        (F.max("x") + 1).alias("c1"),
        (4 * F.count(F.lit(1)) - 2 * (F.count("r") + F.count("d"))).alias("perimeter"),
        (F.var_pop("x") + 1 / 12).alias("mxx"),
        (F.var_pop("y") + 1 / 12).alias("myy"),
        F.covar_pop("x", "y").alias("mxy"),
    )
    root = F.sqrt(4 * F.col("mxy") * F.col("mxy") + (F.col("mxx") - F.col("myy")) * (F.col("mxx") - F.col("myy")))
    large, small = (F.col("mxx") + F.col("myy") + root) / 2, F.greatest(F.lit(0.0), (F.col("mxx") + F.col("myy") - root) / 2)
    return found.withColumns(
        {
            "area_um2": F.col("area") * um_per_px * um_per_px,
            "circularity": F.least(F.lit(1.0), F.try_divide(4 * pi * F.col("area"), F.col("perimeter") * F.col("perimeter"))),
            "major_axis": 4 * F.sqrt(large),
            "minor_axis": 4 * F.sqrt(small),
            "eccentricity": F.sqrt(F.greatest(F.lit(0.0), 1 - F.try_divide(small, large))),
            # Rounded, as the sign of a difference that is only noise would turn the axis by a right angle.
            "orientation_deg": F.degrees(F.atan2(2 * F.round("mxy", 9) + 0.0, F.round(F.col("mxx") - F.col("myy"), 9))) / 2,
        }
    ).drop("mxx", "myy", "mxy")


def intensity(pixels: DataFrame, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """Mean, population deviation, median, skewness and excess kurtosis (biased) of the pixel values."""
    return pixels.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.median("v").alias("median"), F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"))


def local_windows(places: DataFrame, pixels: DataFrame, reach: int = 5, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """Statistics of the pixels within `reach` of each place (py, px) and their ratio to the object's mean."""
    spread = places.select(*by, "py", "px", offsets(reach).alias("o")).select(*by, "py", "px", (F.col("py") + F.col("o.dy")).alias("y"), (F.col("px") + F.col("o.dx")).alias("x"))
    near = spread.join(pixels, [*by, "y", "x"]).groupBy(*by, "py", "px").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("local_mean"), F.stddev_pop("v").alias("local_std"), F.max("v").alias("local_max"))
    whole = pixels.groupBy(*by).agg(F.avg("v").alias("object_mean"))
    return near.join(whole, list(by)).withColumn("local_ratio", F.try_divide("local_mean", "object_mean")).drop("object_mean")


def otsu(pixels: DataFrame, bins: int = 256, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """The Otsu threshold of each image: the middle of the bin with the largest variance between classes, first of ties."""
    ends = pixels.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    bin_ = F.least(F.floor(F.try_divide(F.col("v") - F.col("low"), width)), F.lit(bins - 1))
    counted = pixels.join(ends, list(by)).where("high > low").withColumns({"bin": bin_, "mid": F.col("low") + (bin_ + 0.5) * width}).groupBy(*by, "bin", "mid").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*by).orderBy("bin")
    every = Window.partitionBy(*by)
    sums = counted.withColumns({"below": F.sum("n").over(upto), "s": F.sum(F.col("n") * F.col("mid")).over(upto), "all": F.sum("n").over(every), "t": F.sum(F.col("n") * F.col("mid")).over(every)})
    above = F.col("all") - F.col("below")
    apart = F.col("s") / F.col("below") - F.try_divide(F.col("t") - F.col("s"), above)
    return sums.withColumn("between", F.coalesce(F.col("below") * above * apart * apart, F.lit(-1.0))).groupBy(*by).agg(F.max_by("mid", F.struct(F.round("between", 6), -F.col("bin"))).alias("threshold"))


def object_numbers(keys: pa.Table) -> np.ndarray:
    """Numbers from 0 of sorted objects, given the columns that name them."""
    new = np.zeros(max(keys.num_rows - 1, 0), bool)
    for column in keys.columns:
        after, before = column[1:], column[:-1]
        new |= pc.coalesce(pc.not_equal(after, before), pc.xor(pc.is_null(after), pc.is_null(before))).to_numpy()
    return np.append(0, np.cumsum(new))


def components(mask: DataFrame, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """Four-neighbour components of masks: by, y, x and the component's first pixel (cy, cx) in raster order.

    Objects are dealt out once and stream by in order; all that a batch completes are labelled together, as a call for
    each would take longer than its pixels. A task holds one object and a batch.
    """
    rows = mask.select(*by, "y", "x")

    def named(held: pa.Table) -> Iterator[pa.RecordBatch]:
        y, x = (held.column(c).to_numpy() for c in ("y", "x"))
        first = pa.array(kernels.first_pixels(y, x, object_numbers(held.select(by))))
        for c in ("y", "x"):
            held = held.append_column(f"c{c}", held.column(c).take(first))
        yield from held.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            seam = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            number = object_numbers(pa.Table.from_batches([*seam, batch]).select(by))[len(seam) :]
            # Rows before `last` belong to objects that are complete.
            last = int(np.searchsorted(number, number[-1]))
            if held and number[-1]:
                yield from named(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif last:
                yield from named(pa.Table.from_batches([batch.slice(0, last)]))
            held.append(batch.slice(last))
        if held:
            yield from named(pa.Table.from_batches(held))

    return spread(rows, *by).sortWithinPartitions(*by).mapInArrow(run, rows.selectExpr("*", "y AS cy", "x AS cx").schema)


def least_squares_at(sites: np.ndarray, heights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For whole numbers `at`, the least of (at - site)^2 + height over the rising sites: the lower envelope of parabolas,
    in steps in proportion to both."""
    kept, edges = [], []  # edges[k] parts kept[k] from the next
    place, top = sites.tolist(), (heights + sites * sites).tolist()
    for k, x in enumerate(place):
        while kept:
            meets = (top[k] - top[kept[-1]]) / (2 * (x - place[kept[-1]]))
            if not edges or meets > edges[-1]:
                edges.append(meets)
                break
            kept.pop()
            edges.pop()
        kept.append(k)
    own = np.array(kept)[np.searchsorted(edges, at)]
    return (at - sites[own]) ** 2 + heights[own]


def edge_distance(mask: DataFrame, background: DataFrame, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """Distance of each mask pixel to the nearest background pixel, in two passes: along columns by windows, then along
    rows, whose pixels go to numpy as lists and take the lower envelope of their columns' distances. Both passes take
    steps in proportion to the pixels. Mask and background together have to cover the object's box; objects without
    background have no distances."""
    flat = mask.select(*by, "y", "x", F.lit(True).alias("inner")).unionByName(background.select(*by, "y", "x", F.lit(False).alias("inner")))
    column = Window.partitionBy(*by, "x").orderBy("y")
    at = F.when(~F.col("inner"), F.col("y"))
    above = F.last(at, True).over(column.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    below = F.first(at, True).over(column.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    away = flat.withColumn("dy", F.least(F.col("y") - above, below - F.col("y")).cast("long"))

    @F.pandas_udf("array<double>")
    def nearest(xs: pd.Series, dys: pd.Series, inners: pd.Series) -> pd.Series:
        out = []
        for x, dy, inner in zip(xs, dys, inners, strict=True):
            x, dy, inner = np.asarray(x, np.int64), np.asarray(dy, float), np.asarray(inner, bool)
            known = ~np.isnan(dy)
            # The list is sorted, so the first of a place has its least height.
            sites, first = np.unique(x[known], return_index=True)
            heights = dy[known][first].astype(np.int64) ** 2
            out.append(np.sqrt(least_squares_at(sites, heights, x[inner])) if len(sites) and inner.any() else np.zeros(0))
        return pd.Series(out)

    rows = away.groupBy(*by, "y").agg(F.array_sort(F.collect_set(F.struct("x", "dy", "inner"))).alias("row"))
    xs = F.transform(F.filter("row", lambda p: p["inner"]), lambda p: p["x"])
    found = rows.select(*by, "y", xs.alias("x"), nearest("row.x", "row.dy", "row.inner").alias("distance"))
    pairs = found.where(F.size("x") == F.size("distance")).select(*by, "y", F.explode(F.arrays_zip("x", "distance")).alias("p"))
    return pairs.select(*by, "y", "p.x", "p.distance")


def locus_distances(loci: DataFrame, mask: DataFrame, background: DataFrame, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """For loci (by, locus, py, px): distance to the membrane (negative outside), to the centroid, and the radial
    position, 1 at the centroid and 0 at or beyond the membrane; null out of the image."""
    inner = edge_distance(mask, background, by).withColumnsRenamed({"y": "py", "x": "px"})
    outer = edge_distance(background, mask, by).select(*by, F.col("y").alias("py"), F.col("x").alias("px"), (-F.col("distance")).alias("distance"))
    centre = mask.groupBy(*by).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    rows = loci.join(inner.unionByName(outer), [*by, "py", "px"], "left").join(centre, list(by), "left")
    dy, dx = F.col("py") - F.col("cy"), F.col("px") - F.col("cx")
    rows = rows.withColumn("to_centroid", F.when(F.col("distance").isNotNull(), F.sqrt(dy * dy + dx * dx)))
    radial = F.when(F.col("distance") > 0, F.col("distance") / (F.col("distance") + F.col("to_centroid"))).when(F.col("distance").isNotNull(), 0.0)
    return rows.select(*by, "locus", "py", "px", F.col("distance").alias("to_membrane"), "to_centroid", radial.alias("radial"))


def crop_quality(pixels: DataFrame, mask: DataFrame, rounds: int = 6, least_ring: int = 25, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """Median inside, median of a ring around (all outside if the ring is small), contrast, and median gradient on the boundary."""
    row, column = Window.partitionBy(*by, "y").orderBy("x"), Window.partitionBy(*by, "x").orderBy("y")

    def slope(w):
        before, after, own = F.lag("v").over(w), F.lead("v").over(w), F.col("v")
        return F.coalesce((after - before) / 2, after - own, own - before, F.lit(0.0))

    steep = pixels.withColumns({"gx": slope(row), "gy": slope(column)}).withColumn("g", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    flag = lambda some, name: some.select(*by, "y", "x", F.lit(True).alias(name))
    marked = steep.join(flag(mask, "m"), [*by, "y", "x"], "left").join(flag(dilated(mask, rounds, by), "wide"), [*by, "y", "x"], "left").join(flag(boundary(mask, by), "edge"), [*by, "y", "x"], "left")
    outside = F.col("m").isNull()
    found = marked.groupBy(*by).agg(
        F.median(F.when(F.col("m"), F.col("v"))).alias("inside"),
        F.when(F.count_if(outside & F.col("wide").isNotNull()) >= least_ring, F.median(F.when(outside & F.col("wide"), F.col("v")))).otherwise(F.median(F.when(outside, F.col("v")))).alias("ring"),
        F.median(F.when(F.col("edge"), F.col("g"))).alias("boundary_gradient"),
    )
    return found.withColumn("contrast", F.try_divide(F.col("inside") - F.col("ring"), F.abs("ring")))


def line(y0: int, x0: int, y1: int, x1: int) -> list[tuple[int, int]]:
    """Pixels of a straight line between two places, both included."""
    n = max(abs(y1 - y0), abs(x1 - x0), 1)
    return [(round(y0 + (y1 - y0) * k / n), round(x0 + (x1 - x0) * k / n)) for k in range(n + 1)]


def static_roi(points: DataFrame, support: DataFrame, rounds: int = 5, by: tuple[str, ...] = OBJECT, connected: bool = True) -> DataFrame:
    """Pixels within `rounds` city blocks of the path through a track's points (y, x, by frame) that lie in the support.
    A ROI that the support cuts into several components is an error once it is read, unless `connected` is false.

    A support without the columns `by` is one plane that all tracks share. Tracks are dealt out once, by `by`: few bytes
    in, but many pixels each.
    """
    from tracklark.operators.regions import require_connected

    if rounds < 5:
        raise ValueError("a static ROI needs a dilation of 5 or more")
    w = Window.partitionBy(*by).orderBy("frame")
    ends = spread(points.select(*by, "frame", F.bround("y").cast("int").alias("y"), F.bround("x").cast("int").alias("x")), *by)
    ends = ends.withColumns({"y0": F.coalesce(F.lag("y").over(w), "y"), "x0": F.coalesce(F.lag("x").over(w), "x")})
    n = F.greatest(F.abs(F.col("y") - F.col("y0")), F.abs(F.col("x") - F.col("x0")), F.lit(1))
    cut = ends.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda a, b: F.bround(F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("n")).cast("int")
    path = cut.select(*by, at("y0", "y").alias("y"), at("x0", "x").alias("x")).distinct()
    on = [*(c for c in by if c in support.columns), "y", "x"]
    roi = dilated(path, rounds, by).join(support.select(*on), on, "left_semi")
    return require_connected(roi, by) if connected else roi


def projected(planes: DataFrame, by: tuple[str, ...] = OBJECT) -> DataFrame:
    """Mean over time and largest value for each place, and the value stretched between two percentiles to 0..255."""
    flat = planes.groupBy(*by, "y", "x").agg(F.avg("v").alias("mean_v"), F.max("v").alias("max_v"))
    ends = flat.groupBy(*by).agg(F.percentile("max_v", F.lit(0.01)).alias("low"), F.percentile("max_v", F.lit(0.997)).alias("high"))
    share = F.try_divide(F.col("max_v") - F.col("low"), F.col("high") - F.col("low"))
    return flat.join(ends, list(by)).withColumn("u8", F.floor(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0))))).cast("int")).drop("low", "high")


def scaffold(spark, frames: int, height: int, width: int, value: int = 1, zeros: tuple[int, int] | None = None) -> DataFrame:
    """A synthetic stack in which every pixel has one value, but for a grid of zeros (margin, spacing) if there is one."""
    at = lambda c, n: (F.col(c) >= zeros[0]) & (F.col(c) < max(zeros[0], n - zeros[0])) & ((F.col(c) - zeros[0]) % zeros[1] == 0)
    whole = spark.range(frames * height * width).withColumn("place", F.col("id") % (height * width))
    return whole.select(F.floor(F.col("id") / (height * width)).cast("int").alias("t"), F.floor(F.col("place") / width).cast("int").alias("y"), (F.col("place") % width).cast("int").alias("x")).withColumn(
        "v", F.when(at("y", height) & at("x", width), 0).otherwise(value) if zeros else F.lit(value)
    )


def overlaps(masks: DataFrame, by: tuple[str, ...] = ("fov",)) -> DataFrame:
    """Pairs a < b of masks (by, obj, y, x) that share pixels, with the shared number, IoU and containment."""
    size = masks.groupBy(*by, "obj").agg(F.count(F.lit(1)).alias("size"))
    other = masks.select(*by, "y", "x", F.col("obj").alias("b"))
    shared = masks.withColumnRenamed("obj", "a").join(other, [*by, "y", "x"]).where("a < b").groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    sized = shared.join(size.withColumnsRenamed({"obj": "a", "size": "a_size"}), [*by, "a"]).join(size.withColumnsRenamed({"obj": "b", "size": "b_size"}), [*by, "b"])
    union = F.col("a_size") + F.col("b_size") - F.col("shared")
    return sized.withColumns({"iou": F.col("shared") / union, "containment": F.col("shared") / F.least("a_size", "b_size")})


def deduplicated_masks(masks: DataFrame, iou: float = 0.3, containment: float = 0.5, by: tuple[str, ...] = ("fov",)) -> DataFrame:
    """Objects kept, largest first, unless they overlap one already kept too much. The pairs come from a join; the fold
    over one field of view's objects and pairs is sequential."""
    size = masks.groupBy(*by, "obj").agg(F.count(F.lit(1)).alias("size"))
    pairs = overlaps(masks, by).where((F.col("iou") > iou) | (F.col("containment") > containment))
    both = pairs.select(*by, "a", "b").union(pairs.select(*by, "b", "a")).groupBy(*by, F.col("a").alias("obj")).agg(F.collect_list("b").alias("rivals"))
    rows = size.join(both, [*by, "obj"], "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: set = set()
        for row in pdf.sort_values(["size", "obj"], ascending=[False, True]).itertuples():
            if row.rivals is None or not kept.intersection(row.rivals):
                kept.add(row.obj)
        return pdf[pdf.obj.isin(kept)].drop(columns="rivals")

    return rows.groupBy(*by).applyInPandas(fold, size.schema)


def solidity(mask: np.ndarray) -> float:
    """Pixels over the area of the convex hull of their corners."""
    from tracklark.operators.features import hull_area

    y, x = np.nonzero(mask)
    corners = np.concatenate([np.stack([x + a, y + b], axis=1) for a in (0, 1) for b in (0, 1)]).astype(float)
    return len(y) / (hull_area(corners) or np.inf)


def adjacent(key: np.ndarray, obj: np.ndarray, steps: list[int]) -> np.ndarray:
    """Pairs of objects (a < b) of which pixels lie a step apart. key: a number for each pixel, obj: its object."""
    order = np.argsort(key, kind="stable")
    at, own = key[order], obj[order]
    found = []
    for step in steps:
        low, high = np.searchsorted(at, key + step, "left"), np.searchsorted(at, key + step, "right")
        n = high - low
        first = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        pairs = np.stack([np.repeat(obj, n), own[first]], axis=1)
        found.append(np.unique(pairs[pairs[:, 0] < pairs[:, 1]], axis=0))
    return np.unique(np.concatenate(found), axis=0)


def merged_masks(masks: DataFrame, most_area: int, near: int = 2, least_solidity: float = 0.6, by: tuple[str, ...] = ("fov",), square: bool = False) -> DataFrame:
    """Pixels with merged objects: again and again the first two objects within `near` city blocks (with `square`, within
    `near` pixels in all eight directions) merge if the union is not too large and solid enough.

    One field of view at a time. Its objects are the nodes of a graph that one join of pixels gives; pairs wait in a queue
    in order, and a merge only brings back the pairs of the two that merged, whose hulls and pixels are joined. A pair
    that failed fails until one of its objects changes, so this is the same as starting again after each merge.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        from tracklark.operators.features import hull_area, hull_ring

        y0, x0 = pdf.y.min(), pdf.x.min()
        width = int(pdf.x.max() - x0) + 1 + 2 * near
        key = (pdf.y.to_numpy(np.int64) - y0) * width + pdf.x.to_numpy(np.int64) - x0
        names, obj = np.unique(pdf.obj.to_numpy(), return_inverse=True)
        around = [(a, b) for a in range(-near, near + 1) for b in range(-near, near + 1) if square or abs(a) + abs(b) <= near]
        order = np.argsort(obj, kind="stable")
        edges = np.searchsorted(obj[order], np.arange(len(names) + 1))
        pixels = [np.unique(key[order[a:b]]) for a, b in zip(edges, edges[1:])]
        ring = [hull_ring([(float(k % width + a), float(k // width + b)) for k in own.tolist() for a in (0, 1) for b in (0, 1)]) for own in pixels]
        pairs = [(int(a), int(b)) for a, b in adjacent(key, obj, [a * width + b for a, b in around])]
        beside: list[set[int]] = [set() for _ in names]
        for a, b in pairs:
            beside[a].add(b)
            beside[b].add(a)
        # Sorted pairs are a heap; the third and fourth number tell whether an object has changed since.
        heap, changes, gone = [(a, b, 0, 0) for a, b in pairs], [0] * len(names), [False] * len(names)
        while heap:
            a, b, before_a, before_b = heappop(heap)
            if gone[a] or gone[b] or changes[a] != before_a or changes[b] != before_b:
                continue
            if max(len(pixels[a]), len(pixels[b])) > most_area:
                continue
            union = np.union1d(pixels[a], pixels[b])
            hull = hull_ring([*ring[a], *ring[b]])
            if len(union) > most_area or len(union) / (hull_area(np.array(hull)) or np.inf) < least_solidity:
                continue
            pixels[a], ring[a], gone[b] = union, hull, True
            changes[a] += 1
            beside[a] = {c for c in beside[a] | beside[b] if c not in (a, b) and not gone[c]}
            for c in beside[a]:
                beside[c].discard(b)
                beside[c].add(a)
                heappush(heap, (min(a, c), max(a, c), changes[min(a, c)], changes[max(a, c)]))
        left = [k for k in range(len(names)) if not gone[k]]
        whole = np.concatenate([pixels[k] for k in left])
        out = pd.DataFrame({"obj": np.repeat(names[left], [len(pixels[k]) for k in left]), "y": whole // width + y0, "x": whole % width + x0})
        return out.assign(**{c: pdf[c].iloc[0] for c in by})[[*by, "obj", "y", "x"]]

    rows = masks.select(*by, "obj", "y", "x")
    return rows.groupBy(*by).applyInPandas(fold, rows.schema)


#: Spark's setting for the bytes of a batch that it sends to Python, and the bound for planes: both sides hold it whole.
SENT, MOST_SENT = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def per_plane(planes: DataFrame, kernel: Callable[..., list[tuple]], schema: str, keys: tuple[str, ...] = ("stack_id", "t"), extra: tuple[str, ...] = (), finish: Callable[[list[tuple]], list[tuple]] = list) -> DataFrame:
    """Apply a numpy kernel to each plane (keys, h, w, px: little-endian doubles) and what its columns `extra` hold;
    planes stream through in batches, of at most `MOST_SENT` bytes in this session from then on. `finish` turns a batch's rows (keys, what the kernel found) into the result's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows = [(*(getattr(r, k) for k in keys), *found) for r in batch.itertuples() for found in kernel(np.frombuffer(r.px, "<f8").reshape(r.h, r.w), *(getattr(r, c) for c in extra))]
            yield pd.DataFrame(finish(rows), columns=[*keys, *names])

    planes.sparkSession.conf.set(SENT, str(MOST_SENT))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in planes.select(*keys).schema)
    return planes.select(*keys, "h", "w", "px", *extra).mapInPandas(run, f"{kinds}, {schema}")


def first_levels(planes: DataFrame, noise: float = 1.0, size: int = 2) -> DataFrame:
    """stack_id and level: mean plus half a deviation of the values above zero of each stack's first filtered plane."""

    def kernel(image: np.ndarray) -> list[tuple]:
        clean = kernels.bandpass(image, noise, size)
        lit = clean[clean > 0]
        return [(float(lit.mean() + 0.5 * lit.std(ddof=1)) if len(lit) > 1 else None,)]

    first = planes.groupBy("stack_id").agg(F.min_by(F.struct("t", "h", "w", "px"), "t").alias("p")).select("stack_id", "p.*")
    return per_plane(first, kernel, "level double").drop("t")


def spots(planes: DataFrame, noise: float = 1.0, size: int = 2, threshold: float | None = None) -> DataFrame:
    """Sub-pixel spots of each plane: band-pass, peaks above the threshold, fitted centres and the sum of the window.

    Without a threshold a plane's column `level` counts, if there is one (see `first_levels`), else mean plus half a
    deviation of its filtered values that aren't zero. With a column `gate` (a byte for each pixel) only peaks on pixels
    that aren't 0 count.
    """
    extra = tuple(c for c in ("level", "gate") if c in planes.columns)

    def kernel(image: np.ndarray, *more) -> list[tuple]:
        own = dict(zip(extra, more, strict=True))
        clean = kernels.bandpass(image, noise, size)
        lit = clean[clean > 0]
        level = threshold if threshold is not None else own.get("level") if "level" in own else (lit.mean() + 0.5 * lit.std() if len(lit) else np.inf)
        if level is None or np.isnan(level):
            return []
        region = np.frombuffer(own["gate"], np.uint8).reshape(image.shape) > 0 if own.get("gate") is not None else None
        out = []
        for y, x in kernels.peaks(clean, level, size, region):
            box = slice(y - size, y + size + 1), slice(x - size, x + size + 1)
            out.append((y - size, x - size, float(clean[box].sum()), image[box]))
        return out

    def fits(rows: list[tuple]) -> list[tuple]:
        """The batch's windows are fitted side by side, up to so many that their slopes stay small."""
        out = []
        for k in range(0, len(rows), WINDOWS):
            some = rows[k : k + WINDOWS]
            found = kernels.centres(np.stack([r[-1] for r in some]))
            out += [(*r[:-4], r[-4] + cy, r[-3] + cx, r[-2], fitted) for r, cy, cx, fitted in zip(some, *(c.tolist() for c in found), strict=True)]
        return out

    return per_plane(planes, kernel, "y double, x double, mass double, fitted boolean", extra=extra, finish=fits)


def nuclei(planes: DataFrame) -> DataFrame:
    """Area and centroid of the nucleus of each plane that has one."""

    def kernel(image: np.ndarray) -> list[tuple]:
        mask = kernels.nucleus(image)
        if mask is None or not mask.any():
            return []
        y, x = np.nonzero(mask)
        return [(len(y), float(y.mean()), float(x.mean()))]

    return per_plane(planes, kernel, "area long, cy double, cx double")


def drift(planes: DataFrame, reference: np.ndarray, upsample: int = 20) -> DataFrame:
    """Shift of each plane to the reference plane, and the correlation after moving it. The reference is one plane."""

    def kernel(image: np.ndarray) -> list[tuple]:
        dy, dx = kernels.shift(reference, image, upsample)
        fixed = kernels.moved(image, dy, dx)
        flat = fixed.std() == 0 or reference.std() == 0
        return [(dy, dx, None if flat else float(np.corrcoef(fixed.ravel(), reference.ravel())[0, 1]))]

    return per_plane(planes, kernel, "shift_y double, shift_x double, correlation double")


def bright_spots(planes: DataFrame, base: float = 1.0, large: int = 120, least: int = 10) -> DataFrame:
    """Bright components of each plane, large ones split at higher levels. Their centres have to lie in the plane's
    nucleus, if it has one."""

    def kernel(image: np.ndarray) -> list[tuple]:
        region = kernels.nucleus(image)
        return kernels.split_clusters(image, np.ones(image.shape, bool) if region is None else region, base, large, least)

    return per_plane(planes, kernel, "y double, x double, level double")


def split_masks(masks: DataFrame, sigma: float = 2.0, apart: int = 10, least: int = 1, least_circularity: float = 0.0, by: tuple[str, ...] = ("fov", "obj")) -> DataFrame:
    """Pixels of each object with the number of the part they belong to after a split at its waist (1 if there is none)."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf.y.to_numpy() - pdf.y.min(), pdf.x.to_numpy() - pdf.x.min()
        mask = np.zeros((y.max() + 1, x.max() + 1), bool)
        mask[y, x] = True
        part = np.zeros(mask.shape, int)
        for k, own in enumerate(kernels.split_at_waist(mask, sigma, apart, least, least_circularity), 1):
            part[own] = k
        return pdf.assign(part=part[y, x])

    rows = masks.select(*by, "y", "x")
    return rows.groupBy(*by).applyInPandas(cut, rows.selectExpr("*", "0 AS part").schema)
