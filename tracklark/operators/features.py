"""Features of tracks, one row for each track."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklark.operators.linking import spread
from tracklark.operators.steps import TRACK, steps, with_angles


def basic(points: DataFrame, by: tuple[str, ...] = TRACK) -> DataFrame:
    """Counts, spread, step sizes, path, net displacement and straightness."""
    ends = F.struct("x", "y")
    found = steps(points, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.var_samp("x").alias("x_variance"),
        F.var_samp("y").alias("y_variance"),
        F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("radius_of_gyration"),
        F.avg("step").alias("mean_step"),
        F.max("step").alias("max_step"),
        F.var_samp("step").alias("step_variance"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length"),
        F.min_by(ends, "frame").alias("head"),
        F.max_by(ends, "frame").alias("tail"),
    )
    dx, dy = F.col("tail.x") - F.col("head.x"), F.col("tail.y") - F.col("head.y")
    net = F.when(F.col("n_frames") > 1, F.sqrt(dx * dx + dy * dy))
    return found.withColumn("net_displacement", net).withColumn("straightness", F.when(F.col("path_length") > 0, F.col("net_displacement") / F.col("path_length"))).drop("head", "tail")


def turning(points: DataFrame, by: tuple[str, ...] = TRACK) -> DataFrame:
    """Mean, variance and median of the unsigned turning angles."""
    return with_angles(steps(points, by), by).groupBy(*by).agg(F.avg("angle").alias("angle_mean"), F.var_samp("angle").alias("angle_variance"), F.median("angle").alias("angle_median"))


def autocorrelation(series: DataFrame, value: str, lags: tuple[int, ...], by: tuple[str, ...] = TRACK) -> DataFrame:
    """Autocorrelation of the not-null values in frame order, by lag; null below 3 values, beyond half their number, or without variation."""
    known = series.where(F.col(value).isNotNull())
    every = Window.partitionBy(*by)
    centred = known.withColumn("c", F.col(value) - F.avg(value).over(every))
    w = Window.partitionBy(*by).orderBy("frame")
    pairs = centred.withColumns({f"c{k}": F.col("c") * F.lead("c", k).over(w) for k in lags})
    found = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"), *[F.sum(f"c{k}").alias(f"s{k}") for k in lags])
    defined = lambda k: (F.col("n") >= 3) & (F.floor(F.col("n") / 2) >= k) & (F.col("own") > 0)
    return found.select(*by, *[F.when(defined(k), F.try_divide(F.col(f"s{k}"), F.col("own"))).alias(f"lag{k}") for k in lags])


def vector_autocorrelation(points: DataFrame, by: tuple[str, ...] = TRACK) -> DataFrame:
    """Mean dot product of neighbouring unit steps, steps without length left out first; null below 3 of them."""
    units = steps(points, by).where("step > 0").select(*by, "frame", (F.col("dx") / F.col("step")).alias("ux"), (F.col("dy") / F.col("step")).alias("uy"))
    w = Window.partitionBy(*by).orderBy("frame")
    dots = units.withColumn("dot", F.col("ux") * F.lag("ux").over(w) + F.col("uy") * F.lag("uy").over(w))
    found = dots.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("dot").alias("dot"))
    return found.select(*by, F.when(F.col("n") >= 3, F.col("dot")).alias("vector_acf_lag1"))


def welch(series: DataFrame, value: str, rate: float = 1.0, by: tuple[str, ...] = TRACK, segment: int = 8) -> DataFrame:
    """Total power, peak frequency and spectral centroid of Welch's density: Hann windows of min(n, segment) values that
    overlap by half, means removed, one-sided. Null below 4 values."""
    w = Window.partitionBy(*by).orderBy("frame")
    every = Window.partitionBy(*by)
    known = series.where(F.col(value).isNotNull()).select(*by, "frame", F.col(value).alias("v"))
    known = known.withColumns({"k": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(every).cast("int")}).where("n >= 4")
    size = F.least("n", F.lit(segment))
    known = known.withColumn("m", size).withColumn("hop", F.col("m") - F.floor(F.col("m") / 2).cast("int"))
    last = F.floor((F.col("n") - F.col("m")) / F.col("hop")).cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.col("k") - F.col("m") + 1) / F.col("hop")).cast("int"))
    final = F.least(last, F.floor(F.col("k") / F.col("hop")).cast("int"))
    cut = known.where(first <= final).withColumn("seg", F.explode(F.sequence(first, final)))
    own = Window.partitionBy(*by, "seg")
    j = F.col("k") - F.col("seg") * F.col("hop")
    hann = 0.5 - 0.5 * F.cos(2 * pi * j / F.col("m"))
    shaped = cut.withColumns({"j": j, "hann": hann, "u": (F.col("v") - F.avg("v").over(own)) * hann})
    turns = shaped.withColumn("bin", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / 2).cast("int"))))
    angle = 2 * pi * F.col("bin") * F.col("j") / F.col("m")
    spectrum = turns.groupBy(*by, "m", "seg", "bin").agg(F.sum(F.col("u") * F.cos(angle)).alias("re"), F.sum(F.col("u") * F.sin(angle)).alias("im"), F.sum(F.col("hann") * F.col("hann")).alias("ww"))
    twice = F.when((F.col("bin") == 0) | (F.col("bin") * 2 == F.col("m")), 1.0).otherwise(2.0)
    density = spectrum.withColumn("p", twice * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (rate * F.col("ww")))
    mean = density.groupBy(*by, "m", "bin").agg(F.avg("p").alias("p")).withColumn("f", F.col("bin") * rate / F.col("m"))
    b = Window.partitionBy(*by).orderBy("bin")
    mean = mean.withColumn("area", (F.col("p") + F.lag("p").over(b)) / 2 * (rate / F.col("m")))
    # Peaks that differ by rounding only count as ties, which go to the lower frequency.
    return mean.groupBy(*by).agg(
        F.sum("area").alias("total_power"),
        F.max_by("f", F.struct(F.round("p", 6), -F.col("bin"))).alias("peak_frequency"),
        F.try_divide(F.sum(F.col("f") * F.col("p")), F.sum("p")).alias("spectral_centroid"),
    )


_R3 = sqrt(3)
#: Decomposition filters of the second Daubechies wavelet, from their closed form.
LOW = tuple(v / (4 * sqrt(2)) for v in (1 - _R3, 3 - _R3, 3 + _R3, 1 + _R3))
HIGH = (-LOW[3], LOW[2], -LOW[1], LOW[0])


def _level(series: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One level of the filter bank on (k, v, n) with half-point symmetric borders: rows k, low, high."""
    # Output o of floor((n + 3) / 2) takes inputs 2o + 1 - t for taps t; those outside are mirrored at the ends.
    sources = series.withColumn("at", F.explode(F.array(F.col("k"), -F.col("k") - 1, 2 * F.col("n") - 1 - F.col("k"))))
    taps = sources.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(3))))
    o = (F.col("at") + F.col("t") - 1) / 2
    used = taps.where(((F.col("at") + F.col("t")) % 2 != 0) & (o >= 0) & (o < F.floor((F.col("n") + 3) / 2)) & (F.col("at") >= -3) & (F.col("at") <= F.col("n") + 2))
    pick = lambda f: F.element_at(F.array(*[F.lit(x) for x in f]), F.col("t") + 1)
    return used.groupBy(*by, "n", o.cast("int").alias("o")).agg(F.sum(F.col("v") * pick(LOW)).alias("low"), F.sum(F.col("v") * pick(HIGH)).alias("high"))


def wavelet(series: DataFrame, value: str, by: tuple[str, ...] = TRACK) -> DataFrame:
    """Energies of a two-level second-Daubechies transform: total, approximation, detail. Fewer levels for short series
    (two need 12 values, one needs 6); null below that."""
    w = Window.partitionBy(*by).orderBy("frame")
    known = series.where(F.col(value).isNotNull()).select(*by, "frame", F.col(value).alias("v"))
    known = known.withColumns({"k": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(*by)).cast("int")}).where("n >= 6").drop("frame")
    one = _level(known, by).withColumn("levels", F.when(F.col("n") >= 12, 2).otherwise(1))
    again = one.where("levels = 2").select(*by, F.col("o").alias("k"), F.col("low").alias("v"), F.floor((F.col("n") + 3) / 2).cast("int").alias("n"))
    two = _level(again, by)
    parts = one.select(*by, F.when(F.col("levels") == 1, F.col("low") * F.col("low")).alias("a"), (F.col("high") * F.col("high")).alias("d")).unionByName(
        two.select(*by, (F.col("low") * F.col("low")).alias("a"), (F.col("high") * F.col("high")).alias("d"))
    )
    sums = parts.groupBy(*by).agg(F.sum("a").alias("energy_approx"), F.sum("d").alias("energy_detail"))
    return sums.withColumn("energy_total", F.col("energy_approx") + F.col("energy_detail"))


def hull_ring(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The corners of the convex hull, anticlockwise; of fewer than three points those points, sorted."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(some) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(reversed(points))


def hull_area(xy: np.ndarray) -> float | None:
    """Area of the convex hull; none below 3 points or if all lie on a line."""
    ring = hull_ring([*map(tuple, xy.tolist())])
    if len(ring) < 3:
        return None
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
    return area if area > 0 else None


#: A track's points are cut down to their hull whenever a task holds so many, and a task passes on all hulls whenever it
#: holds so many points.
CUT_AT, HELD_POINTS = 256, 20_000


def partial_hulls(points: DataFrame, by: tuple[str, ...] = TRACK) -> DataFrame:
    """Of each track and task the corners of its points' hull, before any shuffle. A hull of hulls is the hull of all."""
    rows = points.select(F.struct(*by).alias("key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}
        held: list[list[tuple[float, float]]] = []
        size = 0

        def out() -> pa.RecordBatch:
            rings = [*map(hull_ring, held)]
            xs, ys = ([p[k] for ring in rings for p in ring] for k in (0, 1))
            at = pa.array(np.repeat(np.arange(len(rings)), [len(r) for r in rings]))
            return pa.RecordBatch.from_arrays([pa.array([dict(zip(by, k, strict=True)) for k in names], kind).take(at), pa.array(xs, pa.float64()), pa.array(ys, pa.float64())], names=["key", "x", "y"])

        for batch in batches:
            kind = batch.column(0).type
            for key, *p in zip(zip(*(c.to_pylist() for c in batch.column(0).flatten()), strict=True), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = names.setdefault(key, len(held))
                if n == len(held):
                    held.append([])
                own = held[n]
                own.append(tuple(p))
                size += 1
                # Never a ring that is mostly corners again and again.
                if len(own) >= CUT_AT and not len(own) & (len(own) - 1):
                    size -= len(own)
                    held[n] = own = hull_ring(own)
                    size += len(own)
            if size > HELD_POINTS:
                yield out()
                names, held, size = {}, [], 0
        if held:
            yield out()

    return rows.mapInArrow(run, rows.schema).select("key.*", "x", "y")


def corner_lists(points: DataFrame, by: tuple[str, ...] = TRACK) -> DataFrame:
    """xy: of each track with a place, the corners of the hulls that tasks sent."""
    return partial_hulls(points, by).groupBy(*by).agg(F.collect_list(F.struct("x", "y")).alias("xy"))


def area_of(xy: str) -> Column:
    """The area of the hull of a list of places; null without one."""

    @F.pandas_udf("double")
    def area(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([hull_area(np.stack([x, y], axis=1)) if x is not None and len(x) else None for x, y in zip(xs, ys, strict=True)], dtype=float)

    found = area(f"{xy}.x", f"{xy}.y")
    return F.when(~F.isnan(found), found)


def hulls(points: DataFrame, by: tuple[str, ...] = TRACK) -> DataFrame:
    """The convex hull area of each track: tasks send the hulls of what they have, and the hull of those goes to numpy.
    Points without a place are left out; a track without any has none."""
    every = points.select(*by).distinct()
    return every.join(corner_lists(points, by), list(by), "left").select(*by, area_of("xy").alias("hull_area"))


def size_normalised(features: DataFrame, area: str = "area") -> DataFrame:
    """Hull area over object area, also for each frame, and radius of gyration over the area's root."""
    return features.withColumns(
        {
            "hull_per_area": F.try_divide(F.col("hull_area"), F.col(area)),
            "hull_per_area_frame": F.try_divide(F.try_divide(F.col("hull_area"), F.col(area)), F.col("n_frames")),
            "gyration_per_root_area": F.try_divide(F.col("radius_of_gyration"), F.sqrt(F.col(area))),
        }
    )


def decay_fit(lag: np.ndarray, value: np.ndarray, start: float) -> float | None:
    """Least-squares decay length of exp(-lag / tau) through the positive values; none below 3 of them."""
    lag, value = lag[value > 0], value[value > 0]
    if len(lag) < 3:
        return None
    tau, damp = start, 1e-3
    error = lambda t: float(((np.exp(-lag / t) - value) ** 2).sum()) if t else np.inf
    best = error(tau)
    for _ in range(200):
        curve = np.exp(-lag / tau)
        slope = curve * lag / tau**2
        grad, size = float(slope @ (value - curve)), float(slope @ slope)
        if size == 0 or not np.isfinite(size):
            return None
        move = grad / (size * (1 + damp))
        with np.errstate(over="ignore"):
            after = error(tau + move)
        if np.isfinite(after) and after <= best:
            if abs(move) <= 1e-10 * abs(tau):
                return tau + move
            tau, best, damp = tau + move, after, damp / 10
        else:
            damp *= 10
            if damp > 1e12:
                return tau
    return None


def acf(v: np.ndarray) -> np.ndarray:
    """All lags up to half the number of values."""
    v = v - v.mean() if len(v) >= 3 else v[:0]
    own = float(v @ v)
    return np.array([v[:-k] @ v[k:] / own for k in range(1, len(v) // 2 + 1)]) if own else np.zeros(0)


def fits_of(dx: np.ndarray, dy: np.ndarray, step: np.ndarray, angle: np.ndarray) -> tuple[float | None, ...]:
    """Decay lengths of the autocorrelations of step and angle, and the persistence length."""
    fitted = [decay_fit(np.arange(1, len(a) + 1.0), a, 2.0) if len(a) >= 3 else None for a in map(acf, (step, angle))]
    unit = np.stack([dx, dy], axis=1)[step > 0] / step[step > 0, None]
    turn = np.array([(unit[:-k] * unit[k:]).sum(axis=1).mean() for k in range(1, len(unit) // 2 + 1)]) if len(unit) >= 3 else np.zeros(0)
    mean = step.mean() if len(step) else 0.0
    return (*fitted, decay_fit(np.arange(1, len(turn) + 1) * mean, turn, mean) if len(turn) >= 3 and mean else None)


def spectrum_of(v: np.ndarray, rate: float = 1.0, segment: int = 8) -> tuple[float | None, ...]:
    """What `welch` returns, of one series."""
    if len(v) < 4:
        return None, None, None
    m = min(len(v), segment)
    parts = np.lib.stride_tricks.sliding_window_view(v, m)[:: m - m // 2]
    hann = 0.5 - 0.5 * np.cos(2 * pi * np.arange(m) / m)
    p = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * hann, axis=1)) ** 2 / (rate * (hann @ hann))
    p[:, 1 : m // 2 + m % 2] *= 2
    p, f = p.mean(axis=0), np.arange(m // 2 + 1) * rate / m
    total = float(p.sum())
    return float((p[1:] + p[:-1]).sum() / 2 * rate / m), float(f[np.round(p, 6).argmax()]), float(f @ p) / total if total else None


def bank_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of the filter bank, with half-point symmetric borders."""
    wide = np.pad(v, 3, mode="symmetric")
    low, high = (np.convolve(wide, taps)[4 : len(v) + 6 : 2] for taps in (LOW, HIGH))
    return low, high


def energies_of(v: np.ndarray) -> tuple[float | None, ...]:
    """What `wavelet` returns, of one series."""
    if len(v) < 6:
        return None, None, None
    low, high = bank_of(v)
    detail = float(high @ high)
    if len(v) >= 12:
        low, high = bank_of(low)
        detail += float(high @ high)
    return float(low @ low), detail, float(low @ low) + detail


FITS = ("speed_tau", "angle_tau", "persistence")
SPECTRA = tuple(f"{v}_{c}" for v in ("step", "angle") for c in ("total_power", "peak_frequency", "spectral_centroid", "energy_approx", "energy_detail", "energy_total"))


def of_series(kind: tuple[str, ...], row) -> Callable[[str], Column]:
    """A function of lists of (frame, dx, dy, step, angle) in rising order: row(dx, dy, step, angle) gives `kind`. The
    columns go to Python as arrays of numbers without nulls; as structs they would be a dictionary for each step."""

    @F.pandas_udf(", ".join(f"{c} double" for c in kind))
    def run(dx: pd.Series, dy: pd.Series, step: pd.Series, angle: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([row(*(np.asarray(v, float) for v in own)) for own in zip(dx, dy, step, angle, strict=True)], columns=list(kind), dtype=float)

    return lambda s: run(*[F.filter(F.col(f"{s}.{c}"), lambda v: v.isNotNull()) for c in ("dx", "dy", "step", "angle")])


def decays(points: DataFrame, by: tuple[str, ...] = TRACK) -> DataFrame:
    """Decay lengths of the autocorrelations of speed and angle, and the persistence length (fits, so grouped numpy)."""
    moved = with_angles(steps(points, by), by).where("dx IS NOT NULL").select(*by, "frame", "dx", "dy", "step", "angle")
    lists = moved.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("frame", "dx", "dy", "step", "angle"))).alias("s"))
    return lists.select(*by, of_series(FITS, fits_of)("s").alias("f")).select(*by, *[F.when(~F.isnan(f"f.{c}"), F.col(f"f.{c}")).alias(c) for c in FITS])


def all_features(points: DataFrame, frame_interval: float = 1.0, by: tuple[str, ...] = TRACK) -> DataFrame:
    """Every feature of each track in one row.

    One shuffle by track feeds all of it: windows over the ordered rows make steps, angles and products of neighbours,
    and one aggregate sums them and lists the steps, of which Python makes spectra, wavelets and fits, many tracks in a
    batch. Hulls are shuffled as corners. A task holds the steps of one track in its aggregate.
    """
    rate, keys = 1 / frame_interval, ", ".join(f"`{c}`" for c in by)
    ordered = f"OVER (PARTITION BY {keys} ORDER BY frame)"
    every = Window.partitionBy(*by)
    # Few bytes, but long to compute, so the partitions of this shuffle must not be merged by their size.
    moved = with_angles(steps(spread(points, *by), by), by)
    moved = moved.withColumns({"ux": F.when(F.col("step") > 0, F.col("dx") / F.col("step")), "uy": F.when(F.col("step") > 0, F.col("dy") / F.col("step"))})
    moved = moved.withColumns({"cs": F.col("step") - F.avg("step").over(every), "ca": F.col("angle") - F.avg("angle").over(every)})
    next_one = lambda c, k: F.col(c) * F.expr(f"lead({c}, {k}) IGNORE NULLS {ordered}")
    moved = moved.withColumns({"dot": next_one("ux", 1) + next_one("uy", 1), "cs1": next_one("cs", 1), "ca1": next_one("ca", 1), "ca2": next_one("ca", 2)})
    ends = F.struct("x", "y")
    square = lambda c: F.sum(F.col(c) * F.col(c))
    sums = {
        "n_frames": F.count(F.lit(1)), "x_variance": F.var_samp("x"), "y_variance": F.var_samp("y"), "radius_of_gyration": F.sqrt(F.var_pop("x") + F.var_pop("y")), "mean_step": F.avg("step"), "max_step": F.max("step"),
        "step_variance": F.var_samp("step"), "path_length": F.coalesce(F.sum("step"), F.lit(0.0)), "head": F.min_by(ends, "frame"), "tail": F.max_by(ends, "frame"),
        "angle_mean": F.avg("angle"), "angle_variance": F.var_samp("angle"), "angle_median": F.median("angle"),
        "units": F.count("ux"), "dots": F.avg("dot"), "steps": F.count("cs"), "angles": F.count("ca"), "step_own": square("cs"), "angle_own": square("ca"), "step_1": F.sum("cs1"), "angle_1": F.sum("ca1"), "angle_2": F.sum("ca2"),
        "s": F.array_sort(F.collect_list(F.when(F.col("dx").isNotNull(), F.struct("frame", "dx", "dy", "step", "angle")))),
    }
    found = moved.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()])
    dx, dy = F.col("tail.x") - F.col("head.x"), F.col("tail.y") - F.col("head.y")
    found = found.withColumn("net_displacement", F.when(F.col("n_frames") > 1, F.sqrt(dx * dx + dy * dy)))
    share = lambda n, own, part, lag: F.when((F.col(n) >= 3) & (F.floor(F.col(n) / 2) >= lag) & (F.col(own) > 0), F.try_divide(F.col(part), F.col(own)))

    def row(dx, dy, step, angle):
        return (*fits_of(dx, dy, step, angle), *(x for v in (step, angle) for x in (*spectrum_of(v, rate), *energies_of(v))))

    names = (*FITS, *SPECTRA)
    # Joined first: both sides are dealt by track here, which Python's results are not known to be.
    found = found.join(corner_lists(points, by), list(by), "left").withColumns({"f": of_series(names, row)("s"), "hull_area": area_of("xy")})
    of = {c: F.when(~F.isnan(f"f.{c}"), F.col(f"f.{c}")) for c in names}
    basic_ones = ("n_frames", "x_variance", "y_variance", "radius_of_gyration", "mean_step", "max_step", "step_variance", "path_length", "net_displacement")
    return found.select(
        *by,
        *basic_ones,
        F.when(F.col("path_length") > 0, F.col("net_displacement") / F.col("path_length")).alias("straightness"),
        "angle_mean",
        "angle_variance",
        "angle_median",
        F.when(F.col("units") >= 3, F.col("dots")).alias("vector_acf_lag1"),
        *[of[c].alias(c) for c in FITS],
        share("steps", "step_own", "step_1", 1).alias("speed_acf_lag1"),
        share("angles", "angle_own", "angle_1", 1).alias("angle_acf_lag1"),
        share("angles", "angle_own", "angle_2", 2).alias("angle_acf_lag2"),
        *[of[c].alias(c) for c in SPECTRA],
        "hull_area",
    )


def rounded(column: str | Column, places: int = 4) -> Column:
    """Rounded for a feature table: halves go to the even digit."""
    return F.bround(F.col(column) if isinstance(column, str) else column, places)
