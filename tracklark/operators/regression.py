"""Grouped cross-validation of elastic nets from sums of products, with folds balanced by group size."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklark.operators.tables import numbered
from tracklark.session import small_enough

#: So many groups' folds at most are broadcast.
FEW_GROUPS = 200_000
#: Scores are compared to so many decimals, so that the choice does not hang on the order of summation.
DECIMALS = 9


class Stretch(NamedTuple):
    """Groups of `size` rows from the `start`th of that size (from 0) on take the folds of `turn` in turn."""

    size: int
    start: int
    turn: list[int]


def dealt(sizes: list[tuple[int, int]], folds: int) -> list[Stretch]:
    """How groups go to folds if each, the largest first, goes to the fold with the fewest rows (ties to the smallest
    number). sizes: (size, number of groups), largest first.

    Groups of one size fill the folds up level by level. While the same folds take part, they take turns: each fold's
    next place is less than one size above the lowest. So a size needs one stretch for each fold that joins in.
    """
    load, out = [0] * folds, []
    for size, groups in sizes:
        done = 0
        while done < groups:
            least = min(load)
            active = sorted((f for f in range(folds) if load[f] < least + size), key=lambda f: (load[f], f))
            outside = min((load[f] for f in range(folds) if f not in active), default=None)
            # Whole turns until the fold outside is less than a size above the lowest.
            turns = -(-(groups - done) // len(active)) if outside is None else max(1, (outside - least) // size)
            out.append(Stretch(size, done, active))
            for k, f in enumerate(active):
                load[f] += size * max(0, min(turns, -(-(groups - done - k) // len(active))))
            done += turns * len(active)
    return out


def balanced_folds(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """group, n (its rows) and fold of each group: the largest group first (ties: the larger group), each to the fold
    with the fewest rows so far. Rows without a group have none, and there are no more folds than groups.

    Only the histogram of group sizes comes to the driver, which has at most sqrt(2 * rows) entries; groups of a size are
    numbered by range partitions and look their fold up, so no task or driver holds all groups.
    """
    spark = rows.sparkSession
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    histogram = [(r["n"], r["groups"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("groups")).collect()]
    histogram.sort(reverse=True)
    folds = max(1, min(folds, sum(g for _, g in histogram)))
    before, offsets = 0, []
    for n, g in histogram:
        offsets.append((n, before))
        before += g
    plan: dict[int, list] = {n: [] for n, _ in histogram}
    for s in dealt(histogram, folds):
        plan[s.size].append((s.start, s.turn))
    kind = "n long, before long, stretches array<struct<start:long,turn:array<int>>>"
    known = spark.createDataFrame([(n, b, plan[n]) for n, b in offsets], kind)
    if len(offsets) <= FEW_GROUPS:
        known = F.broadcast(known)
    placed = numbered(sizes, F.desc("n"), F.desc(group), name="place").join(known, "n").withColumn("rank", F.col("place") - 1 - F.col("before"))
    last = F.element_at(F.filter("stretches", lambda s: s["start"] <= F.col("rank")), -1)
    found = placed.withColumn("of", last)
    turn = F.element_at("of.turn", ((F.col("rank") - F.col("of.start")) % F.size("of.turn") + 1).cast("int"))
    return found.select(group, "n", turn.alias("fold"))


def with_folds(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """The rows with their group's fold."""
    found = balanced_folds(rows, group, folds).select(group, "fold")
    return rows.join(F.broadcast(found) if small_enough(found, FEW_GROUPS) else found, group, "left")


def finite(c: str) -> Column:
    """The value as a double, null if it isn't a finite number."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


class Sums(NamedTuple):
    """Of each fold the sums of products of 1, the features (missing as 0), their missing flags, and the target; features
    and target are taken relative to `shift`, about their means, which keeps digits."""

    features: list[str]
    shift: np.ndarray
    by_fold: dict[int, np.ndarray]


def product_sums(rows: DataFrame, features: list[str], target: str, fold: str) -> Sums:
    """One aggregation for the means and one for all sums. Each task multiplies its rows as matrices and returns one number
    for each fold and pair of columns; rows without a target or fold take no part."""
    known = rows.select(F.col(fold).cast("int").alias("fold"), *[finite(c).alias(f"x{k}") for k, c in enumerate(features)], finite(target).alias("y")).where("y IS NOT NULL AND fold IS NOT NULL")
    columns = [*(f"x{k}" for k in range(len(features))), "y"]
    means = known.agg(*[F.avg(c).alias(c) for c in columns]).first()
    shift = np.array([means[c] or 0.0 for c in columns])
    size = 2 * len(features) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            of = batch.column(0).to_numpy()
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1) - shift
            gone = np.isnan(x[:, :-1])
            whole = np.hstack([np.ones((len(x), 1)), np.where(gone, 0.0, x[:, :-1]), gone, x[:, -1:]])
            for f in np.unique(of):
                own = whole[of == f]
                total[f] = total.get(f, 0.0) + own.T @ own
        for f, g in total.items():
            i, j = np.indices(g.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(g.size, f, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(g.ravel())], names=["fold", "i", "j", "total"])

    out: dict[int, np.ndarray] = {}
    for r in known.mapInArrow(run, "fold int, i int, j int, total double").groupBy("fold", "i", "j").agg(F.sum("total").alias("total")).collect():
        out.setdefault(r.fold, np.zeros((size, size)))[r.i, r.j] = r.total
    return Sums(features, shift, out)


def medians(rows: DataFrame, sums: Sums, target: str, fold: str) -> dict[int | None, np.ndarray]:
    """Medians of the features, relative to the shift, over all folds (None) and over all but one. The latter only of
    features with missing values; the others' are never used and are 0."""
    p = len(sums.features)
    wanted = [(None, k) for k in range(p)] + [(f, k) for f in sorted(sums.by_fold) for k in range(p) if any(g[1 + p + k, 0] > 0 for g in sums.by_fold.values())]
    known = rows.where(finite(target).isNotNull() & F.col(fold).isNotNull())
    inside = lambda f, c: c if f is None else F.when(F.col(fold) != f, c)
    found = known.agg(*[F.median(inside(f, finite(sums.features[k]))) for f, k in wanted]).first()
    out = {f: np.zeros(p) for f in (None, *sums.by_fold)}
    for (f, k), value in zip(wanted, found, strict=True):
        if value is not None:
            out[f][k] = value - sums.shift[k]
    return out


class Standard(NamedTuple):
    """A training set whose missing values are its medians, scaled to mean 0 and variance 1 (constant columns to 0)."""

    rows: float
    median: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    gram: np.ndarray
    cross: np.ndarray
    target_mean: float
    target_variance: float


def standard(total: np.ndarray, median: np.ndarray) -> Standard:
    """From sums of products. gram and cross: mean products of the scaled features with each other and the target."""
    p = len(median)
    # Features with medians in place of missing values are sums of columns.
    fill = np.zeros((p + 2, 2 * p + 2))
    fill[0, 0] = fill[p + 1, 2 * p + 1] = 1
    fill[1 : p + 1, 1 : p + 1] = np.eye(p)
    fill[1 : p + 1, p + 1 : 2 * p + 1] = np.diag(median)
    g = fill @ total @ fill.T
    n = g[0, 0]
    mean, y = g[0, 1:-1] / n, g[0, -1] / n
    cov = g[1:, 1:] / n - np.outer(np.append(mean, y), np.append(mean, y))
    variance = np.diag(cov)[:-1]
    scale = np.sqrt(np.where(variance > 1e-12 * (mean * mean + 1e-300), variance, 1.0))
    live = np.where(variance > 1e-12 * (mean * mean + 1e-300), 1.0, 0.0)
    return Standard(n, median, mean, scale, cov[:-1, :-1] * np.outer(live / scale, live / scale), cov[:-1, -1] * live / scale, y, cov[-1, -1])


def descended(s: Standard, alpha: float, ratio: float, start: np.ndarray, rounds: int = 10_000, least: float = 1e-12) -> np.ndarray:
    """Weights of the elastic net |y - Xw|^2 / 2n + alpha * (ratio * |w|_1 + (1 - ratio) * |w|^2 / 2), by coordinate
    descent on the mean products."""
    w, part = start.copy(), s.gram @ start
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(w)):
            pull = s.cross[j] - part[j] + s.gram[j, j] * w[j]
            down = s.gram[j, j] + alpha * (1 - ratio)
            new = np.sign(pull) * max(abs(pull) - alpha * ratio, 0.0) / down if down > 0 else 0.0
            if new != w[j]:
                part += s.gram[:, j] * (new - w[j])
                moved, w[j] = max(moved, abs(new - w[j])), new
        if moved <= least * max(np.abs(w).max(initial=0.0), 1e-300):
            break
    return w


def path(s: Standard, alphas: list[float], ratios: list[float]) -> dict[tuple[float, float], np.ndarray]:
    """Weights of all points, each starting from those of the next stronger alpha."""
    out = {}
    for ratio in ratios:
        w = np.zeros(len(s.cross))
        for alpha in sorted(alphas, reverse=True):
            out[alpha, ratio] = w = descended(s, alpha, ratio, w)
    return out


def coefficients(s: Standard, w: np.ndarray) -> np.ndarray:
    """Of the prediction, over 1, the features, the flags (all relative to the shift), and -1 for the target."""
    own = w / s.scale
    return np.concatenate([[s.target_mean - own @ s.mean], own, own * s.median, [-1.0]])


def r2(total: np.ndarray, v: np.ndarray) -> float:
    """1 less the share of unexplained variance; of one row NaN, of equal targets 0."""
    n, y = total[0, 0], total[0, -1]
    spread = total[-1, -1] - y * y / n
    return float("nan") if n < 2 else 1 - float(v @ total @ v) / spread if spread > 0 else 0.0


class ElasticNet(NamedTuple):
    """The chosen net, in units of the features, and the scores of all points: (alpha, ratio, mean R2 of the folds)."""

    features: list[str]
    median: list[float]
    weights: list[float]
    intercept: float
    alpha: float
    ratio: float
    scores: list[tuple[float, float, float]]

    def predicted(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        """The rows with a prediction, all in the JVM."""
        total = F.lit(self.intercept)
        for c, m, w in zip(self.features, self.median, self.weights, strict=True):
            total = total + F.coalesce(finite(c), F.lit(m)) * w
        return rows.withColumn(name, total)


#: The usual grid: 20 strengths evenly in logarithm, three mixtures.
ALPHAS, RATIOS = [float(10 ** (-4 + 5 * k / 19)) for k in range(20)], [0.1, 0.5, 0.9]


def cross_validated(train: DataFrame, features: list[str], target: str, fold: str = "fold", alphas: list[float] = ALPHAS, ratios: list[float] = RATIOS) -> ElasticNet | None:
    """The elastic net with the best mean R2 over the folds, refitted on all rows; missing features take the median of
    each training set, and each training set is scaled for itself. Of equal scores the first alpha, then ratio, wins.

    All points and folds come from the same sums: a training set's are the total less the fold's. None with fewer than two
    folds or a constant target. p features cost a task (2p + 2)^2 sums for each fold.
    """
    sums = product_sums(train, features, target, fold)
    if len(sums.by_fold) < 2:
        return None
    total, median = sum(sums.by_fold.values()), medians(train, sums, target, fold)
    whole = standard(total, median[None])
    if not whole.target_variance > 1e-12 * (whole.target_mean + sums.shift[-1]) ** 2:
        return None
    scores: dict[tuple[float, float], list[float]] = {}
    for f, own in sums.by_fold.items():
        s = standard(total - own, median[f])
        for point, w in path(s, alphas, ratios).items():
            scores.setdefault(point, []).append(r2(own, coefficients(s, w)))
    table = [(a, r, float(np.mean(scores[a, r]))) for a in alphas for r in ratios]
    alpha, ratio, _ = max(table, key=lambda x: -np.inf if np.isnan(x[2]) else round(x[2], DECIMALS))
    w = path(whole, [a for a in alphas if a >= alpha], [ratio])[alpha, ratio]
    own = w / whole.scale
    at = sums.shift[:-1]
    intercept = whole.target_mean + sums.shift[-1] - float(own @ (whole.mean + at))
    return ElasticNet(features, (median[None] + at).tolist(), own.tolist(), intercept, alpha, ratio, table)
