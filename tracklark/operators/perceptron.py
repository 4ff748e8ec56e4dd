"""A small perceptron for several targets, trained by full-batch gradients that tasks add up."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklark.operators.model import inner_holdout
from tracklark.operators.regression import finite
from tracklark.session import discard, materialize

# Sizes of the hidden layers, the least gain that counts, and the largest norm of a gradient.
HIDDEN, LEAST_GAIN, LARGEST_NORM = (64, 32), 1e-6, 1.0


def flat(layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.concatenate([x.ravel() for layer in layers for x in layer])


def shaped(v: np.ndarray, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, offsets) of each layer."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((v[at : at + a * b].reshape(a, b), v[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def started(sizes: tuple[int, ...], seed: int) -> np.ndarray:
    """Seeded weights, uniform within one over the root of a layer's inputs."""
    draw = np.random.RandomState(seed)
    return np.concatenate([draw.uniform(-1, 1, (a + 1) * b) / np.sqrt(a) for a, b in zip(sizes, sizes[1:])])


def forward(x: np.ndarray, layers) -> list[np.ndarray]:
    """The values of all layers, the last without a bend."""
    out = [x]
    for k, (w, b) in enumerate(layers):
        v = out[-1] @ w + b
        out.append(np.maximum(v, 0) if k < len(layers) - 1 else v)
    return out


def squares(x: np.ndarray, y: np.ndarray, layers) -> tuple[float, int, np.ndarray]:
    """The sum of squared errors over known targets, their number, and the sum's gradient."""
    values = forward(x, layers)
    known = ~np.isnan(y)
    error = np.where(known, values[-1] - np.where(known, y, 0), 0.0)
    parts, back = [], 2 * error
    for k in range(len(layers) - 1, -1, -1):
        parts.append((values[k].T @ back, back.sum(axis=0)))
        if k:
            back = (back @ layers[k][0].T) * (values[k] > 0)
    return float((error * error).sum()), int(known.sum()), flat(parts[::-1])


class Perceptron(NamedTuple):
    """A trained net: features and targets with their means and deviations (features also with medians), the layers' sizes
    and weights, and the validation loss of each epoch."""

    features: list[str]
    targets: list[str]
    median: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    target_mean: np.ndarray
    target_scale: np.ndarray
    sizes: tuple[int, ...]
    weights: np.ndarray
    losses: list[float]

    def predicted(self, rows: DataFrame, prefix: str = "predicted_") -> DataFrame:
        """The rows with a prediction of each target, made in Arrow batches of the features alone."""
        names = [f"{prefix}{t}" for t in self.targets]

        @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
        def guess(batches):
            import pandas as pd

            layers = shaped(self.weights, self.sizes)
            for columns in batches:
                x = np.stack([c.to_numpy(float) for c in columns], axis=1)
                x = (np.where(np.isnan(x), self.median, x) - self.mean) / self.scale
                yield pd.DataFrame(forward(x, layers)[-1] * self.target_scale + self.target_mean, columns=names)

        guess = F.pandas_udf(_typed(guess.func), guess.returnType)
        found = rows.withColumn("_guess", guess(*[finite(c) for c in self.features]))
        return found.select(*rows.columns, *[F.col(f"_guess.`{n}`").alias(n) for n in names])


def _typed(f):
    """`f` with the annotations that tell Spark of batches of several columns."""
    import pandas as pd

    f.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return f


def trained(train: DataFrame, features: list[str], targets: list[str], group: str, epochs: int = 100, patience: int = 15, rate: float = 3e-2, decay: float = 1e-4, seed: int = 42, hidden: tuple[int, ...] = HIDDEN, share: float = 0.1) -> Perceptron | None:
    """The net with the least loss on held-out groups: mean squared error over all known targets, in units of their
    deviations. Steps are AdamW's with a cosine schedule and clipped gradients; training stops once the held-out loss has
    not fallen for `patience` epochs. There is no dropout, as every step sees all rows.

    Each epoch is one job: the weights go out with the task, every task adds up its rows' gradients and losses, and one
    shuffle adds up the tasks', so the driver gets one number for each weight. The rows are written once, standardised.
    Missing features take their median. None without rows, or without a target that varies.
    """
    rows = inner_holdout(train.where(F.col(group).isNotNull()), group, share)
    x, y = [f"x{k}" for k in range(len(features))], [f"y{k}" for k in range(len(targets))]
    some = F.coalesce(*[finite(t) for t in targets]).isNotNull()
    rows = rows.where(some).select("is_validation", *[finite(c).alias(n) for c, n in zip(features, x)], *[finite(c).alias(n) for c, n in zip(targets, y)])
    fit = F.when(~F.col("is_validation"), F.lit(1))
    own = lambda c: F.when(fit == 1, F.col(c))
    medians = rows.agg(*[F.median(own(c)).alias(c) for c in x]).first()
    median = np.array([0.0 if medians[c] is None else medians[c] for c in x])
    filled = rows.withColumns({c: F.coalesce(c, F.lit(float(m))) for c, m in zip(x, median)})
    found = filled.agg(*[f(own(c)).alias(f"{n}_{c}") for c in (*x, *y) for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.count(fit).alias("n")).first()
    if not found["n"] or not any(found[f"s_{c}"] for c in y):
        return None
    of = lambda n, names, default: np.array([found[f"{n}_{c}"] or default for c in names])
    mean, scale, target_mean, target_scale = of("m", x, 0.0), of("s", x, 1.0), of("m", y, 0.0), of("s", y, 1.0)
    moved = filled.select("is_validation", *[((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip((*x, *y), (*mean, *target_mean), (*scale, *target_scale))])
    ready, held = materialize(moved)
    sizes = (len(x), *hidden, len(y))
    w = started(sizes, seed)
    first, second, best, best_w, waited, losses = np.zeros_like(w), np.zeros_like(w), np.inf, w, 0, []
    for epoch in range(epochs):
        fit_loss, fit_n, held_loss, held_n, gradient = epoch_sums(ready, w, sizes)
        # Without held-out rows the training loss decides.
        loss = held_loss / held_n if held_n else fit_loss / max(fit_n, 1)
        losses.append(loss)
        if loss < best - LEAST_GAIN:
            best, best_w, waited = loss, w, 0
        else:
            waited += 1
            if waited >= patience:
                break
        g = gradient / max(fit_n, 1)
        g = g * min(1.0, LARGEST_NORM / (np.linalg.norm(g) + 1e-6))
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = rate * (1 + np.cos(np.pi * epoch / epochs)) / 2
        w = w * (1 - step * decay) - step * (first / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    discard(train.sparkSession, held)
    return Perceptron(features, targets, median, mean, scale, target_mean, target_scale, sizes, best_w, losses)


def epoch_sums(rows: DataFrame, w: np.ndarray, sizes: tuple[int, ...]) -> tuple[float, int, float, int, np.ndarray]:
    """Training loss and count, held-out loss and count, and the training loss's gradient, all as sums over the rows
    (is_validation, features, targets)."""
    n = sizes[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, total = shaped(w, sizes), np.zeros(len(w) + 4)
        for batch in batches:
            out = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            x, y = values[:, :n], values[:, n:]
            loss, known, gradient = squares(x[~out], y[~out], layers)
            held, held_known, _ = squares(x[out], y[out], layers)
            total += np.concatenate([gradient, [loss, known, held, held_known]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "total"])

    sums = np.zeros(len(w) + 4)
    found = rows.mapInArrow(run, "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).toArrow()
    sums[found["k"].to_numpy()] = found["total"].to_numpy()
    loss, known, held, held_known = sums[-4:]
    return loss, int(known), held, int(held_known), sums[:-4]
