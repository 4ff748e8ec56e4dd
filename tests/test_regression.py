"""Balanced folds and elastic nets from sums of products against plain versions."""

import random

import numpy as np
import pytest

from tests.test_queries import QUERIES
from tracklark.operators import regression


@pytest.mark.parametrize("folds", [1, 2, 5, 7])
def test_stretches_are_the_sequential_choice(folds):
    draw = random.Random(folds)
    for _ in range(300):
        sizes = sorted({draw.choice([1, 2, 3, 5, 8, 40, 1000]): draw.randint(1, 30) for _ in range(draw.randint(1, 5))}.items(), reverse=True)
        stretches, load = regression.dealt(sizes, folds), [0] * folds
        assert len(stretches) <= folds * len(sizes)
        for size, groups in sizes:
            own = [s for s in stretches if s.size == size]
            for k in range(groups):
                s = [s for s in own if s.start <= k][-1]
                least = load.index(min(load))
                assert s.turn[(k - s.start) % len(s.turn)] == least
                load[least] += size


def test_folds_of_many_equal_groups_and_nulls(spark):
    sizes = {f"g{k:03}": n for k, n in enumerate([400, 90, 90, 7] + [3] * 50 + [1] * 200)}
    rows = spark.createDataFrame([(g, k, 0) for g, n in sizes.items() for k in range(n)] + [(None, 1, 0)] * 30, "who string, n int, fold int").repartition(5)
    found = regression.balanced_folds(rows, "who").collect()
    load, want = [0] * 5, {}
    for g, n in sorted(sizes.items(), key=lambda x: (x[1], x[0]), reverse=True):
        want[g] = load.index(min(load))
        load[want[g]] += n
    assert {r.who: (r.n, r.fold) for r in found} == {g: (sizes[g], f) for g, f in want.items()}
    assert max(load) - min(load) <= 400 and sorted(load)[-2] - min(load) <= 3
    assert {r.fold for r in regression.balanced_folds(rows.where("who IN ('g001', 'g002')"), "who").collect()} == {0, 1}
    assert regression.balanced_folds(rows.where("who IS NULL"), "who").count() == 0
    assert regression.with_folds(rows.drop("fold"), "who").where("fold IS NULL").count() == 30


def plain_net(x, y, alpha, ratio):
    """Coordinate descent on the rows themselves."""
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        old = w.copy()
        for j in range(len(w)):
            pull = x[:, j] @ (y - x @ w + x[:, j] * w[j]) / len(y)
            w[j] = np.sign(pull) * max(abs(pull) - alpha * ratio, 0) / (x[:, j] @ x[:, j] / len(y) + alpha * (1 - ratio))
        if np.abs(w - old).max() < 1e-13:
            break
    return w


def prepared(train, rows):
    med = np.nanmedian(train, axis=0)
    fill = lambda a: np.where(np.isnan(a), med, a)
    mean, sd = fill(train).mean(axis=0), fill(train).std(axis=0)
    return (fill(rows) - mean) / np.where(sd > 0, sd, 1)


def test_nets_equal_those_fitted_on_rows(spark):
    draw = np.random.default_rng(4)
    n = 240
    x = draw.normal(size=(n, 4)) * [1, 50, 0.1, 0] + [1000, -3, 0, 7]
    x[:, 1] += 30 * x[:, 0]
    y = 2e4 + 3 * (x[:, 0] - 1000) - 40 * x[:, 2] + draw.normal(size=n) * 0.5
    x[draw.random((n, 4)) < [0.1, 0, 0.3, 0]] = np.nan
    fold = draw.integers(0, 3, n)
    rows = [(int(f), *(None if np.isnan(v) else float(v) for v in r), float(t)) for f, r, t in zip(fold, x, y, strict=True)]
    frame = spark.createDataFrame([*rows, (0, 1.0, 1.0, 1.0, 1.0, None), (None, 1.0, 1.0, 1.0, 1.0, 5.0), (1, 1.0, 1.0, 1.0, 1.0, float("nan"))], "fold int, a double, b double, c double, d double, y double")
    alphas, ratios = [0.001, 0.05, 0.4, 3.0], [0.1, 0.9]
    models = [regression.cross_validated(frame.repartition(k), ["a", "b", "c", "d"], "y", "fold", alphas, ratios) for k in (1, 6)]
    net = models[0]
    assert np.allclose(models[1].weights, net.weights, rtol=1e-9) and models[1].intercept == pytest.approx(net.intercept)
    scores = {}
    for a in alphas:
        for r in ratios:
            own = []
            for f in range(3):
                t = fold != f
                mean = y[t].mean()
                w = plain_net(prepared(x[t], x[t]), y[t] - mean, a, r)
                guess = mean + prepared(x[t], x[~t]) @ w
                own.append(1 - ((y[~t] - guess) ** 2).sum() / ((y[~t] - y[~t].mean()) ** 2).sum())
            scores[a, r] = np.mean(own)
    assert {(a, r): pytest.approx(s, abs=1e-7) for a, r, s in net.scores} == scores
    assert (net.alpha, net.ratio) == max(scores, key=lambda p: round(scores[p], 9))
    w = plain_net(prepared(x, x), y - y.mean(), net.alpha, net.ratio)
    got = net.predicted(frame.where("y IS NOT NULL AND NOT isnan(y) AND fold IS NOT NULL")).select("y", "prediction").collect()
    assert sorted(r.prediction for r in got) == pytest.approx(sorted(y.mean() + prepared(x, x) @ w), abs=1e-6)


def test_weights_meet_the_conditions_of_the_optimum():
    draw = np.random.default_rng(5)
    for _ in range(20):
        x = draw.normal(size=(50, 6)) @ draw.normal(size=(6, 6))
        y = draw.normal(size=50) + x[:, 0]
        whole = np.hstack([np.ones((50, 1)), x, np.zeros((50, 6)), y[:, None]])
        s = regression.standard(whole.T @ whole, np.zeros(6))
        alpha, ratio = float(draw.choice([0.01, 0.3])), float(draw.choice([0.1, 0.9]))
        w = regression.descended(s, alpha, ratio, np.zeros(6))
        slope = s.gram @ w - s.cross + alpha * (1 - ratio) * w
        assert np.abs(slope[w == 0]).max(initial=0) <= alpha * ratio + 1e-9 and np.allclose(slope[w != 0], -alpha * ratio * np.sign(w[w != 0]), atol=1e-8)


def test_no_net_without_folds_or_variation(spark):
    frame = spark.createDataFrame([(k % 2, float(k), 5.0) for k in range(9)], "fold int, a double, y double")
    assert regression.cross_validated(frame, ["a"], "y") is None
    assert regression.cross_validated(frame.withColumn("y", frame.a).where("fold = 1"), ["a"], "y") is None
    assert regression.cross_validated(frame.where("false"), ["a"], "y") is None


def test_queries_of_empty_tables(spark, tmp_path, sf_dir):
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [QUERIES[q](spark, str(tmp_path)).count() for q in ("elastic_net_scores", "elastic_net_r2", "random_forest_r2")] == [0, 0, 0]
