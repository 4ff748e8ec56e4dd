"""The perceptron: gradients, independence of partitions, and what it learns."""

import numpy as np
import pytest

from tracklark.operators import model, perceptron
from tracklark.plans.catalogue import QUERIES


def test_gradients_equal_finite_differences():
    draw = np.random.default_rng(1)
    sizes = (3, 5, 4, 2)
    w = perceptron.started(sizes, 7)
    x, y = draw.normal(size=(20, 3)), draw.normal(size=(20, 2))
    y[draw.random((20, 2)) < 0.3] = np.nan
    loss = lambda v: perceptron.squares(x, y, perceptron.shaped(v, sizes))[0]
    total, known, gradient = perceptron.squares(x, y, perceptron.shaped(w, sizes))
    assert known == (~np.isnan(y)).sum() and total == pytest.approx(loss(w))
    for k in range(len(w)):
        step = np.zeros_like(w)
        step[k] = 1e-6
        assert gradient[k] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, rel=1e-4, abs=1e-5)
    assert (perceptron.flat(perceptron.shaped(w, sizes)) == w).all()


@pytest.fixture(scope="module")
def planted(spark):
    draw = np.random.default_rng(2)
    rows = []
    for k in range(600):
        a, b = draw.normal(size=2)
        rows.append((int(k % 60), float(a), None if k % 17 == 0 else float(b * 10 + 100), float(abs(a) * 5 + 3), float("nan") if k % 5 == 0 else float(b), 1.0))
    return spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 1.0, 1.0), (3, 1.0, 1.0, None, None, None)], "cell int, a double, b double, u double, v double, w double")


def test_a_planted_relation_is_learned_whatever_the_partitions(spark, planted):
    test = model.hash_split(planted, "cell")
    nets = [perceptron.trained(test.where("NOT is_test").repartition(k), ["a", "b"], ["u", "v"], "cell", epochs=60, rate=3e-2, hidden=(16, 8)) for k in (1, 5)]
    one, five = nets
    assert np.abs(one.weights - five.weights).max() < 1e-6 and len(one.losses) == len(five.losses)
    assert min(one.losses) < 0.3 * one.losses[0]
    held = test.where("is_test AND cell IS NOT NULL")
    got = one.predicted(held)
    assert got.columns == [*held.columns, "predicted_u", "predicted_v"] and got.count() == held.count()
    mean = test.where("NOT is_test").agg({"u": "avg"}).first()[0]
    net = model.metrics(got, "u", "predicted_u").first()
    flat = model.metrics(held.selectExpr("u", f"{mean}D AS guess"), "u", "guess").first()
    assert net.rmse < 0.5 * flat.rmse and net.r2 > 0.7


def test_no_rows_and_targets_that_do_not_vary(spark, planted):
    assert perceptron.trained(planted.where("false"), ["a"], ["u"], "cell", 3) is None
    assert perceptron.trained(planted, ["a"], ["w"], "cell", 3) is None
    assert len(perceptron.trained(planted, ["a"], ["u", "w"], "cell", 3, hidden=(4,)).losses) == 3


def test_query_beats_the_mean(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.target: r for r in QUERIES["perceptron_r2"](spark, sf_dir).collect()}
    assert set(got) == {"path_length", "radius_of_gyration"} and got["path_length"].r2 > 0.8
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["perceptron_r2"](spark, str(tmp_path)).count() == 0
