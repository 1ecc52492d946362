"""Optimizers, schedules, stopping rules and small contracts that have no SQL."""

import numpy as np
import pytest

from splitframe.ml import gbdt, glm
from splitframe.ml.optim import Optimizer, converged, rate
from splitframe.operators import encode, sampling


@pytest.mark.parametrize("method,lr", [("sgd", 0.1), ("adagrad", 0.5), ("rmsprop", 0.05), ("adam", 0.1)])
def test_optimizers_reach_the_minimum(method, lr):
    opt, w, target = Optimizer(method, lr), np.zeros(2), np.array([1.0, -2.0])
    for epoch in range(2000):
        w = opt.step(w, w - target, rate("linear", epoch, 1.0, 0.01, 2000))
    assert np.allclose(w, target, atol=0.02)


def test_penalties():
    assert Optimizer("sgd", 0.1, "l2", 1.0).step(np.array([1.0]), np.array([0.0]))[0] == pytest.approx(0.9)
    assert Optimizer("sgd", 0.1, "l1", 1.0).step(np.array([0.05, -1.0]), np.zeros(2)).tolist() == pytest.approx([0.0, -0.9])
    with pytest.raises(ValueError):
        Optimizer("newton")


def test_rates_and_rules():
    assert [rate("step", e, every=2, factor=0.5) for e in range(5)] == [1, 1, 0.5, 0.5, 0.25]
    assert rate("linear", 5, 1.0, 0.0, 10) == 0.5 and rate("constant", 9) == 1.0
    w = np.ones(2)
    assert not converged("diff", 1e-3, 1.0, None, w, w) and converged("diff", 1e-3, 1.0, 1.0001, w, w)
    assert converged("weight_diff", 1e-3, 1.0, None, w, w) and converged("abs", 0.1, 0.01, None, w, w)


def test_logistic_fit_with_adam(spark):
    rows = [(float(k), int(k > 0)) for k in range(-20, 21)]
    df = spark.createDataFrame(rows, "x double, y int")
    w = glm.fit_logistic(df, ["x"], "y", epochs=200, optimizer=Optimizer("adam", 0.05), early_stop="weight_diff", tol=1e-6)
    assert w["x"] > 0


def test_one_vs_rest_tells_classes_apart(spark):
    rows = [(k, float(k % 3 == 1), float(k % 3 == 2), k % 3) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    models = glm.fit_one_vs_rest(df, ["a", "b"], "y", [0, 1, 2], epochs=500, lr=0.5, tol=0.0)
    assert glm.predict_class(df, models).where("y != predict_result").count() == 0


def test_goss_and_resample_edges(spark):
    none = spark.createDataFrame([], "id long, g double")
    assert gbdt.goss(none, "id", "g").count() == 0 and sampling.resample(none, "id", 5).count() == 0
    same = spark.createDataFrame([(k, 1.0) for k in range(50)], "id long, g double")
    found = gbdt.goss(same, "id", "g", by="abs").collect()
    assert sum(r.top for r in found) == 10 and len(found) == 15
    drawn = sampling.resample(same, "id", 120)
    assert drawn.count() == drawn.select("id").distinct().count() == 120


def test_manual_selection():
    assert encode.manual(["a", "b", "c"], keep=["a"], drop=["a", "b"]) == ["a", "c"]
    with pytest.raises(ValueError):
        encode.manual(["a"], drop=["a"])
