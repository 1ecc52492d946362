"""Boosting, homogeneous training and metrics against plain NumPy versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitframe.functions import evaluate
from splitframe.ml import gbdt, glm
from splitframe.ml.callbacks import Checkpoint, EarlyStop, History
from splitframe.ml.optim import METHODS, Optimizer, start_weights


def plain_trees(x, y, cuts, objective, classes, num_trees, limits, rate):
    """Boosted trees by loops over all rows: raw scores, and splits by feature with their gains."""
    b = np.stack([np.searchsorted(c[:-1], x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    start = y.mean() if objective == "regression:l2" else 0.0
    s = np.full((len(y), classes), start)
    gained = {}
    floor = lambda v: math.floor(v * 1e10) / 1e10
    cut1 = lambda g: math.copysign(max(abs(g) - limits.l1, 0), g)
    part = lambda g, h: cut1(floor(g)) ** 2 / (floor(h) + limits.l2)

    def grow(rows, g, h, depth):
        leaf = floor(-cut1(g[rows].sum()) / (h[rows].sum() + limits.l2))
        best = None
        if depth < limits.max_depth and len(rows) >= limits.min_sample_split:
            for j in range(x.shape[1]):
                for cut in range(len(cuts[j]) - 1):
                    left = rows[b[rows, j] <= cut]
                    right = rows[b[rows, j] > cut]
                    if min(len(left), len(right)) < max(1, limits.min_leaf) or min(h[left].sum(), h[right].sum()) < limits.min_child_weight:
                        continue
                    gain = floor(part(g[left].sum(), h[left].sum()) + part(g[right].sum(), h[right].sum()) - part(g[rows].sum(), h[rows].sum()))
                    if gain >= limits.min_gain and (best is None or gain > best[0]) and cut in b[rows, j]:
                        best = (gain, j, left, right)
        out = np.zeros(len(y))
        if best is None:
            out[rows] = leaf
            return out
        gained[best[1]] = gained.get(best[1], 0.0) + best[0]
        return grow(best[2], g, h, depth + 1) + grow(best[3], g, h, depth + 1)

    for _ in range(num_trees):
        if objective == "multi:ce":
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g, h = p - (y[:, None] == np.arange(classes)), 2 * p * (1 - p)
        elif objective == "binary:bce":
            p = 1 / (1 + np.exp(-s))
            g, h = p - y[:, None], p * (1 - p)
        else:
            g, h = 2 * (s - y[:, None]), np.full_like(s, 2.0)
        s = s + rate * np.stack([grow(np.arange(len(y)), g[:, k], h[:, k], 0) for k in range(classes)], 1)
    return s, gained


@pytest.mark.parametrize("objective,options", [("binary:bce", {}), ("regression:l2", {"l1": 0.5, "min_leaf": 20}), ("multi:ce", {"min_child_weight": 5.0, "min_sample_split": 60})])
def test_trees_like_plain_loops(spark, objective, options):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 3)).round(3)
    signal = x[:, 0] * 2 + (x[:, 1] > 0.3) - x[:, 2] ** 2
    y = {"binary:bce": (signal > 0).astype(int), "regression:l2": signal.round(3), "multi:ce": np.digitize(signal, [-1.0, 0.8])}[objective]
    df = spark.createDataFrame([(i, *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")
    model = gbdt.fit(df, ["a", "b", "c"], "y", objective, num_trees=2, max_depth=3, max_bin=8, **options)
    classes = 3 if objective == "multi:ce" else 1
    limits = gbdt.Limits(3, **options)
    want, gained = plain_trees(x, np.asarray(y, float), [model.cuts[f] for f in "abc"], objective, classes, 2, limits, 0.3)
    got = np.array([list(row) for row in df.orderBy("id").select(*[s.alias(f"s{k}") for k, s in enumerate(model.scores())]).collect()])
    assert np.allclose(got, want, atol=1e-8)
    assert model.importance("gain") == pytest.approx({"abc"[j]: v for j, v in gained.items()})
    if objective == "multi:ce":
        p = np.exp(want) / np.exp(want).sum(1, keepdims=True)
        rows = model.predict(df).orderBy("id").collect()
        assert [r.predict_result for r in rows] == p.argmax(1).tolist() and np.allclose([r.predict_score for r in rows], p.max(1))


def test_trees_on_one_side_samples_and_early_stop(spark):
    r = np.random.default_rng(4)
    rows = [(i, float(a), int(a + e > 0)) for i, (a, e) in enumerate(zip(r.normal(size=300), 0.2 * r.normal(size=300)))]
    df = spark.createDataFrame(rows, "id long, a double, y int")
    seen = []
    model = gbdt.fit(df, ["a"], "y", num_trees=5, goss_rates=(0.4, 0.3), sample_id="id", callback=lambda m, k: seen.append(len(m.trees)) or k == 1)
    assert seen == [1, 2] and model.importance()["a"] > 0
    assert evaluate.auc(model.predict(df), "predict_score", "y").first().auc > 0.9
    with pytest.raises(ValueError):
        gbdt.fit(df, ["a"], "y", goss_rates=(0.4, 0.3))


def test_homogeneous_training_like_numpy(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(200, 2))
    y = (x @ [1.5, -1.0] + 0.3 > 0).astype(int)
    party = np.arange(200) % 3
    df = spark.createDataFrame([(*map(float, a), int(b), int(c)) for a, b, c in zip(x, y, party)], "a double, b double, y int, party int")
    stop, saved = EarlyStop("loss", 2), []
    for method, options in (("weighted_mean", {}), ("mean", {}), ("sum", {"lr": 0.05})):
        got = glm.fit_homo_logistic(df, ["a", "b"], "y", "party", rounds=5, lr=options.get("lr", 0.5), aggregator=method, callbacks=(stop, Checkpoint(lambda m, k: saved.append(k), 2)))
        w, lr = np.zeros(3), options.get("lr", 0.5)
        one = np.c_[x, np.ones(200)]
        for _ in range(5):
            models, sizes = [], []
            for k in range(3):
                own = party == k
                g = one[own].T @ (1 / (1 + np.exp(-one[own] @ w)) - y[own]) / own.sum()
                models.append(w - lr * g)
                sizes.append(own.sum())
            models, sizes = np.array(models), np.array(sizes, float)
            w = {"mean": models.mean(0), "sum": models.sum(0), "weighted_mean": (models * sizes[:, None]).sum(0) / sizes.sum()}[method]
        assert np.allclose([got["a"], got["b"], got["intercept"]], w)
        stop = EarlyStop("loss", 2)
    assert saved == [1, 3] * 3


def test_early_stop_and_history(spark):
    stop = EarlyStop("auc", 2, higher_is_better=True)
    for k, v in enumerate([0.5, 0.7, 0.6, 0.65]):
        assert not stop.need_stop()
        stop.on_round_end(f"m{k}", k, {"auc": v})
    assert stop.need_stop() and stop.best_model == "m1" and stop.history.values("auc") == [0.5, 0.7, 0.6, 0.65]
    h = History()
    h.log("rows", 5)
    with pytest.raises(ValueError):
        h.log("rows", 6)
    assert h.table(spark).count() == 1


@pytest.mark.parametrize("method", METHODS)
def test_every_method_goes_down(method):
    lr = {"adadelta": 1.0, "rprop": 0.01, "adagrad": 0.5}.get(method, 0.05)
    opt, w = Optimizer(method, lr, eps=1e-6), np.array([3.0, -2.0])
    start = float(w @ w)
    for _ in range(300):
        w = opt.step(w, 2 * w)
    assert float(w @ w) < 0.9 * start and np.isfinite(w).all()


def test_first_steps_by_hand():
    g, w = np.array([0.5, -2.0]), np.zeros(2)
    assert Optimizer("adam", 0.1).step(w, g) == pytest.approx(-0.1 * np.sign(g), rel=1e-6)
    assert Optimizer("adamw", 0.1, weight_decay=0.5).step(np.ones(2), g) == pytest.approx(1 - 0.05 - 0.1 * np.sign(g), rel=1e-6)
    assert Optimizer("adamax", 0.1).step(w, g) == pytest.approx(-0.1 * np.sign(g), rel=1e-6)
    assert Optimizer("rprop", 0.1).step(w, g) == pytest.approx(-0.1 * np.sign(g))
    assert Optimizer("radam", 0.1).step(w, g) == pytest.approx(-0.1 * g)
    assert Optimizer("adadelta", 1.0, eps=1e-6).step(w, g) == pytest.approx(-np.sqrt(1e-6) / np.sqrt(0.1 * g * g + 1e-6) * g)
    assert Optimizer("asgd", 0.1, lambd=0.0).step(w, g) == pytest.approx(-0.1 * g)
    fast = Optimizer("sgd", 0.1, momentum=0.9, nesterov=True)
    assert fast.step(w, g) == pytest.approx(-0.1 * 1.9 * g)


def test_start_weights():
    assert start_weights(2).tolist() == [0, 0, 0] and start_weights(1, "consts", False, 2.5).tolist() == [2.5] and start_weights(2, "ones").tolist() == [1, 1, 1]
    assert start_weights(3, "random", seed=1).tolist() == start_weights(3, "random", seed=1).tolist()
    assert (start_weights(50, "random_uniform", seed=2) >= 0).all()
    with pytest.raises(ValueError):
        start_weights(1, "normal")


def test_metrics_by_type_and_multi_detail(spark):
    rows = [(k / 20, int(k % 3 == 0), "train" if k % 2 else "test") for k in range(20)]
    df = spark.createDataFrame(rows, "s double, y int, type string")
    got = {(r.type, r.metric): r.value for r in evaluate.evaluate(df, "binary", "s", "y", by="type").collect()}
    for name in ("train", "test"):
        own = [(s, y) for s, y, t in rows if t == name]
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        assert got[name, "auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
        assert got[name, "binary_accuracy"] == pytest.approx(np.mean([(s > 0.5) == y for s, y in own]))
    assert {r.metric for r in evaluate.evaluate(df, "binary", "s", "y", ["ks"]).collect()} == {"ks"}
    with pytest.raises(ValueError):
        evaluate.evaluate(df, "regression", "s", "y", ["auc"])
    made = evaluate.predict_detail_multi(df, [F.col("s"), 1 - F.col("s"), F.lit(0.5)], ["a", "b", "c"]).collect()
    assert all(r.predict_result == ("a" if r.s >= max(1 - r.s, 0.5) else "b" if 1 - r.s >= 0.5 else "c") for r in made)


def test_quantile_cuts_like_numpy(spark):
    values = [float(v) for v in np.random.default_rng(3).integers(0, 40, 101)]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    want = sorted(set(np.quantile(values, [*(round(k * 0.05, 3) for k in range(20)), 1.0], method="nearest")))
    assert evaluate.quantile_cuts(df, "s") == want
    assert evaluate.quantile_cuts(spark.createDataFrame([(1.0,)] * 3, "s double"), "s") == [1.0, 1.0]
