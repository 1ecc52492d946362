"""Dense histograms, flat forests, portable and resumed models, correlations of wide tables, and small contracts of components."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from splitframe import components
from splitframe.frame import Frame
from splitframe.ml import gbdt
from splitframe.operators import bins, dense, stat
from splitframe.sources import readers


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_sums_like_pandas(spark, monkeypatch):
    """Missing bins and nodes, bins that do not start at 0, empty partitions, names with dots; several steps a batch."""
    monkeypatch.setattr(dense, "CELLS_AT_ONCE", 100)
    r = np.random.default_rng(1)
    rows = [(None if r.random() < 0.1 else ["x", "y"][r.integers(2)], None if r.random() < 0.2 else int(r.integers(-3, 4)), int(r.integers(5, 9)), float(r.normal()), int(r.integers(10))) for _ in range(700)]
    df = spark.createDataFrame(rows, "node string, `a.b` int, c long, g double, n int").repartition(9, "node")
    made = bins.histogram(df, ["a.b", "c"], {"g": F.col("g"), "n": F.col("n"), "cnt": F.lit(1)}, F.col("node"))
    assert "Generate" not in _plan(made) and dict(made.dtypes)["n"] == "bigint" and dict(made.dtypes)["g"] == "double"
    want = {}
    for node, a, c, g, n in rows:
        for f, b in (("a.b", a), ("c", c)):
            old = want.get((node, f, b), (0.0, 0, 0))
            want[node, f, b] = (old[0] + g, old[1] + n, old[2] + 1)
    got = {(x.node, x.feature, x.bin): (x.g, x.n, x.cnt) for x in made.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert bins.histogram(df.limit(0), ["c"], {"cnt": F.lit(1)}).count() == 0
    with pytest.raises(Exception, match="outside"):
        bins.histogram(df, ["c"], {"cnt": F.lit(1)}, shape={"c": (0, 3)}).count()


def test_a_partition_sends_cells_instead_of_rows(spark):
    """What is shuffled has a row for each cell and partition, not for each feature of each row."""
    df = spark.range(20_000, numPartitions=4).select(*[(F.hash("id", F.lit(k)) % 8 + 8).alias(f"b{k}") for k in range(30)])
    made = bins.histogram(df, [f"b{k}" for k in range(30)], {"cnt": F.lit(1)})
    sent = dense.dense_sums(df, ["b0"], {"b0": (0, 16)}, {"cnt": F.lit(1)})
    assert made.agg(F.sum("cnt")).first()[0] == 20_000 * 30 and sent.count() <= 16


def _random_model(r, features=5, trees=100, depth=6, classes=1):
    cuts = {f"x{k}": sorted({round(r.gauss(0, 1), 2) for _ in range(12)}) + [math.inf] for k in range(features)}
    made = []
    for _ in range(trees):
        tree, todo, n = {}, [(0, 0)], 1
        while todo:
            here, d = todo.pop(0)
            if d == depth or r.random() < 0.15:
                tree[here] = r.gauss(0, 1)
                continue
            f = r.choice(list(cuts))
            tree[here] = (f, r.randrange(len(cuts[f]) - 1), n, n + 1, r.random())
            todo += [(n, d + 1), (n + 1, d + 1)]
            n += 2
        made.append(tree)
    return gbdt.Model(cuts, 0.1, "multi:ce" if classes > 1 else "regression:l2", 0.25, classes, made)


def _plain_score(model, row, k=0):
    total = model.start
    for tree in model.trees[k :: model.classes]:
        n = 0
        while isinstance(tree[n], tuple):
            f, b, left, right, _ = tree[n]
            x = row[f]
            n = right if x is None or sum(c < x or math.isnan(x) for c in model.cuts[f][:-1]) > b else left
        total += model.learning_rate * tree[n]
    return total


@pytest.mark.parametrize("classes", [1, 4])
def test_forest_of_100_trees_like_plain_loops(spark, classes):
    r = random.Random(classes)
    model = _random_model(r, classes=classes)
    rows = [{f: None if r.random() < 0.1 else math.nan if r.random() < 0.05 else r.choice(model.cuts[f][:-1]) if r.random() < 0.3 else r.gauss(0, 1) for f in model.cuts} for _ in range(300)]
    df = spark.createDataFrame([(i, *x.values()) for i, x in enumerate(rows)], "id int, " + ", ".join(f"{f} double" for f in model.cuts))
    again = gbdt.Model.from_dict(json.loads(json.dumps(model.to_dict())))
    assert again == model
    found = df.orderBy("id").select(*again.scores()).collect()
    assert np.allclose([list(x) for x in found], [[_plain_score(model, x, k) for k in range(classes)] for x in rows])
    plan = _plan(again.predict(df))
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("objective,classes", [("binary:bce", 2), ("multi:ce", 3), ("regression:l2", 1)])
def test_resumed_boosting_is_like_boosting_at_once(spark, objective, classes):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 2)).round(2)
    y = np.digitize(x[:, 0] + x[:, 1] ** 2, [0.5, 1.5][: max(classes - 1, 1)]) if classes > 1 else x[:, 0]
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, y double")
    whole = gbdt.fit(df, ["a", "b"], "y", objective, num_trees=4, max_depth=2)
    two = gbdt.fit(df, ["a", "b"], "y", objective, num_trees=2, max_depth=2)
    both = gbdt.fit(df, ["a", "b"], "y", objective, num_trees=2, max_depth=2, warm_start=gbdt.Model.from_dict(two.to_dict()))
    assert len(two.trees) * 2 == len(both.trees) == len(whole.trees)
    for a, b in zip(whole.trees, both.trees):
        assert a.keys() == b.keys()
        assert all(x[:4] == y[:4] if isinstance(x, tuple) else x == pytest.approx(y, abs=1e-8) for x, y in ((a[n], b[n]) for n in a))
    with pytest.raises(ValueError):
        gbdt.fit(df, ["a"], "y", objective, warm_start=two)


def test_missing_values_go_right(spark):
    rows = [(None, 1)] * 30 + [(float(k), 0) for k in range(30)]
    df = spark.createDataFrame(rows, "a double, y int")
    model = gbdt.fit(df, ["a"], "y", num_trees=1, max_depth=1)
    assert model.trees[0][0][1] == len(model.cuts["a"]) - 1
    found = model.predict(df).groupBy("y").agg(F.min("predict_score"), F.max("predict_score")).collect()
    assert all((r[1] > 0.5) == (r.y == 1) == (r[2] > 0.5) for r in found)


def test_correlation_like_numpy_with_missing_values(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 6)) * [1, 1e4, 1, 1, 1, 0] + [0, 1e6, 0, 0, 0, 3]
    x[:, 2] = x[:, 0] * 2 + r.normal(size=500)
    x[r.random(x.shape) < 0.1] = np.nan
    x[:, 4] = np.nan
    names = [f"c.{k}" for k in range(6)]
    pdf = pd.DataFrame(x, columns=names)
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"`{n}` double" for n in names)).repartition(5)
    want = pdf.corr().to_numpy()
    found = stat.correlation_matrix(df, names)
    assert np.allclose(found[:4, :4], want[:4, :4], atol=1e-10) and np.isnan(found[4]).all() and np.isnan(found[5]).all()
    rows = {(a.x, a.y): a["corr"] for a in stat.correlation(df, names).collect()}
    assert len(rows) == 36 and rows["c.4", "c.0"] is None and rows["c.0", "c.2"] == pytest.approx(want[0, 2])


def test_correlation_of_a_wide_table(spark):
    """330 columns are one matrix, not 54,615 aggregates."""
    df = spark.range(2000, numPartitions=4).select(*[F.rand(k).alias(f"c{k}") for k in range(330)])
    assert stat.correlation_matrix(df, df.columns).shape == (330, 330)


def test_kurtosis_as_some_tools_have_it(spark):
    x = np.array([1.0, 2.0, 2.5, 7.0, -1.0])
    df = spark.createDataFrame([(float(v), 1.0) for v in x], "x double, one double")
    found = {r["column"]: r.value for r in stat.statistics(df, ["x", "one"], ["kurt"], compat_kurt=True).collect()}
    d = x - x.mean()
    assert found == {"x": pytest.approx((d**4).mean() / (d**2).mean() ** 4 - 3), "one": -3.0}


def test_components_union_reader_and_portable_trees(spark, tmp_path):
    df = spark.createDataFrame([(k, float(k % 7), k % 2) for k in range(40)], "id long, a double, y int")
    df.write.parquet(f"{tmp_path}/t.parquet")
    frame = components.create("reader", uri=f"file://{tmp_path}/t.parquet", sample_id="id", label="y").train(spark)
    assert frame.columns == ["a"] and frame.roles.label == "y" and frame.count() == 40
    parts = [frame._with(frame.df.where("id < 15")), frame._with(frame.df.where("id >= 15"))]
    assert components.create("union").train(parts).count() == 40
    trees = components.create("boosted_trees", num_trees=1, max_depth=2)
    trees.train(frame)
    more = components.create("boosted_trees", num_trees=1, max_depth=2)
    more.train(frame, warm_start=trees)
    again = components.create("boosted_trees", num_trees=1, max_depth=2)
    again.model = json.loads(json.dumps(more.model))
    assert len(again.model["trees"]) == 2
    assert again.predict(frame).orderBy("id").collect() == more.predict(frame).orderBy("id").collect()


def test_selection_keeps_the_lowest_where_low_is_wanted(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 9.0)], "id int, a double, b double")
    frame = Frame.from_spark(df, "id", features=["a", "b"])
    for high, kept in ((True, ["b"]), (False, ["a"])):
        made = components.create("feature_selection", methods=["statistic"], statistic={"metrics": ["mean"], "threshold": 1e9 if high else -1e9, "take_high": high})
        assert made.train(frame).columns == kept


def test_delimiters_are_not_patterns(spark, tmp_path):
    for k, cut in enumerate([".", "|", "^", "*", "+", "$", "||", "\\", "a.", "\t"]):
        path = f"{tmp_path}/{k}"
        spark.createDataFrame([(f"id{cut}1{cut}2",)], "value string").write.text(path)
        row = readers.read_keyed_table(spark, path, ["x", "y"], delimiter=cut, dtype="int").df.first()
        assert (row["x"], row["y"]) == (1, 2), cut
