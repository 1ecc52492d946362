"""Frames, readers, keyed tables, components, artifacts and exchanges on small tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from splitframe import components
from splitframe.artifacts import Artifacts
from splitframe.frame import Frame
from splitframe.ml import tensor
from splitframe.operators import align, kv, sampling
from splitframe.party import Exchange
from splitframe.sources import readers
from splitframe.streaming import events


def make(spark, rows, schema="id long, a double, b double", sid="id", **roles):
    return Frame.from_spark(spark.createDataFrame(rows, schema), sid, **roles)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def got(frame):
    return sorted(map(tuple, frame.df.collect()), key=str)


# Frames
def test_frames_of_one_table_meet_without_a_join(spark):
    f = make(spark, [(1, 1.0, 9.0), (1, 5.0, 2.0), (2, 7.0, None)])
    for made in (f[f > 4], f + f, f * f["a"], f.iloc(f["a"] > 2), f.assign({"c": f["a"]}), Frame.hstack([f["a"], f["b"]]), f.with_role("label", f["b"])):
        assert "Join" not in plan(made.df)
    assert got(f[f > 4]) == [(1, 5.0, None), (1, None, 9.0), (2, 7.0, None)]
    assert got(f.iloc(f["a"] > 2)["a"]) == [(1, 5.0), (2, 7.0)]


def test_frames_of_other_tables_need_unique_ids(spark):
    f, g = make(spark, [(1, 1.0, 2.0), (2, 3.0, 4.0)]), make(spark, [(2, 10.0, 20.0), (1, 1.0, 1.0)])
    assert got(f + g) == [(1, 2.0, 3.0), (2, 13.0, 24.0)]
    twice = make(spark, [(1, 1.0, 1.0), (1, 2.0, 2.0), (2, 0.0, 0.0)])
    with pytest.raises(Exception, match="repeat"):
        (f + twice).df.collect()
    assert len(got(twice + g)) == 3  # repeated on the left, each row meets one


def test_names_that_look_like_working_names(spark):
    rows = [(1, 1.0, 2.0), (2, 3.0, 4.0)]
    f, g = (make(spark, rows, "_id long, _r0 double, ___0 double", "_id") for _ in "xy")
    assert got(f + g) == [(1, 2.0, 4.0), (2, 6.0, 8.0)] and got(f[g > 2]) == [(1, None, None), (2, 3.0, 4.0)]
    left = spark.createDataFrame([(1, 1, 1)], "k int, _l int, _r__l int")
    assert kv.union(left, left, "k", lambda a, b: a + b).collect() == [(1, 2, 2)]
    numbered = spark.createDataFrame([(1, "x"), (2, "y")], "id long, _p string")
    assert sorted(r._p for r in sampling.split(numbered, "id", 1, 1, 0).collect()) == ["x", "y"]


def test_roles_can_be_renamed_and_assigned(spark):
    f = make(spark, [(1, 1.0, 2.0, 0)], "id long, a double, b double, y int", label="y")
    g = f.rename({"a": "A"}, label="target", sample_id="sid")
    assert g.df.columns == ["sid", "target", "A", "b"] and g.roles.label == "target"
    with pytest.raises(ValueError):
        f.rename({"a": "b"})
    with pytest.raises(ValueError):
        f.rename(weight="w")
    assert got(f.with_role("weight", f["b"])) == [(1, 0, 2.0, 1.0, 2.0)]
    with pytest.raises(ValueError):
        f.with_role("label", f)
    assert f.anonymous_columns(["local_x1"]).columns == ["b"]
    with pytest.raises(ValueError):
        f.anonymous_columns(["local_y"])


def test_rows_by_id(spark):
    f = make(spark, [(k, float(k), 0.0) for k in range(10)])
    wanted = spark.createDataFrame([(7, 0), (2, 1), (9, 2), (50, 3)], "id long, place int")
    assert [r.id for r in f.loc(wanted, order="place").df.collect()] == [7, 2, 9]
    assert sorted(r.id for r in f.loc(wanted).df.collect()) == [2, 7, 9]
    with pytest.raises(ValueError):
        f.loc(wanted, target="match_id")
    pairs = spark.createDataFrame([(1, 100), (3, 300)], "id long, new_sample_id long")
    assert sorted(r.id for r in f.loc_with_sample_id_replacement(pairs).df.collect()) == [100, 300]
    assert [r["id"] for r in f.data_overview(3)] == [0, 1, 2]
    assert f.shape == (10, 2) and f.empty_frame().count() == 0


def test_functions_of_rows(spark):
    f = make(spark, [(1, 1.0, 2.0, 1), (2, None, 4.0, 0)], "id long, a double, b double, y int", label="y")
    made = f.apply_row(lambda r: (r["b"] * 10, r["y"]), "x double, z int", with_label=True)
    assert made.columns == ["x", "z"] and got(made) == [(1, 1, 20.0, 1), (2, 0, 40.0, 0)]
    assert got(f.apply_row({"s": F.col("a") + F.col("b")})) == [(1, 1, 3.0), (2, 0, None)]
    with pytest.raises(ValueError):
        f.apply_row(lambda r: 1)


def test_arithmetic_both_ways(spark):
    f = make(spark, [(1, 4.0, 0.0)])
    assert got(10 - f) == [(1, 6.0, 10.0)] and got(f ** 2) == [(1, 16.0, 0.0)] and got(2 * f + 1) == [(1, 9.0, 1.0)] and got(f / 0) == [(1, None, None)]


def test_frame_on_storage(spark, tmp_path):
    f = make(spark, [(1, 1.0, 2.0, 3.0)], "id long, w double, a double, b double", weight="w")
    f.write(str(tmp_path / "f"))
    assert Frame.read(spark, str(tmp_path / "f")).roles == f.roles and got(Frame.read(spark, str(tmp_path / "f"))) == got(f)


# Readers
def test_keyed_table_with_roles_and_missing_values(spark, tmp_path):
    (tmp_path / "t.txt").write_text("k1,m1,1,0.5,3.25,NA\nk2,m2,0,1.5,-,7\nk3,m3,1,,x,\n")
    f = readers.read_keyed_table(spark, str(tmp_path / "t.txt"), ["m", "y", "w", "a", "b"], "id", "m", "y", "w", dtype={"a": "double", "b": "int"}, na_values={"a": ["-"], "b": ["NA"]})
    assert got(f) == [("k1", "m1", 1, 0.5, 3.25, None), ("k2", "m2", 0, 1.5, None, 7), ("k3", "m3", 1, None, None, None)]
    assert dict(f.df.dtypes) == {"id": "string", "m": "string", "y": "int", "w": "float", "a": "double", "b": "int"}
    piped = tmp_path / "p.txt"
    piped.write_text("k1|2|3\n")
    assert got(readers.read_keyed_table(spark, str(piped), ["a", "b"], "id", delimiter="|", na_values="3")) == [("k1", 2.0, None)]


def test_csv_pandas_and_parallel_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,y,a\n1,0,?\n2,1,2.5\n")
    f = readers.read_csv(spark, str(tmp_path / "t.csv"), "id long, y int, a double", "id", na_values="?", label="y")
    assert got(f) == [(1, 0, None), (2, 1, 2.5)]
    g = readers.from_pandas(spark, pd.DataFrame({"a": [1.0, float("nan")]}))
    assert got(g) == [(0, 1.0), (1, None)]
    with pytest.raises(ValueError):
        readers.from_pandas(spark, pd.DataFrame({"s": [1], "a": [1.0]}), sample_id="s")
    assert sorted(readers.parallelize(spark, ["x", "y"], "k long, v string", include_key=False).collect()) == [(0, "x"), (1, "y")]
    assert readers.parallelize(spark, [(5, "x")], "k long, v string", partitions=3).rdd.getNumPartitions() == 3


def test_load_and_save_by_address(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b")], "k long, v string")
    readers.save(df, f"file://{tmp_path}/x.parquet", 2)
    assert readers.load(spark, f"file://{tmp_path}/x.parquet").collect() == [(1, "a,b")]
    (tmp_path / "t.txt").write_text("k,rest,of it\n")
    assert readers.load(spark, f"file://{tmp_path}/t.txt").collect() == [("k,rest,of it",)]
    assert readers.read_keyed_text(spark, f"{tmp_path}/t.txt").collect() == [("k", "rest,of it")]
    assert got(readers.read_parquet(spark, f"file://{tmp_path}/x.parquet", "k")) == [(1, "a,b")]
    with pytest.raises(ValueError):
        readers.load(spark, "ftp://x/y")


# Keyed tables
def test_reductions_by_function(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(50)], "k long, v long").repartition(5)
    assert kv.reduce_with(df, lambda a, b: a + b, "k") == sum(range(50))
    assert kv.reduce_with(df.limit(0), lambda a, b: a + b, "k") is None
    assert sorted(kv.map_reduce_partitions(df, lambda r: [(r["v"], r["k"])], max, "v long, most long").collect()) == [(0, 48), (1, 49), (2, 47)]
    assert sum(r.n for r in kv.apply_partitions_with(df, lambda rows: sum(1 for _ in rows), "n long").collect()) == 50
    assert kv.map_partitions(df, lambda rows: (r["k"] for r in rows if r["k"] > 47), "k long", batch=False).count() == 2
    assert kv.union_all([df, df]).count() == 100
    assert kv.map_rows(df.limit(0), lambda r: 1, "x int").count() == 0


# Alignment
def test_alignment_finds_repeated_host_ids(spark):
    guest = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "sid long, m string")
    host = spark.createDataFrame([("a", 10), ("c", 30), (None, 5)], "h string, x int")
    for salt in (None, "s"):
        assert sorted(align.align(guest, [(host, "h")], "sid", "m", salt).collect()) == [(1, "a", 10), (2, "a", 10)]
    with pytest.raises(Exception, match="duplicate match_id"):
        align.align(guest, [(host.unionAll(host), "h")], "sid", "m").collect()


def test_folds_in_the_order_of_ids(spark):
    df = spark.createDataFrame([(k,) for k in range(23)], "id long").repartition(4)
    for shuffle in (True, False):
        found = sorted((r.fold, r.id) for r in sampling.k_fold(df, "id", 5, shuffle=shuffle).collect())
        assert [sum(f == k for f, _ in found) for k in range(5)] == [5, 5, 5, 4, 4]
    assert [i for _, i in found] == list(range(23))


def test_share_of_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert sampling.sample(df, "k", frac=0.9).count() == 900
    assert {r.k for r in sampling.sample(df, "k", frac=0.01).collect()} == {r.k for r in sampling.sample(df, "k", n=10).collect()}


# Components
def test_registry(spark):
    assert {"feature_scale", "feature_binning", "feature_selection", "feature_correlation", "sample", "data_split", "statistics", "psi", "evaluation", "linear_regression", "logistic_regression", "boosted_trees"} <= set(components.names())
    about = components.describe("feature_binning")
    assert about["stages"] == ["train", "predict"] and about["parameters"]["n_bins"] == 10

    @components.component("doubled")
    class Doubled:
        def __init__(self, by: float = 2.0):
            self.by = by

        def train(self, frame):
            return frame * self.by

    assert got(components.create("doubled", by=3.0).train(make(spark, [(1, 1.0, 2.0)]))) == [(1, 3.0, 6.0)]
    with pytest.raises(ValueError):
        components.component("doubled")(Doubled)
    with pytest.raises(ValueError):
        components.create("nothing")
    with pytest.raises(TypeError):
        components.create("doubled", unknown=1)
    with pytest.raises(ValueError):
        components.component("empty")(object)


def test_scale_binning_and_selection(spark):
    f = make(spark, [(k, float(k), float(k % 5), "xy"[k % 2], int(k > 30)) for k in range(50)], "id long, a double, b double, c string, y int", label="y")
    scale = components.create("feature_scale", scale_col=["a"])
    out = scale.train(f["a"])
    assert abs(sum(r.a for r in out.df.collect())) < 1e-9
    assert got(scale.predict(make(spark, [(1, 24.5)], "id long, a double"))) == [(1, 0.0)]
    none = components.create("feature_scale").train(make(spark, [(1, None)], "id long, a double"))
    assert got(none) == [(1, None)]
    for method, options in (("quantile", {}), ("bucket", {}), ("manual", {"split_pt_dict": {"a": [10, 30, 60], "b": [2, 4]}})):
        made = components.create("feature_binning", method=method, n_bins=5, category_col=["c"], transform_method="woe", **options)
        made.train(f)
        assert set(made.model["iv"]) == {"a", "b", "c"} and made.model["iv"]["a"] > made.model["iv"]["b"]
    pick = components.create("feature_selection", methods=["iv"], iv={"filter_type": "top_k", "threshold": 1})
    assert pick.train(f, made).columns == ["a"] and pick.predict(f).columns == ["a"]
    kept = components.FeatureSelection.by_mask(f, pick.mask(f))
    assert kept.columns == ["a"]
    numbers = f[["a", "b"]]
    assert components.create("feature_selection", methods=["statistic", "manual"], statistic={"metrics": ["mean", "max"], "threshold": 3.0}, manual={"filter_out_col": ["b"]}).train(numbers).columns == ["a"]
    assert components.create("feature_selection", methods=["statistic"], statistic={"threshold": 1e9}).train(numbers).columns == ["a"]
    with pytest.raises(ValueError):
        components.create("feature_binning", method="manual")
    with pytest.raises(ValueError):
        components.create("feature_binning", method="manual", split_pt_dict={"a": [1.0]}).train(numbers)


def test_samples_splits_and_alignment_as_components(spark):
    f = make(spark, [(k, float(k), 0.0, k % 2) for k in range(40)], "id long, a double, b double, y int", label="y")
    assert components.create("sample", n=7).train(f).count() == 7 and components.create("sample", frac={0: 0.5, 1: 0.25}).train(f).count() == 15
    assert components.create("sample", n=60, replace=True).train(f).count() == 60
    assert [x.count() for x in components.create("data_split", train_size=0.5, validate_size=0.25, test_size=0.25, stratified=True).train(f)] == [20, 10, 10]
    host = make(spark, [(1, 5, 9.0), (2, 8, 7.0)], "hid long, m long, z double", "hid", match_id="m")
    guest = make(spark, [(10, 5, 1.0), (11, 6, 2.0)], "id long, m long, a double", match_id="m")
    assert got(components.create("psi").train(guest, [host])) == [(10, 5, 1.0, 9.0)]
    found = components.create("feature_correlation").train(f[["a"]], make(spark, [(k, float(-k)) for k in range(40)], "id long, z double"))
    assert [round(r["corr"], 6) for r in found["across"].collect()] == [-1.0]
    assert components.create("statistics", metrics=["mean"], skip_col=["b"]).train(f).collect()[0]["value"] == 19.5


def test_learners_cross_validate(spark):
    rows = [(k, k / 10, float(k % 7), int(k > 45), k % 3) for k in range(90)]
    f = make(spark, rows, "id long, a double, b double, y int, z int", label="y", features=["a", "b"])
    metrics, data = components.create("boosted_trees", num_trees=2, max_depth=2).cross_validation(f, 3, output_cv_data=True)
    assert {(r.fold, r.metric) for r in metrics.collect()} >= {(k, "auc") for k in range(3)} and data.count() == 90
    assert min(r.value for r in metrics.where("metric = 'auc'").collect()) > 0.95
    lr = components.create("logistic_regression", epochs=30, lr=0.02)
    assert lr.train(f).columns[-3:] == ["predict_score", "predict_result", "predict_detail"]
    many = Frame(f.base, f.roles)
    multi = make(spark, rows, "id long, a double, b double, y int, z int", label="z", features=["a", "b"])
    assert {r.metric for r in components.create("logistic_regression", classes=[0, 1, 2], epochs=3).cross_validation(multi, 2).collect()} == {"multi_accuracy", "multi_precision", "multi_recall"}
    assert components.create("evaluation", label_column="y").train(lr.predict(many)).count() == 5


# Artifacts and exchanges
def test_artifacts(spark, tmp_path):
    a = Artifacts(spark, str(tmp_path))
    a.write_model("m", {"w": [1.5, None]}, {"by": "test"})
    a.write_table("t", spark.range(3))
    a.write_frame("f", make(spark, [(1, 1.0, 2.0)]))
    for step in (0, 1):
        a.append_metrics(spark.createDataFrame([("train", "loss", step, 0.5)], "group string, metric string, step int, value double"))
    assert a.read_model("m") == {"w": [1.5, None]} and a.read_table("t").count() == 3 and a.read_frame("f").columns == ["a", "b"] and a.metrics().count() == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        a.write_table("t", spark.range(1))


def test_exchange_in_memory_and_in_a_folder(spark, tmp_path):
    f = make(spark, [(1, 1.0, 2.0)])
    for x in (Exchange(), Exchange(spark, str(tmp_path))):
        x.send(f, "scores", "host", ["id", "a"])
        assert x.receive("scores", "host").collect() == [(1, 1.0)] and x.log == [("scores", "host", ("id", "a"))]
        with pytest.raises(ValueError):
            x.send(f, "scores", "host", ["id"])
    assert Exchange(spark, str(tmp_path)).receive("scores", "host").count() == 1
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        Exchange(spark, str(tmp_path)).send(f, "scores", "host", ["id"])


# Tensors
def test_tensors_meet_and_check_shapes(spark):
    a = tensor.from_shards(spark, [[[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0]]])
    assert tensor.to_local(tensor.binary(a, a, "mul")) == [[1.0, 4.0], [9.0, 16.0], [25.0, 36.0]]
    assert tensor.to_local(tensor.binary(a, [10.0, 20.0], "add"))[0] == [11.0, 22.0] and tensor.to_local(tensor.binary(a, 2, "div"))[0] == [0.5, 1.0]
    assert tensor.to_local(tensor.binary(tensor.columns(a, [0]), a, "sub"))[1] == [0.0, -1.0]
    with pytest.raises(Exception, match="shapes differ"):
        tensor.binary(a, [1.0, 2.0, 3.0], "add").collect()
    with pytest.raises(Exception, match="shapes differ"):
        tensor.binary(a, tensor.rows(a, slice(0, 2)), "add").collect()
    with pytest.raises(ValueError):
        tensor.from_shards(spark, [[[1.0], [1.0, 2.0]]])
    with pytest.raises(ValueError):
        tensor.checked(a.unionAll(a))
    assert tensor.shape(tensor.stack([a, a])) == (6, 2) and tensor.to_local(tensor.rows(tensor.stack([a, a]), [3])) == [[1.0, 2.0]]
    assert [r.row_id for r in tensor.rows(a, slice(0, 3, 2)).collect()] == [0, 2]
    b = tensor.from_shards(spark, [[[1.0, 0.0, 2.0], [0.0, 1.0, 1.0]]])
    assert {(r.i, r.j): r.x for r in tensor.matmul(a, b).collect()}[2, 2] == 16.0
    assert {(r.i, r.j): r.x for r in tensor.rmatmul_local([[1.0, 1.0, 1.0]], a).collect()} == {(0, 0): 9.0, (0, 1): 12.0}
    with pytest.raises(ValueError):
        tensor.matmul(a, a)
    assert tensor.dot(a, a) == 91.0
    assert tensor.to_local(tensor.keeping_dims(tensor.by_column(a), "sum", 0)) == [[9.0, 12.0]] and tensor.to_local(tensor.keeping_dims(tensor.by_row(a), "mean", 1)) == [[1.5], [3.5], [5.5]]
    assert tensor.by_row(a, unbiased=False).first()["var"] == 0.25
    assert tensor.to_local(tensor.from_fixed_point(tensor.fixed_point(a, 8), 8)) == tensor.to_local(a)
    assert sorted(r.x for r in tensor.map_reduce(a, lambda v: v, "max", 2).collect()) == [3.0, 4.0, 5.0, 6.0]


# Streams
def test_windows_on_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)]
    spark.createDataFrame(rows, "t string, event_type string, value double").selectExpr("cast(t as timestamp) ts", "event_type", "value").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    made = events.tumbling(source, late="2 hours")
    q = made.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("windows").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
