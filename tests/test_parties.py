"""Tiles, mini-batches, samples by rank, alignment of many hosts, hosts that follow the guest, and the stateful stream operator."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitframe.ml import glm, tensor, tiles
from splitframe.operators import align, encode, follow, sampling
from splitframe.party import Exchange
from splitframe.streaming import state


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _tensor(spark, m, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids if ids is not None else range(len(m)), m)], "row_id long, v array<double>").repartition(3)


@pytest.mark.parametrize("side,block", [(4, 2), (3, 5), (128, 8)])
def test_product_of_tiles_like_numpy(spark, side, block):
    r = np.random.default_rng(side)
    a, b = r.normal(size=(11, 9)), r.normal(size=(9, 13))
    made = tiles.product(tiles.from_rows(_tensor(spark, a), side), tiles.from_rows(_tensor(spark, b), side), side, block)
    got = np.zeros((11, 13))
    for c in tiles.cells(made, side).collect():
        got[c.i, c.j] = c.x
    assert np.allclose(got, a @ b)
    back = np.zeros((9, 11))
    for c in tiles.cells(tiles.transposed(tiles.from_rows(_tensor(spark, a), side), side), side).collect():
        back[c.i, c.j] = c.x
    assert (back == a.T).all()


def test_tiles_of_some_rows(spark):
    """Rows that are missing stay missing on the left; only tiles are shuffled."""
    a, ids = np.arange(12.0).reshape(4, 3), [2, 3, 9, 700]
    made = tensor.matmul(_tensor(spark, a, ids), _tensor(spark, np.eye(3)))
    got = {(c.i, c.j): c.x for c in made.collect()}
    assert got == {(i, j): a[k, j] for k, i in enumerate(ids) for j in range(3)} and dict(made.dtypes)["j"] == "int"
    assert "SortMergeJoin" not in _plan(made) and "BroadcastHashJoin" not in _plan(made)
    with pytest.raises(ValueError):
        tensor.matmul(_tensor(spark, a), _tensor(spark, np.eye(4)))


@pytest.mark.parametrize("method,kind", [("sgd", "linear"), ("adam", "logistic"), ("rprop", "logistic"), ("nadam", "linear")])
def test_mini_batches_resume_as_if_not_stopped(spark, method, kind, monkeypatch):
    r = np.random.default_rng(3)
    x = r.normal(size=(150, 2))
    y = (x @ [1.0, -2.0] > 0).astype(float) if kind == "logistic" else x @ [1.0, -2.0] + 0.5
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    options = {"kind": kind, "method": method, "lr": 0.02, "schedule": "step", "rates": {"every": 2, "factor": 0.5}}
    whole = glm.fit_mini_batch(df, ["a", "b"], "y", "id", 32, 4, **options)
    half = glm.fit_mini_batch(df, ["a", "b"], "y", "id", 32, 2, **options)
    monkeypatch.setattr(glm, "SUMS_HELD", 0)  # sums are read again in each epoch
    both = glm.fit_mini_batch(df, ["a", "b"], "y", "id", 32, 2, warm_start=json.loads(json.dumps(half)), **options)
    assert both["epoch"] == whole["epoch"] == 4
    assert np.allclose(list(both["weights"].values()), list(whole["weights"].values()), atol=1e-12) and both["loss"] == pytest.approx(whole["loss"])


def test_mini_batches_like_numpy(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(100, 2))
    y = x @ [0.5, 2.0] + 1
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    order = [row.id for row in sampling.numbered(df, "id", 42).orderBy("_n").collect()]
    one, w = np.c_[x, np.ones(100)], np.zeros(3)
    for _ in range(3):
        for low in range(0, 100, 30):
            own = order[low : low + 30]
            w = w - 0.1 * one[own].T @ (one[own] @ w - y[own]) / len(own)
    got = glm.fit_mini_batch(df, ["a", "b"], "y", "id", 30, 3, "linear", lr=0.1)
    assert np.allclose(list(got["weights"].values()), w)


def test_samples_are_a_filter(spark, monkeypatch):
    monkeypatch.setattr(sampling, "ROWS_IN_PREFIX", 2)
    df = spark.range(5000).select((F.col("id") * 3).alias("k"), F.lit("x").alias("p")).repartition(4)
    want = [r.k for r in df.orderBy(sampling.key(42, "k"), "k").select("k").collect()]
    for n in (0, 1, 499, 4999, 5000, 9000):
        made = sampling.sample(df, "k", n)
        assert sorted(r.k for r in made.collect()) == sorted(want[:n])
    plan = _plan(sampling.sample(df, "k", 500))
    assert "Sort" not in plan and "Window" not in plan and "Limit" not in plan
    assert sampling.sample(df, "k", frac=0.1).count() == 500


def test_top_rows_like_pandas(spark):
    r = np.random.default_rng(5)
    rows = [(i, None if r.random() < 0.05 else float(r.integers(0, 6)), int(r.integers(0, 4)), ["u", "v"][r.integers(2)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b int, s string").repartition(4)
    less = lambda x: (x is None, 0 if x is None else -x)
    for columns in (["a"], ["a", "b"], ["b", "a"]):
        place = [{"a": 1, "b": 2}[c] for c in columns]
        order = sorted(rows, key=lambda x: ([less(x[p]) for p in place], x[0]))
        for n in (1, 37, 200, 395, 400, 500):
            assert sorted(x.id for x in encode.top_rows(df, n, columns, "id").collect()) == sorted(x[0] for x in order[:n]), (columns, n)
            nth = [order[min(n, 400) - 1][p] for p in place]
            ties = [x for x in order[n:] if [x[p] for p in place] == nth]
            assert encode.top_rows(df, n, columns, "id", "last").count() == min(n, 400) + len(ties)
    assert [x.id for x in encode.top_rows(df, 3, ["s"], "id").orderBy("id").collect()] == sorted([x[0] for x in rows if x[3] == "v"])[:3]


def test_top_rows_with_an_error(spark):
    values = np.random.default_rng(6).permutation(5000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double").repartition(4)
    some = [r.v for r in encode.top_rows(df, 500, ["v"], "id", "last", error=0.02).collect()]
    assert 500 <= len(some) <= 500 + 2 * 0.02 * 5000 + 1 and min(some) >= 5000 - len(some)
    assert encode.top_rows(df, 500, ["v"], "id", error=0.02).count() == 500


def test_many_hosts_in_one_shuffle(spark):
    guest = spark.createDataFrame([(i, i % 7) for i in range(50)] + [(99, None)], "sid long, m long")
    hosts = [spark.createDataFrame([(m, f"{k}{m}") for m in range(k, 7)] + [(None, "none")], f"h{k} long, `v.{k}` string").repartition(2) for k in range(4)]
    made = align.align(guest.repartition(3), [(h, f"h{k}") for k, h in enumerate(hosts)] + [(spark.createDataFrame([(m,) for m in range(6)], "h9 long"), "h9")], "sid", "m")
    assert made.columns == ["sid", "m", *(f"v.{k}" for k in range(4))]
    rows = made.collect()
    assert sorted(r.sid for r in rows) == [i for i in range(50) if 3 <= i % 7 < 6] and all(r["v.2"] == f"2{r.m}" for r in rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = align.align(guest.repartition(3), [(h, f"h{k}") for k, h in enumerate(hosts)], "sid", "m")
        assert len(re.findall(r"Exchange hashpartitioning", _plan(again))) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hosts_follow_the_guest(spark, tmp_path):
    guest = spark.createDataFrame([(f"s{i}", i) for i in range(100)], "sid string, m long").repartition(3)
    host = spark.createDataFrame([(i, float(i)) for i in range(40, 160)], "hid long, v double").repartition(4)
    exchange = Exchange(spark, str(tmp_path))
    leader = follow.Leader(exchange, guest, "sid", "m", ["b"])
    follower = follow.Follower(Exchange(spark, str(tmp_path)), "b", host, "hid")
    for name, ranges in (("split", follow.split_ranges(leader.total, 0.6, 0.2, 0.2)), ("folds", follow.fold_ranges(leader.total, 3)), ("sample", follow.sample_range(leader.total, 17))):
        own, theirs = leader.select(name, ranges), follower.select(name)
        assert own.keys() == theirs.keys()
        for part in own:
            a, b = {r.m: r.row_number for r in own[part].collect()}, {r.hid: r.row_number for r in theirs[part].collect()}
            assert b == {m: k for m, k in a.items() if m >= 40}
        if name == "split":
            assert [own[p].count() for p in ("train", "validate", "test")] == [60, 20, 20]
        if name == "folds":
            assert sorted(own[f"validate {k}"].count() for k in range(3)) == [33, 33, 34] and own["train 0"].count() == 66
    assert leader.select("none", {"empty": []})["empty"].count() == 0 == follower.select("none")["empty"].count()
    with pytest.raises(ValueError):
        leader.select("split", {})


def test_guest_splits_like_the_plain_split(spark):
    df = spark.createDataFrame([(i, i) for i in range(70)], "sid long, m long")
    leader = follow.Leader(Exchange(spark), df, "sid", "m", [])
    made = leader.select("split", follow.split_ranges(70, 0.5, 0.25, 0.25))
    want = sampling.split(df, "sid", 0.5, 0.25, 0.25)
    for part in made:
        assert sorted(r.sid for r in made[part].collect()) == sorted(r.sid for r in want.where(F.col("split") == part).collect())


def test_events_once_and_late_ones_apart(spark, tmp_path):
    """Repeats within and across batches, late rows to a table of their own, ids that leave the state, and a restart."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.STORE)
    schema = "event_id long, user_id long, ts timestamp, `a value` double"
    at = lambda minutes: f"2024-01-01 {minutes // 60:02d}:{minutes % 60:02d}:00"
    batches = [
        [(1, 7, at(0), 1.0), (1, 7, at(0), 1.0), (2, 7, at(30), 2.0), (3, 8, at(0), 3.0)],
        [(1, 7, at(1), 1.5), (2, 7, at(30), 2.0), (4, 7, at(25), 4.0), (5, 7, at(5), 5.0), (6, 8, at(1), 6.0), (7, None, at(1), 0.0)],
        [(8, 7, at(120), 8.0)],
        [(2, 7, at(30), 2.0), (8, 7, at(119), 8.0), (9, 7, at(115), 9.0)],
    ]
    places = [f"{tmp_path}/{x}" for x in ("in", "on_time", "late", "checkpoint")]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, user_id long, ts string, v double").select("event_id", "user_id", F.to_timestamp("ts").alias("ts"), F.col("v").alias("a value")).coalesce(1).write.parquet(f"{places[0]}/{k}")
        marked = state.once(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(places[0]), "user_id", "event_id", "ts", 10 * 60 * 1000)
        running = state.routed(marked, *places[1:])
        running.processAllAvailable()
        running.stop()
    on_time = sorted(r.event_id for r in spark.read.parquet(places[1]).collect())
    late = sorted((r.event_id, r["a value"]) for r in spark.read.parquet(places[2]).collect())
    assert on_time == [1, 2, 3, 4, 6, 8, 9]
    assert late == [(1, 1.5), (2, 2.0), (5, 5.0)]


def test_components_lead_follow_and_resume(spark, tmp_path):
    from splitframe import components
    from splitframe.frame import Frame

    guest = Frame.from_spark(spark.createDataFrame([(f"s{i}", i, float(i % 5), i % 2) for i in range(60)], "sid string, m long, x double, y int"), "sid", "m", "y", features=["x"])
    host = Frame.from_spark(spark.createDataFrame([(f"h{i}", i, float(i)) for i in range(80)], "hid string, m long, v double"), "hid", "m", features=["v"])
    for k, made in enumerate((components.create("data_split", train_size=0.5, validate_size=0.25, test_size=0.25), components.create("sample", n=13))):
        exchange = Exchange(spark, f"{tmp_path}/{k}")
        own, theirs = made.lead(guest, exchange, ["b"]), made.follow(host, Exchange(spark, f"{tmp_path}/{k}"), "b")
        assert own.keys() == theirs.keys()
        for part in own:
            assert sorted(r.m for r in own[part].df.collect()) == sorted(r.m for r in theirs[part].df.collect())
    assert own["sample"].count() == 13
    with pytest.raises(ValueError):
        components.create("sample", frac={0: 0.5}).lead(guest, Exchange(spark), [])
    for name in ("logistic_regression", "linear_regression"):
        whole, half, rest = (components.create(name, epochs=e, batch_size=16, optimizer="adam", l2=0.01) for e in (4, 2, 2))
        whole.train(guest)
        half.train(guest)
        rest.train(guest, half)
        assert rest.model["weights"] == pytest.approx(whole.model["weights"]) and rest.model["epoch"] == 4
