"""Quantile sketches: error bounds against exact ranks, merging over batches, and exact ranks found by a sketch."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitframe import components
from splitframe.frame import Frame
from splitframe.operators import quantile, sketch


def _data(seed=1, n=6000):
    r = np.random.default_rng(seed)
    return np.stack([r.normal(size=n), r.integers(0, 4, n).astype(float), np.where(r.random(n) < 0.4, 7.0, r.lognormal(size=n))], 1)


def _table(spark, x, parts=4):
    return spark.createDataFrame([tuple(map(float, row)) for row in x], "`a.b` double, b double, c double").repartition(parts)


def _miss(values, value, rank):
    """How far the ranks of ``value`` are from ``rank``."""
    low, high = int((values < value).sum()) + 1, int((values <= value).sum())
    return max(0, low - rank, rank - high)


@pytest.mark.parametrize("width", [16, 100, 1000])
def test_buffers_keep_their_error(width):
    r = np.random.default_rng(width)
    for n in (0, 1, 15, 16, 17, 5000):
        x = np.concatenate([np.sort(r.normal(size=n // 2)), r.integers(0, 3, n - n // 2)])
        made = sketch.Buffers(width)
        for part in np.array_split(x, 7):
            made.add(part)
        rows = list(made.rows("x"))
        values = np.concatenate([v for _, _, v, _ in rows])
        weights = np.concatenate([np.full(len(v), 1 << level) for _, level, v, _ in rows])
        assert weights.sum() == n and made.error <= (math.log2(max(n, 2)) + 1) * n / width
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        for rank in range(1, n + 1, 37):
            assert _miss(x, values[order[np.searchsorted(upto, rank)]], rank) <= made.error


def test_sketches_of_three_batches_merge(spark, tmp_path):
    """Batches are sketched apart, kept as tables and merged later, in any order."""
    parts = [_data(seed, n) for seed, n in ((1, 4000), (2, 300), (3, 7001))]
    kept = []
    for k, x in enumerate(parts):
        sketch.merged(sketch.sketch(_table(spark, x), ["a.b", "b", "c"], 0.05), relative_error=0.05).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    whole = np.concatenate(parts)
    q = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    one = sketch.merged(sketch.merged(kept[2], kept[0], relative_error=0.05), kept[1], relative_error=0.05)
    for r in sketch.quantiles(one, q).collect():
        values = whole[:, ["a.b", "b", "c"].index(r.column)]
        assert r.n == len(values) and 0 < r.rank_error <= 0.05 * r.n
        assert _miss(values, r.value, max(1, math.floor(r.q * r.n))) <= r.rank_error


def test_many_parts_merge_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(sketch, "MERGED_AT_ONCE", 3)
    x = _data(4, 3000)
    found = sketch.quantiles(sketch.merged(sketch.sketch(_table(spark, x, 30), ["b"], width=64), width=64), [0.5]).first()
    assert found.n == 3000 and _miss(x[:, 1], found.value, 1500) <= found.rank_error


def test_approximate_quantiles_and_binning(spark):
    x = _data(5, 8000)
    df = _table(spark, x)
    for r in quantile.quantiles(df, ["a.b", "c"], [0.1, 0.5], approx=True, relative_error=0.02).collect():
        values = x[:, ["a.b", "b", "c"].index(r.column)]
        assert _miss(values, r.value, math.floor(r.q * 8000)) <= 0.02 * 8000
    frame = Frame.from_spark(df.withColumn("id", F.monotonically_increasing_id()).withColumn("y", (F.col("b") > 1).cast("int")), "id", label="y", features=["b", "c"])
    binning = components.create("feature_binning", n_bins=4, relative_error=0.02)
    binning.train(frame)
    for k, cut in enumerate(binning.model["cuts"]["c"][:-1]):
        assert any(_miss(x[:, 2], cut, math.floor(p / 4 * 8000)) <= 0.02 * 8000 for p in range(1, 4))


def test_exact_ranks_found_by_a_sketch(spark, monkeypatch):
    """Every rank exactly, with buffers much smaller than the data, ties, missing values, NaN, infinities and an empty column."""
    monkeypatch.setattr(quantile, "FIRST_WIDTH", 32)
    monkeypatch.setattr(quantile, "VALUES_AT_ONCE", 50)
    r = np.random.default_rng(6)
    rows = [(float(v), float(w), None, None if r.random() < 0.3 else int(w)) for v, w in zip(r.normal(size=2000), r.integers(0, 5, 2000))]
    rows += [(math.nan, math.inf, None, None), (math.inf, -math.inf, None, None), (-math.inf, 0.0, None, None)]
    df = spark.createDataFrame(rows, "`x.y` double, b double, none double, d int").repartition(5)
    q = [0.0, 0.001, 0.3, 0.5, 0.77, 0.999, 1.0]
    got = {(a["column"], a.q): a.value for a in quantile.quantiles(df, ["x.y", "b", "none", "d"], q).collect()}
    want = {}
    for k, c in enumerate(["x.y", "b", "none", "d"]):
        values = sorted(math.inf if math.isnan(x[k]) else float(x[k]) for x in rows if x[k] is not None)
        want |= {(c, p): values[max(1, math.floor(p * len(values))) - 1] for p in q if values}
    assert got == want


def test_widths():
    assert sketch.width_of(0.01) == 4000
    with pytest.raises(ValueError):
        sketch.width_of(0)
