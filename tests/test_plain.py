"""Catalogue queries that SQL cannot express, against plain versions over the same files."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from splitframe.ml import gbdt
from splitframe.operators.quantile import cut_lists, quantiles
from splitframe.plans import catalogue

from .test_learners_more import plain_trees

SF = "/root/testdata/sf0.01"


def table(name, columns):
    return pd.read_parquet(f"{SF}/{name}.parquet", columns=columns)


def split_stratified(spark):
    d = table("labels", ["doc_id", "quality"])
    d["k"] = [hashlib.md5(f"42:{i}".encode()).hexdigest() for i in d.doc_id]
    total = len(d)
    left = [round(total * 0.6), round(total * 0.2)]
    out, labels = [], sorted(d.quality.unique())
    whole = list(left)
    for j, y in enumerate(labels):
        own = d[d.quality == y].sort_values(["k", "doc_id"])
        n = left if j == len(labels) - 1 else [round(len(own) / total * s) for s in whole]
        left = [a - b for a, b in zip(left, n)]
        out += [(i, y, "train" if r < n[0] else "validate" if r < n[0] + n[1] else "test") for r, i in enumerate(own.doc_id)]
    return sorted(out), lambda r: (r.doc_id, r.quality, r.split)


def vif(spark):
    x = table("lineitem", catalogue.NUMBERS).to_numpy(float)
    inverse = np.linalg.inv(np.corrcoef(x.T))
    return [(c, float(inverse[k, k])) for k, c in enumerate(catalogue.NUMBERS)], lambda r: (r["column"], r.vif)


def gbdt_predict(spark):
    d = table("orders", ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate"])
    x = np.stack([d.o_totalprice.to_numpy(float), pd.to_datetime(d.o_orderdate).dt.year.to_numpy(float)], 1)
    y = (d.o_orderstatus == "F").to_numpy(float)
    rows = spark.createDataFrame(pd.DataFrame({"o_totalprice": x[:, 0], "year": x[:, 1]}))
    cuts = cut_lists(quantiles(rows, ["o_totalprice", "year"], [i / 32 for i in range(32)]), ["o_totalprice", "year"], "q")
    scores, _ = plain_trees(x, y, [[*cuts[f], float("inf")] for f in ("o_totalprice", "year")], "binary:bce", 1, 2, gbdt.Limits(2), 0.3)
    return sorted(zip(d.o_orderkey.tolist(), (1 / (1 + np.exp(-scores[:, 0]))).tolist())), lambda r: (r.o_orderkey, r.predict_score)


def one_vs_rest(spark):
    d = table("embeddings", ["vec_id", "label", "embedding"])
    x = np.c_[np.stack(d.embedding).astype(float), np.ones(len(d))]
    scores = []
    for c in range(10):
        y, w, last = np.where(d.label == c, 1.0, -1.0), np.zeros(x.shape[1]), None
        for _ in range(20):
            w = w - 0.15 * ((x.T @ (x @ w / 4 - y / 2)) / len(x))
            xw = x @ w
            loss = np.mean(np.log(2) - 0.5 * y * xw + 0.125 * xw * xw)
            if last is not None and abs(loss - last) < 1e-4:
                break
            last = loss
        scores.append(x @ w)
    return sorted(zip(d.vec_id.tolist(), np.argmax(scores, 0).tolist())), lambda r: (r.vec_id, r.predict_result)


def lr_mini_batch(spark):
    docs = table("documents", ["doc_id", "n_chars"]).set_index("doc_id").n_chars
    d = table("labels", ["doc_id", "quality"])
    d = d[d.doc_id.isin(docs.index)].copy()
    d["k"] = [hashlib.md5(f"42:{i}".encode()).hexdigest() for i in d.doc_id]
    d = d.sort_values(["k", "doc_id"])
    x = np.c_[docs.loc[d.doc_id].to_numpy(float) / docs.max(), np.ones(len(d))]
    y = np.where(d.quality == 1, 1.0, -1.0)
    w, m, v, step = np.zeros(2), np.zeros(2), np.zeros(2), 0
    for _ in range(4):
        for low in range(0, len(d), 64):
            a, b = x[low : low + 64], y[low : low + 64]
            g = a.T @ (a @ w / 4 - b / 2) / len(a) + 0.01 * w
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return [("s", float(w[0])), ("intercept", float(w[1]))], lambda r: (r["column"], r.weight)


PLAIN = {f.__name__: f for f in (split_stratified, vif, gbdt_predict, one_vs_rest, lr_mini_batch)}


@pytest.mark.parametrize("name", PLAIN)
def test_query_like_its_plain_version(spark, name):
    want, seen = PLAIN[name](spark)
    got = sorted(map(seen, catalogue.queries()[name](spark, SF).collect()))
    want = sorted(want)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(abs(x - y) <= 1e-6 if isinstance(x, float) else x == y for x, y in zip(a, b)), (a, b)
