"""Linear and logistic regression whose passes over the data are single aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import free, quoted
from ..operators.sampling import batches
from ..storage import kept
from .optim import Optimizer, converged, rate, start_weights


def gram_sums(features: list[str], label: str | None = None) -> list[Column]:
    sums = [F.sum(F.col(a).cast("double") * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
    return sums + ([F.sum(F.col(a).cast("double") * F.col(label)).alias(f"b_{i}") for i, a in enumerate(features)] if label else [])


def gram(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """One row of sums: g_i_j = sum(x_i * x_j) for i <= j, and b_i = sum(x_i * y)."""
    return df.agg(*gram_sums(features, label))


def gram_arrays(df: DataFrame, features: list[str], labels: list[Column]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums x_i * x_j (a column of ones last), sums x_i * y for each label, and the number of rows.

    Each partition gives its own sums in one pass; Spark adds them up cell by cell. Rows with a NULL are left out.
    """
    import pyarrow as pa

    p, q = len(features) + 1, len(labels)
    cells = df.select(F.array(*[F.col(quoted(f)).cast("double") for f in features], F.lit(1.0), *[y.cast("double") for y in labels]).alias("v"))

    def summed(batches):
        total = np.zeros((p, p + q))
        for batch in batches:
            v = batch.column(0).combine_chunks() if isinstance(batch.column(0), pa.ChunkedArray) else batch.column(0)
            m = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, p + q)
            total += m[:, :p].T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p * (p + q))), pa.array(total.ravel())], ["cell", "x"])

    whole = cells.where(~F.exists("v", lambda x: x.isNull())).mapInArrow(summed, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x"))
    out = np.zeros(p * (p + q))
    for r in whole.collect():  # a row for each cell
        out[r["cell"]] = r["x"]
    out = out.reshape(p, p + q)
    return out[:, :p], out[:, p:], int(round(out[p - 1, p - 1]))


def fit_linear(df: DataFrame, features: list[str], label: str, epochs: int | None = None, lr: float = 0.01, l2: float = 0.0) -> dict[str, float]:
    """Weights and ``intercept``: exact, or after ``epochs`` full-batch gradient steps, from one pass over the data."""
    g, b, n = gram_arrays(df, features, [F.col(quoted(label))])
    b = b[:, 0]
    if epochs is None:
        w = np.linalg.lstsq(g + l2 * n * np.eye(len(b)), b, rcond=None)[0]
    else:
        w = np.zeros(len(b))
        for _ in range(epochs):
            w = w - lr * ((g @ w - b) / n + l2 * w)
    return dict(zip([*features, "intercept"], map(float, w)))


def logistic_gradient(df: DataFrame, features: list[str], label: str, weights: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """One row: Taylor loss and gradient g_i = avg((xw / 4 - y / 2) * x_i) for labels y of -1 and 1.

    ``by`` gives a row for each party, with its number of rows ``n``.
    """
    y = F.when(F.col(label) == 1, 1.0).otherwise(-1.0)
    xw = sum((F.col(f).cast("double") * weights[f] for f in features), F.lit(weights["intercept"]))
    p = free(df)
    d = df.withColumns({f"{p}xw": xw, f"{p}y": y})
    xw, y = F.col(f"{p}xw"), F.col(f"{p}y")
    step = xw / 4 - y / 2
    grads = [F.avg(step * F.col(f)).alias(f"grad_{f}") for f in features]
    loss = F.avg(F.lit(float(np.log(2))) - 0.5 * y * xw + 0.125 * xw * xw)
    size = [F.count("*").alias("n")] if by else []
    return d.groupBy(*by).agg(*size, loss.alias("loss"), *grads, F.avg(step).alias("grad_intercept"))


def _descended(g: np.ndarray, b: np.ndarray, n: int, epochs: int, opt: Optimizer, tol: float, schedule: str, early_stop: str, start: np.ndarray, **rates) -> np.ndarray:
    """Weights after full-batch descent on the Taylor loss, whose gradient is linear in the weights."""
    w, last = start, None
    for epoch in range(epochs):
        before, w = w, opt.step(w, (g @ w / 4 - b / 2) / n, rate(schedule, epoch, **rates))
        loss = float(np.log(2) - 0.5 * b @ w / n + 0.125 * w @ g @ w / n)
        if converged(early_stop, tol, loss, last, w, before):
            break
        last = loss
    return w


def _signed(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(-1.0)


def fit_logistic(df: DataFrame, features: list[str], label: str, epochs: int = 20, lr: float = 0.15, l2: float = 0.0, tol: float = 1e-4, optimizer: Optimizer | None = None, schedule: str = "constant", early_stop: str = "diff", init: str = "zeros", seed: int | None = None, **rates) -> dict[str, float]:
    """Full-batch descent on the Taylor loss; one Gram pass over the data serves all epochs."""
    g, b, n = gram_arrays(df, features, [_signed(F.col(quoted(label)) == 1)])
    w = _descended(g, b[:, 0], n, epochs, optimizer or Optimizer("sgd", lr, "l2", l2), tol, schedule, early_stop, start_weights(len(features), init, seed=seed), **rates)
    return dict(zip([*features, "intercept"], map(float, w)))


def batch_sums(df: DataFrame, features: list[str], label: Column, sample_id: str, batch_size: int, seed: int = 42) -> DataFrame:
    """(batch_id, cells, n): of each batch of rows in digest order the sums x_i * x_j and x_i * y, as one array; rows with a NULL are left out."""
    import pyarrow as pa

    p = len(features) + 1
    of = free(df)
    placed = batches(df.withColumn(f"{of}y", label.cast("double")), sample_id, batch_size, seed)
    cells = placed.select("batch_id", F.array(*[F.col(quoted(f)).cast("double") for f in features], F.lit(1.0), F.col(f"{of}y")).alias("v")).where(~F.exists("v", lambda x: x.isNull()))

    def summed(table):
        m = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, p + 1)
        return pa.table({"batch_id": table.column("batch_id")[:1], "cells": pa.array([(m[:, :p].T @ m).ravel()], pa.list_(pa.float64())), "n": pa.array([len(m)], pa.int64())})

    return cells.groupBy("batch_id").applyInArrow(summed, "batch_id long, cells array<double>, n long")


#: Bytes of batch sums that the driver keeps over all epochs; more are read again from their table in each epoch.
SUMS_HELD = 1 << 28


def fit_mini_batch(
    df: DataFrame, features: list[str], label: str, sample_id: str, batch_size: int, epochs: int = 20, kind: str = "logistic", method: str = "sgd", lr: float = 0.15, penalty: str | None = None, alpha: float = 0.0,
    tol: float = 0.0, schedule: str = "constant", early_stop: str = "diff", init: str = "zeros", seed: int = 42, warm_start: dict | None = None, rates: dict | None = None, **options,
) -> dict:
    """Mini-batch descent for a logistic (Taylor loss) or linear (squared loss) model; the state that comes back can be gone on from.

    The rows are passed over once: each batch's gradient follows from its sums, a batch in a row of a written table, and epochs run over these rows in order, one row
    at a time. The result has weights, epoch, the optimizer's state and the last loss, as plain values; with it as ``warm_start``, ``epochs`` more epochs
    follow as if training had not stopped. ``rates`` are the settings of ``schedule``, other options those of the optimizer.
    """
    if kind not in ("logistic", "linear"):
        raise ValueError(f"unknown kind {kind}")
    y = _signed(F.col(quoted(label)) == 1) if kind == "logistic" else F.col(quoted(label))
    sums = kept(batch_sums(df, features, y, sample_id, batch_size, seed)).orderBy("batch_id")
    p = len(features) + 1
    half, quarter = (0.5, 0.25) if kind == "logistic" else (1.0, 1.0)

    def each():
        for r in sums.toLocalIterator():
            m = np.array(r["cells"]).reshape(p, p + 1)
            yield m[:, :p], m[:, p], r["n"]

    held = list(each()) if sums.count() * p * (p + 1) * 8 <= SUMS_HELD else None
    opt, first, last = Optimizer(method, lr, penalty, alpha, **options), 0, None
    if warm_start is None:
        w = start_weights(len(features), init, seed=seed)
    else:
        if list(warm_start["weights"]) != [*features, "intercept"]:
            raise ValueError("a model goes on with its own features")
        w, first, last = np.array(list(warm_start["weights"].values())), warm_start["epoch"], warm_start["loss"]
        opt.t = warm_start["optimizer"]["t"]
        opt.state = {k: np.array(v) if isinstance(v, list) else v for k, v in warm_start["optimizer"]["state"].items()}
    epoch = first
    for epoch in range(first, first + epochs):
        before, loss, rows = w, 0.0, 0
        for g, b, n in held if held is not None else each():
            loss += (float(np.log(2)) * n if kind == "logistic" else 0.0) + float(quarter / 2 * w @ g @ w - half * b @ w)
            rows += n
            w = opt.step(w, (quarter * g @ w - half * b) / n, rate(schedule, epoch, **(rates or {})))
        loss = loss / max(rows, 1)
        done = converged(early_stop, tol, loss, last, w, before)
        last = loss
        if done:
            break
    state = {k: v.tolist() if isinstance(v, np.ndarray) else float(v) for k, v in opt.state.items()}
    return {"weights": dict(zip([*features, "intercept"], map(float, w))), "epoch": epoch + 1 if epochs else first, "loss": last, "optimizer": {"t": opt.t, "state": state}}


def bce_gradient(df: DataFrame, features: list[str], label: str, weights: np.ndarray, by: tuple[str, ...] = ()) -> DataFrame:
    """Per party (``by``): rows n, mean cross-entropy and its gradient g0, g1, ... (the intercept last); labels 0 and 1."""
    xw = sum((F.col(quoted(f)).cast("double") * float(w) for f, w in zip(features, weights)), F.lit(float(weights[-1])))
    y = (F.col(quoted(label)) == 1).cast("double")
    loss = F.greatest(xw, F.lit(0.0)) - xw * y + F.log1p(F.exp(-F.abs(xw)))
    step = 1 / (1 + F.exp(-xw)) - y
    grads = [F.avg(step * F.col(quoted(f))).alias(f"g{i}") for i, f in enumerate(features)] + [F.avg(step).alias(f"g{len(features)}")]
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(loss).alias("loss"), *grads)


def aggregated(values: np.ndarray, sizes: np.ndarray, method: str = "weighted_mean") -> np.ndarray:
    """Party models (a row each) made one: their mean, their sum, or their mean by rows."""
    if method == "mean":
        return values.mean(axis=0)
    if method == "sum":
        return values.sum(axis=0)
    if method == "weighted_mean":
        return (values * sizes[:, None]).sum(axis=0) / sizes.sum()
    raise ValueError(f"unknown method {method}")


def fit_homo_logistic(
    df: DataFrame, features: list[str], label: str, party: str, rounds: int = 20, lr: float = 0.1, optimizer: str = "sgd", penalty: str | None = None, alpha: float = 0.0, aggregator: str = "weighted_mean",
    init: str = "zeros", seed: int | None = None, schedule: str = "constant", tol: float = 0.0, callbacks: tuple = (), **rates,
) -> dict[str, float]:
    """Rounds of federated averaging: each party takes a step on its own rows' cross-entropy, then the models are aggregated.

    A round is one grouped aggregate over the data, a row for each party; ``df`` is read each time, so keep what it is made from.
    """
    w, last = start_weights(len(features), init, seed=seed), None
    own: dict = {}
    for c in callbacks:
        c.on_train_begin(dict(zip([*features, "intercept"], map(float, w))))
    for step in range(rounds):
        for c in callbacks:
            c.on_round_begin(dict(zip([*features, "intercept"], map(float, w))), step)
        found = bce_gradient(df, features, label, w, (party,)).orderBy(party).collect()
        sizes = np.array([r["n"] for r in found], float)
        models = []
        for r in found:
            opt = own.setdefault(r[party], Optimizer(optimizer, lr, penalty, alpha))
            models.append(opt.step(w, np.array([r[f"g{i}"] for i in range(len(w))]), rate(schedule, step, **rates)))
        w = aggregated(np.array(models), sizes, aggregator)
        loss = float((np.array([r["loss"] for r in found]) * sizes).sum() / sizes.sum())
        model = dict(zip([*features, "intercept"], map(float, w)))
        for c in callbacks:
            c.on_round_end(model, step, {"loss": loss})
        if any(c.need_stop() for c in callbacks) or (tol and last is not None and abs(loss - last) < tol):
            break
        last = loss
    model = dict(zip([*features, "intercept"], map(float, w)))
    for c in callbacks:
        c.on_train_end(model)
    return model


def fit_one_vs_rest(df: DataFrame, features: list[str], label: str, classes: list, epochs: int = 20, lr: float = 0.15, l2: float = 0.0, tol: float = 1e-4, method: str = "sgd", schedule: str = "constant", early_stop: str = "diff", init: str = "zeros", seed: int | None = None, **rates) -> dict:
    """A logistic model for each of a few classes, against all others; all share one pass over the data."""
    g, b, n = gram_arrays(df, features, [_signed(F.col(quoted(label)) == c) for c in classes])
    out = {}
    for k, c in enumerate(classes):
        w = _descended(g, b[:, k], n, epochs, Optimizer(method, lr, "l2", l2), tol, schedule, early_stop, start_weights(len(features), init, seed=seed), **rates)
        out[c] = dict(zip([*features, "intercept"], map(float, w)))
    return out


def predict_class(df: DataFrame, models: dict, name: str = "predict_result") -> DataFrame:
    """The class of highest score; of equal scores, the first class."""
    score = lambda w: sum((F.col(f).cast("double") * v for f, v in w.items() if f != "intercept"), F.lit(w["intercept"]))
    best = F.array_max(F.array(*[F.struct(score(w).alias("s"), F.lit(-k).alias("k")) for k, w in enumerate(models.values())]))
    return df.withColumn(name, F.element_at(F.array(*[F.lit(c) for c in models]), (1 - best["k"]).cast("int")))


def predict(df: DataFrame, weights: dict[str, float], logistic: bool = False, name: str = "predict_score") -> DataFrame:
    xw = sum((F.col(f).cast("double") * v for f, v in weights.items() if f != "intercept"), F.lit(weights["intercept"]))
    return df.withColumn(name, 1 / (1 + F.exp(-xw)) if logistic else xw)


def weighted_mean(df: DataFrame, party: str, weight: str, values: list[str]) -> DataFrame:
    """Aggregate of party models: the mean of each value over parties, by weight."""
    return df.agg(*[F.try_divide(F.sum(F.col(v) * F.col(weight)), F.sum(weight)).alias(v) for v in values], F.count_distinct(party).alias("parties"))
