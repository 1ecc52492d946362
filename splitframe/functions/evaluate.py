"""Evaluation metrics over (score, label) rows; every table is one aggregate over a short threshold list."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.quantile import at_ranks


def binary(df: DataFrame, score: str, label: str, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each value of ``by``, such as train and test): accuracy, precision, recall, f1 with score > threshold as positive."""
    hit, y = F.col(score) > threshold, F.col(label) == 1
    one = df.groupBy(*by).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return one.select(
        *by, F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"), F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
    )


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums; rows are summed by score and score range before they are ordered."""
    s = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    cuts = s.agg(F.percentile_approx("s", [k / 100 for k in range(1, 100)], 1000)).first()[0] or []
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array(F.lit(0.0))
    s = s.withColumn("b", F.size(F.filter(edges, lambda e: e < F.col("s"))))
    below = s.groupBy("b").agg(F.sum("n").alias("m")).withColumn("m", F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy("b")) - F.col("m"))
    w = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    d = s.join(F.broadcast(below), "b").withColumn("under", F.col("m") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    one = d.agg(F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return one.select(F.try_divide(F.col("u"), F.col("p").cast("double") * F.col("n")).alias("auc"))


def score_cuts(df: DataFrame, score: str) -> list[float]:
    """Scores of all rows at descending index int(rows * c) for c = 0.00, 0.01 to 0.99."""
    found = at_ranks(df, [score], lambda c, n: [(k, n - int(n * (k / 100))) for k in range(100)])
    return [r["value"] for r in found.orderBy("tag").collect()]


def step_cuts(df: DataFrame, score: str, add_end: bool = True) -> tuple[list[float], list[float]]:
    """Thresholds and their cuts: the distinct scores at descending index int(distinct * c), then the least less 0.001 as cut 1."""
    distinct = df.select(F.col(score).cast("double").alias("s")).where("s is not null").distinct()
    cuts = [k * 0.01 for k in range(100)]
    found = at_ranks(distinct, ["s"], lambda c, n: [(k, n - int(n * cut)) for k, cut in enumerate(cuts)])
    thresholds = [r["value"] for r in found.orderBy("tag").collect()]
    if add_end and thresholds:
        return [*thresholds, min(thresholds) - 0.001], [*cuts, 1.0]
    return thresholds, cuts


def quantile_cuts(df: DataFrame, score: str, quantiles: list[float] | None = None, remove_duplicate: bool = True) -> list[float]:
    """Ascending scores nearest to quantiles 0, 0.05 to 1; one value alone stands for least and greatest."""
    wanted = quantiles if quantiles is not None else [*(round(k * 0.05, 3) for k in range(20)), 1.0]
    found = at_ranks(df, [score], lambda c, n: [(k, 1 + round(q * (n - 1))) for k, q in enumerate(wanted)])
    values = sorted(r["value"] for r in found.collect())
    if remove_duplicate:
        values = sorted(set(values))
    return values * 2 if len(values) == 1 else values


def confusion_at(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """(cut, threshold, tp, fp, tn, fn) with score > threshold as positive.

    Rows are counted by the number of thresholds below them, at most one count each, then summed up.
    """
    spark = df.sparkSession
    distinct = sorted(set(thresholds))
    place = F.size(F.filter(F.array(*[F.lit(float(t)) for t in distinct]), lambda t: F.col(score) > t))
    counts = df.groupBy(place.alias("place")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    table = spark.createDataFrame([(k, float(t), distinct.index(t) + 1) for k, t in enumerate(thresholds)], "cut int, threshold double, need int")
    whole = counts.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("ap"), F.coalesce(F.sum("n"), F.lit(0)).alias("an"))
    above = F.broadcast(counts).alias("c")  # a row for each threshold at most
    sums = table.join(above, F.col("place") >= F.col("need"), "left").groupBy("cut", "threshold").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("fp"))
    return sums.crossJoin(F.broadcast(whole)).select("cut", "threshold", "tp", "fp", (F.col("an") - F.col("fp")).alias("tn"), (F.col("ap") - F.col("tp")).alias("fn"))


def confusion_table(df: DataFrame, score: str, label: str) -> DataFrame:
    return confusion_at(df, score, label, score_cuts(df, score))


def ks_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """(cuts, threshold, tpr, fpr), with threshold 0 and rates of 1 at cut 1."""
    t = confusion_table(df, score, label)
    tpr, fpr = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.try_divide(F.col("fp").cast("double"), F.col("fp") + F.col("tn"))
    end = df.sparkSession.createDataFrame([(1.0, 0.0, 1.0, 1.0)], "cuts double, threshold double, tpr double, fpr double")
    return t.select((F.col("cut") / 100).alias("cuts"), "threshold", tpr.alias("tpr"), fpr.alias("fpr")).unionByName(end)


def ks(df: DataFrame, score: str, label: str, exact: bool = False) -> DataFrame:
    """The largest tpr - fpr over the hundred cuts, or over all scores (``exact``)."""
    if not exact:
        return ks_table(df, score, label).where("cuts < 1").agg(F.max(F.col("tpr") - F.col("fpr")).alias("ks"))
    s = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    above = ranged_sums(s, "s", ["p", "n"], descending=True)
    whole = s.agg(F.sum("p").alias("ap"), F.sum("n").alias("an"))
    one = above.crossJoin(F.broadcast(whole))  # one row
    return one.agg(F.greatest(F.lit(0.0), F.max(F.try_divide(F.col("p_sum").cast("double"), F.col("ap")) - F.try_divide(F.col("n_sum").cast("double"), F.col("an")))).alias("ks"))


def ranged_sums(df: DataFrame, by: str, values: list[str], descending: bool = False) -> DataFrame:
    """``df`` with running sums (name_sum, own row included) in the order of a column of distinct values: summed by range first, so that no task sorts all rows."""
    cuts = df.agg(F.percentile_approx(by, [k / 100 for k in range(1, 100)], 1000)).first()[0] or []
    edges = sorted(set(cuts))
    place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in edges]), lambda e: e < F.col(by))) if edges else F.lit(0)
    p = "_" * (1 + max(len(c) for c in df.columns))
    d = df.withColumn(f"{p}b", -place if descending else place)
    w = Window.partitionBy(F.lit(0)).orderBy(f"{p}b")
    before = d.groupBy(f"{p}b").agg(*[F.sum(v).alias(f"{p}{v}") for v in values])  # a row for each range
    before = before.select(f"{p}b", *[(F.sum(f"{p}{v}").over(w) - F.col(f"{p}{v}")).alias(f"{p}{v}") for v in values])
    own = Window.partitionBy(f"{p}b").orderBy(F.desc(by) if descending else F.asc(by)).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(F.broadcast(before), f"{p}b").select(*df.columns, *[(F.sum(v).over(own) + F.col(f"{p}{v}")).alias(f"{v}_sum") for v in values])


def _at_steps(df: DataFrame, score: str, label: str, add_end: bool) -> DataFrame:
    thresholds, cuts = step_cuts(df, score, add_end)
    named = df.sparkSession.createDataFrame(list(enumerate(cuts)), "cut int, cuts double")
    return confusion_at(df, score, label, thresholds).join(F.broadcast(named), "cut")


def precision_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """(cuts, threshold, p) at distinct scores; a precision of no row counts as 1."""
    tp = F.col("tp").cast("double")
    return _at_steps(df, score, label, True).select("cuts", "threshold", F.coalesce(F.try_divide(tp, tp + F.col("fp")), F.lit(1.0)).alias("p"))


def recall_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """(cuts, threshold, r) at distinct scores; NULL without positive rows."""
    tp = F.col("tp").cast("double")
    return _at_steps(df, score, label, True).select("cuts", "threshold", F.try_divide(tp, tp + F.col("fn")).alias("r"))


def accuracy_table(df: DataFrame, score: str, label: str, normalize: bool = True) -> DataFrame:
    """(cuts, threshold, accuracy) at distinct scores, without the final threshold below all."""
    t = _at_steps(df, score, label, True).where("cuts < 1")
    right = (F.col("tp") + F.col("tn")).cast("double")
    return t.select("cuts", "threshold", (F.try_divide(right, F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")) if normalize else right).alias("accuracy"))


def _of_class(zero: bool) -> tuple[Column, Column, Column, Column]:
    """tp, fp, fn, tn as doubles, with class 0 as the positive one if asked for."""
    names = ("tn", "fn", "fp", "tp") if zero else ("tp", "fp", "fn", "tn")
    return tuple(F.col(c).cast("double") for c in names)


def lift_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """(cuts, threshold, lift_x_0, lift_y_0, lift_x_1, lift_y_1) at distinct scores.

    x is the share of rows that are called the class, y its precision over its share. An empty precision counts
    as 1; y of a class without rows is the largest double.
    """
    out = []
    for zero in (True, False):
        tp, fp, fn, tn = _of_class(zero)
        n = tp + fp + fn + tn
        y = F.coalesce(F.try_divide(F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0)), (tp + fn) / n), F.lit(sys.float_info.max))
        out += [((tp + fp) / n).alias(f"lift_x_{int(not zero)}"), y.alias(f"lift_y_{int(not zero)}")]
    return _at_steps(df, score, label, False).select("cuts", "threshold", *out)


def gain_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """(cuts, threshold, gain_x_0, gain_y_0, gain_x_1, gain_y_1) at distinct scores: the share of rows called the class, and of its rows that are."""
    out = []
    for zero in (True, False):
        tp, fp, fn, tn = _of_class(zero)
        out += [((tp + fp) / (tp + fp + fn + tn)).alias(f"gain_x_{int(not zero)}"), F.coalesce(F.try_divide(tp, tp + fn), F.lit(1.0)).alias(f"gain_y_{int(not zero)}")]
    return _at_steps(df, score, label, False).select("cuts", "threshold", *out)


def f_score_table(df: DataFrame, score: str, label: str, beta: float = 1.0) -> DataFrame:
    """At thresholds 0.00 to 0.99."""
    t = confusion_at(df, score, label, [k / 100 for k in range(100)])
    b = beta * beta
    tp = F.col("tp").cast("double")
    return t.select("cut", "threshold", F.coalesce(F.try_divide((1 + b) * tp, (1 + b) * tp + b * F.col("fn") + F.col("fp")), F.lit(0.0)).alias("f_score"))


def regression(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """One row: mse, rmse, mae, r2."""
    e, y = F.col(predicted) - F.col(label), F.col(label)
    one = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("v"))
    return one.select("mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide(F.col("mse"), F.col("v"))).alias("r2"))


def multi(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """One row: accuracy (and micro F1), macro precision and recall."""
    c = df.groupBy(F.col(predicted).alias("p"), F.col(label).alias("y")).count()
    by_p = c.groupBy(F.col("p").alias("k")).agg(F.sum("count").alias("np"), F.sum(F.when(F.col("p") == F.col("y"), F.col("count")).otherwise(0)).alias("hit"))
    by_y = c.groupBy(F.col("y").alias("k")).agg(F.sum("count").alias("ny"))
    j = by_y.join(by_p, "k", "full_outer")
    hit = F.coalesce("hit", F.lit(0)).cast("double")
    return j.agg(
        F.try_divide(F.sum(hit), F.sum("ny").cast("double")).alias("accuracy"),
        F.avg(F.coalesce(F.try_divide(hit, F.col("np")), F.lit(0.0))).alias("precision"), F.avg(F.coalesce(F.try_divide(hit, F.col("ny")), F.lit(0.0))).alias("recall"),
    )


def population_stability(expected: DataFrame, actual: DataFrame, score: str) -> DataFrame:
    """Sum of (a - e) * ln(a / e) over the ranges between the quantile cuts of ``expected``; empty shares count 1e-6.

    Ranges are closed on the left, the last one on both sides; shares are of all rows of each table.
    """
    edges = quantile_cuts(expected, score)
    if edges[0] == edges[-1]:
        place = F.lit(0)
    else:
        place = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[1:-1]]), lambda e: F.col(score) >= e)) if len(edges) > 2 else F.lit(0)
    ranges = expected.sparkSession.range(max(1, len(edges) - 1)).select(F.col("id").cast("int").alias("bin"))

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.where((F.col(score) >= edges[0]) & (F.col(score) <= edges[-1])).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
        return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("all")))).select("bin", F.try_divide(F.col("n").cast("double"), F.col("all")).alias(name))

    j = ranges.join(shares(expected, "e"), "bin", "left").join(shares(actual, "a"), "bin", "left").select(F.coalesce("e", F.lit(1e-6)).alias("e"), F.coalesce("a", F.lit(1e-6)).alias("a"))
    return j.agg(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("psi"))


#: Metrics of each kind of task, by name (fixed values).
ENSEMBLES = {
    "binary": ("auc", "binary_accuracy", "binary_precision", "binary_recall", "binary_f1"),
    "multi": ("multi_accuracy", "multi_precision", "multi_recall"),
    "regression": ("rmse", "mse", "mae", "r2"),
}


def evaluate(df: DataFrame, task: str, score: str, label: str, metrics: list[str] | None = None, by: str | None = None, threshold: float = 0.5) -> DataFrame:
    """(type, metric, value) of a task's metrics or those named, over all rows or for each value of ``by`` (train, validate, test)."""
    wanted = list(metrics or ENSEMBLES[task])
    unknown = [m for m in wanted if m not in ENSEMBLES[task] and m != "ks"]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    parts = []
    for value in [None] if by is None else [r[0] for r in df.select(by).distinct().orderBy(by).collect()]:  # a few values
        own = df if by is None else df.where(F.col(by).eqNullSafe(F.lit(value)))
        one = {
            "binary": lambda: [binary(own, score, label, threshold).withColumnsRenamed({c: f"binary_{c}" for c in ("accuracy", "precision", "recall", "f1")})]
            + [f(own, score, label) for n, f in (("auc", auc), ("ks", ks)) if n in wanted],
            "multi": lambda: [multi(own, score, label).withColumnsRenamed({c: f"multi_{c}" for c in ("accuracy", "precision", "recall")})],
            "regression": lambda: [regression(own, score, label)],
        }[task]()
        for table in one:
            for c in table.columns:
                if c in wanted:
                    parts.append(table.select(F.lit(None if value is None else str(value)).cast("string").alias("type"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def predict_detail(df: DataFrame, score: Column, threshold: float = 0.5) -> DataFrame:
    one = F.round(score, 6)
    return df.withColumns({"predict_score": score, "predict_result": (score > threshold).cast("int"), "predict_detail": F.to_json(F.struct(F.round(1 - one, 6).alias("0"), one.alias("1")))})


def predict_detail_multi(df: DataFrame, scores: list[Column], classes: list) -> DataFrame:
    """The class of the highest score (the first of equal ones), that score, and all scores by class."""
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    result = F.coalesce(*[F.when(s == best, F.lit(c)) for s, c in zip(scores, classes)])
    return df.withColumns({"predict_score": best, "predict_result": result, "predict_detail": F.to_json(F.struct(*[F.round(s, 6).alias(str(c)) for s, c in zip(scores, classes)]))})
