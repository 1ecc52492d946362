"""Cross-validation from sums by fold: what a model is fitted on are all sums less those of its fold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .glm import gram_sums


def cross_validate_linear(df: DataFrame, features: list[str], label: str, fold: str, l2: float = 0.0) -> DataFrame:
    """(fold, n, rmse) of linear models fitted on the other folds, from one pass over the data."""
    names = [*features, "_one"]
    p = len(names)
    sums = df.withColumn("_one", F.lit(1.0)).groupBy(fold).agg(*gram_sums(names, label), F.sum(F.col(label).cast("double") * F.col(label)).alias("yy"))
    own = {}
    for r in sums.collect():  # a row for each fold
        g = np.array([[r[f"g_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        own[r[fold]] = g, np.array([r[f"b_{i}"] for i in range(p)]), r["yy"]
    all_g, all_b = sum(x[0] for x in own.values()), sum(x[1] for x in own.values())
    out = []
    for k, (g, b, yy) in sorted(own.items()):
        n, rest = g[-1, -1], all_g - g
        w = np.linalg.lstsq(rest + l2 * rest[-1, -1] * np.eye(p), all_b - b, rcond=None)[0]
        out.append((k, int(round(n)), float(np.sqrt(max(0.0, yy - 2 * w @ b + w @ g @ w) / n))))
    return df.sparkSession.createDataFrame(out, "fold int, n long, rmse double")
