"""Column statistics: all metrics of all columns in one aggregate."""

from __future__ import annotations

import re
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import quoted
from . import quantile

#: Rows whose means sums of products are taken about.
PILOT_ROWS = 256


def variance(c: Column, ddof: int) -> Column:
    n = F.count(c)
    return F.var_pop(c) * F.try_divide(n, F.when(n > ddof, n - ddof))


def skewness(c: Column, unbiased: bool) -> Column:
    n, g = F.count(c), F.skewness(c)
    if not unbiased:
        return g
    return F.when(n >= 3, F.coalesce(g, F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c: Column, unbiased: bool, compat: bool = False) -> Column:
    """Excess kurtosis. ``compat`` divides the fourth moment by the fourth power of the second one, as the biased formula of some tools does."""
    n, g = F.count(c), F.kurtosis(c)
    if unbiased:
        return F.when(n >= 4, ((n + 1) * g + 6) * (n - 1) / ((n - 2) * (n - 3)))
    if compat:
        flat = F.var_pop(c) < 1e-14
        return F.when(flat, -3.0).otherwise((g + 3) / F.when(~flat, F.pow(F.var_pop(c), 2)) - 3)
    return g


def metric(name: str, c: Column, ddof: int = 1, unbiased: bool = False, compat_kurt: bool = False) -> Column:
    rows = F.count(F.lit(1))
    missing = F.count_if(c.isNull())
    table = {
        "count": lambda: F.count(c), "sum": lambda: F.sum(c), "min": lambda: F.min(c), "max": lambda: F.max(c), "mean": lambda: F.avg(c),
        "var": lambda: variance(c, ddof), "std": lambda: F.sqrt(variance(c, ddof)),
        "variation": lambda: F.try_divide(F.sqrt(variance(c, ddof)), F.avg(c)),
        "coefficient_of_variation": lambda: F.try_divide(F.sqrt(variance(c, ddof)), F.avg(c)),
        "skewness": lambda: skewness(c, unbiased), "skew": lambda: skewness(c, unbiased),
        "kurtosis": lambda: kurtosis(c, unbiased, compat_kurt), "kurt": lambda: kurtosis(c, unbiased, compat_kurt),
        "na_count": lambda: missing, "missing_count": lambda: missing, "missing_ratio": lambda: F.try_divide(missing, rows),
    }
    if name not in table:
        raise ValueError(f"unknown metric {name}")
    return table[name]().cast("double")


def statistics(df: DataFrame, columns: list[str], metrics: list[str], ddof: int = 1, bias: bool = True, compat_kurt: bool = False) -> DataFrame:
    """Long table (metric, column, value). Metrics also include ``median`` and ``N%``, by the exact rank rule; ``compat_kurt`` as in ``kurtosis``."""
    ranks = {m: 0.5 if m == "median" else float(m[:-1]) / 100 for m in metrics if m == "median" or re.fullmatch(r"\d{1,3}%", m)}
    plain = [m for m in metrics if m not in ranks]
    parts = []
    if plain:
        one = df.agg(*[metric(m, F.col(c), ddof, not bias, compat_kurt).alias(f"{m}|{c}") for m in plain for c in columns])
        entries = [F.struct(F.lit(m).alias("metric"), F.lit(c).alias("column"), F.col(f"`{m}|{c}`").alias("value")) for m in plain for c in columns]
        parts.append(one.select(F.inline(F.array(*entries))))
    if ranks:
        found = quantile.quantiles(df, columns, sorted(set(ranks.values())))
        for m, q in ranks.items():
            parts.append(found.where(F.col("q") == q).select(F.lit(m).alias("metric"), "column", F.col("value").cast("double")))
    return reduce(DataFrame.unionByName, parts)


def describe(df: DataFrame, columns: list[str], ddof: int = 1, unbiased: bool = True) -> DataFrame:
    return statistics(df, columns, ["sum", "min", "max", "mean", "std", "var", "variation", "skew", "kurt", "na_count"], ddof, not unbiased)


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson correlations of all pairs of columns, from one pass: sums of products by partition, about the means of some first rows.

    What they are taken about changes only the rounding. Each pair is over the rows where both have a value. A column that does not vary, or a pair without rows, gives NaN.
    """
    import pyarrow as pa

    p = len(columns)
    cells = df.select(F.array(*[F.col(quoted(c)).cast("double") for c in columns]).alias("v"))
    first = cells.limit(PILOT_ROWS).toArrow().column("v").combine_chunks()
    with np.errstate(invalid="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # a column without values
        about = np.nan_to_num(np.nanmean(np.concatenate([np.full((1, p), np.nan), first.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)]), axis=0))

    def summed(batches):
        total = np.zeros((4, p, p))
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                m = batch.slice(low, 4096).column(0).flatten()
                if not m.null_count:
                    x = m.to_numpy().reshape(-1, p) - about
                    total += np.stack([x.T @ x, np.broadcast_to(x.sum(0)[:, None], (p, p)), np.broadcast_to((x * x).sum(0)[:, None], (p, p)), np.full((p, p), float(len(x)))])
                    continue
                there = m.is_valid().to_numpy(zero_copy_only=False).reshape(-1, p).astype(float)
                x = np.where(there > 0, m.to_numpy(zero_copy_only=False).reshape(-1, p) - about, 0.0)
                total += np.stack([x.T @ x, x.T @ there, (x * x).T @ there, there.T @ there])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4 * p * p)), pa.array(total.ravel())], ["cell", "x"])

    out = np.zeros(4 * p * p)
    sums = cells.mapInArrow(summed, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow()  # four cells for each pair of columns
    out[sums.column("cell").to_numpy()] = sums.column("x").to_numpy()
    xy, x, xx, n = out.reshape(4, p, p)  # x[i, j]: of column i where j has a value too
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = xx - x * x / n
        made = (xy - x * x.T / n) / np.sqrt(spread * spread.T)
    made[(spread <= 0) | (spread.T <= 0)] = np.nan
    return made


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation (x, y, corr) of every ordered pair; NULL where it is not defined."""
    found = correlation_matrix(df, columns)
    rows = [(a, b, None if np.isnan(found[i, j]) else float(found[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "x string, y string, corr double")


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation factors: the diagonal of the inverse correlation matrix, whose size is that of the schema."""
    full = correlation_matrix(df, columns)

    def volume(m) -> float:
        eig = np.linalg.eigvalsh(m)
        return float(np.prod(eig[np.abs(eig) >= 1e-8]))

    out = [(c, volume(np.delete(np.delete(full, k, 0), k, 1)) / volume(full)) for k, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(out, "column string, vif double")
