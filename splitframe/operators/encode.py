"""Categories, value maps, scaling, selection and top rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..names import quoted
from . import sketch
from .quantile import at_ranks
from .sampling import first_rows


def categories(df: DataFrame, column: str) -> list:
    """Distinct values in order; they become columns, so there are few."""
    return [r[0] for r in df.select(column).distinct().where(F.col(column).isNotNull()).orderBy(column).collect()]


def replaced(c: Column, mapping: dict) -> Column:
    out = None
    for old, new in mapping.items():
        out = F.when(c == old, F.lit(new)) if out is None else out.when(c == old, F.lit(new))
    return c if out is None else out.otherwise(c)


def top_rows(df: DataFrame, n: int, columns: list[str], sample_id: str, keep: str = "first", error: float = 0.0, seed: int = 42) -> DataFrame:
    """The n largest rows by the columns; ``first`` breaks ties by id, ``last`` keeps all ties of the nth. NULL is below all values.

    The value of the nth row is found by rank, column by column, so rows above it are a filter and only ties are looked at further. With ``error`` and one
    column, a sketch gives a value that at least n rows reach and at most n + 2 * error * rows: of these, ``first`` draws n and ``last`` takes all.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    if n <= 0:
        return df.limit(0)
    if error > 0 and len(columns) == 1:
        rows = df.where(F.col(quoted(columns[0])).isNotNull()).count()
        found = sketch.quantiles(sketch.merged(sketch.sketch(df, columns, error), relative_error=error), [max(0.0, 1 - n / max(rows, 1) - error)]).first()
        some = df if found is None or rows <= n or found.q <= 0 else df.where(F.col(quoted(columns[0])) >= found.value)
        return some if keep == "last" else first_rows(some, sample_id, n, seed)
    left, above, tied = n, [], df
    for c in columns:
        value = F.col(quoted(c))
        if not isinstance(df.schema[c].dataType, NumericType):
            break
        row = at_ranks(tied, [c], lambda _, rows: [(0, rows - left + 1)] if rows >= left else []).first()
        if row is None:  # the nth is a NULL
            above.append(tied.where(value.isNotNull()))
            left -= above[-1].count()
            tied = tied.where(value.isNull())
            continue
        nth = F.lit(row["value"]).cast(df.schema[c].dataType)
        more = tied.where(value > nth)
        left -= more.count()
        above.append(more)
        tied = tied.where(value == nth)
    else:
        if keep == "last":
            return reduce(DataFrame.unionByName, [*above, tied])
        if tied.count() > left:
            ids = df.schema[sample_id].dataType
            if isinstance(ids, NumericType):
                end = at_ranks(tied, [sample_id], lambda _, rows: [(0, left)]).first()
                tied = tied.where(F.col(quoted(sample_id)) <= F.lit(end["value"]).cast(ids))
            else:
                tied = tied.orderBy(quoted(sample_id)).limit(left)
        return reduce(DataFrame.unionByName, [*above, tied])
    order = [F.desc(quoted(c)) for c in columns]  # by columns that have no ranks as numbers
    if keep == "first":
        return df.orderBy(*order, quoted(sample_id)).limit(n)
    least = df.select(*map(quoted, columns)).orderBy(*order).limit(n).agg(F.min(F.struct(*map(quoted, columns))).alias("least"))
    return df.crossJoin(F.broadcast(least)).where(F.struct(*map(quoted, columns)) >= F.col("least")).drop("least")  # the other side is one row


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    moments = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]).first()
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(moments[c]["m"]), F.lit(moments[c]["s"])) for c in columns})


def min_max_scale(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0, strict: bool = True, fit_on: DataFrame | None = None) -> DataFrame:
    """A range below 1e-6 counts as 1; ``strict`` clips values outside of the fitted range."""
    ends = (df if fit_on is None else fit_on).agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in columns]).first()

    def scaled(c: str) -> Column:
        a, b = float(ends[c]["a"]), float(ends[c]["b"])
        span = b - a if b - a >= 1e-6 else 1.0
        out = (F.col(c) - a) * ((high - low) / span) + low
        return F.greatest(F.least(out, F.lit(high)), F.lit(low)) if strict else out

    return df.withColumns({c: scaled(c) for c in columns})


def selected(metrics: DataFrame, filter_type: str, threshold: float, take_high: bool = True) -> DataFrame:
    """Columns of a (column, value) table that pass: by threshold, top_k (0: all) or top_percentile (rounded up)."""
    v = F.col("value")
    if filter_type == "threshold":
        return metrics.where(v >= threshold if take_high else v <= threshold).select("column")
    n = metrics.count()
    k = n if filter_type == "top_k" and threshold == 0 else threshold if filter_type == "top_k" else math.ceil(n * threshold)
    return metrics.orderBy(v.desc() if take_high else v.asc(), "column").limit(int(k)).select("column")


def selected_by_all(parts: list[DataFrame], metrics: DataFrame | None = None) -> DataFrame:
    """Columns that all parts hold; with ``metrics`` (column, value), the best column where no column is in all."""
    both = reduce(lambda a, b: a.join(b, "column", "left_semi"), parts)
    if metrics is not None and both.isEmpty():
        return metrics.orderBy(F.desc("value"), "column").limit(1).select("column")
    return both


def manual(columns: list[str], keep: list[str] | None = None, drop: list[str] | None = None) -> list[str]:
    """Columns without those of ``drop``, except those of ``keep``; all can't go."""
    left = [c for c in columns if c in (keep or ()) or c not in (drop or ())]
    if not left:
        raise ValueError("no column is left")
    return left


def ranks(df: DataFrame, by: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
