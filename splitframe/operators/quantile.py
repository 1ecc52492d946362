"""Quantiles as data values: the value of rank max(1, floor(q * n)), exactly, without one sort of all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..names import quoted
from .sketch import merged, sketch, weighted
from .sketch import quantiles as sketch_quantiles

#: Buffers of the sketch that finds where exact ranks lie, and values that a task holds before it sends them.
FIRST_WIDTH = 8192
VALUES_AT_ONCE = 4_000_000


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*entries))).where("value is not null")


def _between(df: DataFrame, columns: list[str], ranges: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """(place, low, value, n): of each column the values in its ranges (ends included) with their counts, and as ``value`` NULL the count below each range.

    Partitions count by NumPy; no row is repeated for its columns.
    """
    import numpy as np
    import pyarrow as pa

    cells = df.select(*[F.col(quoted(c)).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    kinds = [("place", pa.int32()), ("low", pa.int32()), ("value", pa.float64()), ("n", pa.int64())]

    def found(batches):
        below: dict = {}
        held: dict = {}

        def sent(key):
            values, counts = (np.concatenate(x) for x in zip(*held.pop(key)))
            values, at = np.unique(values, return_inverse=True)
            return [np.full(len(values), key[0]), np.full(len(values), key[1]), values, np.bincount(at, counts).astype(np.int64)]

        for batch in batches:
            for k, c in enumerate(columns):
                x = np.sort(batch.column(k).drop_null().to_numpy(zero_copy_only=False))
                for r, (low, high) in enumerate(ranges[c]):
                    first, last = np.searchsorted(x, low, "left"), np.searchsorted(x, high, "right")
                    below[k, r] = below.get((k, r), 0) + int(first)
                    if last > first:
                        held.setdefault((k, r), []).append(np.unique(x[first:last], return_counts=True))
                        if sum(len(v) for v, _ in held[k, r]) > VALUES_AT_ONCE:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(sent((k, r)), kinds)], [n for n, _ in kinds])
        for key in list(held):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(sent(key), kinds)], [n for n, _ in kinds])
        rows = [(k, r, None, n) for (k, r), n in below.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    return cells.mapInArrow(found, "place int, low int, value double, n long").groupBy("place", "low", "value").agg(F.sum("n").alias("n"))


def at_ranks(df: DataFrame, columns: list[str], ranks) -> DataFrame:
    """(column, tag, value) of wanted ranks. ranks(column, n) lists (tag, rank from 1) for n values; NaN is above all values.

    A sketch tells between which values each rank surely lies. One more pass counts what lies below and sends the values there, summed by value; only
    these are ordered.
    """
    import pyarrow as pa

    spark = df.sparkSession
    cells = df.select(*[F.when(F.isnan(F.col(quoted(c)).cast("double")), float("inf")).otherwise(F.col(quoted(c)).cast("double")).alias(f"c{k}") for k, c in enumerate(columns)])
    def located(rows):
        values, weights, error = weighted(rows)
        n, upto, out = int(weights.sum()), weights.cumsum(), []
        place = int(rows.column("column")[0].as_py()[1:])
        for tag, rank in ranks(columns[place], n) if n else []:
            first, last = upto.searchsorted(rank - error - 1), upto.searchsorted(rank + error + 1)
            low = -math.inf if first <= 0 or rank - error <= 1 else float(values[first - 1])
            out.append((place, float(tag), int(rank), low, math.inf if last >= len(values) else float(values[last])))
        kinds = (("place", pa.int32()), ("tag", pa.float64()), ("rank", pa.int64()), ("from", pa.float64()), ("to", pa.float64()))
        return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate(kinds)})

    looked = merged(sketch(cells, cells.columns, width=FIRST_WIDTH), width=FIRST_WIDTH)
    wanted, ranges = [], {c: [] for c in columns}
    for r in looked.groupBy("column").applyInArrow(located, "place int, tag double, rank long, from double, to double").collect():  # a row for each rank
        own = ranges[columns[r["place"]]]
        if (r["from"], r["to"]) not in own:
            own.append((r["from"], r["to"]))
        wanted.append((r["place"], own.index((r["from"], r["to"])), r["tag"], r["rank"]))
    table = spark.createDataFrame(wanted, "place int, low int, tag double, rank long")
    found = _between(cells, cells.columns, {f"c{k}": ranges[c] for k, c in enumerate(columns)}) if wanted else spark.createDataFrame([], "place int, low int, value double, n long")
    below = found.where("value is null").select("place", "low", F.col("n").alias("before"))
    inside = found.where("value is not null")
    upto = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("place", "low").orderBy("value")))
    placed = table.join(below, ["place", "low"])  # a row for each rank
    hit = upto.join(F.broadcast(placed), ["place", "low"]).where((F.col("rank") - F.col("before") <= F.col("upto")) & (F.col("rank") - F.col("before") > F.col("upto") - F.col("n")))
    return hit.select(F.get(F.array(*[F.lit(c) for c in columns]), F.col("place")).alias("column"), "tag", "value")


def quantiles(df: DataFrame, columns: list[str], q: list[float], approx: bool = False, relative_error: float = 1e-4) -> DataFrame:
    """Long table (column, q, value); with ``approx`` from a sketch, whose ranks miss by ``relative_error`` of the values at most."""
    if approx:
        return sketch_quantiles(merged(sketch(df, columns, relative_error), relative_error=relative_error), q).select("column", "q", "value")
    found = at_ranks(df, columns, lambda c, n: [(x, max(1, min(n, math.floor(x * n)))) for x in q])
    return found.withColumnRenamed("tag", "q")


def equal_width_cuts(df: DataFrame, columns: list[str], q: int) -> DataFrame:
    """Long table (column, i, cut): min + i * (max - min) / q for i from 1 to q."""
    one = df.agg(*[F.struct(F.min(F.col(c).cast("double")).alias("low"), F.max(F.col(c).cast("double")).alias("high")).alias(c) for c in columns])
    entries = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("i"), (F.col(f"{c}.low") + i * (F.col(f"{c}.high") - F.col(f"{c}.low")) / q).alias("cut")) for c in columns for i in range(1, q + 1)]
    return one.select(F.inline(F.array(*entries)))


def cut_lists(cuts: DataFrame, columns: list[str], order: str) -> dict[str, list[float]]:
    """Distinct ascending cut points by column; a few for each column."""
    found: dict[str, list[float]] = {c: [] for c in columns}
    for r in cuts.orderBy("column", order).collect():
        value = r["value"] if "value" in cuts.columns else r["cut"]
        if not found[r["column"]] or value > found[r["column"]][-1]:
            found[r["column"]].append(value)
    return found
