"""Histograms as dense arrays: each partition adds up (node, feature, bin) cells by NumPy, then Spark adds the cells.

A partition sends each cell once, however many rows it has, and no row is repeated for its features. An array has a place for each bin
of each feature, and one for missing bins, so its size is that of the schema.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import free, quoted

#: Cells of rows and features that are added up at once.
CELLS_AT_ONCE = 2_000_000
WHOLE = ("int", "bigint", "smallint", "tinyint")


def bounds(df: DataFrame, features: list[str]) -> dict[str, tuple[int, int]]:
    """The least bin and the number of bins of each feature, in one pass."""
    ends = df.agg(*[F.struct(F.min(quoted(f)).alias("low"), F.max(quoted(f)).alias("high")).alias(f"c{k}") for k, f in enumerate(features)]).first()
    return {f: (int(e["low"] or 0), int(e["high"] or 0) - int(e["low"] or 0) + 1) for f, e in zip(features, ends)}


def dense_sums(df: DataFrame, features: list[str], shape: dict[str, tuple[int, int]], values: dict[str, Column], node: Column | None = None) -> DataFrame:
    """(node, place, bin, values...) sums by the ``place`` of a feature in ``features``; bin is NULL for missing bins.

    ``shape`` has the least bin and the number of bins of each feature. NULL values count as 0. Sums of whole numbers are whole up to 2 ** 53.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    names = list(values)
    rows = df.select((F.lit(0) if node is None else node).alias("node"), F.array(*[F.col(quoted(f)).cast("int") for f in features]).alias("bins"), *[v.alias(f"v{k}") for k, v in enumerate(values.values())])
    kinds = dict(rows.dtypes)
    cells = rows.select("node", "bins", F.array(*[F.col(f"v{k}").cast("double") for k in range(len(names))], F.lit(1.0)).alias("v"))
    lows = np.array([shape[f][0] for f in features])
    sizes = np.array([shape[f][1] for f in features])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # one more place for missing bins
    width, n = int(starts[-1]), len(features)
    place = np.repeat(np.arange(n), sizes + 1)
    bin_of = np.arange(width) - starts[place] + lows[place]
    missing = bin_of == (lows + sizes)[place]

    def summed(batches):
        totals: dict = {}
        kind = None
        for whole in batches:
            kind = whole.schema.field("node").type
            step = max(1, CELLS_AT_ONCE // n)
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                b = pc.fill_null(batch.column(1).flatten(), np.iinfo(np.int32).min).to_numpy().reshape(-1, n).astype(np.int64)
                v = pc.fill_null(batch.column(2).flatten(), 0.0).to_numpy().reshape(-1, len(names) + 1)
                inside = np.where(b == np.iinfo(np.int32).min, sizes, b - lows)
                if ((inside < 0) | (inside > sizes)).any():
                    raise ValueError("a bin is outside of its feature's bins")
                coded = batch.column(0).dictionary_encode()
                of = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy().astype(np.int64)
                at = (of[:, None] * width + starts[:-1] + inside).ravel()
                nodes = [*coded.dictionary.to_pylist(), None]
                made = np.stack([np.bincount(at, np.repeat(v[:, k], n), len(nodes) * width) for k in range(len(names) + 1)])
                for k, name in enumerate(nodes):
                    own = made[:, k * width : (k + 1) * width]
                    if own[-1].any():
                        totals[name] = totals[name] + own if name in totals else own.copy()
        for name, own in totals.items():
            some = np.flatnonzero(own[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), kind), pa.array(place[some], pa.int32()), pa.array(bin_of[some], pa.int32(), mask=missing[some]), *(pa.array(own[k][some]) for k in range(len(names)))],
                ["node", "place", "bin", *(f"v{k}" for k in range(len(names)))],
            )

    schema = ", ".join([f"node {kinds['node']}", "place int", "bin int", *(f"v{k} double" for k in range(len(names)))])
    whole = cells.mapInArrow(summed, schema).groupBy("node", "place", "bin").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(len(names))])
    return whole.select("node", "place", "bin", *[(F.col(f"v{k}").cast("long") if kinds[f"v{k}"] in WHOLE else F.col(f"v{k}")).alias(name) for k, name in enumerate(names)])


def named(sums: DataFrame, features: list[str]) -> DataFrame:
    """The sums with ``feature`` in place of its number."""
    return sums.withColumn("place", F.get(F.array(*[F.lit(f) for f in features]), F.col("place"))).withColumnRenamed("place", "feature")
