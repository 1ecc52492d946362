"""Mergeable quantile sketches, kept as a table.

A sketch has, for each column, buffers of values: one of level l stands for 2**l values each. Full buffers of ``width`` values
are sorted and every other value goes to the level above, which moves any rank by 2**l at most; the sum of these is the sketch's ``error``. Partitions and batches
make sketches of their own, and tables of sketches merge by union and compaction, in any order and at any time. With
width = LEVELS / relative_error the error stays below relative_error * n for up to width * 2**LEVELS values.

NULL and NaN values are left out. The table has a row for each column, level and part: (column, level, values, error).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import quoted

LEVELS = 40
SCHEMA = "column string, level int, values array<double>, error long"
#: Sketches that one task merges; more are merged in several rounds.
MERGED_AT_ONCE = 64


class Buffers:
    """The sketch of one column in memory."""

    def __init__(self, width: int):
        self.width = width + width % 2
        self.levels: list[list[np.ndarray]] = []
        self.held: list[int] = []
        self.turns: list[int] = []
        self.error = 0

    def add(self, values: np.ndarray, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
            self.held.append(0)
            self.turns.append(0)
        self.levels[level].append(values)
        self.held[level] += len(values)
        while self.held[level] >= self.width:
            whole = np.concatenate(self.levels[level])
            self.levels[level], self.held[level] = [whole[self.width :]], len(whole) - self.width
            full = np.sort(whole[: self.width])
            self.turns[level] += 1
            self.error += 1 << level
            self.add(full[self.turns[level] % 2 :: 2], level + 1)

    def rows(self, column: str):
        for level, parts in enumerate(self.levels):
            if self.held[level] or not level:
                yield column, level, np.concatenate(parts) if parts else np.zeros(0), self.error if not level else 0


def width_of(relative_error: float) -> int:
    if not 0 < relative_error < 1:
        raise ValueError("the relative error is between 0 and 1")
    return math.ceil(LEVELS / relative_error)


def _batch(rows):
    import pyarrow as pa

    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["column", "level", "values", "error"])


def sketch(df: DataFrame, columns: list[str], relative_error: float = 1e-3, width: int | None = None) -> DataFrame:
    """A sketch of each column for each partition; ``merged`` makes one of them. ``width`` is set instead of the error where only the error that comes out counts."""
    width = width or width_of(relative_error)
    cells = df.select(*[F.col(quoted(c)).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])

    def made(batches):
        own = [Buffers(width) for _ in columns]
        for batch in batches:
            for k, buffers in enumerate(own):
                x = batch.column(k).drop_null().to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)]
                for low in range(0, len(x), width):
                    buffers.add(x[low : low + width])
        yield _batch([r for c, b in zip(columns, own) for r in b.rows(c)])

    return cells.mapInArrow(made, SCHEMA)


def merged(*sketches: DataFrame, relative_error: float = 1e-3, width: int | None = None) -> DataFrame:
    """One sketch of each column from tables of sketches, which were made with this error or a smaller one."""
    width = width or width_of(relative_error)
    both = reduce(DataFrame.unionByName, sketches)

    def compacted(table):
        import pyarrow as pa

        buffers = Buffers(width)
        buffers.error = sum(table.column("error").to_pylist())
        for level, values in zip(table.column("level").to_pylist(), table.column("values")):
            buffers.add(np.array(values.as_py(), float), level)
        return pa.Table.from_batches([_batch(buffers.rows(table.column("column")[0].as_py()))])

    parts = both.rdd.getNumPartitions()
    while parts > MERGED_AT_ONCE:  # a tree of merges, so that no task takes all parts
        parts = math.ceil(parts / MERGED_AT_ONCE)
        both = both.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(parts))).groupBy("column", "_part").applyInArrow(compacted, SCHEMA)
    return both.groupBy("column").applyInArrow(compacted, SCHEMA)


def quantiles(table: DataFrame, q: list[float]) -> DataFrame:
    """(column, q, value, rank_error, n): values whose ranks miss max(1, floor(q * n)) by ``rank_error`` at most; of a merged sketch."""

    def found(rows):
        import pyarrow as pa

        values, weights, error = weighted(rows)
        upto, n = weights.cumsum(), int(weights.sum())
        ranks = [max(1, min(n, math.floor(x * n))) for x in q if n]
        out = [(rows.column("column")[0].as_py(), float(x), float(values[upto.searchsorted(r)]), error, n) for x, r in zip(q, ranks)]
        kinds = (("column", pa.string()), ("q", pa.float64()), ("value", pa.float64()), ("rank_error", pa.int64()), ("n", pa.int64()))
        return pa.table({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate(kinds)})

    return table.groupBy("column").applyInArrow(found, "column string, q double, value double, rank_error long, n long")


def weighted(rows) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted values of the rows of a sketch (Arrow) of one column, their weights and the rank error."""
    values = [np.array(v.as_py(), float) for v in rows.column("values")]
    weights = np.concatenate([np.full(len(v), 1 << level, np.int64) for v, level in zip(values, rows.column("level").to_pylist())])
    values = np.concatenate(values)
    order = np.argsort(values, kind="stable")
    return values[order], weights[order], sum(rows.column("error").to_pylist())
