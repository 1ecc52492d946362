"""Tiled matrices: a table of tiles (ti, tj, ids, width, cells), whose product is worked out by NumPy, block of tiles by block of tiles.

Tile (ti, tj) has the rows whose ids lie in [ti * SIDE, (ti + 1) * SIDE) and as many columns from tj * SIDE on; ``ids`` are
the rows that there are, ``cells`` their float64 cells row by row. Only tiles are shuffled, never single cells, and a task holds
BLOCK x BLOCK tiles of either side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 128
BLOCK = 8
SCHEMA = "ti long, tj long, ids array<bigint>, width int, cells binary"


def _table(rows):
    import pyarrow as pa

    columns = list(zip(*rows)) or [[]] * 5
    kinds = (("ti", pa.int64()), ("tj", pa.int64()), ("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("cells", pa.binary()))
    return pa.table({n: pa.array(list(c), t) for c, (n, t) in zip(columns, kinds)})


def _matrix(ids, width: int, cells: bytes) -> np.ndarray:
    return np.frombuffer(cells, np.float64).reshape(len(ids), width)


def from_rows(t: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of a tensor (row_id, v)."""
    parts = t.select("row_id", F.floor(F.col("row_id") / side).alias("ti"), "v", F.explode(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / side).cast("int"))).alias("tj")).where("size(v) > 0")
    cut = parts.select("ti", F.col("tj").cast("long").alias("tj"), "row_id", F.slice("v", F.col("tj") * side + 1, F.lit(side)).cast("array<double>").alias("v"))

    def tile(rows):
        rows = rows.sort_by("row_id")
        ids = rows.column("row_id").to_pylist()
        cells = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return _table([(rows.column("ti")[0].as_py(), rows.column("tj")[0].as_py(), ids, len(cells) // len(ids), cells.tobytes())])

    return cut.groupBy("ti", "tj").applyInArrow(tile, SCHEMA)


def transposed(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of the transpose; row ids that are missing are columns of zeros."""
    rows = (tiles.agg(F.max(F.array_max("ids"))).first()[0] or 0) + 1

    def turned(batches):
        for batch in batches:
            out = []
            for ti, tj, ids, width, cells in zip(*(c.to_pylist() for c in batch.columns)):
                whole = np.zeros((min(side, rows - ti * side), width))
                whole[np.array(ids) - ti * side] = _matrix(ids, width, cells)
                out.append((tj, ti, list(range(tj * side, tj * side + width)), len(whole), np.ascontiguousarray(whole.T).tobytes()))
            yield from _table(out).to_batches()

    return tiles.select("ti", "tj", "ids", "width", "cells").mapInArrow(turned, SCHEMA)


def product(a: DataFrame, b: DataFrame, side: int = SIDE, block: int = BLOCK) -> DataFrame:
    """Tiles of ``a`` times ``b``: blocks of tiles meet by their inner index, their products are added up tile by tile."""
    across = (b.agg(F.max("tj")).first()[0] or 0) // block + 1
    down = (a.agg(F.max("ti")).first()[0] or 0) // block + 1
    left = a.select(F.floor(F.col("ti") / block).alias("bi"), F.floor(F.col("tj") / block).alias("bk"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("bj"), "*")
    right = b.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("bi"), F.floor(F.col("ti") / block).alias("bk"), F.floor(F.col("tj") / block).alias("bj"), "*")

    def tiles_of(table):
        return [(r["ti"], r["tj"], r["ids"], _matrix(r["ids"], r["width"], r["cells"])) for r in table.to_pylist()]

    def multiplied(lefts, rights):
        by_inner: dict = {}
        for tk, tj, ids, m in tiles_of(rights):
            whole = np.zeros((side, m.shape[1]))
            whole[np.array(ids) - tk * side] = m
            by_inner.setdefault(tk, []).append((tj, whole))
        sums: dict = {}
        for ti, tk, ids, m in tiles_of(lefts):
            for tj, whole in by_inner.get(tk, ()):
                made = m @ whole[: m.shape[1]]
                old = sums.get((ti, tj))
                sums[ti, tj] = (ids, made if old is None else old[1] + made)
        return _table([(ti, tj, ids, m.shape[1], m.tobytes()) for (ti, tj), (ids, m) in sums.items()])

    def added(table):
        rows = table.to_pylist()
        ids, width = rows[0]["ids"], rows[0]["width"]
        return _table([(rows[0]["ti"], rows[0]["tj"], ids, width, sum(_matrix(ids, width, r["cells"]) for r in rows).tobytes())])

    keys = ["bi", "bk", "bj"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiplied, SCHEMA)
    return parts.groupBy("ti", "tj").applyInArrow(added, SCHEMA)


def cells(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """(i, j, x) of each cell."""
    import pyarrow as pa

    def listed(batches):
        for batch in batches:
            for ti, tj, ids, width, own in zip(*(c.to_pylist() for c in batch.columns)):
                columns = [np.repeat(np.array(ids, np.int64), width), np.tile(np.arange(tj * side, tj * side + width, dtype=np.int64), len(ids)), np.frombuffer(own, np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "x"])

    return tiles.select("ti", "tj", "ids", "width", "cells").mapInArrow(listed, "i long, j long, x double")
