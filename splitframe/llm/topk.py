"""Operator 4, exact top-k by inner product over vector-approximation files.

The file of approximations has a byte for each component: the number of its cell. Every block of vectors cuts each dimension at quantiles of
its own components, and its row holds the least and the greatest component of each cell, so bounds are as close as the block's vectors let them be. The few vectors of a
block whose components are far out (at most one in FAR_SHARE) are held exactly beside the cells, so that they widen none. Only this file meets the
queries, in units of a block of it and a block of queries, both of bounded size:

1. A first scan of the cells gives lower bounds of the scores; the kth largest of a query over all
   blocks is surely reached.
2. A second scan gives the vectors whose upper bound reaches that bound.
3. Exact vectors of these are read by row in the order of the upper bound: first 2 k of each query; then
   only those whose bound still reaches the kth exact score, after which the result is certain.

Of vectors that are equal in all components only the k + 1 of smallest id can be in a result; the others leave at
the start, so a vector that very many rows hold costs no more than k + 1 rows.

A block of cells is sent once for each block of queries; with b bytes of memory for a unit, blocks of b / 16 / dimensions queries fit.

Edge cases: vectors that are null or empty, or that hold null or non-finite components, take no part.
A query meets only the vectors of its own length; lengths differ freely. Equal scores go to the smaller id; repeated ids
stand once for each row, and a query meets no row of its own id. Rows without id take no part. Fewer than k
candidates give fewer rows, an empty table none. All finite components count exactly, however large: scores that pass 64 bits are summed in whole numbers of any size
and ranked by them; their ``score`` is null, as no long holds it, and ``with_text`` adds it as text.
Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved

#: Cells of a dimension: as many as a byte tells apart.
CELLS = 256
VECTORS_IN_BLOCK = 16_384
QUERIES_IN_BLOCK = 4_096
#: Queries of a block that are scanned at once.
QUERIES_AT_ONCE = 128
#: One vector in so many can be held exactly beside its block, if its largest component is FAR_TIMES that of the others.
FAR_SHARE = 128
FAR_TIMES = 4.0
#: Components (times the scale) up to here are summed in 64 bits, for up to 2**12 of them.
PLAIN = 2.0**25
_LARGEST = np.finfo(np.float64).max


def cut(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, low, high, far) of a block of vectors: cell numbers, the ends of each dimension's cells, and the places of the vectors held exactly."""
    rows, n = values.shape
    largest = np.abs(values).max(1)
    order = np.argsort(largest, kind="stable")
    most = rows // FAR_SHARE
    usual = largest[order[rows - most - 1]]
    far = order[rows - most :][largest[order[rows - most :]] > FAR_TIMES * usual] if most else order[:0]
    near = np.ones(rows, bool)
    near[far] = False
    cells = np.zeros((rows, n), np.uint8)
    low, high = np.zeros((n, CELLS)), np.zeros((n, CELLS))
    for d in range(n):
        x = values[near, d]
        edges = np.unique(np.quantile(x, np.arange(1, CELLS) / CELLS, method="lower"))
        own = np.searchsorted(edges, x, side="right").clip(0, CELLS - 1)
        cells[near, d] = own
        low[d], high[d] = np.inf, -np.inf
        np.minimum.at(low[d], own, x)
        np.maximum.at(high[d], own, x)
    low[~np.isfinite(low)] = high[~np.isfinite(high)] = 0.0  # cells without vectors
    return cells, low, high, far


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of ``queries`` with vectors between ``low`` and ``high``."""
    kind = np.float64
    most = max(np.abs(queries).max(initial=0.0), np.abs(low).max(initial=0.0), np.abs(high).max(initial=0.0))
    if most > 1e100:  # products would pass a double
        kind = np.longdouble
    q, low, high = queries.astype(kind), low.astype(kind), high.astype(kind)
    middle, half = (low + high) / 2, (high - low) / 2
    about, spread = q @ middle.T, np.abs(q) @ half.T
    reach = np.maximum(np.abs(low), np.abs(high)).max(axis=0, initial=0)
    slack = (2.0**-50 * (low.shape[1] + 2) * (np.abs(q) @ reach))[:, None]  # of the sums in floating point
    clipped = [np.clip(x, -_LARGEST, _LARGEST).astype(np.float64) for x in (about - spread - slack, about + spread + slack)]
    return clipped[0], clipped[1]


def far_key(score: int) -> bytes:
    """Bytes in the order of whole numbers beyond 64 bits of one sign."""
    size = (abs(score).bit_length() + 7) // 8
    data = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return data if score >= 0 else bytes(255 - b for b in data)


def _dot(scale: int):
    def dotted(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (batch.column(c) for c in ("v", "w"))
            n = np.diff(x.offsets.to_numpy())
            a, b = x.flatten().to_numpy() * float(scale), y.flatten().to_numpy() * float(scale)
            starts = np.cumsum(n) - n
            some = np.repeat(np.arange(len(n)), n)
            large = np.zeros(len(n), bool)
            np.logical_or.at(large, some, ~((np.abs(a) < PLAIN) & (np.abs(b) < PLAIN)))
            large |= n > 4096
            fine = ~large[some]
            products = np.where(fine, a, 0).astype(np.int64) * np.where(fine, b, 0).astype(np.int64)
            score = np.add.reduceat(products, starts) if len(n) else np.zeros(0, np.int64)
            side, far, text = np.zeros(len(n), np.int8), [None] * len(n), [None] * len(n)
            reached = score / float(scale) ** 2
            for k in np.flatnonzero(large):
                own = slice(starts[k], starts[k] + n[k])
                whole = sum(_whole(p, scale) * _whole(q, scale) for p, q in zip(x.flatten()[own].to_pylist(), y.flatten()[own].to_pylist()))
                if -(2**63) <= whole < 2**63:
                    score[k] = whole
                else:
                    side[k], far[k], text[k] = (1 if whole > 0 else -1), far_key(whole), str(whole)
                units = whole // scale**2
                reached[k] = float(units) if abs(units) < 2**1023 else 2.0**1023 if units > 0 else -_LARGEST
            reached = np.nextafter(reached, -np.inf).clip(-_LARGEST, _LARGEST)  # no more than the score
            columns = [batch.column("query"), batch.column("query_id"), batch.column("vec_id"), pa.array(side), pa.array(score), pa.array(far, pa.binary()), pa.array(reached), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["query", "query_id", "vec_id", "side", "score", "far", "reached", "text"])

    return dotted


def _whole(x: float, scale: int) -> int:
    return math.floor(x * scale) if abs(x) < 2.0**900 else int(x) * scale


def top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, vectors_in_block: int = VECTORS_IN_BLOCK, queries_in_block: int = QUERIES_IN_BLOCK, with_text: bool = False
) -> DataFrame:
    """query_id, rank, vec_id, score for queries ``vec_id % every == 0`` of ``vectors`` (vec_id, embedding); ``scale`` is a power of two."""
    import pyarrow as pa

    if scale < 1 or scale & (scale - 1):
        raise ValueError("the scale is a power of two")
    # A component is its whole number divided by the scale, which any double holds exactly.
    part = lambda x: F.when(F.abs(x) < 2.0**46, F.floor(x * scale) / float(scale) + 0.0).otherwise(x)
    clean = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
        .where("vec_id is not null and e is not null and size(e) > 0")
        .where(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .select("vec_id", F.size("e").cast("long").alias("n"), F.transform("e", part).alias("v"))
    )
    asked = saved(clean.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("query", F.monotonically_increasing_id()), "topk-queries")
    few = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = saved(clean.withColumn("copy", few).where(F.col("copy") <= k + 1).drop("copy").withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    about = kept.groupBy("n").agg(F.ceil(F.count("*") / vectors_in_block).alias("blocks"))
    about = saved(about.join(asked.groupBy("n").agg(F.ceil(F.count("*") / queries_in_block).alias("query_blocks")), "n"), "topk-lengths")

    def packed(table):
        n = table.column("n")[0].as_py()
        values = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, n)
        cell, low, high, far = cut(values)
        return pa.table({
            "n": [n], "query_blocks": table.column("query_blocks")[:1], "rows": [table.column("row").to_numpy().tobytes()], "ids": [table.column("vec_id").to_numpy().tobytes()],
            "cells": [cell.tobytes()], "low": [low.tobytes()], "high": [high.tobytes()], "far": [far.astype(np.int64).tobytes()], "far_values": [np.ascontiguousarray(values[far]).tobytes()],
        })

    dealt = kept.join(F.broadcast(about), "n").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))  # a row for each length
    file_schema = "n long, query_blocks long, rows binary, ids binary, cells binary, low binary, high binary, far binary, far_values binary"
    file = saved(dealt.groupBy("n", "block").applyInArrow(packed, file_schema), "topk-cells")

    def asking(table):
        values = table.column("v").combine_chunks().flatten().to_numpy()
        return pa.table({
            "n": table.column("n")[:1], "q": table.column("q")[:1], "queries": [table.column("query").to_numpy().tobytes()], "query_ids": [table.column("vec_id").to_numpy().tobytes()],
            "values": [values.tobytes()], "least": [table.column("least").to_numpy().tobytes()],
        })

    def units(queries: DataFrame) -> DataFrame:
        """Each block of cells with each block of queries of its length."""
        blocks = queries.join(F.broadcast(about.select("n", "query_blocks")), "n").withColumn("q", F.pmod(F.xxhash64("query"), F.col("query_blocks")))
        blocks = blocks.groupBy("n", "q").applyInArrow(asking, "n long, q long, queries binary, query_ids binary, values binary, least binary")
        each = file.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)))
        return each.join(blocks, ["n", "q"]).drop("q", "query_blocks")

    def scanned(batches):
        """(queries, their least scores, rows, lower, upper bounds) of a few queries and one block at a time."""
        for batch in batches:
            for u in range(batch.num_rows):
                one = {name: batch.column(name)[u].as_py() for name in batch.schema.names}
                n = one["n"]
                rows, ids, queries, query_ids, far = (np.frombuffer(one[c], np.int64) for c in ("rows", "ids", "queries", "query_ids", "far"))
                cell = np.frombuffer(one["cells"], np.uint8).reshape(len(rows), n)
                low, high = (np.frombuffer(one[c]).reshape(n, CELLS)[np.arange(n), cell] for c in ("low", "high"))
                exact = np.frombuffer(one["far_values"]).reshape(len(far), n)
                values, least = np.frombuffer(one["values"]).reshape(-1, n), np.frombuffer(one["least"])
                for a in range(0, len(queries), QUERIES_AT_ONCE):
                    part = slice(a, a + QUERIES_AT_ONCE)
                    lower, upper = bounds(values[part], low, high)
                    if len(far):
                        lower[:, far], upper[:, far] = bounds(values[part], exact, exact)
                    own = query_ids[part, None] == ids
                    lower[own] = upper[own] = -np.inf
                    yield queries[part], least[part], rows, lower, upper

    def lower_bounds(batches):
        for queries, _, rows, lower, _ in scanned(batches):
            best = -np.partition(-lower, min(k, len(rows)) - 1, axis=1)[:, :k]
            named = np.repeat(queries, best.shape[1])
            some = np.isfinite(best.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(named[some]), pa.array(best.ravel()[some])], ["query", "lower"])

    def candidates(batches):
        for queries, least, rows, _, upper in scanned(batches):
            q, v = np.nonzero((upper >= least[:, None]) & np.isfinite(upper))
            yield pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(rows[v]), pa.array(upper[q, v])], ["query", "row", "upper"])

    lowest = F.lit(float("-inf"))
    sure = units(asked.withColumn("least", lowest)).mapInArrow(lower_bounds, "query long, lower double")
    sure = sure.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower")))).where(F.col("r") == k).select("query", F.col("lower").alias("least"))
    bounded = saved(asked.join(sure, "query", "left").fillna({"least": float("-inf")}), "topk-bounded")
    survivors = units(bounded).mapInArrow(candidates, "query long, row long, upper double")
    survivors = saved(survivors.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("upper"), "row"))), "topk-survivors")

    def exact(wanted: DataFrame) -> DataFrame:
        read = wanted.join(kept.select("row", "vec_id", F.col("v")), "row").join(asked.select("query", F.col("vec_id").alias("query_id"), F.col("v").alias("w")), "query")
        return read.select("query", "query_id", "vec_id", "v", "w").mapInArrow(_dot(scale), "query long, query_id long, vec_id long, side byte, score long, far binary, reached double, text string")

    order = Window.partitionBy("query").orderBy(F.desc("side"), F.desc("score"), F.desc("far"), "vec_id")
    first = saved(exact(survivors.where(F.col("r") <= 2 * k)), "topk-first")
    reached = first.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query", "reached")
    rest = exact(survivors.where(F.col("r") > 2 * k).join(reached, "query").where(F.col("upper") >= F.col("reached")).drop("reached"))
    found = saved(first.unionAll(rest), "topk-found")
    discard(first, survivors, bounded, file, kept, asked, about)
    score = F.when(F.col("side") == 0, F.col("score"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"), F.coalesce("text", F.col("score").cast("string")).alias("score_text"))
    return best if with_text else best.drop("score_text")
