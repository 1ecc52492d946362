"""Samples, splits and folds in a reproducible order: by the MD5 of seed and id.

Rows are numbered by counting digest prefixes first, so no task sorts all rows; the prefixes get longer with the table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..names import free, quoted


def key(seed: int, sample_id: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(sample_id).cast("string")))


#: Rows that one digest prefix is meant to hold.
ROWS_IN_PREFIX = 100_000


def numbered(df: DataFrame, sample_id: str, seed: int, by: list[str] | None = None, name: str = "_n") -> DataFrame:
    """``df`` with its row number ``name`` from 1 in digest order, within each group of ``by``."""
    by, p = by or [], free(df)
    digest, prefix, before_, many = f"{p}k", f"{p}p", f"{p}b", f"{p}c"
    d = df.withColumn(digest, key(seed, sample_id))
    digits = max(3, math.ceil(math.log(max(1, df.count()) / ROWS_IN_PREFIX + 1, 16)))
    d = d.withColumn(prefix, F.substring(digest, 1, digits))
    coarse = d.groupBy(*by, F.substring(prefix, 1, digits - 2).alias(f"{p}q"), prefix).agg(F.count("*").alias(many))
    # Two steps, so that no window runs over all prefixes.
    outer = coarse.groupBy(*by, f"{p}q").agg(F.sum(many).alias(f"{p}s"))
    outer = outer.withColumn(f"{p}o", F.sum(f"{p}s").over(Window.partitionBy(*by, F.lit(0)).orderBy(f"{p}q")) - F.col(f"{p}s")).drop(f"{p}s")
    inner = coarse.withColumn(f"{p}i", F.sum(many).over(Window.partitionBy(*by, f"{p}q").orderBy(prefix)) - F.col(many))
    same = [F.col(f"x.{quoted(c)}").eqNullSafe(F.col(f"y.{quoted(c)}")) for c in [*by, f"{p}q"]]
    before = inner.alias("x").join(outer.alias("y"), reduce(lambda a, b: a & b, same)).select(*[F.col(f"x.{quoted(c)}") for c in [*by, prefix]], (F.col(f"{p}o") + F.col(f"{p}i")).alias(before_))
    w = Window.partitionBy(*by, prefix).orderBy(digest, sample_id)
    same = [F.col(f"x.{quoted(c)}").eqNullSafe(F.col(f"y.{quoted(c)}")) for c in [*by, prefix]]
    joined = d.alias("x").join(before.alias("y"), reduce(lambda a, b: a & b, same)).select(*[F.col(f"x.{quoted(c)}") for c in d.columns], before_)
    return joined.withColumn(name, F.row_number().over(w) + F.col(before_)).drop(digest, prefix, before_)


def first_rows(df: DataFrame, sample_id: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows that are first in digest order, as a filter: sample ids are unique.

    Counts of digest prefixes find the one in which the nth row lies, three more digits a step; only that prefix, of at most ROWS_IN_PREFIX
    rows, is ordered. No row is moved.
    """
    if n <= 0:
        return df.limit(0)
    p = free(df)
    digest = f"{p}k"
    d = df.withColumn(digest, key(seed, sample_id))
    prefix, before, size = "", 0, None
    while size is None or (size > ROWS_IN_PREFIX and len(prefix) < 30):
        here = F.substring(digest, 1, len(prefix) + 3)
        counts = d.where(F.col(digest).startswith(prefix)).groupBy(here.alias("p")).count().collect()  # 4096 rows at most
        found = None
        for r in sorted(counts, key=lambda r: r["p"]):
            if before + r["count"] >= n:
                found = r
                break
            before += r["count"]
        if found is None:
            return df  # there are no more rows
        prefix, size = found["p"], found["count"]
    last = d.where(F.col(digest).startswith(prefix)).select(F.struct(digest, quoted(sample_id)).alias("at")).orderBy("at").limit(n - before)
    end = last.agg(F.max("at").alias("at")).first()["at"]
    nth = F.struct(F.lit(end[0]).alias(digest), F.lit(end[1]).cast(df.schema[sample_id].dataType).alias(sample_id))
    here = F.substring(digest, 1, len(prefix))
    return d.where((here < prefix) | ((here == prefix) & (F.struct(digest, quoted(sample_id)) <= nth))).drop(digest)


def sample(df: DataFrame, sample_id: str, n: int | None = None, frac: float | None = None, seed: int = 42) -> DataFrame:
    """Exactly n rows, or max(1, int(rows * frac))."""
    if (n is None) == (frac is None):
        raise ValueError("give n or frac")
    if frac is not None and frac > 1:
        raise ValueError("frac is at most 1 without replacement")
    return first_rows(df, sample_id, n if frac is None else max(1, int(df.count() * frac)), seed)


def resample(df: DataFrame, sample_id: str, n: int, seed: int = 42) -> DataFrame:
    """n draws with replacement; each has a new sample id, the SHA-256 of seed and draw. No rows from an empty table.

    Draw i takes the row whose place in digest order is the MD5 of seed and i, modulo the rows.
    """
    rows = df.count()
    draw = F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))
    place = F.conv(F.substring(F.md5(draw), 1, 12), 16, 10).cast("long") % max(rows, 1) + 1
    draws = df.sparkSession.range(1, n + 1).select(place.alias("_n"), F.sha2(draw, 256).alias("_new"))
    return numbered(df, sample_id, seed).join(draws, "_n").withColumn(sample_id, F.col("_new")).drop("_n", "_new")


def sample_by_label(df: DataFrame, sample_id: str, label: str, fractions: dict, seed: int = 42) -> DataFrame:
    """max(1, int(rows * frac)) rows of each label in ``fractions``."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    wanted = F.lit(0)
    for value, frac in fractions.items():
        wanted = F.when(F.col(label) == value, max(1, int(counts.get(value, 0) * frac))).otherwise(wanted)
    return numbered(df, sample_id, seed, [label]).where(F.col("_n") <= wanted).drop("_n")


def sizes(total: int, train, validate, test) -> tuple[int, int, int]:
    """Row counts from sizes that are all counts or all shares; what they leave goes to test."""
    given = [train, validate, test]
    if any(isinstance(x, float) for x in given):
        shares = [x or 0.0 for x in given]
        if abs(sum(shares) - 1.0) > 1e-6:
            raise ValueError("shares add up to 1")
        a, b = round(total * shares[0]), round(total * shares[1])
        return a, b, total - a - b
    counts = [x or 0 for x in given]
    if sum(counts) != total:
        raise ValueError("counts add up to the rows")
    return tuple(counts)


def split(df: DataFrame, sample_id: str, train, validate, test, seed: int = 42, label: str | None = None) -> DataFrame:
    """``df`` with column ``split``; stratified by ``label`` if given, where the last label gets what is left."""
    total = df.count()
    whole = sizes(total, train, validate, test)
    part = lambda a, b: F.when(F.col("_n") <= a, "train").when(F.col("_n") <= a + b, "validate").otherwise("test")
    if label is None:
        return numbered(df, sample_id, seed).withColumn("split", part(*whole[:2])).drop("_n")
    counts = [(r[label], r["count"]) for r in df.groupBy(label).count().orderBy(label).collect()]
    left, out = list(whole[:2]), None
    for k, (value, n) in enumerate(counts):
        own = left if k == len(counts) - 1 else [round(n / total * s) for s in whole[:2]]
        left = [a - b for a, b in zip(left, own)]
        here = part(*own)
        out = F.when(F.col(label) == value, here) if out is None else out.when(F.col(label) == value, here)
    return numbered(df, sample_id, seed, [label]).withColumn("split", out).drop("_n")


def in_order(df: DataFrame, sample_id: str, name: str = "_n") -> DataFrame:
    """``df`` with its row number from 1 by ascending sample id: ranges of ids are counted first."""
    p = free(df)
    d = df.repartitionByRange(quoted(sample_id)).sortWithinPartitions(quoted(sample_id)).withColumn(f"{p}m", F.monotonically_increasing_id())
    d = d.withColumn(f"{p}part", F.shiftright(f"{p}m", 33)).withColumn(f"{p}at", F.col(f"{p}m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = d.groupBy(f"{p}part").agg(F.count("*").alias(f"{p}c"))  # a row for each range
    before = sizes.select(f"{p}part", (F.sum(f"{p}c").over(Window.partitionBy(F.lit(0)).orderBy(f"{p}part")) - F.col(f"{p}c")).alias(f"{p}b"))
    return d.join(F.broadcast(before), f"{p}part").withColumn(name, F.col(f"{p}at") + F.col(f"{p}b") + 1).select(*[quoted(c) for c in df.columns], name)


def k_fold(df: DataFrame, sample_id: str, n_splits: int, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """``df`` with column ``fold`` from 0; the first (rows % n_splits) folds have one row more.

    Folds are runs of rows in digest order, or without ``shuffle`` in the order of the sample ids.
    """
    if n_splits < 2:
        raise ValueError("at least two folds")
    size, extra = divmod(df.count(), n_splits)
    i = F.col("_n") - 1
    cut = extra * (size + 1)
    fold = F.when(i < cut, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - cut) / max(size, 1)))
    placed = numbered(df, sample_id, seed) if shuffle else in_order(df, sample_id)
    return placed.withColumn("fold", fold.cast("int")).drop("_n")


def batches(df: DataFrame, sample_id: str, batch_size: int, seed: int = 42) -> DataFrame:
    return numbered(df, sample_id, seed).withColumn("batch_id", F.floor((F.col("_n") - 1) / batch_size).cast("long")).drop("_n")
