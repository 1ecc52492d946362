"""Row-sharded tensors as (row_id, v array<double>) tables; row ids are unique, and rows of one tensor have one length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tiles

_BINARY = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: F.try_divide(x, y)}


def from_shards(spark: SparkSession, shards: list[list[list[float]]]) -> DataFrame:
    """Local shards of rows, one after the other; all rows have the same length."""
    rows = [r for s in shards for r in s]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("shards differ in their columns")
    return spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rows)], "row_id long, v array<double>")


def checked(t: DataFrame) -> DataFrame:
    """``t`` if its rows have one length; raises otherwise."""
    ends = t.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b"), F.count("*").alias("n"), F.count_distinct("row_id").alias("d")).first()
    if ends.a != ends.b:
        raise ValueError("rows differ in their columns")
    if ends.n != ends.d:
        raise ValueError("row ids repeat")
    return t


def shape(t: DataFrame) -> tuple[int, int]:
    r = t.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("m")).first()
    return r.n, r.m


def unary(t: DataFrame, op: str) -> DataFrame:
    ops = {"exp": F.exp, "log": F.ln, "square": lambda x: x * x, "neg": lambda x: -x, "sigmoid": lambda x: 1 / (1 + F.exp(-x))}
    return t.select("row_id", F.transform("v", ops[op]).alias("v"))


def binary(a: DataFrame, b, op: str) -> DataFrame:
    """Element by element with a number, a local row, or a tensor; a tensor of one column meets every column of the other.

    Tensors meet row by row; a row id that only one of them has is an error, as are rows of other lengths.
    """
    f = _BINARY[op]
    if isinstance(b, (int, float)):
        return a.select("row_id", F.transform("v", lambda x: f(x, F.lit(float(b)))).alias("v"))
    if isinstance(b, (list, tuple)):
        row = F.array(*[F.lit(float(x)) for x in b])
        if len(b) == 1:
            return binary(a, b[0], op)
        return a.select("row_id", F.when(F.size("v") == len(b), F.zip_with("v", row, f)).otherwise(F.raise_error(F.lit("shapes differ"))).alias("v"))
    met = a.join(b.select("row_id", F.col("v").alias("w")), "row_id", "full")
    wide = F.when(F.size("v") == F.size("w"), F.zip_with("v", "w", f)).when(F.size("w") == 1, F.transform("v", lambda x: f(x, F.get("w", 0)))).when(F.size("v") == 1, F.transform("w", lambda y: f(F.get("v", 0), y)))
    return met.select("row_id", F.coalesce(wide, F.raise_error(F.lit("shapes differ"))).alias("v"))


def fixed_point(t: DataFrame, precision: int) -> DataFrame:
    """Cells as whole numbers of 2 ** -precision, halves away from zero."""
    return t.select("row_id", F.transform("v", lambda x: F.round(x * 2.0**precision).cast("long")).alias("v"))


def from_fixed_point(t: DataFrame, precision: int) -> DataFrame:
    return t.select("row_id", F.transform("v", lambda x: x / 2.0**precision).alias("v"))


def by_column(t: DataFrame, unbiased: bool = True) -> DataFrame:
    """(col, sum, mean, var, std, min, max) of each column, with partial sums before the shuffle."""
    var = F.var_samp("x") if unbiased else F.var_pop("x")
    return t.select(F.posexplode("v").alias("col", "x")).groupBy("col").agg(F.sum("x").alias("sum"), F.avg("x").alias("mean"), var.alias("var"), F.sqrt(var).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def by_row(t: DataFrame, unbiased: bool = True) -> DataFrame:
    total = lambda f: F.aggregate("v", F.lit(0.0), lambda a, x: a + f(x))
    n = F.size("v")
    out = t.select("row_id", "v", total(lambda x: x).alias("sum"), F.array_max("v").alias("max"), F.array_min("v").alias("min"))
    out = out.withColumn("mean", F.try_divide(F.col("sum"), n))
    out = out.withColumn("var", F.try_divide(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))), n - int(unbiased)))
    return out.select("row_id", "sum", "mean", "var", F.sqrt("var").alias("std"), "min", "max")


def keeping_dims(summary: DataFrame, name: str, axis: int) -> DataFrame:
    """A column of ``by_column`` (axis 0) as a tensor of one row, or of ``by_row`` (axis 1) as one of one column."""
    if axis == 1:
        return summary.select("row_id", F.array(name).alias("v"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("col", F.col(name).alias("x")))), lambda c: c["x"])  # as many as a row has
    return summary.agg(cells.alias("v")).select(F.lit(0).cast("long").alias("row_id"), "v")


def columns(t: DataFrame, which: list[int]) -> DataFrame:
    """The tensor of some columns, from 0; a row that is too short has NULL there."""
    return t.select("row_id", F.array(*[F.get("v", i) for i in which]).alias("v"))


def rows(t: DataFrame, which: int | list[int] | slice) -> DataFrame:
    """Some rows by their ids, which stay: one, a list, or a range with a step."""
    if isinstance(which, slice):
        low, step = which.start or 0, which.step or 1
        if low < 0 or (which.stop or 0) < 0 or step < 1:
            raise ValueError("ranges count from the first row")
        kept = (F.col("row_id") >= low) & ((F.col("row_id") - low) % step == 0)
        return t.where(kept if which.stop is None else kept & (F.col("row_id") < which.stop))
    return t.where(F.col("row_id").isin([which] if isinstance(which, int) else list(which)))


def stack(tensors: list[DataFrame]) -> DataFrame:
    """One under the other: each one's row ids follow those of the ones before."""
    out, before = [], 0
    for t in tensors:
        out.append(t.select((F.col("row_id") + before).alias("row_id"), "v"))
        before += t.agg(F.coalesce(F.max("row_id") + 1, F.lit(0))).first()[0]
    return reduce(DataFrame.unionByName, out)


def coordinates(t: DataFrame, transposed: bool = False) -> DataFrame:
    """(i, j, x) of each cell, or of the transpose: rows of any length, none of which is gathered."""
    d = t.select("row_id", F.posexplode("v").alias("col", "x"))
    i, j = ("col", "row_id") if transposed else ("row_id", "col")
    return d.select(F.col(i).alias("i"), F.col(j).alias("j"), "x")


def map_rows(t: DataFrame, f) -> DataFrame:
    """``f`` of the array column of each row."""
    return t.select("row_id", f(F.col("v")).alias("v"))


def map_reduce(t: DataFrame, f, op: str = "add", stride: int | None = None) -> DataFrame:
    """(shard, col, x): ``f`` of each row, then all rows made one column by column; by shards of ``stride`` rows if given."""
    of = {"add": F.sum, "min": F.min, "max": F.max}[op]
    shard = F.lit(0).cast("long") if stride is None else F.floor(F.col("row_id") / stride)
    return t.select(shard.alias("shard"), F.posexplode(f(F.col("v"))).alias("col", "x")).groupBy("shard", "col").agg(of("x").alias("x"))


def join_rows(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """``f`` of the two arrays of each row id that both have."""
    return a.join(b.select("row_id", F.col("v").alias("w")), "row_id").select("row_id", f(F.col("v"), F.col("w")).alias("v"))


def join_reduce(a: DataFrame, b: DataFrame, f, op: str = "add") -> DataFrame:
    return map_reduce(join_rows(a, b, f), lambda v: v, op).drop("shard")


def matmul_local(t: DataFrame, m: list[list[float]]) -> DataFrame:
    """Rows times a local matrix, whose columns are literals of the plan."""
    local = [F.array(*[F.lit(float(x)) for x in c]) for c in zip(*m)]
    dot = [F.aggregate(F.zip_with("v", c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for c in local]
    return t.select("row_id", F.array(*dot).alias("v"))


def rmatmul_local(m: list[list[float]], t: DataFrame) -> DataFrame:
    """(i, j, x) of a local matrix times the tensor, whose rows are the matrix's columns by row id."""
    column = F.array(*[F.array(*[F.lit(float(r[k])) for r in m]) for k in range(len(m[0]))])
    d = t.select(F.posexplode(F.get(column, F.col("row_id").cast("int"))).alias("i", "c"), "v").select("i", "c", F.posexplode("v").alias("j", "y"))
    return d.groupBy("i", "j").agg(F.sum(F.col("c") * F.col("y")).alias("x"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, x) of the product of two distributed tensors, by tiles."""
    inner_a, inner_b = a.agg(F.max(F.size("v"))).first()[0], b.count()
    if inner_a is not None and inner_a != inner_b:
        raise ValueError("inner sizes differ")
    return tiles.cells(tiles.product(tiles.from_rows(a), tiles.from_rows(b))).withColumn("j", F.col("j").cast("int"))


def dot(a: DataFrame, b: DataFrame) -> float:
    """Sum of the products of all cells of two tensors of one shape."""
    return join_reduce(a, b, lambda v, w: F.zip_with(v, w, _BINARY["mul"])).agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0]


def gram(t: DataFrame) -> DataFrame:
    """(i, j, value) of the product of the tensor's transpose with it, for i <= j."""
    d = t.select(F.posexplode("v").alias("i", "x"), "v").select("i", "x", F.posexplode("v").alias("j", "y")).where("i <= j")
    return d.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def to_local(t: DataFrame) -> list[list[float]]:
    """All rows in order, for tensors that are known to be small."""
    return [list(r.v) for r in t.orderBy("row_id").collect()]
