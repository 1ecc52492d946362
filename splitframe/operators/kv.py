"""Algebra of keyed tables: one row for each key, typed value columns.

Values change by Column expressions, or by Python functions of rows or partitions, which Spark calls batch by
batch with a declared schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..names import free, quoted


def join(left: DataFrame, right: DataFrame, key: str, merge=None) -> DataFrame:
    """Inner join; by default the left value stays. merge(l, r) works on the columns of one name."""
    return sorted_merge(left, right, key, both=merge or (lambda a, b: a))


def union(left: DataFrame, right: DataFrame, key: str, merge=None) -> DataFrame:
    """Keyed full outer merge; where both sides have the key, merge(l, r), by default the left value."""
    return sorted_merge(left, right, key, both=merge or (lambda a, b: a), left_only=lambda a: a, right_only=lambda b: b)


def sorted_merge(left: DataFrame, right: DataFrame, key: str, both=None, left_only=None, right_only=None) -> DataFrame:
    """One pass over both tables sorted by key; what is not given for keys of both sides or of one drops these keys."""
    p = free(left, right)
    values = [c for c in left.columns if c != key]
    ours = left.select(F.col(quoted(key)).alias(f"{p}k"), F.lit(True).alias(f"{p}l"), *[F.col(quoted(c)).alias(f"{p}a{i}") for i, c in enumerate(values)])
    theirs = right.select(F.col(quoted(key)).alias(f"{p}k"), F.lit(True).alias(f"{p}r"), *[F.col(quoted(c)).alias(f"{p}b{i}") for i, c in enumerate(values)])
    how = {(False, False): "inner", (True, False): "left", (False, True): "right", (True, True): "full"}[left_only is not None, right_only is not None]
    met = ours.join(theirs, f"{p}k", how)
    if both is None:
        met = met.where(F.col(f"{p}l").isNull() | F.col(f"{p}r").isNull())

    def pick(i: int):
        a, b = F.col(f"{p}a{i}"), F.col(f"{p}b{i}")
        out = F.lit(None) if both is None else both(a, b)
        if left_only is not None:
            out = F.when(F.col(f"{p}r").isNull(), left_only(a)).otherwise(out)
        if right_only is not None:
            out = F.when(F.col(f"{p}l").isNull(), right_only(b)).otherwise(out)
        return out.alias(values[i])

    return met.select(F.col(f"{p}k").alias(key), *[pick(i) for i in range(len(values))])


def subtract(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(quoted(key)), key, "left_anti")


def filter_values(df: DataFrame, condition) -> DataFrame:
    return df.where(condition)


def map_values(df: DataFrame, key: str, exprs: dict) -> DataFrame:
    return df.select(key, *[e.alias(n) for n, e in exprs.items()])


def flat_map(df: DataFrame, array_of_structs) -> DataFrame:
    return df.select(F.inline(array_of_structs))


def map_reduce(df: DataFrame, key, aggregates: dict) -> DataFrame:
    return df.groupBy(key).agg(*[a.alias(n) for n, a in aggregates.items()])


def reduce_all(df: DataFrame, aggregates: dict) -> DataFrame:
    return df.agg(*[a.alias(n) for n, a in aggregates.items()])


# Python functions
def _fields(schema: str) -> list[str]:
    return StructType.fromDDL(schema).fieldNames()


def _tuple(value) -> tuple:
    return value if isinstance(value, tuple) else (value,)


def map_partitions(df: DataFrame, function: Callable[[Iterator], Iterator], schema: str, batch: bool = True) -> DataFrame:
    """``function`` of an iterator of pandas frames, which are the batches of one partition, gives such frames.

    Without ``batch`` it gets an iterator of row dicts and gives tuples.
    """
    if batch:
        return df.mapInPandas(function, schema)
    return _rows(df, schema, function)


def _rows(df: DataFrame, schema: str, function) -> DataFrame:
    """``function`` of an iterator over a partition's rows as dicts gives tuples of ``schema``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def made(batches):
        rows = (row for b in batches for row in b.to_pylist())
        held: list[tuple] = []
        for one in function(rows):
            held.append(_tuple(one))
            if len(held) == 10_000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def _batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], names=kinds.names)

    return df.mapInArrow(made, schema)


def map_rows(df: DataFrame, function, schema: str, columns: list[str] | None = None, kept: list[str] | None = None) -> DataFrame:
    """One row for each row: the ``kept`` columns, then what ``function`` of a dict of ``columns`` gives. The key may change."""
    columns, kept = columns if columns is not None else df.columns, kept or []
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    fields = ", ".join([*(f"{quoted(c)} {kinds[c]}" for c in kept), schema])
    single = len(_fields(schema)) == 1

    def each(rows):
        for r in rows:
            out = function({c: r[c] for c in columns})
            yield (*(r[c] for c in kept), *((out,) if single and not isinstance(out, tuple) else tuple(out)))

    return _rows(df, fields, each)


def map_values_with(df: DataFrame, key: str, function, schema: str) -> DataFrame:
    """Values by a function of the row's values; keys stay."""
    return map_rows(df, function, schema, [c for c in df.columns if c != key], [key])


def flat_map_with(df: DataFrame, function, schema: str) -> DataFrame:
    """Any number of rows from a function of a row."""
    return _rows(df, schema, lambda rows: (out for r in rows for out in function(r)))


def filter_with(df: DataFrame, function) -> DataFrame:
    """Rows for which a function of the row is true."""
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)
    names = df.columns
    return _rows(df, schema, lambda rows: (tuple(r[c] for c in names) for r in rows if function(r)))


def map_reduce_partitions(df: DataFrame, mapper, reducer, schema: str) -> DataFrame:
    """(key, value) pairs from each row by ``mapper``, values of a key made one by ``reducer``, first in each partition.

    ``schema`` has the key and the value. A key that all partitions have gives as many rows to the second step as there are partitions.
    """
    key, value = _fields(schema)

    def own(rows):
        found: dict = {}
        for r in rows:
            for k, v in mapper(r):
                found[k] = reducer(found[k], v) if k in found else v
        yield from found.items()

    def together(pairs):
        values = pairs.column(value).to_pylist()
        return pairs.slice(0, 1).set_column(1, pairs.schema.field(value), [[reduce(reducer, values)]])

    return _rows(df, schema, own).groupBy(quoted(key)).applyInArrow(together, schema)


def reduce_with(df: DataFrame, reducer, column: str):
    """All values of a column made one by an associative function, on each partition first; None for no rows."""
    kind = dict(df.dtypes)[column]

    def own(rows):
        values = [r[column] for r in rows]
        if values:
            yield (reduce(reducer, values),)

    found = [r[0] for r in _rows(df.select(quoted(column)), f"v {kind}", own).collect()]  # a value for each partition
    return reduce(reducer, found) if found else None


def apply_partitions(df: DataFrame, aggregates: dict) -> DataFrame:
    """One row for each partition that has rows."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(*[a.alias(n) for n, a in aggregates.items()])


def apply_partitions_with(df: DataFrame, function, schema: str) -> DataFrame:
    """One row for each partition: what ``function`` of the iterator of its rows gives."""
    return _rows(df, schema, lambda rows: iter([function(rows)]))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
