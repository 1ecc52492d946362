"""Readers and writers: Spark's sources with column roles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame

SCHEMES = ("file", "hdfs", "hive", "s3a", "viewfs")


def read_csv(spark: SparkSession, path: str, schema: str, sample_id: str, sep: str = ",", header: bool = True, na_values: str | None = None, **roles) -> Frame:
    """Typed delimited text; types come from ``schema``, never from the data."""
    options = {"sep": sep, "header": header, "schema": schema} | ({"nullValue": na_values} if na_values else {})
    return Frame.from_spark(spark.read.csv(path, **options), sample_id, **roles)


def read_parquet(spark: SparkSession, path: str, sample_id: str, **roles) -> Frame:
    return Frame.from_spark(spark.read.parquet(path), sample_id, **roles)


def read_table(spark: SparkSession, namespace: str, name: str, sample_id: str, **roles) -> Frame:
    return Frame.from_spark(spark.table(f"{namespace}.{name}"), sample_id, **roles)


def from_pandas(spark: SparkSession, pdf, sample_id: str | None = None, match_id: str | None = None, **roles) -> Frame:
    """Without a sample id the index becomes one; a sample id without a match id is an error."""
    if sample_id is not None and match_id is None:
        raise ValueError("a sample id needs a match id")
    if sample_id is None:
        pdf, sample_id = pdf.rename_axis("sample_id").reset_index(), "sample_id"
    return Frame.from_spark(spark.createDataFrame(pdf), sample_id, match_id, **roles)


def parallelize(spark: SparkSession, rows: list, schema: str, include_key: bool = True, partitions: int = 8) -> DataFrame:
    """Rows of (key, value...), or values that get the keys 0 to n - 1."""
    data = rows if include_key else [(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)]
    df = spark.createDataFrame(data, schema)
    return df.repartition(partitions, df.columns[0])


def read_keyed_table(
    spark: SparkSession, path: str, header: list[str], sample_id: str = "sample_id", match_id: str | None = None, label: str | None = None, weight: str | None = None,
    delimiter: str = ",", dtype: str | dict[str, str] = "float", label_type: str = "int", weight_type: str = "float", na_values: str | list[str] | dict[str, list[str]] | None = None, site: str = "local",
) -> Frame:
    """Lines of a key and delimited values, as a frame: ``header`` names the values, the key is the sample id.

    ``dtype`` is the type of all features or of each (others are floats). ``na_values`` are texts that mean NULL, for
    all columns or by column. What does not parse in its type is NULL too.
    """
    cut = re.escape(delimiter)
    values = F.split(F.get(F.split("value", cut, 2), 1), cut, -1)
    kinds = {c: label_type if c == label else weight_type if c == weight else "string" if c == match_id else (dtype.get(c, "float") if isinstance(dtype, dict) else dtype) for c in header}

    def cell(k: int, c: str):
        text = F.trim(F.get(values, k))
        absent = na_values.get(c, []) if isinstance(na_values, dict) else na_values or []
        absent = [absent] if isinstance(absent, str) else list(absent)
        return F.when(~text.isin(["", *absent]), text).try_cast(kinds[c]).alias(c)

    df = spark.read.text(path).select(F.get(F.split("value", cut, 2), 0).alias(sample_id), *[cell(k, c) for k, c in enumerate(header)])
    own = {sample_id, match_id, label, weight}
    return Frame.from_spark(df, sample_id, match_id, label, weight, [c for c in header if c not in own], site)


def read_keyed_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of "key,rest"."""
    parts = F.split("value", ",", 2)
    return spark.read.text(path).select(parts[0].alias("key"), F.get(parts, 1).alias("value"))


def load(spark: SparkSession, uri: str) -> DataFrame:
    """By scheme: a Hive table (hive://database.table) or files, by their ending."""
    scheme, _, rest = uri.partition("://")
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme}")
    if scheme == "hive":
        return spark.table(rest.replace("/", "."))
    for ending in ("parquet", "csv", "json", "orc"):
        if uri.rstrip("/").endswith(ending):
            return spark.read.format(ending).load(uri)
    return spark.read.text(uri)


def save(df: DataFrame, uri: str, partitions: int | None = None) -> None:
    df = df.repartition(partitions) if partitions else df
    if uri.startswith("hive://"):
        df.write.mode("overwrite").saveAsTable(uri[7:].replace("/", "."))
    else:
        df.write.mode("overwrite").parquet(uri)
