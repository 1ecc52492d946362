"""Artifacts of a run: tables, JSON models and metrics under one folder that Spark can read and write."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .frame import Frame


class Artifacts:
    """Named tables, frames, models and metric rows; each name is written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write_table(self, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/tables/{name}")

    def read_table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tables/{name}")

    def write_frame(self, name: str, frame: Frame) -> None:
        frame.write(f"{self.path}/frames/{name}")

    def read_frame(self, name: str) -> Frame:
        return Frame.read(self.spark, f"{self.path}/frames/{name}")

    def write_model(self, name: str, model: dict, about: dict | None = None) -> None:
        """A model of plain values as JSON, with what it was trained on or by."""
        text = json.dumps({"model": model, "about": about or {}})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.path}/models/{name}")

    def read_model(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/models/{name}", wholetext=True).first()[0])["model"]

    def append_metrics(self, df: DataFrame) -> None:
        """Rows of (group, metric, step, value)."""
        df.select("group", "metric", "step", "value").write.mode("append").parquet(f"{self.path}/metrics")

    def metrics(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/metrics")
