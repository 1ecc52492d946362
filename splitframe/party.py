"""Parties and the boundary between them: what one party lets another see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .frame import Frame


class Exchange:
    """One-shot named transfers; each allows a list of columns and no more.

    With a ``path`` (a folder both sides can reach) what is sent is written there, so that the receiver may be another
    application; without one, both sides share the session.
    """

    def __init__(self, spark: SparkSession | None = None, path: str | None = None):
        self.spark, self.path = spark, path.rstrip("/") if path else None
        self._sent: dict[tuple[str, str], DataFrame] = {}
        self.log: list[tuple[str, str, tuple[str, ...]]] = []

    def send(self, frame: Frame | DataFrame, name: str, to: str, columns: list[str]) -> None:
        if (name, to) in self._sent:
            raise ValueError(f"{name} was sent to {to} before")
        df = (frame.df if isinstance(frame, Frame) else frame).select(*columns)
        if self.path:
            df.write.mode("error").parquet(f"{self.path}/{to}/{name}")  # fails if another application has sent it
        self._sent[name, to] = df
        self.log.append((name, to, tuple(columns)))

    def receive(self, name: str, to: str) -> DataFrame:
        if self.path:
            return (self.spark or SparkSession.active()).read.parquet(f"{self.path}/{to}/{name}")
        return self._sent[name, to]
