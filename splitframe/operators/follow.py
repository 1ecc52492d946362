"""Hosts that follow the guest's selection: one row index, by which all parties cut their tables alike.

The guest numbers its rows once and sends the index (match id, number), sorted in ranges of numbers. Every later split, fold or sample is a few
named ranges of numbers, which is all that is sent for it; each party keeps its own rows of a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import free, quoted
from ..party import Exchange
from ..storage import kept
from .sampling import numbered, sizes

NUMBER = "row_number"


def index(df: DataFrame, sample_id: str, match_id: str, seed: int = 42) -> DataFrame:
    """(match id, row_number) in digest order of the sample ids, in ranges of numbers."""
    rows = numbered(df, sample_id, seed, name=NUMBER).select(F.col(quoted(match_id)).alias("match_id"), NUMBER)
    return kept(rows.repartitionByRange(NUMBER).sortWithinPartitions(NUMBER))


def split_ranges(total: int, train=None, validate=None, test=None) -> dict[str, list[tuple[int, int]]]:
    """Ranges (from, to; ends included) of train, validate and test."""
    out, low = {}, 1
    for name, n in zip(("train", "validate", "test"), sizes(total, train, validate, test)):
        out[name] = [(low, low + n - 1)] if n else []
        low += n
    return out


def fold_ranges(total: int, n_splits: int) -> dict[str, list[tuple[int, int]]]:
    """For each fold its rows (``validate k``) and all others (``train k``); the first folds have one row more."""
    if n_splits < 2:
        raise ValueError("at least two folds")
    size, extra = divmod(total, n_splits)
    ends = [0]
    for k in range(n_splits):
        ends.append(ends[-1] + size + (k < extra))
    out = {}
    for k in range(n_splits):
        own = (ends[k] + 1, ends[k + 1])
        out[f"validate {k}"] = [own] if own[0] <= own[1] else []
        out[f"train {k}"] = [r for r in ((1, ends[k]), (ends[k + 1] + 1, total)) if r[0] <= r[1]]
    return out


def sample_range(total: int, n: int | None = None, frac: float | None = None) -> dict[str, list[tuple[int, int]]]:
    if (n is None) == (frac is None):
        raise ValueError("give n or frac")
    n = min(total, n if n is not None else max(1, int(total * frac)))
    return {"sample": [(1, n)] if n else []}


class Leader:
    """The guest: numbers its rows once, then sends ranges."""

    def __init__(self, exchange: Exchange, df: DataFrame, sample_id: str, match_id: str, hosts: list[str], seed: int = 42):
        self.exchange, self.hosts = exchange, hosts
        self.index = index(df, sample_id, match_id, seed)
        self.total = self.index.count()
        for host in hosts:
            exchange.send(self.index, "row_index", host, ["match_id", NUMBER])
        self.rows = _numbered(df, match_id, self.index)

    def select(self, name: str, ranges: dict[str, list[tuple[int, int]]]) -> dict[str, DataFrame]:
        """The guest's rows of each range; the hosts are sent the ranges under ``name``."""
        rows = [(part, low, high) for part, own in ranges.items() for low, high in own or [(1, 0)]]
        table = self.rows.sparkSession.createDataFrame(rows, "part string, low long, high long")
        for host in self.hosts:
            self.exchange.send(table, f"ranges_{name}", host, ["part", "low", "high"])
        return {part: _cut(self.rows, own) for part, own in ranges.items()}


class Follower:
    """A host: keeps the rows that the guest has, and cuts them by the ranges that it is sent."""

    def __init__(self, exchange: Exchange, host: str, df: DataFrame, match_id: str):
        self.exchange, self.host = exchange, host
        self.rows = _numbered(df, match_id, exchange.receive("row_index", host))

    def select(self, name: str) -> dict[str, DataFrame]:
        ranges: dict[str, list[tuple[int, int]]] = {}
        for r in self.exchange.receive(f"ranges_{name}", self.host).collect():  # a few rows
            ranges.setdefault(r.part, []).extend([(r.low, r.high)] if r.low <= r.high else [])
        return {part: _cut(self.rows, own) for part, own in ranges.items()}


def _numbered(df: DataFrame, match_id: str, numbers: DataFrame) -> DataFrame:
    """The rows of ``df`` that the index has, with their number; written once, in ranges of numbers."""
    p = free(df)
    met = df.join(numbers.select(F.col("match_id").alias(p), NUMBER), F.col(quoted(match_id)) == F.col(p)).drop(p)
    return kept(met.repartitionByRange(NUMBER).sortWithinPartitions(NUMBER))


def _cut(rows: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | F.col(NUMBER).between(low, high)
    return rows.where(inside)
