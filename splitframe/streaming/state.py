"""A stateful stream operator: events once each, with late events told apart.

State is kept by key: the newest time of former batches, and the ids of events that are not older than it by more than ``late``. An event that is
older is late; one whose id is held is a repeat. Ids leave the state when their time falls behind, so it holds no more than the events of that span.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..names import quoted

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Once(StatefulProcessor):
    def __init__(self, event_id: str, ts: str, late_ms: int):
        self.event_id, self.ts, self.late_ms = event_id, ts, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at bigint")
        self.seen = handle.getMapState("seen", "id string", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        edge = None if newest is None else newest - self.late_ms
        for batch in rows:
            at = (batch[self.ts].astype("datetime64[us]").astype("int64") // 1000).tolist()
            keep, late = [], []
            for k, (name, ms) in enumerate(zip(batch[self.event_id].astype(str), at)):
                if edge is not None and ms < edge:
                    keep.append(k)
                    late.append(True)
                elif not self.seen.containsKey((name,)):
                    self.seen.updateValue((name,), (ms,))
                    keep.append(k)
                    late.append(False)
                newest = ms if newest is None else max(newest, ms)
            out = batch.iloc[keep].copy()
            out["late"] = late
            yield out
        if newest is not None:
            self.newest.update((newest,))
            old = [name for name, (ms,) in self.seen.iterator() if ms < newest - self.late_ms]
            for name in old:
                self.seen.removeKey(name)

    def close(self) -> None:
        pass


def once(events: DataFrame, key: str, event_id: str, ts: str, late_ms: int) -> DataFrame:
    """The stream's events once each, with column ``late``: whether the event is older than the key's newest one of former batches by more than ``late_ms``.

    Late events are not compared with each other: each comes out as it is. Events without key, id or time are left out. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    names = events.columns
    plain = {c: f"c{k}" for k, c in enumerate(names)}  # any name of a column goes
    whole = events.where(F.col(quoted(key)).isNotNull() & F.col(quoted(event_id)).isNotNull() & F.col(quoted(ts)).isNotNull())
    whole = whole.select(*[F.col(quoted(c)).alias(plain[c]) for c in names])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema.fields) + ", late boolean"
    made = whole.groupBy(plain[key]).transformWithStateInPandas(_Once(plain[event_id], plain[ts], late_ms), schema, "Append", "None")
    return made.select(*[F.col(plain[c]).alias(c) for c in names], "late")


def routed(marked: DataFrame, on_time: str, late: str, checkpoint: str):
    """Start a query that appends events on time and late ones to tables of their own, each micro-batch once."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        for path, wanted in ((on_time, False), (late, True)):
            held.where(F.col("late") == wanted).drop("late").write.mode("overwrite").parquet(f"{path}/batch={number}")  # written anew if the batch runs again
        held.unpersist()

    return marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
