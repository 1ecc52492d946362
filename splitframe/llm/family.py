"""Operator 5 across batches: a logarithmic family of sorted anchor lists that is kept on shared storage.

A level indexes the texts of consecutive batches: their blocks, and the anchors of the blocks' runs in the order of the
anchors, dealt out by their highest bits. Of a level of n bytes, a range holds about GROUP_ANCHORS anchors; a range is in slices
by block, so that an anchor that all blocks hold adds SLICE_BLOCKS entries at most to any slice.

1. A new batch gets its own lists, and from these the distinct anchors that it asks for.
2. Each level is scanned once: its lists and the asked anchors are sorted and meet by range. Levels are tables bucketed by
   range, so that only what is asked is shuffled. What comes out are the places of shared anchors.
3. Blocks that hold a shared anchor send the bytes around it, as within one batch, and strings are compared byte by byte. Blocks
   are bucketed by their names, so that here too the level stays where it is.
4. The batch becomes the lowest level. Levels of like size merge, list by list in order, so that there are
   logarithmically many and an anchor is moved logarithmically often.

The list of levels is written after each batch, before what it replaces is removed: ``IndexFamily.opened`` goes on from it, also after
a driver was lost in the midst of a batch.

Edge cases: as in ``suffixes``. Of two batches the one added first is earlier, whatever the ids. A row that comes
again in a later batch loses all that LENGTH bytes cover. An empty batch gives an empty table and adds no level.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, mix64, saved, shared_dir
from .slices import bits_for, pack, pack_sorted, unpack, unpack_sorted
from .suffixes import _BLOCK, BATCH_STARTS, GROUP_ANCHORS, GROUP_STARTS, HOT_RUNS, LENGTH, _anchors, _apply, _blocks, _contexts, _hot_repeats, _repeats, _with_digest

SLICE_BLOCKS = 500_000
#: Text that a bucket of a level's tables stands for; larger where a level would have more than MOST_BUCKETS.
BUCKET_BYTES = 256_000_000
MOST_BUCKETS = 50_000
_LIST = "range long, slice long, n long, keys binary, batch binary, block binary, runs binary"
_ASKED = "range long, keys binary, runs binary"
_PLACE = "key long, batch long, block long, runs long, asked long"
_FLAG = "batch long, block long, keys binary, flags binary, highest int"


class Level(NamedTuple):
    """Bytes, blocks and anchors of batches ``first`` to ``last``, and where their tables are."""

    size: int
    blocks: int
    anchors: int
    bits: int
    buckets: int
    first: int
    last: int
    folder: str


def _cuts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal ``values`` begins, and their number at the end."""
    return np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values)) if len(values) else np.zeros(1, np.int64)


def _summed(keys: list, runs: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's runs."""
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(inverse, weights=np.concatenate(runs), minlength=len(found)).astype(np.int64)


def _lists(rows: DataFrame, bits: int, slices: int) -> DataFrame:
    """Sorted lists by range and slice, from the anchors of blocks or from lists of other ranges and slices."""
    import pyarrow as pa

    def dealt(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                keys, runs = unpack_sorted(row["keys"]), unpack(row["runs"])
                of, block = (np.full(len(keys), row[c]) if isinstance(row[c], int) else unpack(row[c]) for c in ("batch", "block"))
                slice_ = (mix64(block.astype(np.uint64) ^ (of.astype(np.uint64) << np.uint64(48))) % np.uint64(slices)).astype(np.int64)
                top = (keys >> np.uint64(64 - bits)).astype(np.int64)
                by = np.argsort(top * slices + slice_, kind="stable")
                keys, of, block, runs, top, slice_ = (x[by] for x in (keys, of, block, runs, top, slice_))
                cut = _cuts(top * slices + slice_)
                some = list(zip(cut, cut[1:]))
                if some:
                    columns = [[top[a] for a, _ in some], [slice_[a] for a, _ in some], [b - a for a, b in some], [pack_sorted(keys[a:b]) for a, b in some], *[[pack(x[a:b]) for a, b in some] for x in (of, block, runs)]]
                    kinds = [pa.int64()] * 3 + [pa.binary()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["range", "slice", "n", "keys", "batch", "block", "runs"])

    def merged(table):
        keys = np.concatenate([unpack_sorted(x) for x in table.column("keys").to_pylist()])
        rest = [np.concatenate([unpack(x) for x in table.column(c).to_pylist()]) for c in ("batch", "block", "runs")]
        by = np.argsort(keys, kind="stable")  # merges what is in order by pieces
        return pa.table({"range": table.column("range")[:1], "slice": table.column("slice")[:1], "n": [len(keys)], "keys": [pack_sorted(keys[by])], **{c: [pack(x[by])] for c, x in zip(("batch", "block", "runs"), rest)}})

    return rows.select("keys", "batch", "block", "runs").mapInArrow(dealt, _LIST).groupBy("range", "slice").applyInArrow(merged, _LIST)


def _asked(lists: DataFrame) -> DataFrame:
    """By range the distinct anchors of ``lists`` and the number of their different runs."""
    import pyarrow as pa

    def own(batches):
        for batch in batches:
            rows = [(r, *_summed([unpack_sorted(k)], [unpack(n)])) for r, k, n in zip(*(batch.column(c).to_pylist() for c in range(3)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in rows], pa.int64()), pa.array([pack_sorted(k) for _, k, _ in rows], pa.binary()), pa.array([pack(n) for _, _, n in rows], pa.binary())], ["range", "keys", "runs"])

    def total(table):
        keys, runs = _summed([unpack_sorted(x) for x in table.column("keys").to_pylist()], [unpack(x) for x in table.column("runs").to_pylist()])
        return pa.table({"range": table.column("range")[:1], "keys": [pack_sorted(keys)], "runs": [pack(runs)]})

    return lists.select("range", "keys", "runs").mapInArrow(own, _ASKED).groupBy("range").applyInArrow(total, _ASKED)


def _redealt(asked: DataFrame, bits: int) -> DataFrame:
    """``asked`` by the ranges of a level: cut where these are finer, in several rows where they are coarser."""
    import pyarrow as pa

    def made(batches):
        for batch in batches:
            rows = []
            for k, n in zip(batch.column("keys").to_pylist(), batch.column("runs").to_pylist()):
                keys, runs = unpack_sorted(k), unpack(n)
                top = (keys >> np.uint64(64 - bits)).astype(np.int64)
                cut = _cuts(top)
                rows += [(top[a], pack_sorted(keys[a:b]), pack(runs[a:b])) for a, b in zip(cut, cut[1:])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["range", "keys", "runs"])

    return asked.select("range", "keys", "runs").mapInArrow(made, _ASKED)


def _scan(lists: DataFrame, asked: DataFrame) -> DataFrame:
    """The places in a level of the anchors that are asked for; ``asked`` is the number that came with them."""
    import pyarrow as pa

    def met(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                keys, wanted = unpack_sorted(row["keys"]), unpack_sorted(row["wanted"])
                at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                hit = np.flatnonzero(wanted[at] == keys)
                if len(hit):
                    columns = [keys[hit].view(np.int64), *[unpack(row[c])[hit] for c in ("batch", "block", "runs")], unpack(row["number"])[at[hit]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "batch", "block", "runs", "asked"])

    wanted = asked.select("range", F.col("keys").alias("wanted"), F.col("runs").alias("number"))
    return lists.join(wanted, "range").select("keys", "batch", "block", "runs", "wanted", "number").mapInArrow(met, _PLACE)


def _several(asked: DataFrame) -> DataFrame:
    """(key, asked) of anchors with more than one run in the batch itself."""
    import pyarrow as pa

    def made(batches):
        for batch in batches:
            for k, n in zip(batch.column("keys").to_pylist(), batch.column("runs").to_pylist()):
                keys, runs = unpack_sorted(k), unpack(n)
                some = np.flatnonzero(runs > 1)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(runs[some])], ["key", "asked"])

    return asked.select("keys", "runs").mapInArrow(made, "key long, asked long")


def _packed_keys(table, number: str) -> tuple[np.ndarray, np.ndarray]:
    keys = table.column("key").to_numpy().view(np.uint64)
    by = np.argsort(keys, kind="stable")
    return keys[by], table.column(number).to_numpy()[by]


class IndexFamily:
    """Indexes of former batches of documents, as tables in the shared folder or under ``path``.

    ``add`` cuts out of a new batch what starts earlier in it or in any level, then makes it the lowest level. ``moved``
    counts the anchors that merges have passed over, ``scanned`` the anchors of the levels that batches were scanned against. ``bits`` is
    the least number of bits that deal a level's anchors out.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, length: int = LENGTH, bits: int = 6):
        self.spark, self.length, self.bits = spark, length, bits
        self.path = path or f"{shared_dir(spark)}/family-{uuid.uuid4().hex}"
        self.levels: list[Level] = []
        self.batches = self.moved = self.scanned = 0
        self._names: dict[str, str] = {}

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> IndexFamily:
        """The family that was written under ``path``, as it was after the last whole batch."""
        every = spark.read.parquet(f"{path}/family-*")
        last = every.where(F.col("batches") == every.agg(F.max("batches")).first()[0]).collect()  # a row for each level
        out = cls(spark, path, last[0]["length"], last[0]["least_bits"])
        out.batches, out.moved, out.scanned = (last[0][c] for c in ("batches", "moved", "scanned"))
        out.levels = [Level(*(r[c] for c in Level._fields)) for r in sorted(last, key=lambda r: r["place"]) if r["folder"]]
        for level in out.levels:
            for kind, schema, by in (("blocks", _BLOCK, "batch, block"), ("lists", _LIST, "range")):
                name = out._names[f"{level.folder}/{kind}"] = f"family_{uuid.uuid4().hex}"
                spark.sql(f"create table {name} ({schema}) using parquet clustered by ({by}) into {level.buckets} buckets location '{level.folder}/{kind}'")
        return out

    def close(self) -> None:
        """Forget the tables' names in the session's catalogue; the family stays under its path."""
        for name in self._names.values():
            self.spark.sql(f"drop table if exists {name}")
        self._names = {}

    def _put(self, df: DataFrame, folder: str, kind: str, buckets: int, *by: str) -> DataFrame:
        name = self._names[f"{folder}/{kind}"] = f"family_{uuid.uuid4().hex}"
        df.repartition(buckets, *by).write.option("path", f"{folder}/{kind}").option("compression", "zstd").bucketBy(buckets, *by).saveAsTable(name)
        return self.spark.table(name)

    def _table(self, level: Level, kind: str) -> DataFrame:
        return self.spark.table(self._names[f"{level.folder}/{kind}"])

    def _layout(self, size: int, blocks: int) -> tuple[int, int, int]:
        """Bits, slices and buckets of a level."""
        buckets = max(8, -(-size // max(BUCKET_BYTES, size // MOST_BUCKETS + 1)))
        return max(self.bits, bits_for(size / 35, GROUP_ANCHORS)), max(1, -(-blocks // SLICE_BLOCKS)), buckets

    def _kept(self) -> None:
        """Write the list of levels; what it no longer names may go."""
        fields = [*Level._fields, "place", "batches", "moved", "scanned", "length", "least_bits"]
        common = (self.batches, self.moved, self.scanned, self.length, self.bits)
        rows = [(*level, k, *common) for k, level in enumerate(self.levels)] or [(*[0] * 7, "", 0, *common)]
        schema = ", ".join(f"{c} {'string' if c == 'folder' else 'long'}" for c in fields)
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/family-{self.batches}")

    def _removed(self, level: Level) -> None:
        for kind in ("blocks", "lists"):
            self.spark.sql(f"drop table if exists {self._names.pop(f'{level.folder}/{kind}')}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(level.folder)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _made(self, keyed: DataFrame) -> Level:
        """The lowest level, of a batch of documents."""
        folder = f"{self.path}/level-{uuid.uuid4().hex}"
        size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        buckets = self._layout(size, 0)[2]
        blocks = self._put(_blocks(keyed, self.length, self.batches), folder, "blocks", buckets, "batch", "block")
        n = blocks.count()
        bits, slices, _ = self._layout(size, n)
        lists = self._put(_lists(_anchors(blocks, bits, self.length), bits, slices), folder, "lists", buckets, "range")
        anchors = lists.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return Level(size, n, anchors, bits, buckets, self.batches, self.batches, folder)

    def _merged(self, high: Level, low: Level) -> Level:
        folder = f"{self.path}/level-{uuid.uuid4().hex}"
        size, n = high.size + low.size, high.blocks + low.blocks
        bits, slices, buckets = self._layout(size, n)
        both = lambda kind: self._table(high, kind).unionByName(self._table(low, kind))
        self._put(both("blocks"), folder, "blocks", buckets, "batch", "block")
        self._put(_lists(both("lists"), bits, slices), folder, "lists", buckets, "range")
        self.moved += high.anchors + low.anchors
        return Level(size, n, high.anchors + low.anchors, bits, buckets, high.first, low.last, folder)

    def shared(self, own: Level) -> DataFrame:
        """Flags of the blocks, of any level or of ``own``, that hold an anchor which ``own`` shares; a saved table."""
        import pyarrow as pa

        lists = self._table(own, "lists")
        asked = saved(_asked(lists), "family-asked")
        places = self.spark.createDataFrame([], _PLACE)
        for level in self.levels:
            places = places.unionAll(_scan(self._table(level, "lists"), _redealt(asked, level.bits)))
            self.scanned += level.anchors
        places = saved(places, "family-places")
        every = places.select("key", "runs", "asked").unionAll(_several(asked).select("key", F.lit(0).cast("long"), "asked"))
        flagged = saved(every.groupBy("key").agg(F.when(F.sum("runs") + F.max("asked") > HOT_RUNS, 2).otherwise(1).cast("long").alias("flag")), "family-flagged")

        def listed(table):
            keys, flag = _packed_keys(table, "flag")
            return pa.table({"range": [int(keys[0] >> np.uint64(64 - own.bits))], "keys": [pack_sorted(keys)], "runs": [pack(flag)]})

        def named(table):
            keys, flag = _packed_keys(table, "flag")
            return pa.table({"batch": table.column("batch")[:1], "block": table.column("block")[:1], "keys": [keys.astype("<u8").tobytes()], "flags": [flag.astype(np.uint8).tobytes()], "highest": pa.array([int(flag.max())], pa.int32())})

        by_range = flagged.withColumn("range", F.shiftrightunsigned("key", 64 - own.bits)).groupBy("range").applyInArrow(listed, _ASKED)
        here = _scan(lists, by_range).select("batch", "block", "key", F.col("asked").alias("flag"))
        there = places.join(flagged, "key").select("batch", "block", "key", "flag")
        flags = saved(here.unionAll(there).groupBy("batch", "block").applyInArrow(named, _FLAG), "family-flags")
        discard(asked, places, flagged)
        return flags

    def add(self, docs: DataFrame) -> DataFrame:
        """``docs`` without what starts earlier; the texts of the batch are indexed as they came."""
        keyed = _with_digest(docs)
        self.batches += 1
        own = self._made(keyed)
        if not own.blocks:
            self._removed(own)
            self._kept()
            return docs
        flags = self.shared(own)
        total = own.size + sum(level.size for level in self.levels)
        bits, hot = bits_for(total, GROUP_STARTS), not flags.where("highest = 2").isEmpty()
        contexts = strings = None
        for level in [*self.levels, own]:
            marks = flags.where(F.col("batch").between(level.first, level.last))
            blocks = self._table(level, "blocks")
            if level is not own:  # of older batches, only blocks that share an anchor with the newest
                blocks = blocks.join(marks.select("batch", "block"), ["batch", "block"], "left_semi")
            sent = _contexts(blocks, marks, bits, self.length)
            contexts = sent if contexts is None else contexts.unionAll(sent)
            if hot:
                found = _hot_repeats_of(blocks, marks)
                strings = found if strings is None else strings.unionAll(found)
        found = _repeats(contexts, self.length, BATCH_STARTS)
        if hot:
            found = found.unionAll(_hot_repeats(strings, flags, self.length))
        here = keyed.select("doc_id", "digest").distinct()
        found = found.withColumnsRenamed({"doc_id": "i", "digest": "h"}).join(here, F.expr("h = digest and i <=> doc_id"), "left_semi").select(F.col("i").alias("doc_id"), F.col("h").alias("digest"), "ranges")
        ranges = saved(found.groupBy("doc_id", "digest").agg(F.collect_list("ranges").alias("ranges"), F.lit(False).alias("copy")), "family-ranges")
        discard(flags)
        self.levels.append(own)
        gone = []
        while len(self.levels) > 1 and self.levels[-2].size < 2 * self.levels[-1].size:
            low, high = self.levels.pop(), self.levels.pop()
            gone += [low, high]
            self.levels.append(self._merged(high, low))
        self._kept()
        for level in gone:
            self._removed(level)
        return _apply(docs, ranges)


def _hot_repeats_of(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """The blocks whose strings of hot anchors become rows."""
    return blocks.join(marks.where("highest = 2").select("batch", "block"), ["batch", "block"], "left_semi")
