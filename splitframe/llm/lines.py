"""Operator 13, line dedup by sharded cuckoo filters over exact reference-count tables.

A line's key is the line without white space at its ends, with A-Z in lower case; keys of at least MIN_CHARS code points are
compared, by a digest of 128 bits. A line goes if a document of smaller id holds its key. ``LineIndex`` keeps

* postings: a row for each document and different key in it;
* counts: a row for each key with its number of documents and its smallest document, in levels: a batch appends rows of the keys that
  it touches, the latest row of a key counts, and levels of like size merge;
* filters: for each shard, which is a range of keys, a cuckoo filter of the keys that counts hold.

``add`` sums a batch by key and asks the filters. Keys that they don't hold are new and need no look at the counts; only the others
meet the counts. ``remove`` takes documents out again: the keys that they alone held leave counts and filters, and for the other ones the next
smallest document is found from the postings, so its line comes back. Every step equals an index made of the remaining documents.

A key that very many documents hold is summed before it is shuffled. Postings meet the counts of hot keys, of which there can be
HOT_KEYS at most, by broadcast; others by a join.

Edge cases: a null or empty text is one empty line. Rows without id count as one document that comes after all others; rows that
repeat an id are one document, so none of them loses lines to the other. Very long lines and texts are taken whole. An empty table gives an empty
one. Extra columns are ignored by ``report`` and kept by ``cleaned``, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, saved
from .cuckoo import LOAD, CuckooFilter

MIN_CHARS = 10
#: Keys that a shard's filter is meant to hold; shards split beyond twice as many.
KEYS_IN_SHARD = 1_000_000
#: A key is hot if it has more than this share of all postings; so there are fewer hot keys than this.
HOT_KEYS = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = b" \t\n\x0b\x0c\r"
_KEY = ["hi", "lo"]


def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The digest of each line's key; None for short keys."""
    out: list[bytes | None] = []
    for line in text.translate(_LOWER).split(b"\n"):
        key = line.strip(_SPACE)
        if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars):
            out.append(None)
        else:
            out.append(hashlib.blake2b(key, digest_size=16).digest())
    return out


def _postings(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, hi, lo: the different keys of each row."""
    import pyarrow as pa

    def found(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                ids, keys = [], []
                for doc, text in zip(*(c.to_pylist() for c in batch.slice(low, 256).columns)):
                    own = {k for k in line_keys((text or "").encode("utf-8", "surrogatepass"), min_chars) if k}
                    ids += [doc] * len(own)
                    keys += own
                halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc", "hi", "lo"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(found, "doc long, hi long, lo long")


class LineIndex:
    """An incremental, reversible index of the lines of documents.

    Batches may come in any order of ids. A document is to be added once; to change it, remove and add it.
    """

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, keys_in_shard: int = KEYS_IN_SHARD):
        self.spark, self.min_chars, self.keys_in_shard = spark, min_chars, keys_in_shard
        self.bits = 4
        self.batches = 0
        self.postings_of: list[DataFrame] = []
        self.removed: list[DataFrame] = []
        self.levels: list[tuple[int, DataFrame]] = []  # rows, counts
        self.filters: DataFrame | None = None
        #: Of the last batch: different keys, keys that the filters may hold, and keys that the counts hold.
        self.asked = self.maybe = self.known = 0

    def _shard(self):
        return F.shiftrightunsigned("hi", 64 - self.bits).alias("shard")

    def postings(self) -> DataFrame | None:
        """doc, hi, lo, batch of all documents that are in the index."""
        if not self.postings_of:
            return None
        out = reduce(DataFrame.unionByName, self.postings_of)
        for gone in self.removed:
            out = out.join(gone.select(F.col("doc").alias("_doc"), F.col("batch").alias("_batch")), F.expr("doc <=> _doc and batch < _batch"), "left_anti")
        return out

    def counts(self) -> DataFrame | None:
        """hi, lo, refs, first of all keys in the index."""
        if not self.levels:
            return None
        rows = reduce(DataFrame.unionByName, [t for _, t in self.levels])
        if len(self.levels) > 1:
            rows = rows.groupBy(*_KEY).agg(F.max_by(F.struct("refs", "first"), "batch").alias("last")).select(*_KEY, "last.refs", "last.first")
        return rows.where("refs > 0").select(*_KEY, "refs", "first")

    def _append(self, changed: DataFrame, name: str) -> DataFrame:
        """Make ``changed`` the lowest level of the counts; merge levels of like size."""
        level = saved(changed.select(*_KEY, "refs", "first", F.lit(self.batches).alias("batch")), name)
        self.levels.append((level.count(), level))
        while len(self.levels) > 1 and self.levels[-2][0] < 2 * self.levels[-1][0]:
            (_, low), (_, high) = self.levels.pop(), self.levels.pop()
            last = F.max_by(F.struct("refs", "first", "batch"), "batch").alias("last")
            merged = high.unionByName(low).groupBy(*_KEY).agg(last).select(*_KEY, "last.*")
            merged = saved(merged if self.levels else merged.where("refs > 0"), "line-counts")
            discard(low, high)
            self.levels.append((merged.count(), merged))
        return level

    def _asked(self, keys: DataFrame) -> DataFrame:
        """``keys`` (hi, lo, refs, first) with ``maybe``: whether the filters may hold them."""
        if self.filters is None:
            return keys.withColumn("maybe", F.lit(False))
        import pyarrow as pa

        def probe(own, filters):
            if not own.num_rows:
                return own.select(["hi", "lo", "refs", "first"]).append_column("maybe", pa.array([], pa.bool_()))
            found = np.zeros(own.num_rows, bool)
            if filters.num_rows:
                found = CuckooFilter.read(filters.column("slots")[0].as_py(), filters.column("rest")[0].as_py()).contains(own.column("lo").to_numpy())
            return own.select(["hi", "lo", "refs", "first"]).append_column("maybe", pa.array(found))

        by = keys.select(self._shard(), "*").groupBy("shard").cogroup(self.filters.groupBy("shard"))
        return by.applyInArrow(probe, "hi long, lo long, refs long, first long, maybe boolean")

    def _filtered(self, new: DataFrame, gone: DataFrame | None = None) -> None:
        """Put the keys ``new`` into the filters and take ``gone`` out; shards that would be too full are made anew from the counts."""
        import pyarrow as pa

        keys = new.select(self._shard(), *_KEY, F.lit(True).alias("new"))
        if gone is not None:
            keys = keys.unionByName(gone.select(self._shard(), *_KEY, F.lit(False).alias("new")))
        before = self.filters
        if before is not None:
            more = keys.groupBy("shard").agg(F.count_if("new").alias("more"))
            full = F.col("held") + F.col("more") > F.octet_length("slots") / 2 * LOAD
            grown = saved(before.join(more, "shard").where(full).select("shard"), "line-grown")
            again = self.counts().select(self._shard(), *_KEY, F.lit(True).alias("new")).join(F.broadcast(grown), "shard", "left_semi")  # no more rows than shards
            before = before.join(F.broadcast(grown), "shard", "left_anti")
            keys = keys.join(F.broadcast(grown), "shard", "left_anti").unionByName(again)
        else:
            before = self.spark.createDataFrame([], "shard long, held long, slots binary, rest binary")

        def changed(own, filters):
            flag, lo = own.column("new").to_numpy(), own.column("lo").to_numpy()
            if filters.num_rows:
                made = CuckooFilter.read(filters.column("slots")[0].as_py(), filters.column("rest")[0].as_py())
            else:
                made = CuckooFilter(2 * int(flag.sum()))
            made.remove(lo[~flag])
            made.insert(lo[flag])
            slots, rest = made.write()
            shard = (own if own.num_rows else filters).column("shard")[0].as_py()
            return pa.table({"shard": [shard], "held": [len(made)], "slots": [slots], "rest": [rest]}, schema=pa.schema([("shard", pa.int64()), ("held", pa.int64()), ("slots", pa.binary()), ("rest", pa.binary())]))

        out = keys.groupBy("shard").cogroup(before.groupBy("shard")).applyInArrow(changed, "shard long, held long, slots binary, rest binary")
        old, self.filters = self.filters, saved(out, "line-filters")
        if old is not None:
            discard(old, grown)

    def _split(self) -> None:
        """Split the shards once they hold too many keys; the filters of the new ones are made from the counts."""
        held = self.filters.agg(F.sum("held")).first()[0] or 0
        if held > 2 * self.keys_in_shard << self.bits:
            while held > self.keys_in_shard << self.bits:
                self.bits += 1
            discard(self.filters)
            self.filters = None
            self._filtered(self.counts())

    def add(self, docs: DataFrame) -> None:
        """Index the lines of ``docs`` (doc_id, text)."""
        self.batches += 1
        own = saved(_postings(docs, self.min_chars).withColumn("batch", F.lit(self.batches)), "line-postings")
        keys = own.groupBy(*_KEY).agg(F.count("*").alias("refs"), F.min("doc").alias("first"))
        keys = saved(self._asked(keys), "line-asked")
        self.asked = keys.count()
        if self.filters is None:
            while self.asked > self.keys_in_shard << self.bits:
                self.bits += 1
            changed = new = keys
            known = None
        else:
            old = self.counts().withColumnsRenamed({"refs": "old_refs", "first": "old_first"})
            known = saved(keys.where("maybe").join(old, _KEY), "line-known")
            new = keys.where("not maybe").unionByName(keys.where("maybe").join(known, _KEY, "left_anti"))
            changed = new.select(*_KEY, "refs", "first").unionByName(known.select(*_KEY, (F.col("refs") + F.col("old_refs")).alias("refs"), F.least("first", "old_first").alias("first")))
        self.maybe, self.known = keys.where("maybe").count(), known.count() if known is not None else 0
        self._append(changed, "line-counts")
        self._filtered(new)
        self._split()
        self.postings_of.append(own)
        discard(keys, *([known] if known is not None else []))

    def remove(self, ids: DataFrame) -> None:
        """Take the documents of ``ids`` (doc_id) out; ids that the index doesn't hold change nothing."""
        if self.filters is None:
            return
        self.batches += 1
        ids = saved(ids.select(F.col("doc_id").cast("long").alias("doc"), F.lit(self.batches).alias("batch")).distinct(), "line-removed")
        held = self.postings()
        gone = held.join(ids.select(F.col("doc").alias("_doc")), F.expr("doc <=> _doc"), "left_semi")
        touched = saved(gone.select(*_KEY).distinct(), "line-touched")
        self.removed.append(ids)
        left = self.postings().join(touched, _KEY, "left_semi").groupBy(*_KEY).agg(F.count("*").alias("refs"), F.min("doc").alias("first"))
        changed = saved(touched.join(left, _KEY, "left").select(*_KEY, F.coalesce("refs", F.lit(0)).alias("refs"), "first"), "line-changed")
        self._append(changed, "line-counts")
        none = changed.where("refs = 0")
        self._filtered(none.limit(0), none)
        discard(touched, changed)

    def drops(self) -> DataFrame:
        """doc, hi, lo: the keys whose lines each document loses."""
        held = self.postings().select("doc", *_KEY)
        shared = self.counts().where("refs > 1")
        total = held.count()
        hot = saved(shared.where(F.col("refs") > total / HOT_KEYS).select(*_KEY, "first", F.lit(True).alias("hot")), "line-hot")
        rest = shared.where(F.col("refs") <= total / HOT_KEYS).select(*_KEY, "first")
        named = held.join(F.broadcast(hot), _KEY, "left")  # fewer than HOT_KEYS rows
        later = F.expr("first < doc or (doc is null and first is not null)")
        of_hot = named.where("hot").where(later).select("doc", *_KEY)
        found = saved(of_hot.unionByName(named.where("hot is null").drop("first", "hot").join(rest, _KEY).where(later).select("doc", *_KEY)), "line-drops")
        discard(hot)
        return found

    def _joined(self, docs: DataFrame, doc_id: str, name: str) -> DataFrame:
        """``docs`` with the keys that each loses, halves in an array, as column ``name``."""
        lost = self.drops().groupBy(F.col("doc").alias(f"{name}d")).agg(F.collect_list(F.array("hi", "lo")).alias(name))
        return docs.join(lost.hint("shuffle_hash"), F.expr(f"{doc_id} <=> `{name}d`"), "left").drop(f"{name}d")

    def report(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_sha256 of ``docs``, which are in the index."""
        import pyarrow as pa

        least = self.min_chars

        def made(batches):
            for batch in batches:
                rows = []
                for doc, text, lost in zip(*batch.columns):
                    n, kept = _kept(text.as_py(), lost.as_py(), least)
                    rows.append((doc.as_py(), n, n - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

        rows = self._joined(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), "doc_id", "_lost")
        return rows.select("doc_id", "text", "_lost").mapInArrow(made, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")

    def cleaned(self, docs: DataFrame) -> DataFrame:
        """``docs`` without the lines that they lose, with all columns; null texts stay null."""
        p = "_" * (max([0, *(len(c) for c in docs.columns)]) + 1)
        least = self.min_chars

        @F.pandas_udf("string")
        def cut(texts: pd.Series, lost: pd.Series) -> pd.Series:
            return pd.Series([b"\n".join(_kept(t, x, least)[1]).decode("utf-8", "surrogatepass") for t, x in zip(texts, lost)], dtype=object)

        rows = self._joined(docs.withColumn(f"{p}i", F.col("doc_id").cast("long")), f"`{p}i`", p)
        text = F.when(F.col("text").isNull() | F.col(p).isNull(), F.col("text")).otherwise(cut(F.col("text").cast("string"), p))
        return rows.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])

    def clear(self) -> None:
        """Remove the tables of the index."""
        discard(*self.postings_of, *self.removed, *(t for _, t in self.levels), *([] if self.filters is None else [self.filters]))


def _kept(text: str | None, lost, min_chars: int) -> tuple[int, list[bytes]]:
    """Number of lines of ``text``, and the lines whose keys are not among ``lost`` (halves of keys)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    if lost is None:
        return len(lines), lines
    gone = {np.array(k, np.int64).tobytes() for k in lost}
    return len(lines), [line for line, key in zip(lines, line_keys(raw, min_chars)) if key not in gone]


def dedup_report(docs: DataFrame, batches: int = 2, min_chars: int = MIN_CHARS) -> DataFrame:
    """``LineIndex.report`` of ``docs``, which are added in ``batches`` batches by a hash of the id."""
    index = LineIndex(docs.sparkSession, min_chars)
    for k in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(batches)) == k))
    found = index.report(docs)
    index.clear()
    return found
