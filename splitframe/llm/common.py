"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = np.uint64(0xFFFFFFFFFFFFFFFF)
#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="splitframe-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, in folders by the column ``by`` if given, and return the written table, which has no lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, True)  # what is written needs its shuffles no more
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)  # what is not discarded before goes with the driver
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``saved`` has written and nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._saved_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


#: One random 64-bit value for each byte, from a fixed seed, so that every task hashes alike.
BYTE_VALUES = np.random.default_rng(20240501).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER_VALUES = BYTE_VALUES[_LOWER]
_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base, modulo 2**64."""
    global _POWERS
    while len(_POWERS) < n:
        step = np.uint64(pow(_BASE, len(_POWERS), 2**64))
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS[:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the A-Z-lower-cased words of UTF-8 ``data``, and each word's first byte."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = ends - starts
    kept = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(kept)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        terms = _LOWER_VALUES[raw[kept]] * powers(int(lengths.max()) + 1)[at]
        sums = np.add.reduceat(terms, first)
        return mix64(sums + lengths.astype(np.uint64)), starts


def joined(texts: list) -> tuple[bytes, np.ndarray]:
    """Texts (null: empty) as one UTF-8 buffer with a line break after each, and each text's first byte (one more at the end)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
    return b"\n".join(parts) + b"\n" if parts else b"", bounds


def text_chunks(batch, column: str, max_chars: int):
    """Slices of an Arrow batch with about ``max_chars`` of text each; a longer text stands alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > max_chars:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n) + 1
    if start < batch.num_rows:
        yield batch.slice(start)
