"""Operator 5, removal of repeated passages with a logarithmic family of suffix arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier: in a document of
smaller id, or earlier in the same document. Any longer repeat is a run of such strings. Strings of
one content have one anchor, the smallest hash of the ``GRAM``-byte strings in them, at the same
offset; consecutive starts with one anchor are a run. Hashes only decide what may be equal; strings are
compared byte by byte.

1. Whole copies (by SHA-256) leave the index; the text of smallest id stands for them. What is left is
   dealt into blocks of BLOCK_BYTES, a longer text over several that overlap by LENGTH - 1 bytes.
   A run that a block holds before, byte for byte, is a repeat and is not sent.
2. Groups by hash range count the different runs of each anchor over all blocks. A run whose anchor has
   no other holds nothing repeated.
3. The other runs go with their bytes to groups by anchor range of about GROUP_STARTS string starts. There, in
   document order, each batch of BATCH_STARTS gets a suffix array (starts in the order of the LENGTH
   bytes from them on), which is scanned against each level of the family for equal strings and becomes the
   lowest level; levels of like size merge, so there are logarithmically many. A start that equals
   one of a level, or an earlier one of its batch, is a repeat.
4. An anchor with more than HOT_RUNS different runs (the edge of a passage in very many documents) would
   outgrow its group. Its strings are rows of their own: Spark finds each one's first start with a partial
   minimum, however many documents hold it.
5. Repeats come back to their document as byte ranges.

``family.IndexFamily`` keeps sorted anchors of former batches of documents in levels and scans them for each new batch.

Edge cases: null text is the empty text and stays null in ``without_repeats``. Texts under LENGTH bytes lose
nothing. Rows that repeat both doc_id and text are one document and all have its result. A null doc_id
comes before all others. Of different texts with the same doc_id, the one of smaller digest is earlier. Very
long texts are indexed in pieces, but one row must fit a task. Empty tables give empty tables. Extra columns are
kept by ``without_repeats``, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, discard, mix64, powers, saved
from .slices import bits_for, edges, pack, pack_sorted, unpack, unpack_sorted

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 1_000_000
#: String starts that a group is meant to hold; it gets those of one more anchor at most, HOT_RUNS runs of up to LENGTH - GRAM + 1 starts.
GROUP_STARTS = 250_000
BATCH_STARTS = 32_768
HOT_RUNS = 4_000
#: String starts whose anchors are found at once.
STEP = 16_384
#: Anchors in a group that counts them.
GROUP_ANCHORS = 500_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_inverse_powers = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse_powers
    while len(_inverse_powers) < n:
        with np.errstate(over="ignore"):
            _inverse_powers = np.concatenate([_inverse_powers, _inverse_powers * np.uint64(pow(_INVERSE, len(_inverse_powers), 2**64))])
    return _inverse_powers[:n]


class Prints:
    """Fingerprints of strings of any one length that start at each byte of a buffer."""

    def __init__(self, raw: np.ndarray):
        self.n = len(raw)
        self.sums = np.zeros(self.n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(BYTE_VALUES[raw] * powers(self.n), out=self.sums[1:])

    def of(self, length: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Those of the strings that start at ``low`` or later and before ``high``."""
        high = max(low, min(self.n - length + 1, self.n if high is None else high))
        with np.errstate(over="ignore"):
            return mix64((self.sums[low + length : high + length] - self.sums[low:high]) * inverse_powers(self.n)[low:high])


def runs(raw: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of string starts with a common anchor, in a buffer of documents that begin at ``bounds``.

    Arrays (document, first start, last start, anchor hash); places are those of the buffer.
    """
    prints = Prints(raw)
    width = length - gram + 1
    count = len(raw) - length + 1
    none = np.zeros(0, np.int64)
    if count <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    anchor = np.empty(count, np.int64)
    for low in range(0, count, STEP):  # stretches that stay in the processor's cache
        grams = prints.of(gram, low, min(count, low + STEP) + width - 1)
        least, span = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), 1  # of equal hashes, the leftmost
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        anchor[low : low + STEP] = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) + low
    # The last byte of each document in the buffer is a separator, which belongs to no string.
    begins, final = bounds[:-1], bounds[1:] - 1 - length
    first = np.union1d(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, begins)
    doc = np.searchsorted(bounds, first, side="right") - 1
    last = np.minimum(np.append(first[1:], count) - 1, final[doc])
    some = first <= last
    first, last, doc = first[some], last[some], doc[some]
    at = anchor[first]
    with np.errstate(over="ignore"):
        keys = mix64((prints.sums[at + gram] - prints.sums[at]) * inverse_powers(prints.n)[at])
    return doc, first, last, keys


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... for counts[k] numbers, for all k in a row."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts) + np.repeat(first, counts)


def _buffer(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings in one buffer with a separator after each, and where each begins."""
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
    return np.frombuffer(b"\0".join(parts) + b"\0", np.uint8), bounds


def _ranges(starts: np.ndarray, length: int) -> bytes:
    """Ascending starts of repeated strings as [from, to) pairs of covered bytes, 8 bytes each number."""
    if not len(starts):
        return b""
    cut = np.flatnonzero(np.append(True, np.diff(starts) > length))
    ends = starts[np.append(cut[1:], len(starts)) - 1] + length
    return np.stack([starts[cut], ends], 1).astype("<i8").tobytes()


_DOC = "struct<doc_id:bigint,digest:binary>"
_BLOCK = "batch long, block long, pieces array<struct<doc_id:bigint,digest:binary,begins:bigint,size:bigint>>, size long, body binary"
_SENT = f"range long, batch long, docs array<{_DOC}>, of binary, starts binary, counts binary, body binary, sure array<binary>"
_FOUND = "doc_id long, digest binary, ranges binary"


def _order(doc: tuple) -> tuple:
    """Sorts (doc_id, digest, ...) in document order, null ids first."""
    return doc[0] is not None, doc[0] or 0, *doc[1:]


def _blocks(texts: DataFrame, length: int, batch: int) -> DataFrame:
    """``texts`` (doc_id, digest, text) as blocks of about BLOCK_BYTES, in document order within each."""
    import pyarrow as pa

    schema = _arrow(_BLOCK)

    def made(batches):
        from pyspark import TaskContext

        block, held, room = TaskContext.get().partitionId() << 40, {}, BLOCK_BYTES

        def row():
            order = sorted(held, key=_order)
            body, _ = _buffer([held[k] for k in order])
            pieces = [{"doc_id": k[0], "digest": k[1], "begins": k[2], "size": len(held[k])} for k in order]
            return pa.RecordBatch.from_pylist([{"batch": batch, "block": block, "pieces": pieces, "size": len(body), "body": pa.compress(body, codec="zstd", asbytes=True)}], schema)

        for chunk in batches:
            for i, digest, text in zip(*(chunk.column(k) for k in range(3))):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for at in range(0, len(raw) - length + 1, BLOCK_BYTES):
                    part = raw[at : at + BLOCK_BYTES + length - 1]
                    if held and len(part) > room:
                        yield row()
                        block, held, room = block + 1, {}, BLOCK_BYTES
                    held[i.as_py(), digest.as_py(), at] = part
                    room -= len(part)
        if held:
            yield row()

    return texts.select("doc_id", "digest", "text").mapInArrow(made, _BLOCK)


def _arrow(ddl: str):
    """The Arrow schema of a DDL string; for the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


class Block:
    """The runs of a block that it does not hold before, and those that it does."""

    def __init__(self, row: dict, length: int):
        import pyarrow as pa

        self.raw = np.frombuffer(pa.decompress(row["body"], decompressed_size=row["size"], codec="zstd", asbytes=True), np.uint8)
        self.pieces = row["pieces"]
        self.bounds = np.append(0, np.cumsum([p["size"] + 1 for p in self.pieces]))
        self.doc, self.start, stop, self.keys = runs(self.raw, self.bounds, length)
        self.count = stop - self.start + 1
        self.length = length
        self.known = np.zeros(len(self.start), bool)
        if len(self.keys):
            _, inverse, times = np.unique(self.keys, return_inverse=True, return_counts=True)
            seen, data = set(), self.raw.tobytes()
            for k in np.flatnonzero(times[inverse] > 1):
                own = data[self.start[k] : self.start[k] + self.count[k] + length - 1]
                self.known[k] = own in seen
                seen.add(own)
        self.anchors, self.runs_of = np.unique(self.keys[~self.known], return_counts=True)

    def at(self, k: np.ndarray) -> np.ndarray:
        """Places in their document of runs k."""
        return self.start[k] - self.bounds[self.doc[k]] + np.array([p["begins"] for p in self.pieces], np.int64)[self.doc[k]]

    def named(self, d: int) -> dict:
        return {n: self.pieces[d][n] for n in ("doc_id", "digest")}

    def repeated(self, doc: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[list, list]:
        """(documents, ranges) of ``count`` repeated starts each from ``first`` on in documents ``doc``."""
        docs, ranges = [], []
        for d in np.unique(doc):
            own = np.flatnonzero(doc == d) if len(doc) < 1000 else np.arange(*np.searchsorted(doc, [d, d + 1]))
            docs.append(self.named(d))
            ranges.append(_ranges(_spread(first[own], count[own]), self.length))
        return docs, ranges


def _anchors(blocks: DataFrame, bits: int, length: int) -> DataFrame:
    """Per block and range the anchors of its runs, with the number of its different runs of each."""
    import pyarrow as pa

    def made(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                b = Block(row, length)
                x = edges(b.anchors, bits)
                some = np.flatnonzero(np.diff(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), row["batch"])), pa.array(np.full(len(some), row["block"])), pa.array(some),
                        pa.array([pack_sorted(b.anchors[x[j] : x[j + 1]]) for j in some], pa.binary()), pa.array([pack(b.runs_of[x[j] : x[j + 1]]) for j in some], pa.binary()),
                    ],
                    ["batch", "block", "range", "keys", "runs"],
                )

    return blocks.mapInArrow(made, "batch long, block long, range long, keys binary, runs binary")


def _flags(anchors: DataFrame, hot_runs: int) -> DataFrame:
    """For each anchor of each block: 0 (all its runs are this one), 1 (there are others) or 2 (more than ``hot_runs`` of them)."""
    import pyarrow as pa

    def counted(table):
        each = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        runs_of = np.concatenate([unpack(x) for x in table.column("runs").to_pylist()])
        found, inverse = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(inverse, weights=runs_of)
        cut = np.cumsum([0, *map(len, each)])
        flag = (total > 1).astype(np.uint8) + (total > hot_runs)
        flag = flag[inverse]
        flags = [flag[a:b].tobytes() for a, b in zip(cut, cut[1:])]
        highest = [int(flag[a:b].max(initial=0)) for a, b in zip(cut, cut[1:])]
        return pa.table({"batch": table.column("batch"), "block": table.column("block"), "range": table.column("range"), "flags": pa.array(flags, pa.binary()), "highest": pa.array(highest, pa.int32())})

    return anchors.groupBy("range").applyInArrow(counted, "batch long, block long, range long, flags binary, highest int")


def _flag_of_runs(b: Block, flags) -> np.ndarray:
    if "keys" in flags.column_names:  # a family's flags name their anchors; all others have 0
        if not flags.num_rows:
            return np.zeros(len(b.keys), np.uint8)
        named = np.frombuffer(b"".join(flags.column("keys").to_pylist()), "<u8")
        at = np.minimum(np.searchsorted(named, b.keys), len(named) - 1)
        return np.where(b.known | (named[at] != b.keys), 0, np.frombuffer(b"".join(flags.column("flags").to_pylist()), np.uint8)[at])
    parts = sorted(zip(flags.column("range").to_pylist(), flags.column("flags").to_pylist()))
    by_anchor = np.frombuffer(b"".join(x for _, x in parts), np.uint8)
    return np.where(b.known, 0, by_anchor[np.minimum(np.searchsorted(b.anchors, b.keys), len(b.anchors) - 1)])


def _contexts(blocks: DataFrame, flags: DataFrame, bits: int, length: int) -> DataFrame:
    """By anchor range the runs whose anchors have others, with the bytes that they cover; and what each block holds before."""
    import pyarrow as pa

    schema = _arrow(_SENT)

    def made(blocks_, flags_):
        if not blocks_.num_rows:
            return pa.Table.from_pylist([], schema)
        row = blocks_.to_pylist()[0]
        b = Block(row, length)
        rows = []
        docs, ranges = b.repeated(b.doc[b.known], b.at(np.flatnonzero(b.known)), b.count[b.known])
        if docs:
            rows.append({"range": row["block"] % (1 << bits), "docs": docs, "sure": ranges})
        sent = np.flatnonzero(_flag_of_runs(b, flags_) == 1) if len(b.keys) else []
        if len(sent):
            top = (b.keys[sent] >> np.uint64(64 - bits)).astype(np.int64)
            by = np.argsort(top, kind="stable")
            sent, top = sent[by], top[by]
            at, data = b.at(sent), b.raw.tobytes()
            cut = np.append(np.flatnonzero(np.append(True, top[1:] != top[:-1])), len(top))
            for low, high in zip(cut, cut[1:]):
                own = sent[low:high]
                present, of = np.unique(b.doc[own], return_inverse=True)
                body = b"".join([data[b.start[k] : b.start[k] + b.count[k] + length - 1] for k in own])
                rows.append({"range": int(top[low]), "docs": [b.named(d) for d in present], "of": pack(of), "starts": pack(at[low:high]), "counts": pack(b.count[own]), "body": body})
        for r in rows:
            r["batch"] = row["batch"]
        return pa.Table.from_pylist(rows, schema)

    return blocks.groupBy("batch", "block").cogroup(flags.groupBy("batch", "block")).applyInArrow(made, _SENT)


def strings(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The strings of ``length`` bytes at places ``at`` of ``text``, as values that numpy compares byte by byte.

    One is added to each byte, since trailing zeros do not count there; no byte of UTF-8 is 255.
    """
    if not len(at):
        return np.zeros(0, f"S{length}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text + np.uint8(1), length)[at]).view(f"S{length}").ravel()


class SuffixArray:
    """Starts in a text in the order of the ``length`` bytes from them on, each content once, at its earliest."""

    def __init__(self, text: np.ndarray, order: np.ndarray, values: np.ndarray):
        self.text, self.order, self.values = text, order, values

    @classmethod
    def of(cls, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[SuffixArray, np.ndarray]:
        """The array of ascending ``starts``, and which of these are the first of their content."""
        values = strings(text, starts, length)
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        new = np.append(True, ranked[1:] != ranked[:-1]) if len(order) else np.zeros(0, bool)
        first = np.zeros(len(starts), bool)
        first[order[new]] = True
        return cls(text, starts[order[new]], ranked[new]), first

    def __len__(self) -> int:
        return len(self.order)

    def scan(self, other: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """Where each string of ``other`` stands in this array, and whether it is there."""
        at = np.searchsorted(self.values, other.values)
        return at, self.values[np.minimum(at, len(self) - 1)] == other.values if len(self) else np.zeros(len(other), bool)

    def merged(self, other: SuffixArray) -> SuffixArray:
        """Both arrays as one; ``other`` holds strings that this one has not."""
        at, _ = self.scan(other)
        return SuffixArray(np.concatenate([self.text, other.text]), np.insert(self.order, at, other.order + len(self.text)), np.insert(self.values, at, other.values))

    def without(self, gone: np.ndarray) -> SuffixArray:
        return SuffixArray(self.text, self.order[~gone], self.values[~gone])


class Family:
    """Levels of suffix arrays; each is at least twice as large as the next.

    ``moved`` counts the strings that merges of levels have passed over.
    """

    def __init__(self):
        self.levels: list[SuffixArray] = []
        self.moved = 0

    def known(self, batch: SuffixArray) -> np.ndarray:
        """Which strings of ``batch`` a level holds; no two levels hold the same, so what one has is not looked up in the next."""
        out, left = np.zeros(len(batch), bool), np.arange(len(batch))
        for level in self.levels:
            hit = level.scan(batch)[1]
            out[left[hit]] = True
            left, batch = left[~hit], batch.without(hit)
        return out

    def add(self, batch: SuffixArray) -> None:
        """New strings become the lowest level; levels of like size merge."""
        if not len(batch):
            return
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            low, high = self.levels.pop(), self.levels.pop()
            self.moved += len(low) + len(high)
            self.levels.append(high.merged(low))


def first_starts(bodies: list, counts: np.ndarray, length: int, batch_starts: int) -> np.ndarray:
    """For runs in document order (their bytes, and how many starts each has): which starts are the first of their content."""
    family, out = Family(), []
    ends = np.cumsum(counts)
    low = 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + batch_starts, side="right")))
        text = np.frombuffer(b"".join(bodies[low:high]), np.uint8)
        spans = counts[low:high] + length - 1
        starts = _spread(np.cumsum(spans) - spans, counts[low:high])
        array, first = SuffixArray.of(text, starts, length)
        known = family.known(array)
        first[np.searchsorted(starts, array.order[known])] = False
        family.add(array.without(known))
        out.append(first)
        low = high
    return np.concatenate(out) if out else np.zeros(0, bool)


def _repeats(contexts: DataFrame, length: int, batch_starts: int) -> DataFrame:
    """Ranges of repeats, from each group's index family."""
    import pyarrow as pa

    schema = _arrow(_FOUND)

    def found(table):
        docs, batch = table.column("docs").to_pylist(), table.column("batch").to_pylist()
        out = [(d["doc_id"], d["digest"], r) for of, sure in zip(docs, table.column("sure").to_pylist()) if sure for d, r in zip(of, sure)]
        named = sorted({(b, *_order((d["doc_id"], d["digest"]))) for b, of in zip(batch, docs) for d in of})
        rank = {d: k for k, d in enumerate(named)}
        doc, start, count, bodies = [], [], [], []
        for k, counts in enumerate(table.column("counts")):
            if counts.is_valid:
                counts, data = unpack(counts.as_py()), table.column("body")[k].as_py()
                at = np.append(0, np.cumsum(counts + length - 1))
                bodies += [data[a:b] for a, b in zip(at, at[1:])]
                doc.append(np.array([rank[(batch[k], *_order((d["doc_id"], d["digest"])))] for d in docs[k]])[unpack(table.column("of")[k].as_py())])
                start.append(unpack(table.column("starts")[k].as_py()))
                count.append(counts)
        if bodies:
            doc, start, count = np.concatenate(doc), np.concatenate(start), np.concatenate(count)
            order = np.lexsort((start, doc))
            new = np.append(True, (np.diff(doc[order]) != 0) | (np.diff(start[order]) != 0))  # a repeated row is the same document
            order = order[new]
            doc, start, count = doc[order], start[order], count[order]
            first = first_starts([bodies[k] for k in order], count, length, batch_starts)
            place, of = _spread(start, count)[~first], np.repeat(doc, count)[~first]
            cut = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)) if len(of) else np.zeros(0, int)
            for low, high in zip(cut, cut[1:]):
                _, has_id, i, digest = named[of[low]]
                out.append((i if has_id else None, digest, _ranges(place[low:high], length)))
        return pa.Table.from_pylist([dict(zip(("doc_id", "digest", "ranges"), x)) for x in out], schema)

    return contexts.groupBy("range").applyInArrow(found, _FOUND)


def _hot_repeats(blocks: DataFrame, flags: DataFrame, length: int) -> DataFrame:
    """Ranges of repeats among the strings of anchors with very many runs: Spark groups by the strings themselves."""
    import pyarrow as pa

    sent = "batch long, string binary, doc_id long, digest binary, start long, ranges binary"
    schema = _arrow(sent)

    def made(blocks_, flags_):
        rows = []
        if blocks_.num_rows and flags_.num_rows:
            row = blocks_.to_pylist()[0]
            b = Block(row, length)
            hot = np.flatnonzero(_flag_of_runs(b, flags_) == 2)
            starts = _spread(b.start[hot], b.count[hot])
            doc, at = np.repeat(b.doc[hot], b.count[hot]), _spread(b.at(hot), b.count[hot])
            _, first = SuffixArray.of(b.raw, starts, length)
            data = b.raw.tobytes()
            rows = [{"batch": row["batch"], "string": data[s : s + length], "start": int(a), **b.named(d)} for s, a, d in zip(starts[first], at[first], doc[first])]
            rows += [{"batch": row["batch"], "ranges": r, **d} for d, r in zip(*b.repeated(doc[~first], at[~first], np.ones((~first).sum(), np.int64)))]
        return pa.Table.from_pylist(rows, schema)

    marked = flags.where("highest = 2").select("batch", "block").distinct()
    some = blocks.join(marked, ["batch", "block"], "left_semi")
    flags = flags.join(marked, ["batch", "block"], "left_semi")
    made = saved(some.groupBy("batch", "block").cogroup(flags.groupBy("batch", "block")).applyInArrow(made, sent), "repeat-hot")
    place = F.struct("batch", F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "digest", "start")
    single = made.where("string is not null")
    first = single.groupBy("string").agg(F.min(place).alias("first"))
    again = single.join(first, "string").where(~place.eqNullSafe(F.col("first")))
    pair = F.concat(*[F.unhex(F.concat_ws("", *[F.substring(F.lpad(F.hex(x), 16, "0"), k, 2) for k in range(15, 0, -2)])) for x in (F.col("start"), F.col("start") + length)])
    return again.select("doc_id", "digest", pair.alias("ranges")).unionAll(made.where("ranges is not null").select("doc_id", "digest", "ranges"))


def _cut(data: bytes, ranges: list, whole: bool) -> tuple[bytes, int, int]:
    """What is left of ``data``, bytes removed and maximal removed runs; ranges: packed pairs."""
    if whole:
        return b"", len(data), int(len(data) > 0)
    pairs = np.frombuffer(b"".join(ranges), "<i8").reshape(-1, 2) if ranges is not None and len(ranges) else np.zeros((0, 2), np.int64)
    if not len(pairs):
        return data, 0, 0
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    cut = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
    low, high = pairs[cut, 0], reach[np.append(cut[1:], len(pairs)) - 1]
    kept = [data[a:b] for a, b in zip(np.append(0, high), np.append(low, len(data)))]
    return b"".join(kept), int((high - low).sum()), len(low)


def _with_digest(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _matched(blocks: DataFrame, anchors: DataFrame, n_bytes: int, length: int, batch_starts: int, hot_runs: int) -> DataFrame:
    """Ranges (doc_id, digest, ranges) of what is repeated in ``blocks``."""
    flags = saved(_flags(anchors, hot_runs), "repeat-flags")
    found = _repeats(_contexts(blocks, flags, bits_for(n_bytes, GROUP_STARTS), length), length, batch_starts)
    if not flags.where("highest = 2").isEmpty():
        found = found.unionAll(_hot_repeats(blocks, flags, length))
    return found


def _located(keyed: DataFrame, length: int, batch_starts: int, hot_runs: int) -> DataFrame:
    """Per (doc_id, digest) of ``keyed`` that loses anything: its repeated ranges, or that it is a copy."""
    copies = saved(keyed.select("doc_id", "digest", F.octet_length("text").alias("size")).where(F.col("size") >= length).distinct(), "repeat-copies")
    first_id = copies.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("first"))
    copies = saved(copies.join(first_id, "digest").select("doc_id", "digest", "size", (~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).alias("copy")), "repeat-copies")
    total = copies.where("not copy").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    own = copies.where("not copy").select(F.col("doc_id").alias("i"), F.col("digest").alias("h"))
    texts = keyed.join(own.hint("shuffle_hash"), F.expr("digest = h and doc_id <=> i")).select("doc_id", "digest", "text")
    blocks = saved(_blocks(texts, length, 0), "repeat-blocks")
    anchors = _anchors(blocks, bits_for(total / 35, GROUP_ANCHORS), length)
    found = _matched(blocks, anchors, total, length, batch_starts, hot_runs)
    ranges = found.groupBy("doc_id", "digest").agg(F.collect_list("ranges").alias("ranges"), F.lit(False).alias("copy"))
    whole = copies.where("copy").select("doc_id", "digest", F.expr("cast(array() as array<binary>)").alias("ranges"), F.lit(True).alias("copy"))
    out = saved(ranges.unionByName(whole), "repeat-ranges")
    discard(blocks, copies)
    return out


def repeat_report(docs: DataFrame, length: int = LENGTH, batch_starts: int = BATCH_STARTS, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    import pyarrow as pa

    keyed = _with_digest(docs)
    ranges = _located(keyed, length, batch_starts, hot_runs)

    def reported(found):
        for batch in found:
            ids, data, of, copy = (batch.column(k) for k in range(4))
            rows = []
            for i, t, r, c in zip(ids, data, of, copy):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                kept, removed, spans = _cut(raw, r.as_py(), bool(c.as_py()))
                rows.append((i.as_py(), len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = keyed.join(ranges.select(F.col("doc_id").alias("i"), F.col("digest").alias("h"), "ranges", "copy").hint("shuffle_hash"), F.expr("digest = h and doc_id <=> i"), "left")
    return out.select("doc_id", "text", "ranges", "copy").mapInArrow(reported, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _apply(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """``docs`` without the ``ranges`` of its texts."""
    p = "_" * max([1, *(len(c) for c in docs.columns)])
    own = docs.withColumns({f"{p}i": F.col("doc_id").cast("long"), f"{p}h": F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))})
    found = ranges.select(F.col("doc_id").alias(f"{p}d"), F.col("digest").alias(f"{p}g"), F.col("ranges").alias(f"{p}r"), F.col("copy").alias(f"{p}c"))
    own = own.join(found.hint("shuffle_hash"), F.expr(f"`{p}h` = `{p}g` and `{p}i` <=> `{p}d`"), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, ranges: pd.Series, copies: pd.Series) -> pd.Series:
        out = []
        for t, r, c in zip(texts, ranges, copies):
            kept = _cut(t.encode("utf-8", "surrogatepass"), None if r is None else list(r), bool(c))[0]
            out.append(kept.decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    text = F.when(F.col("text").isNotNull() & F.col(f"{p}c").isNotNull(), cut(F.coalesce("text", F.lit("")), f"{p}r", f"{p}c")).otherwise(F.col("text"))
    return own.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_repeats(docs: DataFrame, length: int = LENGTH, batch_starts: int = BATCH_STARTS, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``docs`` with repeats cut out of ``text``; a character that is cut in part goes whole. Null text stays null."""
    return _apply(docs, _located(_with_digest(docs), length, batch_starts, hot_runs))
