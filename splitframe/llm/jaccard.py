"""Operator 2, n-gram Jaccard join by vertical partitioning.

The global order of n-grams is by rising document count (in quarter octaves), then by hash. It is cut into
fragments; for a candidate pair the overlap is counted in each fragment separately and summed per pair.

1. Each document becomes the set of its word n-grams (64-bit hashes). Documents of equal sets are one
   class, found by grouping on a 128-bit digest and the size; one representative goes on.
2. Groups by hash range count in how many sets each n-gram occurs. What occurs once can't overlap; a
   set of n with fewer than t*n n-grams left can't have a link and rests.
3. Prefix filter: two linked sets share one of their first ``left - ceil(t*n) + 1`` n-grams, and of the
   first one that they share enough n-grams stand from it on in both (position filter).
   * An n-gram with at most MEET pairs for each of its sets has them all meet at once. In a larger one, in turns,
     all sets meet its hubs: those with the least n-grams of their own, the middle of a group of near copies.
     Verified pairs join components; pairs within one need no test. A hub that all have met leaves the
     n-gram. Each turn has four times the hubs of the last.
   * After the first turn, as soon as the pairs that are left are no more than MEET times its prefix n-grams, they all meet.
     No component loses a link, and no step makes more rows than a fixed multiple of its input.
4. Overlaps of pairs are counted per fragment, summed per pair, and the exact test is on integers.

Set sizes are counted by 64-bit hashes. Overlaps compare 55 bits of the hash and the n-gram's document
count: of two sets of n and m n-grams, different ones coincide with a chance below n * m / 2**55.
The work grows beyond the input only for sets which share rare n-grams and miss the similarity narrowly
in great number; then turns go on, four times as many hubs in each.

Edge cases: null, empty and wordless texts have the empty set, no links, and are their own component.
Fewer words than n are one n-gram. Equal texts and repeated rows are in one component. A row with null
doc_id links nothing and has a null component. A very long text is one block of its own (about 100 bytes
of memory for each of its words). An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, joined, mix64, saved, text_chunks, word_hashes
from .components import components
from .slices import bits_for, edges, pack, pack_sorted, unpack, unpack_sorted

WORDS = 5
PERCENT = 75
#: Cuts of the global order; a row of step 4 holds one part in so many of a set.
FRAGMENTS = 8
#: Pairs for each set of an n-gram, or for each prefix n-gram of the first turn, that may meet at once.
MEET = 16
BLOCK_GRAMS = 1_000_000
_STEPS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending, and the number of the text that each is of."""
    data, bounds = joined(texts)
    hashes, starts = word_hashes(data)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        grams, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(hashes) >= n:
            last = len(hashes) - n + 1
            sums = np.zeros(last, np.uint64)
            for k in range(n):
                sums += hashes[k : k + last] * _STEPS[k]
            inside = doc[:last] == doc[n - 1 :]
            grams, of = mix64(sums[inside]), doc[:last][inside]
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            sums = np.zeros(len(short), np.uint64)
            for k in range(n - 1):
                has = counts[short] > k
                sums[has] += hashes[first[short[has]] + k] * _STEPS[k]
            grams = np.concatenate([grams, mix64(sums + counts[short].astype(np.uint64) * _STEPS[n])])
            of = np.concatenate([of, short])
    order = np.lexsort((of, grams))
    grams, of = grams[order], of[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (of[1:] != of[:-1]))
    return grams[new], of[new]


def set_digests(grams: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for each text's set."""
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(a, of, mix64(grams ^ np.uint64(0x1234567)))
        np.add.at(b, of, mix64(grams ^ np.uint64(0x7654321 << 8)))
    return a, b


_SETS = "array<struct<doc:int,doc_id:long,n:int,a:long,b:long>>"
_DEALT = f"range long, block long, keys binary, docs binary, sets {_SETS}"
_BACK = f"block long, keys binary, docs binary, level binary, sets {_SETS}"
_READY = "row long, doc_id long, n int, a long, b long, grams array<long>"


def _dealt(docs: DataFrame, bits: int, n: int, block_grams: int) -> DataFrame:
    """By range of hashes: each block's n-grams with their documents. Its sets' sizes and digests are dealt out over the ranges at random."""
    import pyarrow as pa

    def made(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 40  # a block is named by the number of its first row
        for batch in batches:
            for chunk in text_chunks(batch, "text", block_grams * 6):
                ids = np.array(chunk.column(0).to_pylist(), np.int64)
                grams, of = shingles(chunk.column(1).to_pylist(), n)
                sizes = np.bincount(of, minlength=len(ids))
                a, b = set_digests(grams, of, len(ids))
                # Of equal sets in the block, the one of smallest id speaks for all.
                order = np.lexsort((np.arange(len(ids)), ids, b, a, sizes))
                same = np.flatnonzero((a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1]) & (sizes[order][1:] == sizes[order][:-1]))
                speaks = np.ones(len(ids), bool)
                speaks[order[same + 1]] = False
                grams, of = grams[speaks[of]], of[speaks[of]]
                dealt = mix64(np.arange(block, block + len(ids), dtype=np.uint64))
                by_set = np.argsort(dealt)
                x, y = edges(grams, bits), edges(dealt[by_set], bits)
                ranges = np.flatnonzero(np.diff(x) + np.diff(y))
                at = np.append(y[ranges], len(ids)).astype(np.int32)
                sets = pa.StructArray.from_arrays(
                    [pa.array(by_set.astype(np.int32)), pa.array(ids[by_set]), pa.array(sizes[by_set].astype(np.int32)), pa.array(a[by_set].view(np.int64)), pa.array(b[by_set].view(np.int64))],
                    ["doc", "doc_id", "n", "a", "b"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ranges), pa.array(np.full(len(ranges), block)), pa.array([pack_sorted(grams[x[k] : x[k + 1]]) for k in ranges], pa.binary()),
                        pa.array([pack(of[x[k] : x[k + 1]]) for k in ranges], pa.binary()), pa.ListArray.from_arrays(pa.array(at), sets),
                    ],
                    ["range", "block", "keys", "docs", "sets"],
                )
                block += len(ids)

    return docs.select("doc_id", "text").mapInArrow(made, _DEALT)


def _shared(dealt: DataFrame) -> DataFrame:
    """To each block the n-grams that lie in two sets or more, with the level of that number, and its sets."""
    import pyarrow as pa

    def summed(table):
        each = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        keys = np.concatenate(each)
        at = np.cumsum([0, *map(len, each)])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(keys)))
        seen = np.empty(len(keys), np.int64)
        seen[order] = np.repeat(lengths, lengths)
        level = np.floor(4 * np.log2(np.maximum(seen, 1))).astype(np.int64)
        out = {"keys": [], "docs": [], "level": []}
        for k, of in enumerate(table.column("docs").to_pylist()):
            own = seen[at[k] : at[k + 1]] > 1
            out["keys"].append(pack_sorted(each[k][own]))
            out["docs"].append(pack(unpack(of)[own]))
            out["level"].append(pack(level[at[k] : at[k + 1]][own]))
        return pa.table({"block": table.column("block"), **{n: pa.array(v, pa.binary()) for n, v in out.items()}, "sets": table.column("sets")})

    return dealt.groupBy("range").applyInArrow(summed, _BACK)


def _ready(shared: DataFrame, percent: int) -> DataFrame:
    """All documents with size and digest; of those that speak for a block and can have links also the n-grams in global order."""
    import pyarrow as pa

    def put(table):
        keys = np.concatenate([unpack_sorted(x) for x in table.column("keys").to_pylist()])
        docs = np.concatenate([unpack(x) for x in table.column("docs").to_pylist()])
        level = np.concatenate([unpack(x) for x in table.column("level").to_pylist()])
        grams = (level << 55) | (keys >> np.uint64(9)).astype(np.int64)
        order = np.lexsort((grams, docs))
        grams, docs = grams[order], docs[order]
        sets = table.column("sets").combine_chunks().flatten()
        doc, n = (sets.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2))
        low, high = np.searchsorted(docs, doc), np.searchsorted(docs, doc, side="right")
        able = (high > low) & (100 * (high - low) >= percent * n)
        kept = [grams[a:b] if k else None for k, a, b in zip(able, low, high)]
        row = doc + table.column("block")[0].as_py()
        return pa.table({"row": pa.array(row), "doc_id": sets.field(1), "n": sets.field(2), "a": sets.field(3), "b": sets.field(4), "grams": pa.array(kept, pa.list_(pa.int64()))})

    return shared.groupBy("block").applyInArrow(put, _READY)


def linked(pairs: DataFrame, segments: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b and any other columns) that link, with their overlap: counted per fragment, then summed."""
    own = pairs.columns
    left = segments.select(F.col("id").alias("a"), F.col("n").alias("na"), "fragment", F.col("grams").alias("x"))
    right = segments.select(F.col("id").alias("b"), F.col("n").alias("nb"), "fragment", F.col("grams").alias("y"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select(*own, "na", "nb", F.size(F.array_intersect("x", "y")).alias("o"))
    total = partial.groupBy(*own, "na", "nb").agg(F.sum("o").alias("overlap"))
    return total.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select(*own, "overlap")


def _segments(sets: DataFrame, fragments: int) -> DataFrame:
    """Each set's n-grams by fragment of the global order."""
    bounds = sets.select(F.explode("grams").alias("g")).select(F.percentile_approx("g", [k / fragments for k in range(1, fragments)], 1000)).first()[0] or []
    cut = sorted(set(bounds))

    def piece(low, high):
        def inside(g):
            test = F.lit(True) if low is None else g >= low
            return test if high is None else test & (g < high)

        return F.filter("grams", inside)

    pieces = F.array(*[piece(a, b) for a, b in zip([None, *cut], [*cut, None])])
    return saved(sets.select("id", "n", F.posexplode(pieces).alias("fragment", "grams")).where(F.size("grams") > 0), "jaccard-segments")


def _linked_sets(sets: DataFrame, percent: int, fragments: int, meet: float = MEET) -> DataFrame:
    """(id, component) of each of ``sets`` (id, n, grams in global order) that links another one."""
    # The prefix of the global order: what stands in one set only comes first, and is left out.
    need = F.ceil(F.col("n") * percent / 100)
    heads = sets.select("id", "n", F.size("grams").alias("left"), F.slice("grams", F.lit(1), (F.size("grams") - need + 1).cast("int")).alias("head"))
    segments = _segments(sets, fragments)
    entries = heads.select("id", "n", "left", F.posexplode("head").alias("at", "gram")).select("gram", "id", "n", (F.col("left") - F.col("at")).alias("rest"), (1 - F.col("left") / F.col("n")).alias("own"), F.col("id").alias("label"))

    def may_link(a, b, rest_a, rest_b):
        """Whether sets of a and b n-grams can link when the first n-gram in both has so many from it on."""
        return (100 + percent) * F.least(rest_a, rest_b) >= percent * (a + b)

    labels, hubs, before, limit = None, 1, [], None
    while True:
        # Of an n-gram, what can't link any set of another component there goes.
        about = entries.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"), F.max("rest").alias("most")).where("low < high")
        open_ = saved(entries.join(about, "gram").where(may_link(F.col("n"), F.col("least"), F.col("rest"), F.col("most"))).select("gram", "id", "n", "rest", "own", "label"), "jaccard-open")
        shares = open_.groupBy("gram", "label").agg(F.count("*").cast("double").alias("k")).groupBy("gram").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("within"))
        shares = saved(shares.select("gram", "k", ((F.col("k") * F.col("k") - F.col("within")) / 2).alias("pairs")), "jaccard-shares")
        many = F.col("pairs") > meet * F.col("k")
        size, pairs_left, any_many = shares.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.max(many), F.lit(False))).first()
        last = not any_many or limit is not None and pairs_left <= limit
        limit = meet * size if limit is None else limit
        meeting = open_.withColumn("whole", F.lit(True))
        if not last:
            large = shares.where(many).select("gram")
            rank = F.row_number().over(Window.partitionBy("gram").orderBy("own", F.xxhash64("id"), "id"))
            few = open_.join(large, "gram", "left_semi").withColumn("rank", rank).where(F.col("rank") <= hubs).drop("rank")
            meeting = saved(few.withColumn("whole", F.lit(False)).unionByName(meeting.join(large, "gram", "left_anti")), "jaccard-hubs")
        other = meeting.select("gram", F.col("id").alias("other"), F.col("n").alias("m"), F.col("rest").alias("rest_other"), F.col("label").alias("to"), "whole")
        apart = (F.col("label") < F.col("to")) | ~F.col("whole") & (F.col("label") != F.col("to"))
        met = open_.join(other, "gram").where(apart & may_link(F.col("n"), F.col("m"), F.col("rest"), F.col("rest_other")))
        first = F.col("id") < F.col("other")
        of = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
        pairs = met.select(of("id", "other").alias("a"), of("other", "id").alias("b"), of("label", "to").alias("of_a"), of("to", "label").alias("of_b")).distinct()
        new = saved(linked(pairs, segments, percent).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct(), "jaccard-links")
        discard(*before)
        before = [open_, shares, meeting, new] if not last else [open_, shares, new]
        if not new.isEmpty():  # links between components, which become one
            joined = components(new).withColumnRenamed("node", "was")
            if labels is None:
                labels = joined.withColumnRenamed("was", "id")
            else:
                moved = labels.withColumnRenamed("component", "was").join(joined, "was", "left").select("id", F.coalesce("component", "was").alias("component"))
                alone = joined.join(labels.select(F.col("id").alias("was")), "was", "left_anti").withColumnRenamed("was", "id")
                labels = saved(moved.unionByName(alone), "jaccard-labels")
        if last:
            discard(*before, segments)
            return labels if labels is not None else sets.select("id", F.col("id").alias("component")).limit(0)
        entries = open_.join(meeting.select("gram", "id"), ["gram", "id"], "left_anti")
        if labels is not None:
            entries = entries.drop("label").join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        hubs *= 4


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where("doc_id is not null")
    chars = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ready = saved(_ready(_shared(_dealt(named, bits_for(chars / 6), words, block_grams)), percent), "jaccard-documents")
    speaker = F.when(F.col("grams").isNotNull(), F.struct("doc_id", "row"))
    classes = ready.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("first"), F.min(speaker).alias("speaker"))
    classes = saved(classes.select("a", "b", "n", "first", F.col("speaker.row").alias("id")), "jaccard-classes")
    sets = saved(ready.where("grams is not null").withColumnRenamed("row", "id").join(classes.select("id"), "id", "left_semi").select("id", "n", "grams"), "jaccard-sets")
    member = classes.where("id is not null").join(_linked_sets(sets, percent, fragments), "id").select("a", "b", "n", "first", "component")
    smallest = member.groupBy("component").agg(F.min("first").alias("smallest"))
    named_class = saved(member.join(smallest, "component").select("a", "b", "n", "smallest"), "jaccard-members")
    classed = classes.select("a", "b", "n", "first").join(named_class, ["a", "b", "n"], "left").select("a", "b", "n", F.coalesce("smallest", "first").alias("class"))
    # Sets without n-grams are equal but link nothing.
    full = ready.where("n > 0").select("doc_id", "a", "b", "n").join(classed, ["a", "b", "n"]).select("doc_id", "n", F.col("class").alias("component_id"))
    out = full.unionAll(ready.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    nameless = docs.where("doc_id is null")

    @F.pandas_udf("long")
    def set_size(texts: pd.Series) -> pd.Series:
        return pd.Series(np.bincount(shingles(texts.tolist(), words)[1], minlength=len(texts)))

    return out.unionAll(nameless.select("doc_id", set_size("text").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
