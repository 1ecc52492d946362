"""Operator 10, language-model scoring with Katz backoff over words, of any order.

Counts of n-grams up to ``order`` words come from all training documents, Good-Turing discounts (counts
up to ``GT_MAX``) of each order from its counts of counts, and the backoff weight of each context from exact
sums over all its followers. A token is evaluated recursively: P(w | h) = d * c(h, w) / (c(h) + 0.5) for n-grams
seen in training, otherwise alpha(h) * P(w | h'), where h' is h without its first word and alpha(h) makes the
probabilities of all words and the unknown word add up to 1 (alpha is 1 for a context without followers). P(w) is the
discounted unigram; all unknown words together are one word that gets the mass left over. The half
count in c(h) + 0.5 keeps that mass above 0 for contexts without small counts.

1. Documents become blocks of about ``BLOCK_TOKENS`` tokens: sorted word hashes and token numbers.
2. For each order, blocks send their n-grams, summed, in slices by hash; groups of slices add up and
   tell each block the counts of its n-grams. One block for each n-gram is told that it owns it.
3. A block with its counts back evaluates each token at the highest order that was seen, and notes the
   contexts that it backed off from. Groups by range tell the blocks which of their n-grams are asked for as contexts;
   of these, blocks send the sums of the n-grams they own.
4. Groups of contexts turn sums into alpha, for the contexts that any block asks for: a table of backoff weights by
   order and range of contexts. A block asks for a context once, however many of its documents back off from it.

No group holds more than about ``KEYS_IN_GROUP`` keys and one of each block for a frequent n-gram. Tables
are written in the shared folder by key range. ``fit`` also keeps all counts and weights as such tables,
and ``evaluate`` scores other texts with them. N-grams are compared by 64-bit hashes.

Edge cases: null and empty texts are the end token alone. Without training documents all
probabilities are those of the unknown word, 1. A null doc_id is a training document. Repeated
rows count as often as they occur; a very long text is one block; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, joined, mix64, saved, text_chunks, word_hashes
from .slices import bits_for, edges, pack, pack_sorted, squeeze, unpack, unpack_sorted, unsqueeze

ORDER = 3
BLOCK_TOKENS = 1_000_000
GT_MAX = 5
END = np.uint64(0x5851F42D4C957F2D)
BEGIN = np.uint64(0x14057B7EF767814F)
FOLDS, HELD_OUT_FOLD = 7, 2
_PAIR = np.uint64(0xA0761D6478BD642F)


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT_FOLD


def blocks_of(docs: DataFrame, block_tokens: int) -> DataFrame:
    """One row per block: its documents' ids, token numbers, and sorted word hashes (BEGIN among them)."""
    import pyarrow as pa

    schema = "block long, ids array<long>, lengths binary, words binary, tokens binary, n_tokens long, n_words long"

    def made(batches):
        from pyspark import TaskContext

        block, ids, parts, sizes, total = TaskContext.get().partitionId() << 32, [], [], [], 0

        def flush():
            words, tokens = np.unique(np.concatenate([*parts, [BEGIN]]), return_inverse=True)
            n = len(tokens) - 1
            arrays = [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64()))]
            arrays += [pa.array([x], pa.binary()) for x in (pack(np.array(sizes)), pack_sorted(words), squeeze(pack(tokens[:n])))]
            arrays += [pa.array([n], pa.int64()), pa.array([len(words)], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["block", "ids", "lengths", "words", "tokens", "n_tokens", "n_words"])

        for batch in batches:
            for chunk in text_chunks(batch, "text", 4_000_000):
                data, bounds = joined(chunk.column(1).to_pylist())
                hashes, starts = word_hashes(data)
                counts = np.diff(np.searchsorted(starts, bounds))
                tokens = np.insert(hashes, np.cumsum(counts), END)  # after each document's words
                ids += chunk.column(0).to_pylist()
                sizes += (counts + 1).tolist()
                parts.append(tokens)
                total += len(tokens)
                if total >= block_tokens:
                    yield flush()
                    block, ids, parts, sizes, total = block + 1, [], [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(made, schema)


class Block:
    """The arrays of one block row."""

    def __init__(self, ids, lengths, words, tokens):
        self.ids = ids
        self.words = unpack_sorted(words)
        self.tokens = unpack(unsqueeze(tokens))
        self.lengths = unpack(lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.training = ~np.array([held_out(i) for i in ids])
        self.in_training = np.repeat(self.training, self.lengths)

    def before(self, of_tokens: np.ndarray, at_first) -> np.ndarray:
        """What ``of_tokens`` has for the token before each; ``at_first`` at the start of a document."""
        out = np.empty_like(of_tokens)
        out[1:] = of_tokens[:-1]
        out[self.first] = at_first
        return out

    def orders(self, order: int, least: int = 1):
        """For ``least`` to ``order`` words: sorted distinct n-gram keys, each token's n-gram number, each token's context key.

        A context is the n-gram of one word less before the token, or BEGIN.
        """
        keys = self.words[self.tokens]
        if least == 1:
            yield self.words, self.tokens, None
        word = mix64(keys)
        for k in range(2, order + 1):
            context = self.before(keys, BEGIN)
            with np.errstate(over="ignore"):
                keys = mix64(context * _PAIR + word)
            if k >= least:
                distinct, number = np.unique(keys, return_inverse=True)
                yield distinct, number, context

    def trained(self, number: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(number[self.in_training], minlength=size)


_SLICE = "range long, block long, keys binary, counts binary"
_COUNTED = "block long, range long, counts binary, owned binary, stats array<long>"
_BLOCK = ["ids", "lengths", "words", "tokens"]


def _sliced(out: dict, keys: np.ndarray, bits: int, **values) -> None:
    """Append to the lists of ``out`` a row for each range of ascending ``keys`` that is not empty; values: (array, how it is packed) or a constant."""
    at = edges(keys, bits)
    for k in np.flatnonzero(np.diff(at)):
        out["range"].append(int(k))
        out["keys"].append(pack_sorted(keys[at[k] : at[k + 1]]))
        for name, value in values.items():
            out[name].append(value[1](value[0][at[k] : at[k + 1]]) if isinstance(value, tuple) else value)


def _slices(blocks: DataFrame, order: int, bits: int) -> DataFrame:
    """Each block's n-grams of ``order`` words with its training counts, by range."""
    import pyarrow as pa

    def sliced(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block, *columns = (c[0].as_py() for c in batch.slice(k, 1).columns)
                own = Block(*columns)
                ((keys, number, _),) = own.orders(order, order)
                out = {n: [] for n in ("range", "block", "keys", "counts")}
                _sliced(out, keys, bits, block=block, counts=(own.trained(number, len(keys)), pack))
                yield pa.RecordBatch.from_arrays([pa.array(out["range"], pa.int64()), pa.array(out["block"], pa.int64()), pa.array(out["keys"], pa.binary()), pa.array(out["counts"], pa.binary())], list(out))

    return blocks.select("block", *_BLOCK).mapInArrow(sliced, _SLICE)


def _summed(table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one range: each slice's keys, all keys and counts in a row, their order, where each distinct key starts in it."""
    each = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([unpack(x) for x in table.column("counts").to_pylist()])
    keys = np.concatenate(each)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    return each, keys, counts, order, np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))


def _counted(slices: DataFrame) -> DataFrame:
    """To each slice the sums of its keys over all blocks. stats, once a range: tokens, keys, then the counts of counts."""
    import pyarrow as pa

    def summed(table):
        table = table.sort_by("block")
        each, keys, counts, order, starts = _summed(table)
        sums = np.add.reduceat(counts[order], starts)
        lengths = np.diff(np.append(starts, len(keys)))
        spread = np.empty(len(keys), np.int64)
        spread[order] = np.repeat(sums, lengths)
        # The first block that saw a key in training owns it.
        ordered, seen = counts[order] > 0, np.zeros(len(keys), bool)
        so_far = np.cumsum(ordered)
        before = np.repeat(so_far[starts] - ordered[starts], lengths)
        seen[order] = ordered & (so_far - before == 1)
        stats = [int(sums.sum()), int((sums > 0).sum()), *np.bincount(sums[sums <= GT_MAX + 1], minlength=GT_MAX + 2)[1:].tolist()]
        at = np.cumsum([0, *map(len, each)])
        parts = list(zip(at[:-1], at[1:]))
        return pa.table(
            {
                "block": table.column("block"),
                "range": table.column("range"),
                "counts": pa.array([squeeze(pack(spread[a:b])) for a, b in parts], pa.binary()),
                "owned": pa.array([np.packbits(seen[a:b]).tobytes() for a, b in parts], pa.binary()),
                "stats": pa.array([stats] + [None] * (len(parts) - 1), pa.list_(pa.int64())),
            }
        )

    return slices.groupBy("range").applyInArrow(summed, _COUNTED)


def _totals(counted: DataFrame) -> list[int]:
    rows = counted.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    found = {r.k: r.v for r in rows}
    return [found.get(k, 0) for k in range(GT_MAX + 3)]


def discounts(of_counts: list[int]) -> np.ndarray:
    """Good-Turing discount ratios for counts 0 to GT_MAX + 1 (the last stands for all above).

    of_counts[r - 1] is the number of types with count r. Where the counts of counts are too thin
    for the formula, a ratio is that of an absolute discount of one half.
    """
    n = [0, *of_counts]
    k = GT_MAX
    out = np.ones(k + 2)
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass
class Totals:
    """What is known of the whole training corpus, apart from the tables."""

    order: int
    bits: list[int]  # of each order's ranges
    tokens: int
    types: int
    docs: int
    ratios: list[list[float]]  # Good-Turing, by order and count

    def __post_init__(self):
        # Unigrams: what the discounts take from the seen words is the unknown word's.
        self.kept, self.whole, self.unknown = None, None, 1.0

    def unigrams(self, of_words: list[int]) -> Totals:
        d, low = self.ratios[0], list(enumerate(of_words[:GT_MAX], 1))
        kept = sum(r * n * d[r] for r, n in low) + self.tokens - sum(r * n for r, n in low)
        self.whole = self.tokens + (0.5 if self.tokens and kept >= self.tokens - 1e-9 else 0.0)
        self.unknown = 1.0 - kept / self.whole if self.tokens else 1.0
        return self

    def discounted(self, order: int, counts: np.ndarray) -> np.ndarray:
        return counts * np.array(self.ratios[order - 1])[np.minimum(counts, GT_MAX + 1)]


#: Added to the order in rows that tell a block which of its n-grams are asked for as contexts of that order.
_WANTED = 100


def _together(blocks: DataFrame, counts: list[DataFrame], wanted: list[DataFrame] | None = None) -> DataFrame:
    out = blocks.select("block", *_BLOCK).withColumns({"order": F.lit(0), "range": F.lit(0).cast("long")})
    for k, table in enumerate(counts, 1):
        out = out.unionByName(table.select("block", "range", "counts", "owned").withColumn("order", F.lit(k)), allowMissingColumns=True)
    for k, table in enumerate(wanted or [], 2):
        out = out.unionByName(table.select("block", "range", F.col("wanted").alias("owned")).withColumn("order", F.lit(_WANTED + k)), allowMissingColumns=True)
    return out


class Counted:
    """A block with the counts of its n-grams: for each order the count, probability and context of each token."""

    def __init__(self, table, totals: Totals):
        rows = table.sort_by([("order", "ascending"), ("range", "ascending")]).to_pylist()
        self.name = rows[0]["block"]
        self.own = Block(*(rows[0][c] for c in _BLOCK))
        self.counts, self.p, self.contexts, self.followers, self.numbers, self.owned, self.wanted = [], [], [], [], [], [], []
        for k, (_, number, context) in enumerate(self.own.orders(totals.order), 1):
            parts = [(unpack(unsqueeze(r["counts"])), r["owned"]) for r in rows if r["order"] == k]
            c = np.concatenate([x for x, _ in parts])[number]
            if k == 1:
                p = np.where(c > 0, totals.discounted(1, c) / max(totals.whole, 1), totals.unknown)
                n = None
            else:
                n = self.own.before(self.counts[-1], totals.docs)
                p = totals.discounted(k, c) / (n + 0.5)
            for to, x in ((self.counts, c), (self.p, p), (self.contexts, context), (self.followers, n), (self.numbers, number)):
                to.append(x)
            self.owned.append(np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8), count=len(x)) for x, o in parts]).astype(bool) if parts[0][1] is not None else None)
            bits = [r["owned"] for r in rows if r["order"] == _WANTED + k + 1]
            self.wanted.append(np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8), count=len(x)) for (x, _), o in zip(parts, bits)]).astype(bool) if bits else None)


_SCORED = "block long, ids array<long>, held binary, lengths binary, known binary, base binary, seen binary, asked array<struct<order:int,contexts:binary,which:binary,who:binary,times:binary>>"


def _scored(blocks: DataFrame, counts: list[DataFrame], totals: Totals) -> DataFrame:
    """Each block's documents with their sums so far, and the contexts that they back off from."""
    import pyarrow as pa

    def measured(table):
        c = Counted(table, totals)
        own = c.own
        logs, top = np.log10(c.p[0]), np.ones(len(own.tokens), np.int8)
        for k in range(2, totals.order + 1):
            seen = c.counts[k - 1] > 0
            logs[seen] = np.log10(c.p[k - 1][seen])
            top[seen] = k
        base = np.log10((c.counts[0] + 1.0) / (totals.tokens + totals.types + 1.0))
        doc = np.repeat(np.arange(len(own.ids)), own.lengths)
        asked = []
        for k in range(2, totals.order + 1):
            back = np.flatnonzero((top < k) & (c.followers[k - 1] > 0))
            contexts, which = np.unique(c.contexts[k - 1][back], return_inverse=True)
            pairs, times = np.unique(doc[back] * max(1, len(contexts)) + which, return_counts=True)
            asked.append({"order": k, "contexts": pack_sorted(contexts), "which": pack(pairs % max(1, len(contexts))), "who": pack(pairs // max(1, len(contexts))), "times": pack(times)})
        sums = [np.add.reduceat(x, own.first) for x in ((c.counts[0] > 0).astype(np.int64), base, logs)]
        arrays = [pa.array([c.name], pa.int64()), pa.array([own.ids], pa.list_(pa.int64()))]
        arrays += [pa.array([x], pa.binary()) for x in ((~own.training).tobytes(), pack(own.lengths), pack(sums[0]), sums[1].tobytes(), sums[2].tobytes())]
        kind = pa.list_(pa.struct([("order", pa.int32()), *((n, pa.binary()) for n in ("contexts", "which", "who", "times"))]))
        return pa.table([*arrays, pa.array([asked], kind)], ["block", "ids", "held", "lengths", "known", "base", "seen", "asked"])

    return _together(blocks, counts).groupBy("block").applyInArrow(measured, _SCORED)


def _doubles(values: np.ndarray) -> bytes:
    """Floating-point numbers, squeezed: the distinct ones and the place of each among them, or all in a row if few repeat."""
    distinct, place = np.unique(values, return_inverse=True)
    if 2 * len(distinct) > len(values):
        distinct, place = values, place[:0]
    planes = np.ascontiguousarray(distinct.view(np.uint8).reshape(-1, 8).T).tobytes()  # equal bytes of all of them together
    return squeeze(len(distinct).to_bytes(8, "little") + planes + pack(place))


def _undoubled(data: bytes) -> np.ndarray:
    data = unsqueeze(data)
    end = 8 + 8 * int.from_bytes(data[:8], "little")
    distinct = np.ascontiguousarray(np.frombuffer(data[8:end], np.uint8).reshape(8, -1).T).view(np.float64).ravel()
    place = unpack(data[end:])
    return distinct[place] if len(place) else distinct


_CONTEXT = "order int, range long, keys binary, used binary, open binary"


def _wanted(blocks: DataFrame, asks: DataFrame, totals: Totals) -> list[DataFrame]:
    """For each order from 2: which of a block's n-grams of one word less any block asks for as contexts, by range."""
    import pyarrow as pa

    def marked(slices_, asks_):
        asked = np.unique(np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(x) for x in asks_.column("keys").to_pylist())]))
        bits = [np.packbits(np.isin(unpack_sorted(x), asked, assume_unique=True)).tobytes() for x in slices_.column("keys").to_pylist()]
        return pa.table([slices_.column("block"), slices_.column("range"), pa.array(bits, pa.binary())], ["block", "range", "wanted"])

    out = []
    for k in range(2, totals.order + 1):
        slices = _slices(blocks, k - 1, totals.bits[k - 2]).select("range", "block", "keys")
        own = asks.where(F.col("order") == k).select("range", "keys")
        out.append(saved(slices.groupBy("range").cogroup(own.groupBy("range")).applyInArrow(marked, "block long, range long, wanted binary"), f"lm-wanted-{k}"))
    return out


def _contexts(blocks: DataFrame, counts: list[DataFrame], totals: Totals, wanted: list[DataFrame] | None = None) -> DataFrame:
    """By order and context, from each block: the probability that its owned n-grams use up, and what their words have at the order below.

    Of all contexts, or of those ``wanted``; the start of a document always.
    """
    import pyarrow as pa

    def sums(table):
        c = Counted(table, totals)
        out = {n: [] for n in ("order", "range", "keys", "used", "open")}
        for k in range(2, totals.order + 1):
            number, owned = c.numbers[k - 1], c.owned[k - 1]
            example = np.zeros(len(owned), np.int64)
            example[number] = np.arange(len(number))
            at = example[owned]
            if c.wanted[k - 2] is not None:
                at = at[c.own.before(c.wanted[k - 2][c.numbers[k - 2]], True)[at]]
            keys, of = np.unique(c.contexts[k - 1][at], return_inverse=True)
            used, open_ = (np.bincount(of, p[at], len(keys)) for p in (c.p[k - 1], c.p[k - 2]))
            _sliced(out, keys, totals.bits[k - 2], order=k, used=(used, _doubles), open=(open_, _doubles))
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], list(out))

    return _together(blocks, counts, wanted).groupBy("block").applyInArrow(sums, _CONTEXT)


_WEIGHTS = "order int, range long, keys binary, weights binary"


def _weighed(contexts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts of one range and log10 of their exactly normalised backoff weights."""
    keys, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(x) for x in contexts.column("keys").to_pylist())]), return_inverse=True)
    used, open_ = (np.bincount(of, np.concatenate([np.zeros(0), *map(_undoubled, contexts.column(c).to_pylist())]), len(keys)) for c in ("used", "open"))
    return keys, np.log10(np.maximum(1.0 - used, 1e-300) / np.maximum(1.0 - open_, 1e-300))


def _weights(contexts: DataFrame) -> DataFrame:
    """The table of backoff weights of ``contexts``."""
    import pyarrow as pa

    def weighed(table):
        keys, weights = _weighed(table)
        values = [table.column("order")[0].as_py()], [table.column("range")[0].as_py()], [pack_sorted(keys)], [_doubles(weights)]
        return pa.table([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["order", "range", "keys", "weights"])

    return contexts.groupBy("order", "range").applyInArrow(weighed, _WEIGHTS)


def _asks(scored: DataFrame, totals: Totals) -> DataFrame:
    """The contexts that each block asks for, once each, by order and range."""
    import pyarrow as pa

    def sliced(batches):
        for batch in batches:
            out = {n: [] for n in ("order", "range", "block", "keys")}
            for block, asked in zip(*(c.to_pylist() for c in batch.columns)):
                for a in asked:
                    _sliced(out, unpack_sorted(a["contexts"]), totals.bits[a["order"] - 2], order=a["order"], block=block)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], list(out))

    return scored.select("block", "asked").mapInArrow(sliced, "order int, range long, block long, keys binary")


def _finished(scored: DataFrame, asks: DataFrame, weights: DataFrame, totals: Totals) -> DataFrame:
    """Every document's result, after its block has got the weights it asked for."""
    import pyarrow as pa

    def answered(asks_, weights_):
        keys = np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(x) for x in weights_.column("keys").to_pylist())])
        values = np.concatenate([np.zeros(0), *map(_undoubled, weights_.column("weights").to_pylist())])
        out = []
        for wanted in asks_.column("keys").to_pylist():
            wanted = unpack_sorted(wanted)
            at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
            out.append((np.where(keys[at] == wanted, values[at], 0.0) if len(keys) else np.zeros(len(wanted))).tobytes())
        return pa.table([asks_.column("block"), asks_.column("order"), asks_.column("range"), pa.array(out, pa.binary())], ["block", "order", "range", "weights"])

    answers = asks.groupBy("order", "range").cogroup(weights.groupBy("order", "range")).applyInArrow(answered, "block long, order int, range long, weights binary")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def finished(scored_, answers_):
        row = scored_.to_pylist()[0]
        of = answers_.sort_by([("order", "ascending"), ("range", "ascending")])
        orders, parts = of.column("order").to_numpy(), of.column("weights").to_pylist()
        logs = np.frombuffer(row["seen"]).copy()
        for a in row["asked"]:
            weights = np.concatenate([np.zeros(0), *(np.frombuffer(parts[k]) for k in np.flatnonzero(orders == a["order"]))])
            logs += np.bincount(unpack(a["who"]), weights[unpack(a["which"])] * unpack(a["times"]), len(logs))
        columns = [pa.array(row["ids"], pa.int64()), pa.array(np.frombuffer(row["held"], bool)), pa.array(unpack(row["lengths"])), pa.array(unpack(row["known"])), pa.array(np.frombuffer(row["base"])), pa.array(logs)]
        return pa.table(columns, names)

    done = scored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finished, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select(*names[:4], F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _learned(docs: DataFrame, order: int, block_tokens: int) -> tuple[DataFrame, list[DataFrame], Totals, list[int]]:
    blocks = saved(blocks_of(docs, block_tokens), "lm-blocks")
    n_tokens, n_words = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    bits = [bits_for(n_words), *[bits_for(n_tokens * 0.8)] * (order - 1)]
    counts = [saved(_counted(_slices(blocks, k, bits[k - 1])), f"lm-counts-{k}") for k in range(1, order + 1)]
    stats = [_totals(t) for t in counts]
    train_docs = blocks.select(F.explode("ids").alias("i")).where(
        "i is null or pmod(crc32(cast(cast(i as string) as binary)), %d) != %d" % (FOLDS, HELD_OUT_FOLD)
    ).count()
    totals = Totals(order, bits, stats[0][0], stats[0][1], train_docs, [discounts(x[2:]).tolist() for x in stats])
    return blocks, counts, totals.unigrams(stats[0][2:]), stats[0][2:]


def score(docs: DataFrame, order: int = ORDER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document, by what those not held out teach."""
    blocks, counts, totals, _ = _learned(docs, order, block_tokens)
    scored = saved(_scored(blocks, counts, totals), "lm-scored")
    asks = _asks(scored, totals)
    wanted = _wanted(blocks, asks, totals)
    weights = saved(_weights(_contexts(blocks, counts, totals, wanted)), "lm-weights")
    discard(blocks, *counts, *wanted)
    return _finished(scored, asks, weights, totals)


def fit(docs: DataFrame, path: str, order: int = ORDER, block_tokens: int = BLOCK_TOKENS) -> None:
    """Keep the model of the documents not held out under ``path``: counts by order and range, backoff weights by order and range, totals."""
    import pyarrow as pa

    blocks, counts, totals, of_words = _learned(docs, order, block_tokens)

    def kept(table):
        _, keys, c, order_, starts = _summed(table)
        sums = np.add.reduceat(c[order_], starts)
        return pa.table([pa.array([table.column("range")[0].as_py()]), pa.array([pack_sorted(keys[order_][starts][sums > 0])], pa.binary()), pa.array([pack(sums[sums > 0])], pa.binary())], ["range", "keys", "counts"])

    for k in range(1, order + 1):
        _slices(blocks, k, totals.bits[k - 1]).groupBy("range").applyInArrow(kept, "range long, keys binary, counts binary").write.parquet(f"{path}/counts/order={k}")
    _weights(_contexts(blocks, counts, totals)).write.partitionBy("order").parquet(f"{path}/weights")
    docs.sparkSession.createDataFrame([(json.dumps({"totals": asdict(totals), "of_words": of_words}),)], "totals string").write.json(f"{path}/totals")
    discard(blocks, *counts)


def evaluate(spark: SparkSession, path: str, docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Scores of ``docs`` by the model that ``fit`` has kept under ``path``."""
    import pyarrow as pa

    about = json.loads(spark.read.json(f"{path}/totals").first().totals)
    totals = Totals(**about["totals"]).unigrams(about["of_words"])
    blocks = saved(blocks_of(docs, block_tokens), "lm-blocks")

    def looked_up(slices_, model_):
        keys = np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(x) for x in model_.column("keys").to_pylist())])
        values = np.concatenate([np.zeros(0, np.int64), *(unpack(x) for x in model_.column("counts").to_pylist())])
        out = []
        for wanted in slices_.column("keys").to_pylist():
            wanted = unpack_sorted(wanted)
            at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
            out.append(squeeze(pack(np.where(keys[at] == wanted, values[at], 0) if len(keys) else np.zeros(len(wanted), np.int64))))
        return pa.table([slices_.column("block"), slices_.column("range"), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], ["block", "range", "counts", "owned"])

    counts = []
    for k in range(1, totals.order + 1):
        model = spark.read.schema("range long, keys binary, counts binary").parquet(f"{path}/counts/order={k}")
        slices = _slices(blocks, k, totals.bits[k - 1])
        counts.append(saved(slices.groupBy("range").cogroup(model.groupBy("range")).applyInArrow(looked_up, "block long, range long, counts binary, owned binary"), f"lm-counts-{k}"))
    scored = saved(_scored(blocks, counts, totals), "lm-scored")
    weights = spark.read.parquet(f"{path}/weights").select(F.col("order").cast("int").alias("order"), "range", "keys", "weights")
    return _finished(scored, _asks(scored, totals), weights, totals)
