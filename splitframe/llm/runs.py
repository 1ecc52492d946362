"""Operator 12, periodic runs of words by the runs theorem.

A run is a stretch of words with smallest period q and at least 2 q words that no neighbour extends. Each run
holds a longest Lyndon word of length q that starts somewhere in it, under an order of the words or under the
reverse order. So the candidates are few: one for each word that starts a text's suffix.

1. Words become numbers, and the suffixes of all texts of a chunk are sorted by prefix doubling. A text ends
   with a mark below all words; suffixes of different texts never compare as equal.
2. The longest Lyndon word from a place ends at the next smaller value of the inverse suffix array; under the reverse
   order, at the next greater one. Both come from tables of minima and maxima of 2**k neighbours. Just one of the two is longer than
   one; so from a place start one longer root and one of length 1.
3. A Lyndon root is extended to both sides. Runs have ``min_length`` words, so on one side three words
   at least must agree; other candidates go. For texts with candidates left, the agreement to the right is a range minimum of the
   longest common prefixes between sorted suffixes, and to the left the same over the texts read backwards.
4. Roots that extend to the same stretch are one run.

Texts stay in their partition; no row is moved. A chunk has about CHUNK_CHARS characters of whole texts; a longer text is a
chunk of its own, whose tables take about 4 bytes for each word and each power of two up to its number of words, some four times.

Edge cases: null, empty and wordless texts have no words, no runs and the empty collapsed text. Texts of one word
repeated are one run of period 1. Rows without id and repeated rows are treated row by row. An empty table gives an empty one. Extra columns are ignored by ``periodic_runs``
and kept by ``without_runs``, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

CHUNK_CHARS = 2_000_000
MIN_LENGTH = 12
#: Words that must agree on one side of a root, if the run has at least MIN_LENGTH words.
AGREE = 3
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def sorted_suffixes(symbols: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Order of the suffixes, names of the first 2**k symbols of each for k = 0, 1, ..., and the k that parts each from the one before it.

    ``symbols`` are 0 at the end of each text and above elsewhere; ``text_of`` numbers the texts. The last names are the ranks.
    """
    n = len(symbols)
    key = text_of.astype(np.int64) * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    heads = np.flatnonzero(new)
    name = np.empty(n, np.int32)
    name[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    names, parts = [name], np.where(new, 0, 127).astype(np.int8)
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    step = 1
    while len(slots):
        at = order[slots]
        key = (names[-1][at].astype(np.int64) << 32) | names[-1][at + step]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        new = np.append(True, key[1:] != key[:-1])
        heads = np.flatnonzero(new)
        name = names[-1].copy()
        name[at] = np.repeat(slots[heads], np.diff(np.append(heads, len(slots))))
        fresh = slots[heads]
        parts[fresh] = np.minimum(parts[fresh], len(names))
        names.append(name)
        slots = slots[~(new & np.append(new[1:], True))]
        step *= 2
    return order, names, parts


def doubled(values: np.ndarray, most: int, pick, outside: int) -> list[np.ndarray]:
    """``pick`` (np.minimum or np.maximum) over the 2**k values from each place on, up to 2**k = ``most``; ``outside`` where they pass the end."""
    tables, step = [values], 1
    while 2 * step <= most:
        before = tables[-1]
        after = np.full(len(values), outside, values.dtype)
        if len(values) > step:
            after[:-step] = pick(before[:-step], before[step:])
        tables.append(after)
        step *= 2
    return tables


def lyndon_lengths(rank: np.ndarray, most: int) -> np.ndarray:
    """For each place the length of the longest Lyndon word from it under the order or the reverse order, the longer one.

    Lengths above ``most`` come out as some length above it.
    """
    n = len(rank)
    rising = np.append(rank[1:] > rank[:-1], False)
    lengths = np.ones(n, np.int64)
    for side, pick, outside in ((rising, np.minimum, -1), (~rising, np.maximum, n)):
        at = np.flatnonzero(side[:-1])
        own, end = rank[at], at + 1
        tables = doubled(rank, most, pick, outside)
        for k in range(len(tables) - 1, -1, -1):
            value = tables[k][np.minimum(end, n - 1)]
            on = (value > own if pick is np.minimum else value < own) & (end < n)
            end = end + (on.astype(np.int64) << k)
        lengths[at] = end - at
    return lengths


class CommonPrefixes:
    """Lengths of common prefixes of suffixes: range minima over those between sorted neighbours."""

    def __init__(self, symbols: np.ndarray, text_of: np.ndarray):
        order, names, parts = sorted_suffixes(symbols, text_of)
        self.rank = names[-1]
        shared = np.zeros(len(symbols), np.int32)
        for k in range(len(names) - 2, -1, -1):
            some = np.flatnonzero(parts > k)
            x, y = order[some - 1] + shared[some], order[some] + shared[some]
            shared[some] += (names[k][x] == names[k][y]).astype(np.int32) << k
        self.tables = doubled(shared, len(shared), np.minimum, 0)

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes at ``x`` and at ``y``, which differ."""
        a, b = self.rank[x].astype(np.int64), self.rank[y].astype(np.int64)
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        k = np.frexp(high - low)[1] - 1
        out = np.zeros(len(low), np.int64)
        for level in np.unique(k):
            some = k == level
            table = self.tables[level]
            out[some] = np.minimum(table[low[some]], table[high[some] - (1 << int(level))])
        return out


def find_runs(words: np.ndarray, lengths: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of at least ``min_length`` words, by text, start and period.

    ``words`` are the numbers (from 0) of the words of texts one after the other, ``lengths`` the texts' numbers of words.
    """
    none = (np.zeros(0, np.int64),) * 4
    if not len(words) or lengths.max() < 2:
        return none
    text_of = np.repeat(np.arange(len(lengths)), lengths + 1)
    ends = np.cumsum(lengths + 1) - 1  # of the marks
    begins = ends - lengths
    symbols = np.zeros(len(text_of), np.int64)
    inside = np.ones(len(text_of), bool)
    inside[ends] = False
    symbols[inside] = words + 1
    longest = int(lengths.max())
    period = lyndon_lengths(sorted_suffixes(symbols, text_of)[1][-1], longest)
    marked = np.concatenate([symbols, np.zeros(AGREE, np.int64)])
    marks = np.append(ends, len(symbols) + np.arange(AGREE))
    marked[marks] = -1 - np.arange(len(marks))  # no mark is like another
    long = np.flatnonzero(inside & (2 * period <= lengths[text_of]) & (np.arange(len(symbols)) + period <= ends[text_of]))
    one = np.flatnonzero(inside & (symbols == marked[1 : len(symbols) + 1]))  # under the other order the longest word is one long
    at, p = np.concatenate([long, one]), np.concatenate([period[long], np.ones(len(one), np.int64)])
    left, right = np.ones(len(at), bool), np.ones(len(at), bool)
    for k in range(min(AGREE, -(-min_length // 4))):
        left &= marked[at - 1 - k] == marked[at - 1 - k + p]
        right &= marked[at + k] == marked[np.minimum(at + k + p, len(marked) - 1)]
    at, p = at[left | right], p[left | right]
    if not len(at):
        return none
    chosen = np.unique(text_of[at])
    held = np.isin(text_of, chosen)
    place = np.cumsum(held) - 1
    some, of = symbols[held], np.repeat(np.arange(len(chosen)), lengths[chosen] + 1)
    x, n = place[at], len(some)
    right = CommonPrefixes(some, of).of(x, x + p)
    # Backwards each text again ends with its mark.
    back = np.concatenate([some[:-1][::-1], [0]])
    backwards = CommonPrefixes(back, np.repeat(np.arange(len(chosen)), lengths[chosen][::-1] + 1))
    first = at == begins[text_of[at]]  # nothing stands before
    mirrored = n - 1 - np.where(first, 1, x)  # of the word before x
    left = np.where(first, 0, backwards.of(mirrored, mirrored - p))
    good = left + right >= np.maximum(p, min_length - p)
    at, p, left, right = at[good], p[good], left[good], right[good]
    text, length = text_of[at], left + p + right
    start = at - left - begins[text]
    found = np.unique(np.stack([text, start, p, length], axis=1), axis=0)
    return found[:, 0], found[:, 1], found[:, 3], found[:, 2]


def words_of(texts):
    """(numbers of the words of all texts, numbers of words by text, the different words) of an Arrow array of strings."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    words, offsets = split.flatten(), split.offsets.to_numpy()
    some = pc.not_equal(words, "")
    number = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    bounds = number[offsets - offsets[0]]
    coded = words.filter(some).dictionary_encode()
    return coded.indices.to_numpy(), np.diff(bounds), coded.dictionary


def _listed(bounds, text, start, length, period):
    import pyarrow as pa

    offsets = np.searchsorted(text, np.arange(len(bounds) + 1)).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(offsets), rows)


def _collapsed(codes, lengths, dictionary, text, start, length, period):
    """The kept words of each text, joined by one space."""
    import pyarrow as pa
    import pyarrow.compute as pc

    begins = np.cumsum(lengths) - lengths
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, begins[text] + start + period, 1)
    np.add.at(edge, begins[text] + start + length, -1)
    keep = np.cumsum(edge[:-1]) == 0
    bounds = np.concatenate([[0], np.cumsum(keep)])[np.append(begins, len(codes))]
    listed = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), dictionary.take(pa.array(codes[keep])))
    return pc.binary_join(listed, pa.scalar(" ", dictionary.type)).cast(pa.string())


def _with_runs(rows: DataFrame, schema: str, min_length: int, chunk_chars: int) -> DataFrame:
    """``rows`` (their last column the text) with n_words, runs and the collapsed text in place of the text."""
    import pyarrow as pa

    def found(batches):
        for batch in batches:
            for part in text_chunks(batch, batch.schema.names[-1], chunk_chars):
                codes, lengths, dictionary = words_of(part.column(part.num_columns - 1))
                runs = find_runs(codes, lengths, min_length)
                columns = [*part.columns[:-1], pa.array(lengths, pa.int64()), _listed(lengths, *runs), _collapsed(codes, lengths, dictionary, *runs)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "n_words", "runs", "collapsed"])

    return rows.mapInArrow(found, f"{schema}, n_words long, runs {RUNS}, collapsed string")


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and the collapsed text of ``docs`` (doc_id, text).

    The collapsed text has no word that a run holds after the run's first ``period`` words; its words are joined by one space.
    """
    if min_length < 2:
        raise ValueError("a run has at least two words")
    return _with_runs(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), "doc_id long", min_length, chunk_chars)


def without_runs(docs: DataFrame, min_length: int = MIN_LENGTH, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``docs`` with the collapsed text where a text has runs; other texts stay as they are, null ones null."""
    p = "_" * (max([0, *(len(c) for c in docs.columns)]) + 1)
    named = {c: f"{p}{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(named[c]) for c in docs.columns], F.col("text").cast("string").alias(p))
    kept = rows.drop(p)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    made = _with_runs(rows, schema, min_length, chunk_chars)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(named["text"]))
    return made.withColumn(named["text"], text).select(*[F.col(named[c]).alias(c) for c in docs.columns])
