"""Operator 1, packing: documents to training sequences of a fixed length, balanced by attention cost.

Every task streams its documents into blocks of a bounded number of tokens and packs each block by
itself, so no row is shuffled and no task holds more than a block, however large the input is.

* Cost of a piece of n tokens: ``linear * n + quadratic * n * n``.
* Pieces go in descending order to the sequence of lowest cost so far that still has room. A block
  opens ``ceil(tokens / length)`` sequences. A piece that fits nowhere whole is cut: it takes the
  room of the emptiest sequences in turn, so that a block has less padding than one sequence.
* A document longer than a sequence first gives whole sequences of its own.

Edge cases: null text is the empty document, which is its end id alone; a null id stays null. An empty table gives no
rows. Repeated rows are packed as often as they occur. A very long text is encoded whole and gives its full sequences
a few thousand at a time. Of documents of equal length the one read first goes first, of sequences of equal cost the first
takes it. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

LENGTH = 2048
END_ID = 1
BLOCK_TOKENS = 2_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict[str, Callable] = {}


def encoder(path: str, ranks_path: str | None = None, pattern: str | None = None) -> Callable[[str], list[int]]:
    """Text to ids exactly as ``tokenizers`` gives them for the vocabulary file.

    Where the same vocabulary is also there as a rank file, texts of Latin-1 characters go through
    the faster byte-pair library; special-token strings and all other texts go to ``tokenizers``.
    """
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def whole(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    if ranks_path is None:
        _encoders[path] = whole
        return whole
    import base64

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def either(text: str) -> list[int]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return whole(text) if any(s in text for s in special) else fast(text)

    _encoders[path] = either
    return either


def byte_bpe_encoder() -> Callable[[str], list[int]]:
    import public_tokenizers as public

    return encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def assign(lengths: list[int], length: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Pack pieces of at most ``length`` tokens; per sequence a list of (piece, start in piece, tokens)."""
    total = sum(lengths)
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in range(-(-total // length))]
    room = [length] * len(sequences)
    # Pieces come in descending order, so a sequence that has room for one keeps it until it takes a
    # piece, and one without has it again from a certain length on: two heaps find the lowest cost exactly.
    fitting = [(0.0, s) for s in range(len(sequences))]  # lowest cost first; all have room for the piece
    full: list[tuple[int, float, int]] = []  # most room first; none has room for the piece
    waiting = []
    for piece in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        n = lengths[piece]
        while full and -full[0][0] >= n:
            _, cost, s = heapq.heappop(full)
            heapq.heappush(fitting, (cost, s))
        if not fitting:
            waiting.append(piece)
            continue
        cost, s = heapq.heappop(fitting)
        sequences[s].append((piece, 0, n))
        room[s] -= n
        cost += linear * n + quadratic * n * n
        if room[s] >= n:
            heapq.heappush(fitting, (cost, s))
        elif room[s]:
            heapq.heappush(full, (-room[s], cost, s))
    open_sequences = sorted((s for s in range(len(sequences)) if room[s]), key=lambda s: (-room[s], s))
    at = 0
    for piece in waiting:
        start = 0
        while start < lengths[piece]:
            s = open_sequences[at]
            n = min(room[s], lengths[piece] - start)
            sequences[s].append((piece, start, n))
            room[s] -= n
            start += n
            at += room[s] == 0
    return sequences


def pack(
    docs: DataFrame,
    make_encoder: Callable[[], Callable[[str], list[int]]] = byte_bpe_encoder,
    length: int = LENGTH,
    end_id: int = END_ID,
    linear: float = 1.0,
    quadratic: float = 1.0 / LENGTH,
    block_tokens: int = BLOCK_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text). ``with_ids`` adds the ids themselves as ``ids array<int>``."""
    import pyarrow as pa

    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def blocks(batches):
        from pyspark import TaskContext

        encode = make_encoder()
        next_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        held: list[tuple[object, int, int, np.ndarray]] = []
        tokens = 0

        def rows(pieces, places):
            """pieces: (doc_id, start, doc_tokens, ids); places: (sequence, offset, piece, start in piece, tokens)."""
            out = []
            for s, offset, p, start, n in places:
                doc, base, total, ids = pieces[p]
                part = ids[start : start + n]
                out.append((doc, base + start, n, zlib.crc32(part.tobytes()), total, s, offset, part))
            columns = list(zip(*out))
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                arrays.append(pa.array([c.astype(np.int32) for c in columns[7]], pa.list_(pa.int32())))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)]
            return pa.RecordBatch.from_arrays(arrays, names)

        def flush():
            nonlocal held, tokens, next_id
            places = []
            for s, members in enumerate(assign([len(p[3]) for p in held], length, linear, quadratic)):
                offset = 0
                for piece, start, n in members:
                    places.append((next_id + s, offset, piece, start, n))
                    offset += n
            next_id += -(-tokens // length)
            batch = rows(held, places)
            held, tokens = [], 0
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(encode(text.as_py() or "") + [end_id], dtype="<u4")
                whole = len(ids) // length * length
                full = [(doc, at, len(ids), ids[at : at + length]) for at in range(0, whole, length)]
                for low in range(0, len(full), 4096):
                    part = full[low : low + 4096]
                    yield rows(part, [(next_id + k, 0, k, 0, length) for k in range(len(part))])
                    next_id += len(part)
                if whole < len(ids):
                    held.append((doc, whole, len(ids), ids[whole:]))
                    tokens += len(ids) - whole
                if tokens >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(blocks, schema)
