"""Operator 6, SentencePiece encoding and decoding with a merge-type model, without the library's encoder.

A merge-type (BPE) encoding has one last token for each prefix of a word, and that token alone, with
the last token of the prefix before it, decides whether the prefix is encoded so. So per word:

1. an Aho-Corasick automaton over the pieces lists, for each end, the pieces that end there;
2. of these, the last token is the one whose left neighbour, the last token of the remaining
   prefix, is compatible with it: merging the two alone gives back the same two;
3. the ids are read backwards from the end through the table of last tokens.

No piece of the model holds a space mark after another character, so words (with the marks before
them) are encoded apart and each task keeps a bounded table of the words it has met. Spaces in runs
are merged by score, as they are the only pieces of equal score.

Edge cases: null and empty texts have only the begin and end ids and decode to the empty text.
Characters without a piece become their UTF-8 bytes' pieces. Rows repeat as in the input; extra
columns are ignored; an empty table gives an empty one. Texts and words of any length are taken whole: the table of last tokens of a word has an entry
for each of its characters.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame

MARK = "▁"
CACHE_WORDS = 600_000
_codecs: dict[str, "PieceCodec"] = {}


class PieceCodec:
    """Prefix tables over one model; ``model`` is the bytes of a merge-type model file."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != 2:
            raise ValueError("a merge-type model is needed")
        if proto.normalizer_spec.name != "identity" or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("a model without normalisation and with a dummy prefix is needed")
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.bos, self.eos = (next(i for i, p in enumerate(proto.pieces) if p.piece == n) for n in ("<s>", "</s>"))
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
            elif p.type == 1:
                self.ids[p.piece] = i
                self.score[p.piece] = p.score
            self.surface.append(p.piece.replace(MARK, " ").encode() if p.type == 1 else b"")
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes over the end of a word")
        # Without a piece of letters and other characters, the two never merge.
        self.letters_apart = all(len(self._PARTS.findall(p)) == 1 for p in self.ids)
        # Order of merging: single characters first, then by descending score.
        singles = [p for p in self.ids if len(p) == 1]
        merged = sorted((p for p in self.ids if len(p) > 1 and not p.startswith(MARK * 2)), key=lambda p: -self.score[p])
        self.pieces = singles + merged
        self.rank = {p: k for k, p in enumerate(self.pieces)}
        self.base = len(singles)
        self.split: list[tuple[int, int] | None] = [None] * self.base
        self.pair: dict[tuple[int, int], int] = {}
        alive = singles[:]
        for p in merged:
            last = self.last_merge(p)
            self.split.append(last)
            if last:
                alive.append(p)
        for p in merged:
            for cut in range(1, len(p)):
                a, b = self.rank.get(p[:cut]), self.rank.get(p[cut:])
                if a is not None and b is not None:
                    self.pair[a, b] = self.rank[p]
        self.id_of = [self.ids[p] for p in self.pieces]
        self.matcher = ahocorasick.Automaton()
        for p in alive:
            self.matcher.add_word(p, self.rank[p])
        self.matcher.make_automaton()
        self.width = [len(p) for p in self.pieces]
        self.compatible: dict[int, bool] = {}
        self.plain = re.compile(f"[{re.escape(''.join(singles))}]*")
        self.words: dict[str, tuple[bytes, bytes]] = {}

    def merged(self, text: str) -> list[str]:
        """The plain merge loop: the pair of highest score first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, b, parts[a] + parts[b]))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        self.trail = None
        while heap:
            _, a, b, whole = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or parts[a] + parts[b] != whole or after[a] != b:
                continue
            self.trail = parts[a], parts[b]
            parts[a], parts[b] = whole, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two pieces whose merge ends the encoding of ``piece``; None if it never comes about."""
        if self.merged(piece) != [piece]:
            return None
        a, b = self.trail
        return self.rank[a], self.rank[b]

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when encoded together: walk back both tokens' merges along
        the cut; no pair met there may merge before the merges that are walked back."""
        known = self.compatible.get(a << 32 | b)
        if known is None:
            left, right, limit = a, b, len(self.pieces)
            while True:
                whole = self.pair.get((left, right))
                if whole is not None and whole < limit:
                    known = False
                    break
                # A tie of the two is impossible for scored pieces; the later merge is undone first.
                if left > right and self.split[left]:
                    limit, left = left, self.split[left][1]
                elif self.split[right]:
                    limit, right = right + 1, self.split[right][0]
                elif self.split[left]:
                    limit, left = left, self.split[left][1]
                else:
                    known = True
                    break
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            self.compatible[a << 32 | b] = known
        return known

    def known_run(self, run: str) -> list[int]:
        """Ids of a run whose characters all have pieces, through the table of last tokens."""
        if run in self.rank and (whole := self.rank[run]) < len(self.split) and (whole < self.base or self.split[whole]):
            return [self.id_of[whole]]
        last, width = [-1] * (len(run) + 1), self.width  # per prefix: its last token
        compatible, fits = self.compatible, self.fits
        for end, token in self.matcher.iter(run):
            end += 1
            if last[end] >= 0:
                continue
            start = end - width[token]
            if start == 0:
                last[end] = token
            elif (left := last[start]) >= 0:
                fit = compatible.get(left << 32 | token)
                if fit or fit is None and fits(left, token):
                    last[end] = token
        out, at, id_of = [], len(run), self.id_of
        while at > 0:
            token = last[at]
            out.append(id_of[token])
            at -= width[token]
        out.reverse()
        return out

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word with the space marks before it."""
        if word.startswith(MARK * 2):
            return [i for part in self.merged(word) for i in ([self.ids[part]] if part in self.ids else self.as_bytes(part))]
        if self.plain.fullmatch(word):
            return self.known_run(word)
        out, run = [], []
        for c in word:
            if c in self.rank:
                run.append(c)
                continue
            if run:
                out += self.known_run("".join(run))
                run = []
            out += self.as_bytes(c)
        return out + (self.known_run("".join(run)) if run else [])

    def as_bytes(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, the one before the first word goes, byte pieces join."""
        out = bytearray()
        for i in ids:
            if i in self.byte_of:
                out.append(self.byte_of[i])
            elif i == self.unk:
                out += " ⁇ ".encode()
            elif i not in (self.bos, self.eos):
                out += self.surface[i]
        text = out.decode("utf-8", "replace")
        inner = [i for i in ids if i not in (self.bos, self.eos)]
        return text[1:] if inner and self.surface[inner[0]].startswith(b" ") else text

    def entry(self, word: str) -> tuple[bytes, bytes]:
        """Of one word: its ids as little-endian unsigned 32-bit integers, and the bytes they decode to."""
        found = self.words.get(word)
        if found is None:
            parts = self._PARTS.findall(word) if self.letters_apart else [word]
            if len(parts) > 1:  # what stands in many words, such as a word before a comma, is encoded once
                each = [self.words.get(p) or self.entry(p) for p in parts]
                return b"".join([e[0] for e in each]), b"".join([e[1] for e in each])
            ids = self.word_ids(word)
            text = b"".join([self.surface[i] or bytes([self.byte_of[i]]) for i in ids])
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            found = struct.pack(f"<{len(ids)}I", *ids), text
            if len(word) <= 64:
                self.words[word] = found
        return found

    #: Letters, or other characters, each with the space marks before them.
    _PARTS = re.compile(f"{MARK}*[^\\W\\d_²³¹¼½¾]+|{MARK}*(?:(?!{MARK})[\\W\\d_²³¹¼½¾])+|{MARK}+")
    _WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Packed ids with begin and end, and the decoded text, of a whole text."""
        begin, end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        if not text:
            return begin + end, b""
        marked = MARK + text.replace(" ", MARK)
        if MARK * 2 in marked or MARK in text:
            words = self._WORDS.findall(marked)
        else:
            words = [MARK + w for w in marked[1:].split(MARK)]
        known, entry = self.words.get, self.entry
        found = [known(w) or entry(w) for w in words]
        decoded = b"".join([f[1] for f in found])
        return begin + b"".join([f[0] for f in found]) + end, decoded[1:]


def codec(path: str) -> PieceCodec:
    """One codec for each Python worker and model."""
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = PieceCodec(f.read())
    return _codecs[path]


def public_model() -> str:
    import public_tokenizers as public

    return public.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model: Callable[[], str] = public_model, with_output: bool = False) -> DataFrame:
    """Per document the number of ids and the digests of ids and decoded text.

    ``with_output`` adds ``ids array<int>`` and ``decoded string`` themselves.
    """
    import pyarrow as pa

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_output else ""

    def encoded(batches):
        of = codec(model()).encode
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                rows = []
                for text in part.column(1):
                    ids, text = of(text.as_py() or "")
                    digests = hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()
                    more = (list(struct.unpack(f"<{len(ids) // 4}I", ids)), text.decode("utf-8", "replace")) if with_output else ()
                    rows.append((len(ids) // 4, *digests, *more))
                columns = list(zip(*rows))
                arrays = [part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2])]
                if with_output:
                    arrays += [pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4])]
                yield pa.RecordBatch.from_arrays(arrays, names + (["ids", "decoded"] if with_output else []))

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(encoded, schema)
