"""Each operator against its brute-force version, and on edge cases."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import public_tokenizers
from pyspark.sql import functions as F

from splitframe.llm import components, html_text, jaccard, language, lm, packing, pieces, quality, slices, suffixes, topk, warc
from splitframe.llm.family import IndexFamily

from . import brute


@pytest.fixture(scope="module")
def rows():
    return brute.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.DOCS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], brute.DOCS)


# 1
@pytest.mark.parametrize("block_tokens", [3000, packing.BLOCK_TOKENS])
def test_packing_holds_each_id_once(docs, rows, block_tokens):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.pack(docs, block_tokens=block_tokens, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        assert r.length == len(r.ids) > 0 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text, *_ in rows:
        want = [*encode.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for p in parts for x in p.ids] == want
        assert all(p.doc_tokens == len(want) for p in parts) and parts[0].start == 0
    for members in by_sequence.values():
        at = 0
        for p in sorted(members, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.LENGTH


def test_packing_is_balanced_and_full():
    lengths = list(np.random.default_rng(1).integers(1, 2048, 4000))
    cuts = packing.assign([int(x) for x in lengths], 2048, 1.0, 1 / 2048)
    full = [sum(n for _, _, n in s) for s in cuts]
    assert sum(full) == sum(lengths) and max(full) <= 2048 and len(full) * 2048 - sum(full) < 2048
    costs = [sum(n + n * n / 2048 for _, _, n in s) for s in cuts]
    assert np.std(costs) < 0.2 * np.mean(costs)
    pieces_of = defaultdict(list)
    for s in cuts:
        for p, start, n in s:
            pieces_of[p].append((start, n))
    for p, n in enumerate(lengths):
        at = 0
        for start, m in sorted(pieces_of[p]):
            assert start == at
            at += m
        assert at == n


@pytest.mark.parametrize("kind", ["lognormal", "uniform"])
def test_packing_like_a_search_of_all_sequences(kind):
    """The same places as looking at every sequence for each piece; only what fits nowhere whole is cut."""
    random = np.random.default_rng(3)
    drawn = random.lognormal(5.2, 1.0, 3000) if kind == "lognormal" else random.integers(1, 2048, 1500)
    lengths = [int(x) for x in np.clip(drawn, 1, 2047)]
    room, costs, want, cut = [2048] * -(-sum(lengths) // 2048), [0.0] * -(-sum(lengths) // 2048), {}, set()
    for p in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        n = lengths[p]
        s = min((s for s in range(len(room)) if room[s] >= n), key=lambda s: (costs[s], s), default=None)
        if s is None:
            cut.add(p)
            continue
        want[p], room[s], costs[s] = s, room[s] - n, costs[s] + (n + n * n / 2048)
    found = packing.assign(lengths, 2048, 1.0, 1 / 2048)
    assert {p: s for s, members in enumerate(found) for p, _, n in members if p not in cut} == want
    assert all(n == lengths[p] for members in found for p, _, n in members if p not in cut)


# 2
@pytest.mark.parametrize("block", [200, jaccard.BLOCK_GRAMS])
def test_near_duplicates(docs, rows, block):
    found = {tuple(r) for r in jaccard.near_duplicates(docs, block_grams=block).collect()}
    assert found == brute.near_duplicates([r[:2] for r in rows])


def test_near_duplicates_of_large_groups(spark):
    """A group of chained near copies, a hot passage, and exact copies under one shared hub."""
    base = [f"h{k}" for k in range(40)]
    rows = [(i, " ".join(base[:i % 40] + [f"c{i}"] + base[i % 40 :])) for i in range(80)]
    rows += [(100 + i, " ".join([*(f"u{i}x{k}" for k in range(6)), *base])) for i in range(60)]
    rows += [(200 + i, "same text of a few common words") for i in range(50)]
    found = {tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert found == brute.near_duplicates(rows)


def test_near_duplicates_without_ids_and_repeated_rows(spark):
    t = "a b c d e f g"
    rows = [(5, t), (5, t), (None, t), (2, t + " h")]
    found = sorted(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert sorted(map(tuple, found), key=str) == sorted([(5, 3, 2), (5, 3, 2), (None, 3, None), (2, 4, 2)], key=str)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(200)] + [(500, 501)], "a long, b long")
    assert {tuple(r) for r in components.components(edges).collect()} == {(k, 0) for k in range(201)} | {(500, 500), (501, 500)}


# 3
def test_warc_round_trip(spark):
    html = '<html><head><title>T</title></head><body><a href="/x?a=1&amp;b=2">L</a><p>One &amp; two<script>no</script></p></body></html>'
    pages = spark.createDataFrame([(1, "http://a/", html, 1), (2, None, None, 1), (3, "http://b/\r\nX: y", "", 1), (1, "http://a/", html, 1)], "page_id long, url string, html string, block int")
    source = warc.responses(pages)
    responses = {r.page_id: r for r in source.collect()}
    made = warc.derive(source)
    assert made.count() == 8
    read = [x for r in warc.write(made, 3).collect() for x in warc.read_records(bytes(r.body))]
    assert len(read) == 8
    ids = {r.record_id: r for r in responses.values()}
    for fields, block in read:
        of = ids[fields["WARC-Refers-To"]]
        assert len(block) == int(fields["Content-Length"]) and fields["WARC-Block-Digest"] == warc.digest(block)
        assert "\n" not in fields.get("WARC-Target-URI", "")
        if fields["WARC-Type"] == "metadata":
            assert f"sourcePayloadDigest: {of.payload_digest}".encode() in block and b"httpStatus: HTTP/1.1 200 OK" in block
    texts = {(f["WARC-Type"], b) for f, b in read if f.get("WARC-Target-URI") == "http://a/"}
    assert ("conversion", "T\nL\nOne & two".encode()) in texts
    assert any(b"outlink: /x?a=1&b=2 a" in b for _, b in texts)


def test_warc_of_real_response_files(spark):
    """Records of a plain and a gzip-membered file keep their own ids, dates, digests and header fields."""
    import gzip

    def record(kind, name, date, block, extra=""):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{name}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: http://h/{name}\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    one = b"HTTP/1.1 404 Gone\r\nX-Own: yes\r\n\r\n<p>first</p>"
    two = b"HTTP/1.1 200 OK\r\n\r\n<p>" + b"second " * 400_000 + b"</p>"
    parts = [record("warcinfo", "info", "2020-01-01T00:00:00Z", b"software: x"), record("response", "one", "2021-05-06T07:08:09Z", one, "WARC-Payload-Digest: sha1:OWN\r\n"), record("response", "two", "2022-01-01T00:00:00Z", two)]
    bodies = [("a.warc", b"".join(parts)), ("b.warc.gz", b"".join(map(gzip.compress, parts))), ("cut.warc", b"".join(parts)[:-500]), ("none.warc", b"")]
    found = warc.read_responses(spark.createDataFrame(bodies, "name string, body binary"))
    rows = found.collect()
    assert sorted((r.record_id, r.warc_date) for r in rows) == sorted([("<urn:one>", "2021-05-06T07:08:09Z")] * 3 + [("<urn:two>", "2022-01-01T00:00:00Z")] * 2)
    assert {r.payload_digest for r in rows if r.record_id == "<urn:one>"} == {"sha1:OWN"}
    made = [(r.warc_type, r.refers_to, r.warc_date, bytes(r.block)) for r in warc.derive(found).collect()]
    metadata = next(b for t, of, _, b in made if t == "metadata" and of == "<urn:one>")
    assert b"httpStatus: HTTP/1.1 404 Gone" in metadata and b"httpHeader: X-Own: yes" in metadata and b"sourcePayloadDigest: sha1:OWN" in metadata
    assert {d for _, of, d, _ in made if of == "<urn:two>"} == {"2022-01-01T00:00:00Z"}
    again = warc.read_responses(warc.write(warc.with_header(found), 2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_warc_files_of_many_members_in_linear_time():
    import gzip
    import time

    block = b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * 6
    one = gzip.compress(f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")

    def took(n):
        began = time.process_time()
        assert sum(b == block for _, b in warc.read_records(one * n)) == n
        return time.process_time() - began

    took(100)
    assert took(16_000) < 6 * took(4_000) + 0.2


def test_warc_records_like_a_plain_version(spark):
    """Text by a parser of the standard library, digests and ids by their definitions, links in order."""
    import base64
    import hashlib
    import uuid
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self, page):
            super().__init__()
            self.lines, self.links, self.quiet = [""], [], 0
            self.feed(page)

        def handle_starttag(self, tag, attrs):
            for name, value in attrs:
                if (tag, name) in (("a", "href"), ("img", "src"), ("link", "href"), ("iframe", "src")):
                    self.links.append(f"outlink: {value.strip()} {tag}")
            self.quiet += tag in ("script", "style")
            self.lines += [""] * (tag not in ("a", "b", "i", "img", "span", "em"))

        def handle_endtag(self, tag):
            self.quiet -= tag in ("script", "style")
            self.lines += [""] * (tag not in ("a", "b", "i", "span", "em"))

        def handle_data(self, data):
            parts = data.split("\n") if not self.quiet else []
            for k, part in enumerate(parts):
                self.lines += [""] * (k > 0)
                self.lines[-1] += part

    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    pages = [(1, "http://a/", "<html><body><h1>T &amp; U</h1><p>one <b>two</b>\nthree<br>four</p><ul><li><a href=' /x?a=1&amp;b=2 '>l</a></li></ul><script>no()</script><img src=i.png></body></html>"), (2, "http://b/", "<div>é &lt;b&gt; ü</div>"), (3, None, "")]
    made = {(r.page_id, r.warc_type): r for r in warc.derive(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()}
    for i, url, page in pages:
        body, parsed = page.encode(), Plain(page)
        http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(body)]
        response = b"\r\n".join([*http, b"", body])
        text = "\n".join(x for x in (" ".join(line.split()) for line in parsed.lines) if x).encode()
        name = f"<urn:uuid:{uuid.uuid5(uuid.UUID('6ba7b811-9dad-11d1-80b4-00c04fd430c8'), f'response {i} {url} {sha(body)}')}>"
        lines = [f"sourcePayloadDigest: {sha(body)}", f"sourceBlockDigest: {sha(response)}", "httpStatus: " + http[0].decode(), *("httpHeader: " + h.decode() for h in http[1:]), *parsed.links]
        for kind, block in (("conversion", text), ("metadata", "".join(f"{x}\r\n" for x in lines).encode())):
            r = made[i, kind]
            assert (bytes(r.block), r.block_digest, r.content_length, r.refers_to, r.source_payload_digest, r.target_uri) == (block, sha(block), len(block), name, sha(body), url)
            fields = dict(line.split(": ", 1) for line in r.header.strip().split("\r\n")[1:])
            assert fields["WARC-Refers-To"] == name and fields["WARC-Type"] == kind and fields["WARC-Block-Digest"] == sha(block) and fields.get("WARC-Target-URI") == url
            assert r.record_id == f"<urn:uuid:{uuid.uuid5(uuid.UUID('6ba7b811-9dad-11d1-80b4-00c04fd430c8'), f'{kind} {name}')}>"


# 4
def _best(rows, k=20):
    ok = {i: [math.floor(64 * x) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in ok:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(ok[q], ok[i])), i) for i in ok if i != q and len(ok[i]) == len(ok[q]))[:k]
            want |= {(q, r): (i, -s) for r, (s, i) in enumerate(best, 1)}
    return want


def test_top_k_against_all_pairs(spark):
    """Ragged lengths, ties, odd vectors, many blocks."""
    r = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in r.normal(size=(300, 7))]
    vectors[40] = vectors[60] = vectors[20]
    vectors[1], vectors[2], vectors[3], vectors[4], vectors[5] = None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 7, [float("inf")] * 7
    vectors[7] = [1.0, 2.0]
    for i in range(200, 300):
        vectors[i] = vectors[i][: 1 + i % 4]
    rows = [(i, v) for i, v in enumerate(vectors)]
    table = spark.createDataFrame([*rows, (None, [1.0] * 7)], "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("row", F.lit(1)).repartition(4)
    found = topk.top_k(table, vectors_in_block=37, queries_in_block=4)
    assert {(x.query_id, x.rank): (x.vec_id, x.score) for x in found.collect()} == _best(rows)


def test_top_k_of_one_very_common_vector(spark):
    rows = [(i, [1.0, 0.5, -0.25] if i % 3 else [i / 500, 1.0, 0.125]) for i in range(500)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), vectors_in_block=50, queries_in_block=7)
    assert {(x.query_id, x.rank): (x.vec_id, x.score) for x in found.collect()} == _best(rows)


def test_top_k_of_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], kind)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], kind)).collect() == [(0, 1, 1, 64 * 128)]
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1.0])], kind), scale=100)


def test_top_k_of_very_large_components(spark):
    """Scores beyond 64 bits are exact whole numbers, ranked among all others."""
    r = np.random.default_rng(9)
    rows = [(i, [float(x) for x in r.normal(size=3) * 10.0 ** r.integers(0, 4)]) for i in range(120)]
    rows += [(200 + i, [float(x) for x in r.normal(size=3) * 10.0 ** e]) for i, e in enumerate((9, 12, 16, 40, 153, 160, 250, 300, 307, 308))]
    rows += [(220, [1e300, 1.0, 0.0]), (221, [-1e300, 1.0, 0.0]), (240, [1.7e308, -1.7e308, 1.7e308])]
    whole = {i: [math.floor(x * 64) if abs(x) < 1e200 else int(x) * 64 for x in v] for i, v in rows}
    want = {}
    for q in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:20]
            want |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), vectors_in_block=40, queries_in_block=3, with_text=True).collect()
    assert {(x.query_id, x.rank): (x.vec_id, int(x.score_text)) for x in found} == want
    assert all((x.score is None) == (not -(2**63) <= int(x.score_text) < 2**63) and x.score in (None, int(x.score_text)) for x in found)


def test_one_outlier_leaves_bounds_as_they_are(spark, monkeypatch):
    """The vectors whose bound reaches the kth score are hardly more with a few very large vectors than without."""
    r = np.random.default_rng(10)
    counts, keep = [], topk.saved

    def counted(df, name, **more):
        made = keep(df, name, **more)
        if name == "topk-survivors":
            counts.append(made.count())
        return made

    monkeypatch.setattr(topk, "saved", counted)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(4000, 8)))]
    for extra in ([], [(4001, [1e6] + [0.0] * 7)], [(4001 + 2 * j, [float(x) for x in r.normal(size=8) * 1e5]) for j in range(12)]):
        found = topk.top_k(spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>"))
        assert found.where("rank = 1").count() == 200 + sum(i % 20 == 0 for i, _ in extra)
    assert counts[1] < 2 * counts[0] and counts[2] < 2 * counts[0] < 200 * 4000 / 5


# 5
@pytest.mark.parametrize(("block", "options"), [(3000, {"batch_starts": 50, "hot_runs": 3}), (suffixes.BLOCK_BYTES, {}), (400, {"batch_starts": 7, "hot_runs": 0})])
def test_repeats(docs, rows, monkeypatch, block, options):
    """Small blocks cut long texts, small batches make many levels, few runs already count as hot."""
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
    want = brute.repeats([r[:2] for r in rows])
    assert {tuple(r) for r in suffixes.repeat_report(docs, **options).collect()} == {w[:5] for w in want.values()}
    got = {r.doc_id: r for r in suffixes.without_repeats(docs, **options).collect()}
    assert {i: r.text for i, r in got.items()} == {r[0]: None if r[1] is None else want[r[0]][5] for r in rows}
    assert all(r.block == "b" and r._score == 1 for r in got.values())


@pytest.mark.parametrize("options", [{}, {"batch_starts": 100, "hot_runs": 5}])
def test_repeats_inside_one_text_and_over_levels(spark, options):
    rows = [(1, "ab" * 400), (2, "x" * 99), (3, "x" * 99), (4, "x" * 100), (5, "x" * 101), (6, None), (7, "ab" * 60 + "tail"), (8, "é" * 300), (9, "z" * 50 + "\0" * 60), (10, "z" * 50 + "\0" * 61)]
    rows += [(k, f"{k} " * 30 + "shared passage of many bytes, " * 5 + f" {k}") for k in range(20, 60)]
    want = brute.repeats(rows)
    assert {tuple(r) for r in suffixes.repeat_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), **options).collect()} == {w[:5] for w in want.values()}


def test_repeats_of_repeated_rows_and_null_ids(spark):
    t = "words that stand in more than one row " * 4
    rows = [(7, t), (7, t), (None, "head " + t), (7, "other " + t), (9, t + "tail")]
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in suffixes.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = suffixes.repeat_report(spark.createDataFrame([rows[2]], "doc_id long, text string")).first()
    assert got[None, len(rows[2][1])] == (first.n_removed, first.n_spans)
    assert got[7, len(t)] == (len(t), 1) and got[9, len(t) + 4] == (len(t), 1)


def test_long_text_in_bounded_pieces(spark):
    """A text of 20 MB is indexed in blocks; its end repeats its start."""
    text = "".join(f"{k * 2654435761 % 2**32:08x}" for k in range(2_500_000))
    found = suffixes.repeat_report(spark.createDataFrame([(1, text + text[:500]), (2, text[-300:])], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_removed, r.n_spans) for r in found] == [(500, 1), (300, 1)]


def test_suffix_arrays_merge_geometrically():
    text = np.frombuffer(b"".join(f"{k:05d}".encode() for k in range(5000)), np.uint8)
    family = suffixes.Family()
    for k in range(100):
        array, first = suffixes.SuffixArray.of(text[k * 250 : k * 250 + 250], np.arange(0, 250, 5), 5)
        assert first.all() and not family.known(array).any()
        family.add(array)
    assert len(family.levels) <= 8 and sum(map(len, family.levels)) == 5000
    assert all(len(a) >= 2 * len(b) for a, b in zip(family.levels, family.levels[1:]))
    for level in family.levels:
        suffixes_in_order = [level.text[p : p + 5].tobytes() for p in level.order]
        assert suffixes_in_order == sorted(suffixes_in_order)
    held = {text[k : k + 5].tobytes() for k in range(0, 25_000, 5)}
    assert family.moved <= sum(map(len, family.levels)) * (1 + math.log2(100))  # each string passes once through each size of level
    asked, _ = suffixes.SuffixArray.of(text[:300], np.arange(0, 296), 5)
    assert family.known(asked).tolist() == [text[p : p + 5].tobytes() in held for p in asked.order]


def test_index_family_adds_batches(docs, rows):
    """Batch after batch gives what all at once does, as ids rise from batch to batch."""
    want = brute.repeats([r[:2] for r in rows])
    family, got = IndexFamily(docs.sparkSession, bits=6), {}
    for low, high in ((0, 200), (200, 400), (400, 10**6)):
        got |= {r.doc_id: r.text for r in family.add(docs.where(f"doc_id >= {low} and doc_id < {high}")).collect()}
    assert got == {r[0]: None if r[1] is None else want[r[0]][5] for r in rows}
    assert len(family.levels) <= 2


# 6
def test_pieces_like_the_library(docs, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.encode_documents(docs, with_output=True).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        want = library.encode(text, add_bos=True, add_eos=True)
        assert r.ids == want and r.decoded == library.decode(want)
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_pieces_of_random_characters():
    import random

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own, r = sentencepiece.SentencePieceProcessor(model_file=path), pieces.codec(path), random.Random(4)
    pool = ["a", "e", "th", "ing", " ", "  ", "▁", "\n", "ß", "é", "日", "🙂", "1", "00", ".", "...", "²", "_", "-", "\t", "　", "<s>", "tion", "aaaa"]
    for _ in range(3000):
        text = "".join(r.choice(pool) for _ in range(r.randrange(0, 30)))
        ids, decoded = own.encode(text)
        want = library.encode(text, add_bos=True, add_eos=True)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, text
        assert decoded.decode("utf-8", "replace") == library.decode(want), text
        assert own.decode(want) == library.decode(want), text


# 7
def test_quality_measures(docs, rows):
    for r in quality.quality_report(docs).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        w = brute.WORD.findall(text)
        lines = [x for x in text.split("\n") if brute.WORD.search(x)]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        times = Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(8)}
        assert r.n_stop_words == sum(x.lower() in quality.STOP_WORDS for x in w)
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.kept and r.base_failed)


def test_repeated_words_of_long_texts(spark):
    """More than 2,000 words, with repeats far apart, in a row and overlapping."""
    import random

    r = random.Random(8)
    words = [f"w{r.randrange(400)}" for _ in range(3000)]
    words[2500:2512] = words[100:112]
    words[1000:1030] = ["same"] * 30
    w = words + words[50:59]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(8)}
    found = quality.quality_report(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    assert found.n_words == len(w) and found.n_repeat_words == len(covered) > 40


def test_quality_keeps_columns(docs):
    kept = quality.apply_rules(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.quality_report(docs).collect() if r.kept}


# 8
PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href='/a'>menu item</a></li></ul></nav>"
    "<div class=\"ad\">buy this now</div><article><h1>Head &amp; line</h1><p>First <b>bold</b> word{0}.<p>Second\n  line<br>after</p>"
    "<script>var a = '</p>';</script></article><div class='comments'><p>a reader says so</p></div><footer>&copy; foot</footer></body></html>"
)


def test_article(spark):
    rows = [(k, f"http://h/{k}", PAGE.format(" more" * k)) for k in range(30)] + [(99, None, None), (98, "u", ""), (97, "u", "plain words only"), (96, "u", "<p>cut in a <b")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(30):
        assert got[k].text == f"Head & line\nFirst bold word{' more' * k}.\nSecond line after"
        assert got[k].n_chars == len(got[k].text)
    assert (got[99].text, got[98].text, got[97].text, got[96].text) == ("", "", "plain words only", "cut in a")


def test_region_against_all_runs():
    """The linear scan against the sums of all contiguous runs; of equal sums, the first and shortest."""
    import random

    r = random.Random(5)
    for _ in range(300):
        values = [r.choice([-3, -1, -1, 0, 1, 2, 4]) for _ in range(r.randrange(0, 14))]
        low, high = html_text.best_region(values)
        sums = {(a, b): sum(values[a:b]) for a in range(len(values)) for b in range(a + 1, len(values) + 1)}
        best = max(sums.values(), default=0)
        assert sum(values[low:high]) == max(best, 0)
        assert high == (min(b for (_, b), x in sums.items() if x == best) if best > 0 else 0)


def _fitted(spark):
    pages = [(k, "u", PAGE.format(" more" * k)) for k in range(40)]
    return html_text.fit(spark.createDataFrame(pages, "page_id long, url string, html string"))


@pytest.mark.parametrize("learned", [True, False])
def test_regions_of_many_templates(spark, learned):
    weights = _fitted(spark) if learned else {}
    say = lambda n, w="word": " ".join([w] * n)
    cases = {
        # an aside longer than what stands before it
        f"<body><nav>{say(30, 'menu')}</nav><article><p>{say(15)}</p><aside>{say(120, 'side')}</aside><p>{say(90)}</p></article><footer>{say(9, 'foot')}</footer></body>": f"{say(15)}\n{say(90)}",
        # no article mark at all
        f"<html><body><div id=menu>{say(20, 'menu')}</div><div class=content><h1>Head</h1><p>{say(40)}</p><div class='share'>{say(60, 'share')}</div><p>{say(30)}</p></div><div class=sidebar>{say(25, 'side')}</div></body></html>": f"Head\n{say(40)}\n{say(30)}",
        # the headline in the article's own header, comments and a form inside it
        f"<main><header><h1>Title</h1></header><p>{say(20)}</p><form>{say(30, 'form')}</form><p>{say(20)}</p><section class='comments'>{say(200, 'reader')}</section></main>": f"Title\n{say(20)}\n{say(20)}",
        # a head without end tag
        f"<html><head><title>no</title><meta charset=x><body><p>{say(12)}</p><div class='cookie-notice'>{say(3, 'cookie')}</div></body>": say(12),
        # character references, line breaks, inline elements, white space
        "<article><p>a&nbsp;&amp; <b>b</b>c\n\t d<br>e&#x21;</p></article>": "a & bc d e!",
        "<script>var x = '<p>no</p>'</script><style>p{}</style><!-- <p>no</p> -->": "",
        "": "",
    }
    for page, want in cases.items():
        assert html_text.article(page, weights) == want, page[:200]


def test_time_is_linear_in_nesting():
    import time

    def took(n):
        page = "<div class='a b'>word " * n + "</i>" * n
        began = time.process_time()
        assert html_text.article(page, {"div": 0.1}).count("word") == n
        html_text.label_counts(page)
        return time.process_time() - began

    took(500)
    assert took(8000) < 12 * took(1600) + 0.5


def test_pages_without_ids_and_repeated_rows(spark):
    rows = [(None, "u", "<p>one text here</p>", "x"), (1, None, "<p>two</p>", "x"), (1, None, "<p>two</p>", "x")]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(str, ((r.page_id, r.text, r.n_chars) for r in found))) == sorted(map(str, [(None, "one text here", 13), (1, "two", 3), (1, "two", 3)]))


# 9
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit_text_model(docs.where("doc_id % 2 = 0").selectExpr("doc_id as id", "text", "lang"))
    hidden = docs.where("doc_id % 2 = 1").selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars", "lang as truth").where("length(text) > 200")
    found = language.identify(hidden, model, hidden["text"], hidden["lang"], hidden["source"]).select("truth", "_language.language").collect()
    assert sum(r.truth == r.language for r in found) >= 0.97 * len(found) > 100


def test_language_edges(spark):
    train = [(k, t, c) for k in range(30) for t, c in (("the house and the garden of the man", "en"), ("das haus und der garten ist nicht", "de"))]
    model = language.fit_text_model(spark.createDataFrame(train, "id long, text string, lang string"))
    rows = [(1, "the garden and the man", None, None, 1), (2, None, "en", "h.de", 1), (3, "", "xx", "", 1), (4, "12 34 !!", "de", "h.de", 1), (5, "und der garten", "de", "x", 1), (5, "und der garten", "de", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _score int")
    kept = language.accepted_documents(docs, model)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 5] and kept.columns == docs.columns
    empty = language.fit_text_model(spark.createDataFrame([], "id long, text string, lang string"))
    assert language.accepted_documents(docs, empty).count() == 0


def test_language_rejects_foreign_and_junk_texts(spark):
    """Texts in no fitted language go, whatever they declare; all clean documents stay."""
    import base64

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit_text_model(docs.where("doc_id % 2 = 0").selectExpr("doc_id as id", "text", "lang"))
    random = np.random.default_rng(4)
    other = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
        base64.b64encode(random.bytes(300)).decode(),
        " ".join("".join(random.choice(list("bcdfghjklmnpqrstvwxz"), 7)) for _ in range(30)),
    ]
    rows = [(-1 - k, t, lang, "src1", len(t)) for k, t in enumerate(other) for lang in ("en", "es", None)]
    clean = docs.where("doc_id % 2 = 1").where("text rlike '[A-Za-z]{3}'")
    both = clean.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = [r.doc_id for r in language.accepted_documents(both, model).select("doc_id").collect()]
    assert sorted(kept) == sorted(r.doc_id for r in clean.select("doc_id").collect())
    pages = spark.createDataFrame([(k, f"http://a.example/{k}", f"<html lang='de'><p>{t}</p></html>") for k, t in enumerate(other)], "page_id long, url string, html string")
    assert [(r.language, r.accepted) for r in language.identify_pages(pages, model).collect()] == [("und", False)] * len(other)


def test_host_prior_decides_short_texts(spark):
    train = [(k, t, c) for k in range(30) for t, c in (("the house and the garden of the man", "en"), ("das haus und der garten ist nicht", "de"))]
    model = language.fit_text_model(spark.createDataFrame(train, "id long, text string, lang string"))
    rows = [(k, f"http://{'a.example' if k % 2 else 'b.example'}/{k}", f"<p>{'the garden and the house' if k % 2 else 'der garten und das haus'}</p>") for k in range(200)]
    rows += [(1000, "http://a.example/x", "<p>garnen</p>"), (1001, "http://b.example/x", "<p>garnen</p>")]
    got = {r.page_id: r.language for r in language.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert (got[1000], got[1001]) == ("en", "de")


def test_fusion_against_a_plain_version(spark):
    """Posteriors from plain dictionaries: trigrams, declarations, suffixes and hosts smoothed from all rows."""
    languages = ["de", "en"]
    texts = [("das haus und der garten", "de"), ("the house and the garden", "en"), ("der mann ist im haus", "de"), ("the man is in it", "en")]
    model = language.fit_text_model(spark.createDataFrame([(k, *texts[k % 4]) for k in range(40)], "id long, text string, lang string"))
    assert model.languages == languages
    rows = [(1, "http://a.b.de/x", "<html lang=de>das garten</html>"), (2, "http://a.b.de/y", "the garden"), (3, "http://c.com/", "<p>haus"), (4, "http://c.com/", "<p>haus"), (None, None, "garten"), (5, "http://a.b.de/", None), (6, "http://q.en/", "<html lang='en'>man im")]
    evidence = {}
    for k, (_, url, page) in enumerate(rows):
        text, declared, host = {0: "das garten", 6: "man im"}.get(k, (page or "").replace("<p>", " ")), {0: "de", 6: "en"}.get(k, ""), (url or "").split("/")[2] if url else ""
        score = model.score([{0: " das garten ", 6: " man im"}.get(k, text)])[0]
        n = score[-1]
        weight = language.TEMPER / n if n > language.TEMPER else 1.0
        told = lambda code, x, right: 0.0 if code not in languages else math.log(right if code == x else (1 - right) / (len(languages) - 1))
        own = [score[j] * weight + told(declared, x, language.DECLARED_RIGHT) + told(host.split(".")[-1], x, language.SUFFIX_RIGHT) for j, x in enumerate([*languages, None])]
        own[2] += math.log(language.OTHER_SHARE / (1 - language.OTHER_SHARE))
        evidence[k] = (host, n, own)
    soft = {}
    for host, _, own in evidence.values():
        whole = sum(map(math.exp, own[:2])) + math.exp(own[2]) * 2
        for level in (("all",), ("suffix", host.split(".")[-1]), ("domain", ".".join(host.split(".")[-2:])), ("host", host)):
            soft.setdefault(level, [0.0, 0.0])
            for j in (0, 1):
                soft[level][j] += math.exp(own[j]) / whole
    want = []
    for k, (host, n, own) in evidence.items():
        top = soft["all",]
        prior = [(x + 1) / (sum(top) + 2) for x in top]
        for level in (("suffix", host.split(".")[-1]), ("domain", ".".join(host.split(".")[-2:])), ("host", host)):
            prior = [(soft[level][j] + language.SMOOTHING * prior[j]) / (sum(soft[level]) + language.SMOOTHING) for j in (0, 1)]
        whole = [math.exp(own[j]) * prior[j] for j in (0, 1)] + [math.exp(own[2])]
        best = max((0, 1), key=lambda j: whole[j])
        posterior = whole[best] / sum(whole) if n else 0.0
        want.append((rows[k][0], languages[best] if n and whole[best] >= whole[2] else "und", round(posterior, 5), posterior >= language.LEAST_POSTERIOR))
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_language", F.lit(1)).withColumn("text", F.lit("zz"))
    got = [(r.page_id, r.language, round(r.posterior, 5), r.accepted) for r in language.identify_pages(table, model).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


# 10
@pytest.mark.parametrize(("block_tokens", "order"), [(500, 3), (lm.BLOCK_TOKENS, 3), (700, 2), (500, 4)])
def test_katz(docs, rows, block_tokens, order):
    want, totals = brute.katz([r[:2] for r in rows], order)
    assert all(abs(x - 1) < 1e-9 for x in totals.values())
    got = {r.doc_id: tuple(r)[1:] for r in lm.score(docs, order=order, block_tokens=block_tokens).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4]
        assert got[i][4:] == pytest.approx(want[i][4:], rel=1e-9)


def test_kept_model_scores_like_the_corpus(docs, rows, tmp_path):
    lm.fit(docs, f"{tmp_path}/model", block_tokens=700)
    got = {r.doc_id: tuple(r)[1:] for r in lm.evaluate(docs.sparkSession, f"{tmp_path}/model", docs, block_tokens=900).collect()}
    want, _ = brute.katz([r[:2] for r in rows])
    for i in want:
        assert got[i][:4] == want[i][:4] and got[i][4:] == pytest.approx(want[i][4:], rel=1e-9)


@pytest.mark.parametrize("x", [[], [0.25], [1.0, -2.5, 1e-300], [0.1, 0.2] * 9, list(np.linspace(-3, 3, 300)), [0.0] * 70_000 + [math.pi]])
def test_packed_sums_come_back_bit_for_bit(x):
    x = np.array(x, np.float64)
    assert lm._undoubled(lm._doubles(x)).tobytes() == x.tobytes()


def test_weights_are_kept_for_every_context_asked_for(docs, monkeypatch):
    held = {}
    monkeypatch.setattr(lm, "_finished", lambda scored, asks, weights, totals: held.update(asks=asks.collect(), weights=weights.collect()))
    lm.score(docs, block_tokens=500)
    known = {(r["order"], r["range"]): set(lm.unpack_sorted(r["keys"]).tolist()) for r in held["weights"]}
    assert held["asks"]
    for r in held["asks"]:
        assert set(lm.unpack_sorted(r["keys"]).tolist()) <= known[r["order"], r["range"]]


def test_packed_integers_of_any_size():
    for most in (0, 1, 255, 256, 2**32 - 1, 2**32, 2**45, 2**62):
        x = np.array([0, 1, most, most // 3])
        assert slices.unpack(slices.pack(x)).tolist() == x.tolist()


# all
@pytest.mark.parametrize("operator", [packing.pack, jaccard.near_duplicates, suffixes.repeat_report, suffixes.without_repeats, pieces.encode_documents, quality.quality_report, quality.apply_rules, lm.score])
def test_empty_tables(nothing, operator):
    assert operator(nothing).count() == 0


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = language.TextModel(["de", "en"], np.zeros((2, language.BUCKETS), np.float32))
    for made in (html_text.extract(pages), warc.derive(warc.responses(pages)), language.identify_pages(pages, model)):
        assert made.count() == 0


@pytest.mark.parametrize("operator", [packing.pack, jaccard.near_duplicates, suffixes.repeat_report, pieces.encode_documents, quality.quality_report, lm.score])
def test_null_ids_and_repeated_rows_stay(spark, operator):
    rows = [(None, "a b c " * 20), (1, None), (1, None), (2, "a b c " * 20), (2, "a b c " * 20), (2, "other text")]
    found = operator(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "1", "2", "2", "2", "None"]


def _chains(n: int, size: int, step: int) -> list[tuple[int, str]]:
    """Texts that share most words with the next ones only, around one passage that all share."""
    import random

    r = random.Random(9)
    words = [f"w{r.randrange(10**9)}" for _ in range(size + n * step)]
    passage = " ".join(f"p{k}" for k in range(size // 2))
    return [(k, passage + " " + " ".join(words[k * step : k * step + size])) for k in range(n)]


@pytest.mark.parametrize("meet", [0.01, jaccard.MEET])
def test_near_duplicates_in_many_turns(spark, monkeypatch, meet):
    """Chains, narrow misses and groups without a middle; small bounds force turns, and both ways agree with brute force."""
    import random

    r = random.Random(3)
    base = [f"b{k}" for k in range(120)]
    rows = _chains(40, 60, 3)
    for k in range(100, 160):  # near copies of one text that is not there itself
        rows.append((k, " ".join(f"x{r.randrange(10**6)}" if r.random() < 0.025 else w for w in base)))
    real = jaccard._linked_sets
    monkeypatch.setattr(jaccard, "_linked_sets", lambda sets, percent, fragments: real(sets, percent, fragments, meet))
    found = {tuple(x) for x in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert found == brute.near_duplicates(rows)


def test_near_duplicates_of_thousands_of_equal_and_empty_texts(spark):
    rows = [(k, "") for k in range(10_000)] + [(k, "one text that ten thousand documents hold word for word") for k in range(10_000, 20_000)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_grams=200).collect()
    assert {(x.n_shingles, x.component_id if x.doc_id >= 10_000 else x.doc_id - x.component_id) for x in found} == {(0, 0), (6, 10_000)} and len(found) == 20_000


def test_a_large_group_of_near_copies_meets_its_hubs_first(spark, monkeypatch):
    # Many small groups leave room for all pairs of the large one; these would grow with the square of its size.
    long = " ".join(f"w{k}" for k in range(60))
    small = [(1000 + 2 * j + k, " ".join(f"s{j}x{i}" for i in range(60)) + f" end{k}") for j in range(60) for k in range(2)]
    real, tested = jaccard.linked, []
    monkeypatch.setattr(jaccard, "linked", lambda pairs, *a: tested.append(pairs.count()) or real(pairs, *a))
    for n in (50, 100):
        tested.append(0)
        rows = [(k, f"{long} end {k}") for k in range(n)] + small
        found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found == {i: 0 if i < 1000 else i - i % 2 for i, _ in rows}
    at = tested.index(0, 1)
    assert sum(tested[:at]) < 20 * 50 and sum(tested[at:]) < 20 * 100 and sum(tested[at:]) < 3 * sum(tested[:at])


def test_strings_that_a_level_holds_are_not_sought_in_the_next(monkeypatch):
    text = np.frombuffer(bytes(range(97, 107)) * 2 + b"zyxwvutsrq", np.uint8)
    family, sought = suffixes.Family(), []
    family.levels = [suffixes.SuffixArray.of(text, np.arange(a, b), 4)[0] for a, b in ((0, 10), (20, 24), (24, 26))]
    real = suffixes.SuffixArray.scan
    monkeypatch.setattr(suffixes.SuffixArray, "scan", lambda self, other: sought.append(len(other)) or real(self, other))
    asked, _ = suffixes.SuffixArray.of(text, np.arange(3, 27), 4)
    assert {int(p) for p in asked.order[family.known(asked)]} == {*range(3, 13), *range(20, 26)}
    assert sought == [len(asked), len(asked) - 10, len(asked) - 14]


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_runs_across_stretches(monkeypatch, step):
    r = np.random.default_rng(step)
    parts = [bytes(r.integers(97, 100, n).astype(np.uint8)) for n in (0, 40, 9, 10, 11, 300, 1)]
    raw, bounds = suffixes._buffer(parts)
    monkeypatch.setattr(suffixes, "STEP", step)
    grams, want = suffixes.Prints(raw).of(4), []
    for d, (low, high) in enumerate(zip(bounds, bounds[1:])):
        for s in range(low, high - 10):
            at = min(range(s, s + 7), key=lambda k: (int(grams[k]) >> 32, k))
            if want and want[-1][0] == d and want[-1][4] == at:
                want[-1][2] = s
            else:
                want.append([d, s, s, int(grams[at]), at])
    assert [tuple(x) for x in zip(*(x.tolist() for x in suffixes.runs(raw, bounds, 10, 4)))] == [tuple(x[:4]) for x in want]
