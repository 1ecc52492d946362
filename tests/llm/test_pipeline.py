"""The pipeline's stages against plain versions of what they decide."""

from pyspark.sql import functions as F

import corpus_pipeline
from splitframe.llm import packing, quality

from . import brute


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        seen[name] = before, {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    before, after = seen["quality_rules"]
    assert after.keys() == {r.doc_id for r in quality.quality_report(spark.createDataFrame(list(before.items()), "doc_id long, text string")).collect() if r.kept}
    before, after = seen["ngram_jaccard"]
    assert after.keys() == {i for i, _, c in brute.near_duplicates(before.items()) if i == c}
    before, after = seen["suffix_dedup"]
    assert after == {i: w[5] for i, w in brute.repeats(before.items()).items() if w[5].strip(" ")}
    assert len(seen["language_id"][1]) > 0.8 * len(seen["language_id"][0])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(after)
    assert sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())
    assert max(r.offset + r.length for r in packed) <= packing.LENGTH


def test_run_gives_the_same_as_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame((d := stage(spark, docs, sf)).collect(), d.schema)
    total = {r.doc_id: r.doc_tokens for r in packing.pack(docs).collect()}
    assert {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, sf).collect()} == total


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    """One row of each group stays, and no row goes because another one has its id."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (3, c), (3, a), (4, d), (None, d), (5, b + " more")]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.ngram_jaccard(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (3, c), (4, d), (5, b + " more")]
    alone = corpus_pipeline.ngram_jaccard(spark, docs.where("doc_id is null"), "")
    assert sorted(r.text for r in alone.collect()) == [a, b, d]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["_gone", "_row", "component_id", "doc_id_", "_language", "quality_n_words", "copy", "ranges", "digest", "_h", "row", "label"]


def _rows(spark):
    """Ordinary documents with nulls in each column, empty texts, repeated rows and a very long text among them."""
    import random

    r = random.Random(1)
    common = "the of and to in is that it for on with as was at by this".split()
    prose = lambda n: " ".join(r.choice(common) if r.random() < 0.4 else "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randrange(3, 9))) for _ in range(n))
    rows = [(k, prose(80), "en", f"h{k % 3}.example", 1) for k in range(40)]
    rows += [rows[3], rows[3], (None, prose(60), "en", "h.example", 1), (None, prose(60), None, None, None), (50, None, "en", "h.example", 0), (51, "", "en", "h.example", 0), (52, " \n\t", None, None, 3)]
    rows += [(60, prose(30_000), "en", "h.example", 1), (61, rows[5][1] + " one more word", "en", "h.example", 1)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def test_edge_rows_pass_through_every_stage(spark):
    docs = _rows(spark).withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
        found = docs.collect()
        assert all(r[c] == f"own {c}" for r in found for c in CLASHES)
        docs = spark.createDataFrame(found, docs.schema)
    ids = [r.doc_id for r in docs.collect()]
    assert ids.count(3) == 1 and ids.count(None) == 2 and 60 in ids and 61 not in ids
    assert set(range(40)) <= set(ids) and not {50, 51, 52} & set(ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_stages_on_empty_tables(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.withColumn("_gone", F.lit(1)), "").columns == [*docs.columns, "_gone"]


def test_a_row_of_nulls_alone(spark):
    docs = spark.createDataFrame([(None, None, None, None, None)], COLUMNS)
    kept = [stage(spark, docs, "").count() for _, stage in corpus_pipeline.STAGES]
    assert kept == [0, 0, 1, 0, 1]


def test_near_copies_meet_their_hubs_first(spark, monkeypatch):
    from splitframe.llm import jaccard

    long = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{long} end {k}") for k in range(60)] + [(1000 + 2 * j + k, " ".join(f"s{j}x{i}" for i in range(60)) + f" end{k}") for j in range(40) for k in range(2)]
    real, tested = jaccard.linked, []
    monkeypatch.setattr(jaccard, "linked", lambda pairs, *a: tested.append(pairs.count()) or real(pairs, *a))
    kept = corpus_pipeline.ngram_jaccard(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(1000, 1080, 2)]
    assert sum(tested) < 20 * 60
