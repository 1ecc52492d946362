"""Operator 12 against a search of every period."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitframe.llm import queries, runs

from . import brute


@pytest.mark.parametrize("seed", range(8))
def test_runs_like_a_search_of_every_period(seed):
    """Few different words, periodic stretches with odd words in them, empty texts and texts of one word."""
    r = random.Random(seed)
    for _ in range(40):
        texts = []
        for _ in range(r.randrange(1, 6)):
            n, k, p = r.randrange(0, 70), r.choice([1, 2, 2, 3, 5]), r.randrange(1, 9)
            base = [r.randrange(k) for _ in range(p if r.random() < 0.5 else max(n, 1))]
            t = [base[i % len(base)] for i in range(n)]
            for _ in range(r.randrange(3) if t else 0):
                t[r.randrange(n)] = r.randrange(k)
            texts.append(t)
        least = r.choice([2, 4, 12, 12])
        found = runs.find_runs(np.array([x for t in texts for x in t], np.int32), np.array([len(t) for t in texts]), least)
        assert list(zip(*(c.tolist() for c in found))) == [(i, s, n, p) for i, t in enumerate(texts) for s, n, p in brute.word_runs(t, least)]


def _rows():
    base = brute.corpus(seed=5, n=70)
    odd = ["a " * 11, "a " * 12, " a\u00a0b a\u00a0b\x0b" * 6, "x y z w " * 3 + "v", "\u2028".join("ab" * 20), "one  two\nthree\t" * 900]
    texts = [(r[0], r[1]) for r in base] + [(1000 + k, t) for k, t in enumerate(odd)] + [(None, "b c " * 20), (3, "q " * 30), (3, "q " * 30)]
    return texts + [(2000 + k, " ".join(f"w{j % 17}" if j % 5 else f"u{j}" for j in range(40 + k))) for k in range(60)]


def test_query_like_the_plain_version(spark, tmp_path):
    rows = _rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, runs string").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.queries()["op12_runs_theorem"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted((brute.run_row(i, t) for i, t in rows), key=str)
    assert sum(r.n_runs > 0 for r in found.collect()) > 10


def test_chunks_do_not_matter(spark):
    docs = spark.createDataFrame(_rows(), "doc_id long, text string")
    one, many = runs.periodic_runs(docs), runs.periodic_runs(docs, chunk_chars=50)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_very_long_text(spark):
    """A text of half a million words, the second half of which repeats a stretch of 1,000 words."""
    w = [f"w{k * 7919 % 99991}" for k in range(250_000)] + [f"v{k % 1000}" for k in range(250_000)]
    row = runs.periodic_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs][-1] == (250_000, 250_000, 1000)
    assert row.collapsed.split(" ")[-1000:] == w[250_000:251_000]


def test_collapsed_documents_keep_their_columns(spark):
    rows = [(1, "a b " * 8, "p", 5), (2, "  few  words ", "q", 6), (None, None, None, None), (1, "a b " * 8, "p", 5), (4, "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, collapsed string, `n.words` int").withColumn("runs", F.array(F.lit(1)))
    found = runs.without_runs(docs)
    assert found.columns == docs.columns
    want = [("a b" if r[1] and r[1].startswith("a b") else r[1]) for r in rows]
    assert sorted(map(str, [(r[0], r[1], r[2], r[3]) for r in found.collect()])) == sorted(map(str, [(r[0], w, r[2], r[3]) for r, w in zip(rows, want)]))
    assert runs.without_runs(docs.limit(0)).count() == 0 and runs.periodic_runs(docs.limit(0)).count() == 0
