"""Operator 13: cuckoo filters, and the index against a plain version, with insertions and deletions."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from splitframe.llm import lines, queries
from splitframe.llm.cuckoo import CuckooFilter

from . import brute


def _hashes(seed, n):
    return np.random.default_rng(seed).integers(-(2**63), 2**63 - 1, n)


@pytest.mark.parametrize("n,capacity", [(1, 0), (3, 1000), (5000, 5000), (5000, 100)])
def test_cuckoo_filter(n, capacity):
    """Nothing is missed, also in a table that is too small; few others are found; what is removed is gone."""
    own, others = _hashes(1, n), _hashes(2, 20_000)
    made = CuckooFilter(capacity)
    for part in np.array_split(own, 3):
        made.insert(part)
    assert made.contains(own).all() and len(made) == n
    made = CuckooFilter.read(*made.write())
    if capacity >= n:
        assert made.contains(others).mean() < 2e-3
    made.remove(own[: n // 2])
    assert made.contains(own[n // 2 :]).all() and len(made) == n - n // 2
    assert made.contains(own[: n // 2]).sum() <= 0.05 * n or capacity < n
    made.remove(own[n // 2 :])
    assert len(made) == 0 and not made.contains(own).any()


def test_cuckoo_filter_holds_a_hash_as_often_as_it_is_inserted():
    made, own = CuckooFilter(100), np.repeat(_hashes(3, 1), 20)
    made.insert(own)
    assert len(made) == 20
    made.remove(own[:19])
    assert len(made) == 1 and made.contains(own).all()
    made.remove(own[:1])
    with pytest.raises(KeyError):
        made.remove(own[:1])


def _rows(seed=4):
    r = random.Random(seed)
    pool = ["shared line number %d" % k for k in range(30)] + ["short", "", "  Ünï códe ten", "ünï códe ten\x0b", "ÄÖÜ ten chars", "nine char", "\u00a0ten chars\u00a0", "THE Same Line", " the same line\r"]
    rows = [(7 * i + 1, "\n".join(r.choice(pool) if r.random() < 0.6 else f"own line {i} {k}" for k in range(r.randrange(0, 12)))) for i in range(90)]
    rows += [(i, "hot line of every text\n" + t) for i, t in rows[:40]] + [(None, "shared line number 3\nonly without id"), (None, "only without id"), (2, None), (3, ""), (4, "\n\n"), (5, "x" * 200_000 + "\nthe same line")]
    return rows + [(9, "twice in one\ntwice in one"), (9, "twice in one")]


def _table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, hi string, n_lines int").withColumn("doc", F.lit(1)).repartition(5)


def test_query_like_the_plain_version(spark, tmp_path):
    rows = _rows()
    _table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.queries()["op13_sharded_cuckoo_lines"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted((r[:4] for r in brute.line_dedup(rows)), key=str)


def test_query_like_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duck.execute(queries.OP13_SQL).fetchall()
    found = queries.queries()["op13_sharded_cuckoo_lines"](spark, sf).collect()
    assert sorted(map(tuple, found)) == sorted(want) and sum(r.n_dropped for r in found) > 100


def _state(index):
    filters = [CuckooFilter.read(r.slots, r.rest) for r in index.filters.collect()]
    counts = index.counts().collect()
    assert sum(map(len, filters)) == len(counts)  # one fingerprint for each key
    return sorted(map(tuple, counts), key=str)


def test_deletions_are_reversible(spark):
    """After insertions and deletions in any order the index equals one of the documents that are left."""
    rows = [r for r in _rows() if r[0] != 9]
    ids = sorted({i for i, _ in rows if i is not None})
    index = lines.LineIndex(spark, keys_in_shard=10)
    parts = [[r for r in rows if r[0] is None or r[0] % 3 == 2], [r for r in rows if r[0] is not None and r[0] % 3 == 0], [r for r in rows if r[0] is not None and r[0] % 3 == 1]]
    for part in parts:
        index.add(_table(spark, part))
    whole = _state(index)
    gone = ids[::2]
    index.remove(spark.createDataFrame([(i,) for i in [*gone, 10**9]], "doc_id long"))
    left = [r for r in rows if r[0] not in gone]
    fresh = lines.LineIndex(spark)
    fresh.add(_table(spark, left))
    assert _state(index) == _state(fresh)
    assert sorted(map(tuple, index.report(_table(spark, left)).collect()), key=str) == sorted((r[:4] for r in brute.line_dedup(left)), key=str)
    index.add(_table(spark, [r for r in rows if r[0] in gone]))
    assert _state(index) == whole
    index.remove(spark.createDataFrame([(i,) for i in [*ids, None]], "doc_id long"))
    assert _state(index) == []


def test_only_keys_that_filters_may_hold_meet_the_counts(spark):
    index = lines.LineIndex(spark)
    index.add(spark.createDataFrame([(k, f"line of document {k}") for k in range(2000)], "doc_id long, text string"))
    assert (index.asked, index.maybe, index.known) == (2000, 0, 0)
    index.add(spark.createDataFrame([(5000 + k, f"line of document {k}\nnew line of document {k}") for k in range(500)], "doc_id long, text string"))
    assert index.asked == 1000 and index.known == 500 and 500 <= index.maybe < 520


def test_cleaned_documents_keep_their_columns(spark):
    rows = _rows()
    docs = _table(spark, rows)
    index = lines.LineIndex(spark)
    index.add(docs)
    found = index.cleaned(docs)
    assert found.columns == docs.columns
    want = [(i, k[4] if t is not None else None) for (i, t), k in zip(rows, brute.line_dedup(rows))]
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_report(none).count() == 0
    index = lines.LineIndex(spark)
    index.add(none)
    assert index.cleaned(none).count() == 0


def test_tables_of_the_index_go(spark):
    from splitframe.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("line-*"))
    found = lines.dedup_report(_table(spark, _rows()))
    found.count()
    assert {p.name.rpartition("-")[0] for p in set(folder.glob("line-*")) - before} <= {"line-drops"}
