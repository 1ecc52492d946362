"""Operator 5 across batches, against the plain version."""

import math
import random

import pytest

from splitframe.llm import family as families
from splitframe.llm.family import IndexFamily

from . import brute

SCHEMA = "doc_id long, text string"


def batches(seed, n_batches, each):
    """Batches of (doc_id, text); ids fall from batch to batch. Passages repeat within and across batches."""
    r = random.Random(seed)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passages = [line(40) for _ in range(6)]
    out, last = [], 10**6
    for _ in range(n_batches):
        last -= each
        rows = []
        for k in range(each):
            parts = [line(r.randrange(0, 30)) for _ in range(r.randrange(1, 4))]
            if r.random() < 0.6:
                parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
            rows.append((last + k, "\n".join(parts)))
        if out:
            rows[0] = (rows[0][0], r.choice(r.choice(out))[1])  # a whole copy of an earlier text
        out.append(rows)
    return out


def expected(parts):
    """Texts by (batch, doc_id), where the batch added first is earlier."""
    named = [(b, i, t) for b, rows in enumerate(parts) for i, t in sorted(rows, key=lambda x: x[0])]
    found = brute.repeats([(k, t) for k, (_, _, t) in enumerate(named)])
    return {(b, i): found[k][5] for k, (b, i, _) in enumerate(named)}


def added(spark, family, parts, first=0):
    out = {}
    for b, rows in enumerate(parts, first):
        out |= {(b, r.doc_id): r.text for r in family.add(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    return out


def test_batches_meet_all_levels_and_work_is_bounded(spark):
    parts = batches(1, 5, 40)
    family = IndexFamily(spark)
    assert added(spark, family, parts) == expected(parts)
    anchors = sum(level.anchors for level in family.levels)
    assert len(family.levels) <= 1 + math.log2(5) and [(level.first, level.last) for level in family.levels][-1][1] == 5
    assert all(a.size >= 2 * b.size for a, b in zip(family.levels, family.levels[1:]))
    assert 0 < family.moved <= anchors * math.log2(2 * 5)  # an anchor is moved once for each doubling
    assert family.scanned <= 4 * anchors
    for level in family.levels:  # lists are in order, within their range
        for r in family._table(level, "lists").collect():
            keys = families.unpack_sorted(r["keys"])
            assert len(keys) == r.n and (keys[1:] >= keys[:-1]).all() and set(keys >> (64 - level.bits)) == {r.range}
    family.close()


def test_a_family_goes_on_after_its_driver(spark, tmp_path):
    parts = batches(2, 3, 25)
    path = f"file://{tmp_path}/kept"
    first = IndexFamily(spark, path)
    got = added(spark, first, parts[:2])
    first.close()
    (tmp_path / "kept/level-of-a-lost-batch").mkdir()
    again = IndexFamily.opened(spark, path)
    assert (again.batches, again.levels, again.moved) == (first.batches, first.levels, first.moved)
    assert got | added(spark, again, parts[2:], 2) == expected(parts)
    held = {p.name for p in (tmp_path / "kept").glob("level-*")}
    assert held == {level.folder.rsplit("/", 1)[1] for level in again.levels} | {"level-of-a-lost-batch"}


@pytest.mark.parametrize("settings", [{"HOT_RUNS": 2}, {"SLICE_BLOCKS": 1, "GROUP_ANCHORS": 2, "BUCKET_BYTES": 1000}])
def test_hot_anchors_slices_ranges_and_buckets(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(families, name, value)
    parts = batches(3, 3, 25)
    assert added(spark, IndexFamily(spark), parts) == expected(parts)


def test_levels_stay_where_they_are(spark):
    """Neither a level's lists nor its blocks are shuffled for a batch."""
    parts = batches(4, 1, 30)
    family = IndexFamily(spark)
    added(spark, family, parts)
    level = family.levels[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lists, blocks = family._table(level, "lists"), family._table(level, "blocks")
        asked = families.saved(families._asked(lists), "asked")
        scan = families._scan(lists, families._redealt(asked, level.bits))
        marks = spark.createDataFrame([(1, 0, b"", b"", 1)], families._FLAG)
        sent = families._contexts(blocks.join(marks.select("batch", "block"), ["batch", "block"], "left_semi"), marks, 6, 100)
        for df, exchanges in ((scan, 1), (sent, 2)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == exchanges and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edge_cases(spark):
    family = IndexFamily(spark)
    empty = spark.createDataFrame([], SCHEMA)
    assert family.add(empty).collect() == [] and family.levels == []
    long = "".join(f"{k * 2654435761 % 2**32:08x}" for k in range(40))
    rows = spark.createDataFrame([(None, long, 1), (1, None, 2), (2, "", 3), (3, long + "!", 4), (3, long + "!", 5)], "doc_id long, text string, batch int")
    got = family.add(rows).collect()
    assert {(r.doc_id, r.text, r.batch) for r in got} == {(None, long, 1), (1, None, 2), (2, "", 3), (3, "!", 4), (3, "!", 5)}
    assert [r.text for r in family.add(spark.createDataFrame([(9, "short"), (0, "é" + long)], SCHEMA)).orderBy("doc_id").collect()] == ["é", "short"]
