"""Operator 11 against counting every prefix."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from splitframe.llm import queries, trie

from . import brute

SCHEMA = "conv_id long, turn long, role string, text string"


def _rows(seed=2):
    """Shared beginnings of many lengths, ties, repeated rows, nulls, a very long and a turnless conversation."""
    r = random.Random(seed)
    say = ["hello", "hello  there", "", None, "a b\u00a0c d", "\n one two\t"]
    rows = []
    for c in range(150):
        for k in range(r.randrange(1, 6)):
            rows.append((c, k, r.choice(["user", "assistant", None]) if r.random() < 0.2 else "user", r.choice(say[:2]) if r.random() < 0.7 else r.choice(say)))
    rows += [(160 + c, k, "user", "hello") for c in range(25) for k in range(1 + c)]
    rows += [(200, k, "user", f"turn {k} of many") for k in range(400)] + [(220 + c, k, "user", f"turn {k} of many") for c in range(5) for k in range(400 - 9 * c)]
    rows += [(300, None, "user", "b"), (300, None, "user", "a"), (300, None, "user", "a"), (300, 1, None, None), (300, 0, "user", "x" * 100_000), (None, 1, "user", "hello")]
    rows += [(5001, 0, "user", "hello"), (5002, 0, "user", "hello"), (5003, 0, "user", "hello"), (5004, 0, "user", "hello")]  # no such base: some lose all their turns
    return rows


def _table(spark, rows, n=5):
    return spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit(1)).withColumn("pos", F.lit("x")).repartition(n)


def test_query_like_the_plain_version(spark, tmp_path):
    rows = _rows()
    _table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.queries()["op11_heavy_path_trie"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute.prefix_trie(brute.rebuilt(rows)), key=str)


@pytest.mark.parametrize("block", [3, 64])
def test_small_blocks(spark, block):
    """Conversations and paths much longer than a block of running sums."""
    rows = [x for x in _rows(5) if x[0] is not None]
    own = {}
    for c, *turn in rows:
        own.setdefault(c, []).append(turn)
    convs = {c: [(r or "", t or "") for _, r, t in sorted(ts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))] for c, ts in own.items()}
    convs[-7] = []
    everyone = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    found = trie.prefix_trie(trie.positions(_table(spark, rows)), everyone, block)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute.prefix_trie(convs), key=str)


def test_rounds_are_logarithmic(spark, monkeypatch):
    """A caterpillar: each turn of a long conversation is left by another one; heavy paths need two rounds, not one for each fork."""
    convs = {0: [("u", str(k)) for k in range(60)]} | {c: [("u", str(k)) for k in range(c)] + [("u", "leave")] for c in range(1, 60)}
    rows = pd.DataFrame([(c, k + 1, r, t) for c, ts in convs.items() for k, (r, t) in enumerate(ts)], columns=["conv_id", "pos", "role", "text"])
    names, keep = [], trie.saved
    monkeypatch.setattr(trie, "saved", lambda df, name, **more: names.append(name) or keep(df, name, **more))
    found = trie.prefix_trie(spark.createDataFrame(rows), spark.createDataFrame([(c,) for c in convs], "conv_id long"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute.prefix_trie(convs), key=str)
    assert names.count("trie-round") == 2


def test_hot_nodes_are_joined_by_broadcast(spark, monkeypatch):
    """With every node hot, and with none, the result is the same."""
    rows = [x for x in _rows(7) if x[0] is not None]
    own = trie.positions(_table(spark, rows))
    everyone = own.select("conv_id")
    want = sorted(map(str, trie.prefix_trie(own, everyone).collect()))
    for keys in (1, 10**9):
        monkeypatch.setattr(trie, "HOT_KEYS", keys)
        assert sorted(map(str, trie.prefix_trie(own, everyone).collect())) == want


def test_one_conversation_over_many_ranges(spark):
    rows = [(1, k // 7, "user", str(k % 5)) for k in range(2000)] + [(2, 0, "user", "a")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = trie.positions(_table(spark, rows, 6)).where("conv_id = 1").orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.pos for r in found] == list(range(1, 2001))
    assert [r.text for r in found] == [str(x[3]) for x in sorted(rows[:2000], key=lambda x: (x[1], x[3]))]


def test_ends_in_many_rows(spark):
    import hashlib

    ends = spark.createDataFrame([(c - 50, 0, 1, 2) for c in range(1000)], "conv_id long, depth long, a long, b long").repartition(7)
    want = hashlib.sha256(",".join(str(c - 50) for c in range(1000)).encode()).hexdigest()
    assert [r.ends_sha256 for r in trie.ends_digest(ends, ids_in_row=13).collect()] == [want]


def test_texts_of_nodes_and_empty_table(spark):
    own = trie.positions(_table(spark, [(1, 0, "user", "a b"), (2, 0, "user", "a b"), (2, 1, "user", "c")]))
    found = trie.with_turns(trie.prefix_trie(own, own), own)
    assert sorted((r.depth, r.text or "") for r in found.collect()) == [(0, ""), (1, "a b"), (2, "c")]
    none = trie.positions(spark.createDataFrame([], SCHEMA))
    assert trie.prefix_trie(none, none).count() == 0
