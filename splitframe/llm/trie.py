"""Operator 11, the prefix trie of conversations by heavy-path decomposition.

Each distinct sequence of first turns is a node; the conversations that start with it are its members. The heavy
child of a node is the child with most members (of equal ones, that of smallest conversation), so from the root to any node no more than log2 of the
number of conversations steps go to light children. Heavy steps join nodes to paths.

1. ``positions`` numbers the turns of each conversation, also of one that holds a third of all rows: turns are dealt out by ranges of
   conversation and order, numbered in each range, and moved by the sizes of the ranges before.
2. A turn has a digest of its place, role and text; a node is known by the exclusive or of the digests up to it, 120 bits, and by its depth.
   So its parent is known without a look at other rows.
3. Grouped sums give members and children. Along each conversation a running maximum gives the last light node so far, which is the head of
   the path, and a running count the number of light nodes, which is the round of the path.
4. Rounds go from the paths with most light nodes above them to the root's path. In a round, each path is an array by depth; suffix sums give the
   sums of its nodes' subtrees, and the sum of its head is added to the head's parent, which is on a path of a later round.

Running values along a conversation or path are worked out in blocks of BLOCK turns and moved by the sums of the blocks
before, so no conversation or path has to fit a task. Nodes with very many members or children are joined by broadcast: those with more than the
HOT_KEYS-th part of all rows, of which there are fewer than HOT_KEYS. The digest of the ends of a node is one SHA-256 over a text in a given order, so one task
reads that text, as a stream of rows of joined ids.

Edge cases: turns are ordered by turn (null first), then role, then text, so ties have one result; a repeated row is a turn of its own. Null role
or text is the empty text. Rows without conversation take no part. A conversation without turns ends at the root. Without any conversation there is no
root and the result is empty. Very long texts are digested whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved

BLOCK = 65_536
HOT_KEYS = 4096
IDS_IN_ROW = 10_000
_NODE = ["depth", "a", "b"]
_PARENT = ["up_depth", "up_a", "up_b"]


def positions(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text of ``turns`` (conv_id, turn, role, text) in order."""
    order = [F.col("turn").asc_nulls_first(), "role", "text", "row"]
    own = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
        F.monotonically_increasing_id().alias("row"),
    )
    dealt = saved(own.repartitionByRange("conv_id", *order).withColumn("piece", F.spark_partition_id()), "trie-turns")
    sizes = dealt.groupBy("conv_id", "piece").agg(F.count("*").alias("n"))
    before = sizes.select("conv_id", "piece", F.sum("n").over(Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)).alias("before")).where("before is not null")
    here = F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy(*order))
    numbered = dealt.withColumn("here", here).join(before, ["conv_id", "piece"], "left")
    out = saved(numbered.select("conv_id", (F.col("here") + F.coalesce("before", F.lit(0))).alias("pos"), "role", "text"), "trie-positions")
    discard(dealt)
    return out


def running(rows: DataFrame, group: list[str], at: str, values: dict[str, tuple[str, Column]], block: int, down: bool = False) -> DataFrame:
    """``rows`` with running values along ``at`` (whole numbers, each once in a group) from its least, or from its greatest if ``down``.

    ``values`` has by name the aggregate (sum, max or bit_xor) and its column. Groups are worked on in blocks of ``block`` numbers.
    """
    kinds = {"sum": F.sum, "max": F.max, "bit_xor": F.bit_xor}
    ends = {"sum": lambda x, y: x + y, "max": F.greatest, "bit_xor": lambda x, y: x.bitwiseXOR(y)}
    order = (lambda c: F.desc(c)) if down else (lambda c: F.asc(c))
    rows = rows.withColumn("_block", F.floor(F.col(at) / block)).withColumns({f"_{name}": c for name, (_, c) in values.items()})
    local = Window.partitionBy(*group, "_block").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "_block").agg(*[kinds[kind](f"_{name}").alias(f"_{name}") for name, (kind, _) in values.items()], F.count("*").alias("_n"))
    carried = totals.select(*group, "_block", *[kinds[kind](f"_{name}").over(earlier).alias(f"_{name}_before") for name, (kind, _) in values.items()], F.sum("_n").over(earlier).alias("_n"))
    carried = carried.where("_n is not null").drop("_n")  # a group of one block has none
    out = rows.withColumns({name: kinds[kind](f"_{name}").over(local) for name, (kind, _) in values.items()}).join(carried, [*group, "_block"], "left")
    whole = {name: F.coalesce(ends[kind](F.col(name), F.col(f"_{name}_before")), F.col(name), F.col(f"_{name}_before")) for name, (kind, _) in values.items()}
    return out.withColumns(whole).drop("_block", *[f"_{name}" for name in values], *[f"_{name}_before" for name in values])


def joined(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """``left`` with the one row of ``right`` for its keys, where ``weight`` is how many rows of ``left`` a row meets; all together meet ``total``."""
    hot = saved(right.where(F.col(weight) > total / HOT_KEYS).drop(weight).withColumn("_hot", F.lit(True)), "trie-hot")
    marked = left.join(F.broadcast(hot), keys, "left")  # fewer than HOT_KEYS rows
    own = [c for c in hot.columns if c not in keys]
    rest = marked.where("_hot is null").drop(*own).join(right.where(F.col(weight) <= total / HOT_KEYS).drop(weight), keys, how)
    return marked.where("_hot").drop("_hot").unionByName(rest)


def _members(positioned: DataFrame, block: int) -> DataFrame:
    """conv_id, its node at each depth from 1 on, the node's parent, and the words of the turn."""
    mixed = F.concat_ws(":", F.col("pos"), F.length("role"), F.concat("role", "text"))
    digested = positioned.select("conv_id", F.col("pos").alias("depth"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.sha2(mixed, 256).alias("digest"))
    parts = digested.select("conv_id", "depth", "words", *[F.conv(F.substring("digest", low, 15), 16, 10).cast("long").alias(c) for c, low in (("own_a", 1), ("own_b", 16))])
    nodes = running(parts, ["conv_id"], "depth", {"a": ("bit_xor", F.col("own_a")), "b": ("bit_xor", F.col("own_b"))}, block)
    up = [F.col("depth") - 1, F.col("a").bitwiseXOR(F.col("own_a")), F.col("b").bitwiseXOR(F.col("own_b"))]
    return nodes.select("conv_id", *_NODE, *[c.alias(n) for c, n in zip(up, _PARENT)], "words")


def ends_digest(ends: DataFrame, ids_in_row: int = IDS_IN_ROW) -> DataFrame:
    """depth, a, b, ends_sha256 of the ascending, comma-joined conversations of each node of ``ends`` (conv_id, depth, a, b)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def listed(batches):
        import numpy as np

        for whole in batches:
            for low in range(0, whole.num_rows, ids_in_row):
                batch = whole.slice(low, ids_in_row)
                node = np.stack([batch.column(c).to_numpy() for c in _NODE])
                heads = np.flatnonzero(np.append(True, (node[:, 1:] != node[:, :-1]).any(0)))
                ids = batch.column("conv_id")
                lists = pa.ListArray.from_arrays(pa.array(np.append(heads, batch.num_rows), pa.int32()), ids.cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in node[:, heads]), ids.take(pa.array(heads)), pc.binary_join(lists, ",")], [*_NODE, "first", "ids"])

    def digested(batches):
        node, made = None, None
        for batch in batches:
            out = []
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids"))):
                if own != node:
                    if node is not None:
                        out.append((*node, made.hexdigest()))
                    node, made = own, hashlib.sha256(ids.encode())
                else:
                    made.update(b"," + ids.encode())
            if out:
                yield _batch(out)
        if node is not None:
            yield _batch([(*node, made.hexdigest())])

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 3 + (pa.string(),))], [*_NODE, "ends_sha256"])

    own = ends.select(*[F.col(c).cast("long").alias(c) for c in _NODE], "conv_id")
    rows = own.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").mapInArrow(listed, "depth long, a long, b long, first long, ids string")
    return rows.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digested, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(positioned: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of ``positioned`` turns (conv_id, pos, role, text); ``conversations`` (conv_id) has turnless ones too.

    Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    members = saved(_members(positioned, block), "trie-members")
    everyone = conversations.select("conv_id").distinct()
    root = everyone.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[F.lit(0).cast("long").alias(c) for c in _NODE], "conv_id", "n_convs", *[F.lit(None).cast("long").alias(c) for c in _PARENT], F.lit(0).cast("long").alias("words"))
    sums = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in (*_PARENT, "words")]]
    nodes = saved(members.groupBy(*_NODE).agg(*sums).unionByName(root), "trie-nodes")
    # The heavy child of each node; all other children are light.
    best = F.max_by(F.struct("a", "b"), F.struct("n_convs", -F.col("conv_id")))
    parents = saved(nodes.where("depth > 0").groupBy(*_PARENT).agg(best.alias("heavy"), F.count("*").alias("n_children")), "trie-parents")
    heavy = parents.select((F.col("up_depth") + 1).alias("depth"), "heavy.a", "heavy.b")
    light = saved(nodes.where("depth > 0").join(heavy, _NODE, "left_anti").select(*_NODE, "n_convs", F.lit(True).alias("light")), "trie-light")
    total = members.count()
    marked = joined(members.select("conv_id", *_NODE), light, _NODE, "n_convs", total)
    along = running(marked, ["conv_id"], "depth", {"head": ("max", F.when(F.col("light"), F.struct(*_NODE))), "round": ("sum", F.when(F.col("light"), 1).otherwise(0).cast("long"))}, block)
    paths = along.groupBy(*_NODE).agg(F.max("head").alias("head"), F.max("round").alias("round"))
    start = F.struct(*[F.lit(0).cast("long").alias(c) for c in _NODE])
    children = parents.select(*[F.col(p).alias(n) for p, n in zip(_PARENT, _NODE)], "n_children")
    shaped = nodes.join(paths, _NODE, "left").join(children, _NODE, "left").select(
        *_NODE, *_PARENT, "conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("head", start).alias("head"),
        F.coalesce("round", F.lit(0)).alias("round"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("tokens"),
    )
    shaped = saved(shaped, "trie-paths", by="round")
    rounds = shaped.agg(F.max("round")).first()[0]
    done, attached = [], None
    for r in range(rounds if rounds is not None else -1, -1, -1):
        own = shaped.where(F.col("round") == r)
        if attached is not None:
            own = own.join(attached, _NODE, "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaf", "tokens")}).drop("more_leaf", "more_tokens")
        own = running(own, ["head"], "depth", {"n_leaves": ("sum", F.col("leaf")), "saved_tokens": ("sum", F.col("tokens"))}, block, down=True)
        done.append(saved(own.select(*_NODE, "conv_id", *_PARENT, "n_convs", "n_children", "n_leaves", "saved_tokens", (F.col("head.depth") == F.col("depth")).alias("is_head")), "trie-round"))
        up = done[-1].where("is_head and depth > 0").groupBy(*[F.col(p).alias(n) for p, n in zip(_PARENT, _NODE)])
        attached = up.agg(F.sum("n_leaves").alias("more_leaf"), F.sum("saved_tokens").alias("more_tokens"))
    found = shaped.limit(0).selectExpr(*_NODE, "conv_id", *_PARENT, "n_convs", "n_children", "leaf n_leaves", "tokens saved_tokens", "true is_head")
    for part in done:
        found = found.unionByName(part)
    of_parent = nodes.select(*[F.col(n).alias(p) for p, n in zip(_PARENT, _NODE)], F.col("conv_id").alias("parent_conv_id")).join(parents.select(*_PARENT, F.col("n_children").alias("weight")), _PARENT)
    found = joined(found, of_parent, _PARENT, "weight", total)
    last = members.groupBy("conv_id").agg(F.max_by(F.struct(*_NODE), "depth").alias("last"))
    ends = everyone.join(last, "conv_id", "left").select("conv_id", F.coalesce("last", start).alias("last")).select("conv_id", "last.*")
    out = found.join(ends_digest(ends), _NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )
    out = saved(out, "trie")
    discard(members, nodes, parents, light, shaped, *done)
    return out


def with_turns(nodes: DataFrame, positioned: DataFrame) -> DataFrame:
    """``nodes`` of a trie with the role and the text of their last turn; the root has none."""
    return nodes.join(positioned.select("conv_id", F.col("pos").alias("depth"), "role", "text"), ["conv_id", "depth"], "left")
