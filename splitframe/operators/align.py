"""Row alignment of several parties by match id, with the semantics of a private set intersection.

With a salt, tokens are salted hashes of ids. They keep ids out of the exchanged table, but a party that can
guess ids can test them; this is alignment, not a cryptographic protocol.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import free, quoted


def token(match_id: str, salt: str = ""):
    """32 bytes that stand for an id."""
    return F.unhex(F.sha2(F.concat(F.lit(salt), F.lit(":"), F.col(quoted(match_id)).cast("string")), 256))


def align(guest: DataFrame, hosts: list[tuple[DataFrame, str]], sample_id: str, match_id: str, salt: str | None = None, check: bool = True) -> DataFrame:
    """Guest rows whose id all hosts have, with the guest's sample id; host columns follow their order.

    hosts: (table, match id column) each. Column names must differ between parties. With a ``salt``, rows meet by salted
    hashes of ids; without one, the parties are in one domain of trust and rows meet by the ids. A guest's match ids may repeat;
    one that a host repeats is an error, found on the way. All hosts meet in one grouping by the key, so the hosts' rows are shuffled once and the guest's once,
    however many hosts there are. Without ``check``, a host's repeated ids repeat rows.
    """
    p = free(guest, *(t for t, _ in hosts))
    key = f"{p}key"
    out = guest.withColumn(key, F.col(quoted(match_id)) if salt is None else token(match_id, salt))
    theirs = [table.withColumn(key, F.col(quoted(own)) if salt is None else token(own, salt)).drop(own) for table, own in hosts]
    if not check:
        for table in theirs:
            out = out.join(table, key)
        return out.drop(key)
    if not theirs:
        return out.drop(key)
    tagged = []
    for k, table in enumerate(theirs):
        values = [quoted(c) for c in table.columns if c != key]
        tagged.append(table.select(key, F.lit(k).alias(f"{p}tag"), (F.struct(*values) if values else F.struct(F.lit(True).alias(f"{p}there"))).alias(f"{p}v{k}")))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).where(F.col(key).isNotNull())
    sums = [x for k in range(len(theirs)) for x in (F.first(f"{p}v{k}", ignorenulls=True).alias(f"{p}v{k}"), F.count_if(F.col(f"{p}tag") == k).alias(f"{p}n{k}"))]
    met = union.groupBy(key).agg(*sums)
    counts = [F.col(f"{p}n{k}") for k in range(len(theirs))]
    whole = F.when(F.greatest(*counts, F.lit(0)) > 1, F.raise_error(F.lit("duplicate match_id in a host table")).cast("boolean")).otherwise(F.least(*counts, F.lit(1)) == 1)
    met = met.where(whole).select(key, *[F.col(f"{p}v{k}.{quoted(c)}").alias(c) for k, table in enumerate(theirs) for c in table.columns if c != key])
    out = out.join(met, key)
    return out.drop(key)


def summary(guest: DataFrame, aligned: DataFrame) -> DataFrame:
    """input_count, intersect_count, intersect_rate in one row."""
    a = guest.agg(F.count("*").alias("input_count"))
    b = aligned.agg(F.count("*").alias("intersect_count"))
    one = a.crossJoin(b)  # one row each
    return one.withColumn("intersect_rate", F.try_divide(F.col("intersect_count").cast("double"), F.col("input_count")))
