"""Binning, WOE and IV, and (node, feature, bin) histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dense import WHOLE, bounds, dense_sums, named


def bucket(c: Column, cuts: list[float]) -> Column:
    """Left-open bins (b[i-1], b[i]]; the last edge is infinity; NULL stays NULL."""
    out = F.when(c.isNotNull(), F.lit(0))
    for b in cuts[:-1]:
        out = out + (c > b).cast("int")
    return out


def histogram(df: DataFrame, features: list[str], values: dict[str, Column], node: Column | None = None, cumulative: bool = False, shape: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(node, feature, bin, values...) sums over integer bins; ``cumulative`` sums them up along the bins.

    ``shape`` has the least bin and the number of bins of each feature; without it, one more pass finds them.
    """
    kinds = dict(df.dtypes)
    for f in features:
        if kinds[f] not in WHOLE:
            raise ValueError(f"{f} is not a column of integer bins")
    out = named(dense_sums(df, features, bounds(df, features) if shape is None else shape, values, node), features)
    if cumulative:
        w = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({k: F.sum(k).over(w) for k in values})
    return out


def sibling(parent: DataFrame, child: DataFrame, values: list[str]) -> DataFrame:
    """Histogram of the other child: parent minus child, by feature and bin."""
    other = child.select("feature", "bin", *[F.col(v).alias(f"_{v}") for v in values])
    return parent.join(other, ["feature", "bin"], "left").select("feature", "bin", *[(F.col(v) - F.coalesce(F.col(f"_{v}"), F.lit(0))).alias(v) for v in values])


def woe_table(df: DataFrame, binned: list[str], label: str, adjustment: float = 0.5) -> DataFrame:
    """Per (feature, bin): counts of events and non-events, rates, woe and iv."""
    event = (F.col(label) == 1).cast("long")
    h = histogram(df, binned, {"event_count": event, "non_event_count": 1 - event})
    total = h.withColumns({t: F.sum(c).over(Window.partitionBy("feature")) for t, c in (("_e", "event_count"), ("_n", "non_event_count"))})

    def rate(c: str, t: str) -> Column:
        return F.when(F.col(c) == 0, adjustment).otherwise(0.0) + F.try_divide(F.col(c).cast("double"), F.greatest(F.col(t), F.lit(1)))

    out = total.withColumns({"event_rate": rate("event_count", "_e"), "non_event_rate": rate("non_event_count", "_n")})
    out = out.withColumn("woe", F.ln(F.try_divide(F.col("event_rate"), F.col("non_event_rate"))))
    out = out.withColumn("iv", (F.col("event_rate") - F.col("non_event_rate")) * F.col("woe"))
    return out.select("feature", "bin", "event_count", "non_event_count", "event_rate", "non_event_rate", "woe", "iv")


def column_iv(table: DataFrame, skip_first: bool = True) -> DataFrame:
    """IV of each feature; by default bin 0 is left out, as the reference semantics have it."""
    return (table.where("bin > 0") if skip_first else table).groupBy("feature").agg(F.sum("iv").alias("iv"))


def woe_transform(df: DataFrame, binned: list[str], table: DataFrame) -> DataFrame:
    """Bin numbers replaced by their WOE; the table has a few rows for each feature."""
    maps = {f: {r["bin"]: r["woe"] for r in table.where(F.col("feature") == f).collect()} for f in binned}
    out = {}
    for f, woe in maps.items():
        pairs = [x for b, v in woe.items() for x in (F.lit(b), F.lit(v))]
        out[f] = F.try_element_at(F.create_map(*pairs), F.col(f)) if pairs else F.lit(None).cast("double")
    return df.withColumns(out)
