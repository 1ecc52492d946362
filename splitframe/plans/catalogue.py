"""The query catalogue: each query over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import components
from ..frame import Frame
from ..functions import evaluate
from ..ml import gbdt, glm, tensor, tiles, validate
from ..operators import align, bins, encode, follow, kv, quantile, sampling, sketch, stat
from ..party import Exchange
from ..streaming import events as streams

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(*names):
    return {n: F.round(F.col(n), 6) for n in names}


def part_frame(spark, d, columns):
    return Frame.from_spark(t(spark, d, "part"), "p_partkey", features=columns)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
METRICS = {
    "sum": "sum({c})", "min": "min({c})", "max": "max({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "var": "var_samp({c})",
    "variation": "stddev_samp({c}) / nullif(avg({c}), 0)", "na_count": "count(*) FILTER ({c} IS NULL)",
}


def _metric_sql(table: str, columns: list[str], metrics: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, '{c}' AS \"column\", round(CAST({e.format(c=c)} AS DOUBLE), 4) AS value FROM {table}" for m, e in metrics.items() for c in columns)


def _stat(name, metrics, sqls, ddof=1, bias=True, columns=NUMBERS, table="lineitem"):
    def f(spark, d):
        return stat.statistics(t(spark, d, table), columns, metrics, ddof, bias).withColumn("value", F.round("value", 4))

    f.__name__ = name
    query(_metric_sql(table, columns, dict(zip(metrics, sqls))))(f)


_stat("stat_describe", list(METRICS), list(METRICS.values()))
_stat("stat_skew_g1", ["skew"], ["(SELECT avg(pow(z.{c} - m.a, 3)) / pow(avg(pow(z.{c} - m.a, 2)), 1.5) FROM lineitem z, (SELECT avg({c}) AS a FROM lineitem) m)"], columns=["l_extendedprice"])
_sql["stat_skew_g1"] = "SELECT 'skew' AS metric, 'l_extendedprice' AS \"column\", round(avg(pow(l_extendedprice - a, 3)) / pow(avg(pow(l_extendedprice - a, 2)), 1.5), 4) AS value FROM lineitem, (SELECT avg(l_extendedprice) AS a FROM lineitem)"
_stat("stat_skew_unbiased", ["skew"], ["skewness({c})"], bias=False)
_stat("stat_kurt_biased", ["kurt"], ["kurtosis_pop({c})"])
_stat("stat_kurt_unbiased", ["kurt"], ["kurtosis({c})"], bias=False)
_stat("stat_var_pop", ["var"], ["var_pop({c})"], ddof=0)


@query("SELECT m AS metric, 'c_acctbal' AS \"column\", round(v, 6) AS value FROM (SELECT count(*) FILTER (c_acctbal < 0) AS n, count(*) AS a FROM customer), LATERAL (SELECT 'missing_count' AS m, CAST(n AS DOUBLE) AS v UNION ALL SELECT 'missing_ratio', n / a)")
def stat_missing(spark, d):
    c = t(spark, d, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return stat.statistics(c, ["c_acctbal"], ["missing_count", "missing_ratio"]).withColumns(r6("value"))


@query("SELECT 'kurt' AS metric, 'l_discount' AS \"column\", round(avg(pow(l_discount - a, 4)) / pow(avg(pow(l_discount - a, 2)), 4) - 3, 2) AS value FROM lineitem, (SELECT avg(l_discount) AS a FROM lineitem)")
def stat_kurt_compat(spark, d):
    return stat.statistics(t(spark, d, "lineitem"), ["l_discount"], ["kurt"], compat_kurt=True).withColumn("value", F.round("value", 2))


# Alignment
@query("SELECT l.doc_id, l.quality, d.n_chars FROM labels l JOIN documents d USING (doc_id)")
def psi_inner(spark, d):
    return align.align(t(spark, d, "labels").withColumn("m", F.col("doc_id")), [(t(spark, d, "documents").select(F.col("doc_id").alias("h"), "n_chars"), "h")], "doc_id", "m").select("doc_id", "quality", "n_chars")


@query("SELECT a AS input_count, b AS intersect_count, b / nullif(a, 0) AS intersect_rate FROM (SELECT count(*) AS a FROM labels), (SELECT count(*) AS b FROM labels JOIN documents USING (doc_id))")
def psi_rate(spark, d):
    return align.summary(t(spark, d, "labels"), psi_inner(spark, d))


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def psi_guest_dup(spark, d):
    return align.align(t(spark, d, "orders").select("o_orderkey", "o_custkey"), [(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")], "o_orderkey", "o_custkey")


@query("SELECT l.doc_id, l.quality, d.n_chars, g.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id JOIN documents g ON l.doc_id = g.doc_id AND g.lang = 'de'")
def psi_multi_host(spark, d):
    docs = t(spark, d, "documents")
    hosts = [(docs.select(F.col("doc_id").alias("h1"), "n_chars"), "h1"), (docs.where("lang = 'de'").select(F.col("doc_id").alias("h2"), "source"), "h2")]
    return align.align(t(spark, d, "labels").select("doc_id", "quality"), hosts, "doc_id", "doc_id").select("doc_id", "quality", "n_chars", "source")


# Keyed tables
def _sides(spark, d):
    """Customers by key, and orders' sums by order key: each has keys that the other has not."""
    left = t(spark, d, "customer").select((F.col("c_custkey") * 2).alias("k"), F.col("c_acctbal").alias("v"))
    right = t(spark, d, "orders").groupBy((F.col("o_custkey") * 3).alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return left, right


_SIDES = "WITH l AS (SELECT c_custkey * 2 AS k, c_acctbal AS v FROM customer), r AS (SELECT o_custkey * 3 AS k, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1) "


@query(_SIDES + "SELECT l.k, round(l.v + r.v, 2) AS v FROM l JOIN r USING (k)")
def kv_join(spark, d):
    return kv.join(*_sides(spark, d), "k", lambda a, b: F.round(a + b, 2))


@query(_SIDES + "SELECT coalesce(l.k, r.k) AS k, CASE WHEN l.k IS NULL THEN r.v ELSE l.v END AS v FROM l FULL JOIN r ON l.k = r.k")
def kv_union_left(spark, d):
    return kv.union(*_sides(spark, d), "k")


@query(_SIDES + "SELECT coalesce(l.k, r.k) AS k, round(coalesce(l.v, 0) + coalesce(r.v, 0), 2) AS v FROM l FULL JOIN r ON l.k = r.k")
def kv_union_sum(spark, d):
    return kv.union(*_sides(spark, d), "k", lambda a, b: a + b).withColumn("v", F.round("v", 2))


@query(_SIDES + "SELECT * FROM l WHERE k NOT IN (SELECT k FROM r)")
def kv_subtract(spark, d):
    return kv.subtract(*_sides(spark, d), "k")


@query("SELECT o_orderstatus AS key, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def kv_map_reduce(spark, d):
    return kv.map_reduce(t(spark, d, "orders"), F.col("o_orderstatus").alias("key"), {"n": F.count("*"), "total": F.round(F.sum("o_totalprice"), 2)})


@query("SELECT p_partkey AS k, unnest([p_size, p_size + 1]) AS v FROM part")
def kv_flat_map(spark, d):
    pair = F.array(*[F.struct(F.col("p_partkey").alias("k"), (F.col("p_size") + i).alias("v")) for i in (0, 1)])
    return kv.flat_map(t(spark, d, "part"), pair)


@query("SELECT c_custkey AS k, round(c_acctbal * 2, 2) AS v FROM customer")
def kv_map_values(spark, d):
    return kv.map_values(t(spark, d, "customer").withColumnRenamed("c_custkey", "k"), "k", {"v": F.round(F.col("c_acctbal") * 2, 2)})


# Quantiles and binning
def _rank_sql(column: str, table: str, qs: list[str]) -> str:
    return f"WITH s AS (SELECT CAST({column} AS DOUBLE) AS v, row_number() OVER (ORDER BY {column}) AS rn, count(*) OVER () AS n FROM {table}) SELECT '{column}' AS \"column\", q, v AS value FROM s, (SELECT unnest([{', '.join(qs)}]) AS q) WHERE rn = greatest(1, CAST(floor(q * n) AS BIGINT))"


_DECILES = [f"CAST({i} AS DOUBLE) / 10" for i in range(11)]


@query(_rank_sql("o_totalprice", "orders", _DECILES))
def quantile_exact(spark, d):
    return quantile.quantiles(t(spark, d, "orders"), ["o_totalprice"], [i / 10 for i in range(11)])


@query("SELECT 'median' AS metric, \"column\", value FROM (" + _rank_sql("o_totalprice", "orders", ["CAST(0.5 AS DOUBLE)"]) + ")")
def median_rank(spark, d):
    return stat.statistics(t(spark, d, "orders"), ["o_totalprice"], ["median"])


@query("SELECT 'l_quantity' AS \"column\", i, round(a + i * (b - a) / 10, 6) AS cut FROM (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem), (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS i)")
def equal_width_cuts(spark, d):
    return quantile.equal_width_cuts(t(spark, d, "lineitem"), ["l_quantity"], 10).withColumns(r6("cut"))


CUTS = [1000.0, 5000.0, 20000.0, 50000.0]
_BUCKET = "(CAST(l_extendedprice > 1000 AS INTEGER) + CAST(l_extendedprice > 5000 AS INTEGER) + CAST(l_extendedprice > 20000 AS INTEGER))"


@query(f"SELECT {_BUCKET} AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def bucketize_left_open(spark, d):
    return t(spark, d, "lineitem").groupBy(bins.bucket(F.col("l_extendedprice"), CUTS).alias("bin")).agg(F.count("*").alias("n"))


def _binned(spark, d):
    return t(spark, d, "lineitem").withColumn("price", bins.bucket(F.col("l_extendedprice"), CUTS)).withColumn("flag", (F.col("l_returnflag") == "R").cast("int"))


_HIST = f"SELECT flag AS node, 'price' AS feature, bin, count(*) AS cnt, round(sum(l_quantity), 2) AS g FROM (SELECT *, {_BUCKET} AS bin, CAST(l_returnflag = 'R' AS INTEGER) AS flag FROM lineitem) GROUP BY 1, 3"


@query(_HIST)
def bin_histogram(spark, d):
    return bins.histogram(_binned(spark, d), ["price"], {"cnt": F.lit(1), "g": F.col("l_quantity")}, F.col("flag")).withColumn("g", F.round("g", 2))


@query(f"SELECT node, feature, bin, CAST(sum(cnt) OVER w AS BIGINT) AS cnt, round(sum(g) OVER w, 2) AS g FROM ({_HIST}) WINDOW w AS (PARTITION BY node, feature ORDER BY bin)")
def bin_cumsum(spark, d):
    return bins.histogram(_binned(spark, d), ["price"], {"cnt": F.lit(1), "g": F.col("l_quantity")}, F.col("flag"), cumulative=True).withColumn("g", F.round("g", 2))


@query(f"WITH h AS ({_HIST}), p AS (SELECT feature, bin, sum(cnt) AS cnt FROM h GROUP BY 1, 2) SELECT p.feature, p.bin, CAST(p.cnt - coalesce(c.cnt, 0) AS BIGINT) AS cnt FROM p LEFT JOIN h c ON c.bin = p.bin AND c.node = 1")
def histogram_sibling(spark, d):
    h = bins.histogram(_binned(spark, d), ["price"], {"cnt": F.lit(1)}, F.col("flag"))
    return bins.sibling(h.groupBy("feature", "bin").agg(F.sum("cnt").alias("cnt")), h.where("node = 1"), ["cnt"])


@query("SELECT q, count(*) AS n, true AS within FROM lineitem, (SELECT unnest([0.01, 0.25, 0.5, 0.99]) AS q) GROUP BY q")
def quantile_sketch_of_batches(spark, d):
    """Sketches of three batches, merged: whether the rank of each value misses by 1% of the rows at most."""
    items = t(spark, d, "lineitem").select("l_extendedprice", F.pmod("l_orderkey", F.lit(3)).alias("batch"))
    parts = [sketch.merged(sketch.sketch(items.where(F.col("batch") == k), ["l_extendedprice"], 0.01), relative_error=0.01) for k in range(3)]
    found = sketch.quantiles(sketch.merged(*parts, relative_error=0.01), [0.01, 0.25, 0.5, 0.99])
    met = items.join(F.broadcast(found), F.lit(True))  # four rows
    low, high, rank = F.count_if(F.col("l_extendedprice") < F.col("value")) + 1, F.count_if(F.col("l_extendedprice") <= F.col("value")), F.greatest(F.lit(1), F.floor(F.col("q") * F.col("n")))
    return met.groupBy("q", "n").agg(low.alias("low"), high.alias("high")).select("q", "n", (F.greatest(F.col("low") - rank, rank - F.col("high")) <= 0.01 * F.col("n")).alias("within"))


def _labelled(spark, d):
    return psi_inner(spark, d)


def _woe(spark, d):
    joined = _labelled(spark, d)
    cuts = quantile.quantiles(joined, ["n_chars"], [i / 10 for i in range(1, 11)])
    lists = quantile.cut_lists(cuts, ["n_chars"], "q")
    return joined.withColumn("n_chars", bins.bucket(F.col("n_chars"), lists["n_chars"])), lists


_WOE = """
WITH j AS (SELECT l.doc_id, l.quality, CAST(d.n_chars AS DOUBLE) AS x FROM labels l JOIN documents d USING (doc_id)),
s AS (SELECT x, row_number() OVER (ORDER BY x) AS rn, count(*) OVER () AS n FROM j),
cuts AS (SELECT DISTINCT x AS c FROM s, (SELECT unnest(range(1, 11)) AS i) WHERE rn = greatest(1, CAST(floor(CAST(i AS DOUBLE) / 10 * n) AS BIGINT))),
inner_cuts AS (SELECT c FROM cuts WHERE c < (SELECT max(c) FROM cuts)),
b AS (SELECT j.doc_id, j.quality, CAST((SELECT count(*) FROM inner_cuts WHERE j.x > c) AS INTEGER) AS bin FROM j),
h AS (SELECT bin, count(*) FILTER (quality = 1) AS e, count(*) FILTER (quality <> 1) AS n FROM b GROUP BY 1),
r AS (SELECT bin, e, n, CASE WHEN e = 0 THEN 0.5 ELSE 0 END + e / CAST(greatest(sum(e) OVER (), 1) AS DOUBLE) AS er, CASE WHEN n = 0 THEN 0.5 ELSE 0 END + n / CAST(greatest(sum(n) OVER (), 1) AS DOUBLE) AS nr FROM h),
w AS (SELECT 'n_chars' AS feature, bin, e AS event_count, n AS non_event_count, er AS event_rate, nr AS non_event_rate, ln(er / nr) AS woe, (er - nr) * ln(er / nr) AS iv FROM r)
"""


@query(_WOE + "SELECT feature, bin, event_count, non_event_count, round(event_rate, 6) AS event_rate, round(non_event_rate, 6) AS non_event_rate, round(woe, 6) AS woe, round(iv, 6) AS iv FROM w")
def woe_iv_quantile(spark, d):
    return bins.woe_table(_woe(spark, d)[0], ["n_chars"], "quality").withColumns(r6("event_rate", "non_event_rate", "woe", "iv"))


@query(_WOE + "SELECT feature, round(sum(iv), 6) AS iv FROM w WHERE bin > 0 GROUP BY 1")
def column_iv(spark, d):
    return bins.column_iv(bins.woe_table(_woe(spark, d)[0], ["n_chars"], "quality")).withColumns(r6("iv"))


@query(_WOE + "SELECT feature, round(sum(iv), 6) AS iv FROM w WHERE bin > 0 GROUP BY 1")
def component_iv(spark, d):
    """IV as the binning component keeps it for selection."""
    binning = components.create("feature_binning", n_bins=10)
    binning.train(Frame.from_spark(_labelled(spark, d), "doc_id", label="quality", features=["n_chars"]))
    return spark.createDataFrame(list(binning.model["iv"].items()), "feature string, iv double").withColumns(r6("iv"))


@query(_WOE + "SELECT doc_id, quality, round(woe, 6) AS n_chars FROM b JOIN w USING (bin)")
def woe_transform(spark, d):
    binned, _ = _woe(spark, d)
    return bins.woe_transform(binned, ["n_chars"], bins.woe_table(binned, ["n_chars"], "quality")).withColumns(r6("n_chars"))


# Scaling, encoding, cells
@query("SELECT p_partkey, round((p_retailprice - a) / s, 6) AS p_retailprice FROM part, (SELECT avg(p_retailprice) AS a, stddev_samp(p_retailprice) AS s FROM part)")
def scale_standard(spark, d):
    return encode.standard_scale(t(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]).withColumns(r6("p_retailprice"))


@query("SELECT c_custkey, round((c_acctbal - a) / (b - a), 6) AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer)")
def scale_minmax(spark, d):
    return encode.min_max_scale(t(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], strict=False).withColumns(r6("c_acctbal"))


@query("SELECT c_custkey, round(greatest(least((c_acctbal - a) / (b - a), 1), 0), 6) AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer WHERE c_nationkey < 5)")
def scale_minmax_strict(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return encode.min_max_scale(c, ["c_acctbal"], fit_on=c.where("c_nationkey < 5")).withColumns(r6("c_acctbal")).drop("c_nationkey")


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS \"o_orderstatus_F\", CAST(o_orderstatus = 'O' AS INTEGER) AS \"o_orderstatus_O\", CAST(o_orderstatus = 'P' AS INTEGER) AS \"o_orderstatus_P\" FROM orders")
def onehot(spark, d):
    return Frame.from_spark(t(spark, d, "orders"), "o_orderkey", features=["o_orderstatus"]).get_dummies().df


@query("SELECT p_partkey, CASE p_size WHEN 1 THEN 100 WHEN 2 THEN 200 ELSE p_size END AS p_size FROM part")
def replace_map(spark, d):
    return part_frame(spark, d, ["p_size"]).replace({"p_size": {1: 100, 2: 200}}).df


@query("SELECT p_partkey, p_size IN (1, 5, 9) AS p_size FROM part")
def isin_list(spark, d):
    return part_frame(spark, d, ["p_size"]).isin([1, 5, 9]).df


@query("SELECT p_partkey, p_size IN (1, 5) AS p_size, false AS p_retailprice FROM part")
def isin_dict(spark, d):
    return part_frame(spark, d, ["p_size", "p_retailprice"]).isin({"p_size": [1, 5]}).df


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN p_size END AS p_size, CASE WHEN p_retailprice > 1000 THEN p_retailprice END AS p_retailprice FROM part")
def where_mask(spark, d):
    f = part_frame(spark, d, ["p_size", "p_retailprice"])
    return f[f > [20, 1000]].df


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, -1) AS c_acctbal FROM customer")
def fillna_dict(spark, d):
    c = t(spark, d, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return Frame.from_spark(c, "c_custkey", features=["c_acctbal"]).fillna({"c_acctbal": -1.0}).df


@query("SELECT p_partkey, round((p_size * 2.0 + 1) / p_retailprice, 6) AS p_size, round((p_retailprice * 2 + 1) / p_retailprice, 6) AS p_retailprice FROM part")
def arith_broadcast(spark, d):
    f = part_frame(spark, d, ["p_size", "p_retailprice"])
    return ((f * 2.0 + 1.0) / f["p_retailprice"]).df.withColumns(r6("p_size", "p_retailprice"))


@query("SELECT p_partkey, p_size * 40 > p_retailprice AS p_size FROM part")
def cmp_frame(spark, d):
    return (part_frame(spark, d, ["p_size"]) * 40 > part_frame(spark, d, ["p_retailprice"])).df


@query("SELECT p_partkey, round(1 / (1 + exp(-CAST(p_size AS DOUBLE))), 6) AS p_size FROM part")
def sigmoid(spark, d):
    return part_frame(spark, d, ["p_size"]).sigmoid().df.withColumns(r6("p_size"))


@query("SELECT p_partkey, p_size <= 20 AS p_size FROM part")
def invert_mask(spark, d):
    return (~(part_frame(spark, d, ["p_size"]) > 20)).df


# Rows
@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topk_first(spark, d):
    return encode.top_rows(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, ["o_totalprice"], "o_orderkey")


@query("SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 30")
def topk_ties(spark, d):
    return encode.top_rows(t(spark, d, "part").select("p_partkey", "p_size"), 30, ["p_size"], "p_partkey", "last")


@query("SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100")
def sample_exact(spark, d):
    return sampling.sample(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", n=100)


@query("SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels) WHERE rn <= greatest(1, CAST(trunc(n * CASE quality WHEN 0 THEN 0.5 ELSE 0.25 END) AS BIGINT))")
def sample_stratified(spark, d):
    return sampling.sample_by_label(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", {0: 0.5, 1: 0.25})


@query("SELECT o_orderkey, CASE WHEN rn <= round_even(n * 0.6, 0) THEN 'train' WHEN rn <= round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'validate' ELSE 'test' END AS split FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS rn, count(*) OVER () AS n FROM orders)")
def split_621(spark, d):
    return sampling.split(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.6, 0.2, 0.2)


@query()
def split_stratified(spark, d):
    return sampling.split(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", 0.6, 0.2, 0.2, label="quality")


@query("SELECT o_orderkey, CAST(CASE WHEN rn - 1 < (n % 5) * (n // 5 + 1) THEN (rn - 1) // (n // 5 + 1) ELSE n % 5 + (rn - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS rn, count(*) OVER () AS n FROM orders)")
def kfold5(spark, d):
    return sampling.k_fold(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1) // 128 AS batch_id FROM orders")
def batches(spark, d):
    return sampling.batches(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 128)


def _half(spark, d, odd):
    return Frame.from_spark(t(spark, d, "orders").where(F.col("o_orderkey") % 2 == odd), "o_orderkey", features=["o_totalprice"])


@query("SELECT o_orderkey, o_totalprice FROM orders")
def vstack(spark, d):
    return Frame.vstack([_half(spark, d, 0), _half(spark, d, 1)]).df


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def hstack(spark, d):
    return Frame.hstack([part_frame(spark, d, ["p_size"]), part_frame(spark, d, ["p_retailprice"])]).df


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0")
def drop_rows(spark, d):
    f = Frame.from_spark(t(spark, d, "orders"), "o_orderkey", features=["o_totalprice"])
    return f.drop(f.df.where("o_orderkey % 7 = 0")).df


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 = 0")
def loc_semi(spark, d):
    f = Frame.from_spark(t(spark, d, "orders"), "o_orderkey", features=["o_totalprice"])
    return f.loc(f.df.where("o_orderkey % 7 = 0")).df


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def iloc_mask(spark, d):
    return part_frame(spark, d, ["p_size"]).iloc(part_frame(spark, d, ["p_size"]) > 25).df


# Correlation
@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) + 0.0 AS corr FROM lineitem" for a in NUMBERS for b in NUMBERS))
def corr_matrix(spark, d):
    return stat.correlation(t(spark, d, "lineitem"), NUMBERS).withColumn("corr", F.round("corr", 6) + 0.0)


@query("SELECT round(corr(o_totalprice, c_acctbal), 6) AS corr FROM orders JOIN customer ON o_custkey = c_custkey")
def corr_cross_party(spark, d):
    both = align.align(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")], "o_orderkey", "o_custkey")
    return both.agg(F.round(F.corr("o_totalprice", "c_acctbal"), 6).alias("corr"))


@query()
def vif(spark, d):
    return stat.vif(t(spark, d, "lineitem"), NUMBERS).withColumns(r6("vif"))


@query("SELECT \"column\" FROM (SELECT 'p_size' AS \"column\", avg(p_size) AS v FROM part UNION ALL SELECT 'p_retailprice', avg(p_retailprice) FROM part) WHERE v >= 100")
def select_threshold(spark, d):
    means = stat.statistics(t(spark, d, "part"), ["p_size", "p_retailprice"], ["mean"]).select("column", "value")
    return encode.selected(means, "threshold", 100)


# Evaluation
_SCORED = "WITH s AS (SELECT l.doc_id, l.quality AS y, CAST(d.n_chars AS DOUBLE) / (SELECT max(n_chars) FROM documents) AS s FROM labels l JOIN documents d USING (doc_id))"


def _scored(spark, d):
    most = t(spark, d, "documents").agg(F.max("n_chars")).first()[0]
    return _labelled(spark, d).select("doc_id", F.col("quality").alias("y"), (F.col("n_chars").cast("double") / most).alias("s"))


@query(_SCORED + ", r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM s) SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1)), 6) AS auc FROM r")
def auc(spark, d):
    return evaluate.auc(_scored(spark, d), "s", "y").withColumns(r6("auc"))


_CUT = _SCORED + ", o AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS rn, count(*) OVER () AS n FROM s), cuts AS (SELECT CAST(c AS INTEGER) AS cut, s AS threshold FROM o, (SELECT unnest(range(0, 100)) AS c) WHERE rn = CAST(floor(n * (c / CAST(100 AS DOUBLE))) AS BIGINT) + 1), m AS (SELECT cut, threshold, count(*) FILTER (y = 1 AND s > threshold) AS tp, count(*) FILTER (y <> 1 AND s > threshold) AS fp, count(*) FILTER (y <> 1 AND s <= threshold) AS tn, count(*) FILTER (y = 1 AND s <= threshold) AS fn FROM s, cuts GROUP BY 1, 2) "


@query(_CUT + "SELECT cut, round(threshold, 6) AS threshold, tp, fp, tn, fn FROM m")
def confusion_100(spark, d):
    return evaluate.confusion_table(_scored(spark, d), "s", "y").withColumns(r6("threshold"))


@query(_CUT + "SELECT round(max(tp / (tp + fn) - fp / (fp + tn)), 6) AS ks FROM m")
def ks_100(spark, d):
    return evaluate.ks(_scored(spark, d), "s", "y").withColumns(r6("ks"))


# Distinct scores at descending index int(distinct * c), c = 0, 0.01 to 0.99; "ends" adds the least less 0.001 as cut 1.
_STEPS = _SCORED + """, u AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT s FROM s)),
steps AS (SELECT c * CAST(0.01 AS DOUBLE) AS cuts, s AS threshold FROM u, (SELECT unnest(range(0, 100)) AS c) WHERE rn = CAST(floor(n * (c * CAST(0.01 AS DOUBLE))) AS BIGINT) + 1),
ends AS (SELECT * FROM steps UNION ALL SELECT 1.0, min(threshold) - 0.001 FROM steps),
m AS (SELECT cuts, threshold, count(*) FILTER (y = 1 AND s > threshold) AS tp, count(*) FILTER (y <> 1 AND s > threshold) AS fp, count(*) FILTER (y <> 1 AND s <= threshold) AS tn, count(*) FILTER (y = 1 AND s <= threshold) AS fn FROM s, ends GROUP BY 1, 2) """


@query(_STEPS + "SELECT round(cuts, 6) AS cuts, round(threshold, 6) AS threshold, round(coalesce(tp / nullif(tp + fp, 0), 1), 6) AS p FROM m")
def precision_steps(spark, d):
    return evaluate.precision_table(_scored(spark, d), "s", "y").withColumns(r6("cuts", "threshold", "p"))


@query(_STEPS + "SELECT round(cuts, 6) AS cuts, round(threshold, 6) AS threshold, round(tp / (tp + fn), 6) AS r FROM m")
def recall_steps(spark, d):
    return evaluate.recall_table(_scored(spark, d), "s", "y").withColumns(r6("cuts", "threshold", "r"))


@query(_STEPS + "SELECT round(cuts, 6) AS cuts, round(threshold, 6) AS threshold, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM m WHERE cuts < 1")
def accuracy_steps(spark, d):
    return evaluate.accuracy_table(_scored(spark, d), "s", "y").withColumns(r6("cuts", "threshold", "accuracy"))


@query(_STEPS + "SELECT round(cuts, 6) AS cuts, round(threshold, 6) AS threshold, round((tn + fn) / (tp + fp + tn + fn), 6) AS lift_x_0, round(coalesce(tn / nullif(tn + fn, 0), 1) / ((tn + fp) / (tp + fp + tn + fn)), 6) AS lift_y_0, round((tp + fp) / (tp + fp + tn + fn), 6) AS lift_x_1, round(coalesce(tp / nullif(tp + fp, 0), 1) / ((tp + fn) / (tp + fp + tn + fn)), 6) AS lift_y_1 FROM m WHERE cuts < 1")
def lift_steps(spark, d):
    return evaluate.lift_table(_scored(spark, d), "s", "y").withColumns(r6("cuts", "threshold", "lift_x_0", "lift_y_0", "lift_x_1", "lift_y_1"))


@query(_STEPS + "SELECT round(cuts, 6) AS cuts, round(threshold, 6) AS threshold, round((tn + fn) / (tp + fp + tn + fn), 6) AS gain_x_0, round(tn / (tn + fp), 6) AS gain_y_0, round((tp + fp) / (tp + fp + tn + fn), 6) AS gain_x_1, round(tp / (tp + fn), 6) AS gain_y_1 FROM m WHERE cuts < 1")
def gain_steps(spark, d):
    return evaluate.gain_table(_scored(spark, d), "s", "y").withColumns(r6("cuts", "threshold", "gain_x_0", "gain_y_0", "gain_x_1", "gain_y_1"))


@query(_SCORED + " SELECT round(greatest(0, max(p / ap - n / an)), 6) AS ks FROM (SELECT sum(count(*) FILTER (y = 1)) OVER w AS p, sum(count(*) FILTER (y <> 1)) OVER w AS n FROM s GROUP BY s WINDOW w AS (ORDER BY s DESC)), (SELECT count(*) FILTER (y = 1) AS ap, count(*) FILTER (y <> 1) AS an FROM s)")
def ks_exact(spark, d):
    return evaluate.ks(_scored(spark, d), "s", "y", exact=True).withColumns(r6("ks"))


@query(_SCORED + ", c AS (SELECT CAST(c AS INTEGER) AS cut, c / CAST(100 AS DOUBLE) AS threshold FROM (SELECT unnest(range(0, 100)) AS c)), m AS (SELECT cut, threshold, count(*) FILTER (y = 1 AND s > threshold) AS tp, count(*) FILTER (y <> 1 AND s > threshold) AS fp, count(*) FILTER (y = 1 AND s <= threshold) AS fn FROM s, c GROUP BY 1, 2) SELECT cut, threshold, round(coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0), 6) AS f_score FROM m")
def fscore_table(spark, d):
    return evaluate.f_score_table(_scored(spark, d), "s", "y").withColumns(r6("f_score"))


@query(_SCORED + " SELECT round(avg(CAST((s > 0.05) = (y = 1) AS INTEGER)), 6) AS accuracy, round(count(*) FILTER (s > 0.05 AND y = 1) / count(*) FILTER (s > 0.05), 6) AS precision, round(count(*) FILTER (s > 0.05 AND y = 1) / count(*) FILTER (y = 1), 6) AS recall, round(2 * count(*) FILTER (s > 0.05 AND y = 1) / (count(*) FILTER (s > 0.05) + count(*) FILTER (y = 1)), 6) AS f1 FROM s")
def binary_metrics(spark, d):
    return evaluate.binary(_scored(spark, d), "s", "y", 0.05).withColumns(r6("accuracy", "precision", "recall", "f1"))


@query("SELECT round(avg(e * e), 4) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - avg(e * e) / var_pop(l_extendedprice), 4) AS r2 FROM (SELECT l_quantity * 1000 - l_extendedprice AS e, l_extendedprice FROM lineitem)")
def rmse_mae_r2(spark, d):
    rows = t(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1000)
    return evaluate.regression(rows, "p", "l_extendedprice").select(*[F.round(c, 4).alias(c) for c in ("mse", "rmse", "mae", "r2")])


@query("WITH p AS (SELECT vec_id % 10 AS p, label AS y FROM embeddings), k AS (SELECT y AS k, count(*) AS ny, count(*) FILTER (p = y) AS hit FROM p GROUP BY 1), q AS (SELECT p AS k, count(*) AS np FROM p GROUP BY 1) SELECT round((SELECT avg(CAST(p = y AS INTEGER)) FROM p), 6) AS accuracy, round(avg(coalesce(hit / np, 0)), 6) AS precision, round(avg(coalesce(hit / ny, 0)), 6) AS recall FROM k FULL JOIN q USING (k)")
def multi_metrics(spark, d):
    return evaluate.multi(t(spark, d, "embeddings").withColumn("p", F.col("vec_id") % 10), "p", "label").withColumns(r6("accuracy", "precision", "recall"))


@query(_SCORED + """, e AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM s WHERE doc_id % 2 = 0),
q AS (SELECT DISTINCT s AS c FROM e, (SELECT unnest(range(0, 21)) AS k) WHERE i = CAST(round_even(CASE k WHEN 20 THEN 1.0 ELSE round(k * CAST(0.05 AS DOUBLE), 3) END * (n - 1), 0) AS BIGINT)),
edges AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS b, count(*) OVER () AS k FROM q),
placed AS (SELECT doc_id % 2 AS side, (SELECT least(max(b), max(k) - 2) FROM edges WHERE c <= s.s) AS b FROM s WHERE s.s BETWEEN (SELECT min(c) FROM q) AND (SELECT max(c) FROM q)),
shares AS (SELECT b, (SELECT count(*) FROM placed p WHERE p.b = r.b AND side = 0) / (SELECT count(*) FROM s WHERE doc_id % 2 = 0) AS e, (SELECT count(*) FROM placed p WHERE p.b = r.b AND side = 1) / (SELECT count(*) FROM s WHERE doc_id % 2 = 1) AS a FROM (SELECT b FROM edges WHERE b < k - 1) r)
SELECT round(sum((greatest(a, 1e-6) - greatest(e, 1e-6)) * ln(greatest(a, 1e-6) / greatest(e, 1e-6))), 6) AS psi FROM shares""")
def psi_metric(spark, d):
    s = _scored(spark, d)
    return evaluate.population_stability(s.where("doc_id % 2 = 0"), s.where("doc_id % 2 = 1"), "s").withColumns(r6("psi"))


# Tensors and learners
@query("SELECT round(sum(l_quantity * l_quantity), 2) AS g_0_0, round(sum(l_quantity * l_discount), 2) AS g_0_1, round(sum(l_discount * l_discount), 2) AS g_1_1, round(sum(l_quantity * l_extendedprice), 0) AS b_0, round(sum(l_discount * l_extendedprice), 0) AS b_1 FROM lineitem")
def gram_matrix(spark, d):
    g = glm.gram(t(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return g.select(*[F.round(c, 2 if c[0] == "g" else 0).alias(c) for c in g.columns])


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def linr_normal_eq(spark, d):
    w = glm.fit_linear(t(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(w["l_quantity"], 4), round(w["intercept"], 3))], "slope double, intercept double")


@query()
def lr_mini_batch(spark, d):
    """A logistic model by Adam over batches of 64 rows, two epochs and, from its kept state, two more."""
    rows, options = _scored(spark, d), {"method": "adam", "lr": 0.1, "penalty": "l2", "alpha": 0.01}
    first = glm.fit_mini_batch(rows, ["s"], "y", "doc_id", 64, 2, **options)
    model = glm.fit_mini_batch(rows, ["s"], "y", "doc_id", 64, 2, warm_start=first, **options)
    return spark.createDataFrame([(c, round(v, 6)) for c, v in model["weights"].items()], "column string, weight double")


@query(_SCORED + ", z AS (SELECT s, CASE WHEN y = 1 THEN 1.0 ELSE -1.0 END AS y, s * 0.5 + 0.1 AS xw FROM s) SELECT round(avg(ln(2) - 0.5 * y * xw + 0.125 * xw * xw), 6) AS loss, round(avg((xw / 4 - y / 2) * s), 6) AS grad_s, round(avg(xw / 4 - y / 2), 6) AS grad_intercept FROM z")
def lr_taylor_step(spark, d):
    return glm.logistic_gradient(_scored(spark, d), ["s"], "y", {"s": 0.5, "intercept": 0.1}).withColumns(r6("loss", "grad_s", "grad_intercept"))


@query("SELECT CAST(i - 1 AS INTEGER) AS col, round(sum(x), 4) AS sum, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS var, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max FROM (SELECT unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1")
def tensor_columns(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v"))
    return tensor.by_column(e).withColumns(r6("mean", "var", "std", "min", "max")).withColumn("sum", F.round("sum", 4))


@query("SELECT vec_id AS row_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS sum FROM embeddings")
def tensor_square_sum(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v"))
    return tensor.by_row(tensor.unary(e, "square")).select("row_id", F.round("sum", 5).alias("sum"))


@query("WITH c AS (SELECT c_nationkey AS party, count(*) AS w, avg(c_acctbal) AS v FROM customer GROUP BY 1) SELECT round(sum(w * v) / sum(w), 4) AS v, count(*) AS parties FROM c")
def secure_weighted_mean(spark, d):
    by_party = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("party")).agg(F.count("*").alias("w"), F.avg("c_acctbal").alias("v"))
    return glm.weighted_mean(by_party, "party", "w", ["v"]).withColumn("v", F.round("v", 4))


_GH = "WITH x AS (SELECT CAST(l_extendedprice > 1000 AS INTEGER) + CAST(l_extendedprice > 5000 AS INTEGER) + CAST(l_extendedprice > 20000 AS INTEGER) AS bin, 0.5 - CAST(l_returnflag = 'R' AS INTEGER) AS g FROM lineitem)"


@query(_GH + ", c AS (SELECT bin, sum(sum(g)) OVER w AS g, sum(count(*)) OVER w AS n FROM x GROUP BY 1 WINDOW w AS (ORDER BY bin)), a AS (SELECT sum(g) AS ga, count(*) AS na FROM x), k AS (SELECT bin, g * g / (n * 0.25 + 0.1) + (ga - g) * (ga - g) / ((na - n) * 0.25 + 0.1) - ga * ga / (na * 0.25 + 0.1) AS gain FROM c, a WHERE n < na) SELECT bin, round(floor(gain * 1e10) / 1e10, 4) AS gain FROM k ORDER BY gain DESC, bin LIMIT 1")
def gbdt_best_split(spark, d):
    rows = _binned(spark, d).withColumns({"g": 0.5 - F.col("flag"), "h": F.lit(0.25)})
    gains = gbdt.split_gains(rows, ["price"], F.lit(0), F.col("g").cast("double"), F.col("h").cast("double"))
    return gains.orderBy(F.desc("gain"), "bin").limit(1).select("bin", F.round("gain", 4).alias("gain"))


@query()
def gbdt_predict(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.year("o_orderdate").alias("year"))
    model = gbdt.fit(rows, ["o_totalprice", "year"], "y", num_trees=2, max_depth=2)
    return model.predict(rows).select("o_orderkey", F.round("predict_score", 6).alias("predict_score"))


@query("SELECT doc_id, round(s, 6) AS predict_score, CAST(s > 0.05 AS INTEGER) AS predict_result FROM (" + _SCORED + " SELECT * FROM s)")
def predict_detail(spark, d):
    out = evaluate.predict_detail(_scored(spark, d), F.col("s"), 0.05)
    return out.select("doc_id", F.round("predict_score", 6).alias("predict_score"), "predict_result")


@query("WITH g AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM labels) SELECT doc_id, n_chars, CASE WHEN rn <= round_even(n * 0.7, 0) THEN 'train' ELSE 'test' END AS split FROM g JOIN documents USING (doc_id)")
def split_followed_by_host(spark, d):
    """The host's rows of the parts into which the guest has split its own."""
    exchange = Exchange(spark)
    leader = follow.Leader(exchange, t(spark, d, "labels"), "doc_id", "doc_id", ["host"])
    host = follow.Follower(exchange, "host", t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    leader.select("split", follow.split_ranges(leader.total, 0.7, 0.0, 0.3))
    parts = host.select("split")
    return parts["train"].withColumn("split", F.lit("train")).unionByName(parts["test"].withColumn("split", F.lit("test"))).drop(follow.NUMBER)


# Further samples, selections, tensors and learners
@query("WITH o AS (SELECT o_totalprice, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS rn, count(*) OVER () AS n FROM orders), d AS (SELECT i, CAST('0x' || substr(md5('42:' || i), 1, 12) AS BIGINT) AS h FROM (SELECT unnest(range(1, 201)) AS i)) SELECT sha256('42:' || i) AS o_orderkey, o_totalprice FROM d JOIN o ON rn = h % n + 1")
def sample_replacement(spark, d):
    return sampling.resample(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 200)


_MEANS = "WITH m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, avg({c}) AS v, stddev_samp({c}) AS s FROM lineitem" for c in NUMBERS) + ") "


def _metric(spark, d, name):
    return stat.statistics(t(spark, d, "lineitem"), NUMBERS, [name]).select("column", "value")


@query(_MEANS + "SELECT c AS \"column\" FROM (SELECT c, row_number() OVER (ORDER BY v DESC, c) AS a, row_number() OVER (ORDER BY s DESC, c) AS b FROM m) WHERE a <= 3 AND b <= 2")
def select_chain(spark, d):
    return encode.selected_by_all([encode.selected(_metric(spark, d, "mean"), "top_k", 3), encode.selected(_metric(spark, d, "std"), "top_percentile", 0.5)])


@query(_MEANS + "SELECT c AS \"column\" FROM m ORDER BY v DESC, c LIMIT 1")
def select_keep_one(spark, d):
    means = _metric(spark, d, "mean")
    return encode.selected_by_all([encode.selected(means, "threshold", 1e12)], means)


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 5000")
def kv_filter(spark, d):
    return kv.filter_values(t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), F.col("v") > 5000)


@query("SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total, max(c_acctbal) AS most FROM customer")
def kv_reduce(spark, d):
    return kv.reduce_all(t(spark, d, "customer"), {"n": F.count("*"), "total": F.round(F.sum("c_acctbal"), 2), "most": F.max("c_acctbal")})


@query("SELECT p_partkey, p_size < 20 AS size, p_retailprice < 20 AS p_retailprice, false AS twice FROM part")
def rename_assign(spark, d):
    f = part_frame(spark, d, ["p_size", "p_retailprice"]).rename({"p_size": "size"})
    return (f.assign({"twice": F.col("size") * 2 + 100}) < 20).df


@query("SELECT c_custkey, c_acctbal < 0 AS c_acctbal FROM customer")
def isna_mask(spark, d):
    c = t(spark, d, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return Frame.from_spark(c, "c_custkey", features=["c_acctbal"]).isna().df


def _vectors(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v"))


@query("SELECT vec_id AS row_id, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * ((i - 1) % 3))), 5) + 0.0 AS a, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * ((i - 1) % 3 - 1))), 5) + 0.0 AS b FROM embeddings")
def tensor_matmul(spark, d):
    out = tensor.matmul_local(_vectors(spark, d), [[float(i % 3 - j) for j in range(2)] for i in range(64)])
    return out.select("row_id", *[(F.round(F.get("v", j), 5) + 0.0).alias(n) for j, n in enumerate("ab")])


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(CAST(embedding[i + 1] AS DOUBLE) * CAST(embedding[j + 1] AS DOUBLE)), 4) + 0.0 AS value FROM embeddings, (SELECT unnest(range(0, 64)) AS i), (SELECT unnest(range(0, 64)) AS j) WHERE i <= j GROUP BY 1, 2")
def tensor_gram(spark, d):
    return tensor.gram(_vectors(spark, d)).withColumn("value", F.round("value", 4) + 0.0)


@query("SELECT CAST(i - 1 AS INTEGER) AS i, vec_id AS j, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)")
def tensor_transpose(spark, d):
    return tensor.coordinates(_vectors(spark, d), transposed=True)


_PARTY = _SCORED + ", z AS (SELECT doc_id % 4 AS party, s, CASE WHEN y = 1 THEN 1.0 ELSE -1.0 END AS y, s * 0.5 + 0.1 AS xw FROM s), g AS (SELECT party, count(*) AS n, avg(ln(2) - 0.5 * y * xw + 0.125 * xw * xw) AS loss, avg((xw / 4 - y / 2) * s) AS grad_s, avg(xw / 4 - y / 2) AS grad_intercept FROM z GROUP BY 1) "


def _party_gradients(spark, d):
    return glm.logistic_gradient(_scored(spark, d).withColumn("party", F.col("doc_id") % 4), ["s"], "y", {"s": 0.5, "intercept": 0.1}, by=("party",))


@query(_PARTY + "SELECT party, n, round(loss, 6) AS loss, round(grad_s, 6) AS grad_s, round(grad_intercept, 6) AS grad_intercept FROM g")
def homo_lr_gradients(spark, d):
    return _party_gradients(spark, d).withColumns(r6("loss", "grad_s", "grad_intercept"))


@query(_PARTY + "SELECT round(sum(n * grad_s) / sum(n), 6) AS grad_s, round(sum(n * grad_intercept) / sum(n), 6) AS grad_intercept, count(*) AS parties FROM g")
def homo_lr_step(spark, d):
    return glm.weighted_mean(_party_gradients(spark, d), "party", "n", ["grad_s", "grad_intercept"]).withColumns(r6("grad_s", "grad_intercept"))


@query(_SCORED + ", b AS (SELECT doc_id % 3 AS type, s > 0.05 AS hit, y = 1 AS yes FROM s) SELECT type, round(avg(CAST(hit = yes AS INTEGER)), 6) AS accuracy, round(coalesce(count(*) FILTER (hit AND yes) / nullif(count(*) FILTER (hit), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (hit AND yes) / nullif(count(*) FILTER (yes), 0), 0), 6) AS recall, round(coalesce(2 * count(*) FILTER (hit AND yes) / nullif(count(*) FILTER (hit) + count(*) FILTER (yes), 0), 0), 6) AS f1 FROM b GROUP BY 1")
def binary_metrics_by_type(spark, d):
    return evaluate.binary(_scored(spark, d).withColumn("type", F.col("doc_id") % 3), "s", "y", 0.05, by=("type",)).withColumns(r6("accuracy", "precision", "recall", "f1"))


@query(_SCORED + ", o AS (SELECT doc_id, row_number() OVER (ORDER BY s - y DESC, md5('42:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM s), k AS (SELECT doc_id, n, r <= trunc(n * 0.2) AS top FROM o) SELECT doc_id, top FROM (SELECT *, row_number() OVER (PARTITION BY top ORDER BY md5('42:' || doc_id), doc_id) AS q FROM k) WHERE top OR q <= trunc(n * 0.1)")
def goss_sample(spark, d):
    return gbdt.goss(_scored(spark, d).withColumn("g", F.col("s") - F.col("y")), "doc_id", "g").select("doc_id", "top")


@query("WITH k AS (SELECT fold, o_totalprice AS y, o_custkey AS x FROM (" + _sql["kfold5"] + ") JOIN orders USING (o_orderkey)), w AS (SELECT f.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS fold) f JOIN k ON k.fold <> f.fold GROUP BY 1) SELECT k.fold, count(*) AS n, round(sqrt(avg(pow(y - a * x - b, 2))), 2) AS rmse FROM k JOIN w USING (fold) GROUP BY 1")
def cv_linear(spark, d):
    folds = sampling.k_fold(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 5)
    return validate.cross_validate_linear(folds, ["o_custkey"], "o_totalprice", "fold").withColumn("rmse", F.round("rmse", 2))


@query()
def one_vs_rest(spark, d):
    rows = t(spark, d, "embeddings").select("vec_id", "label", *[F.get("embedding", i).cast("double").alias(f"x{i}") for i in range(64)])
    models = glm.fit_one_vs_rest(rows, [f"x{i}" for i in range(64)], "label", list(range(10)))
    return glm.predict_class(rows, models).select("vec_id", "predict_result")


# Functions of rows, values and partitions
@query("SELECT 'c' || c_nationkey || '-' || c_custkey AS key, round(c_acctbal * 2 + 1, 2) AS v FROM customer")
def kv_map_rows(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return kv.map_rows(c, lambda r: (f"c{r['c_nationkey']}-{r['c_custkey']}", round(r["c_acctbal"] * 2 + 1, 2)), "key string, v double")


@query("SELECT c_custkey AS k, CAST(c_acctbal >= 0 AS INTEGER) AS sign, round(abs(c_acctbal), 2) AS v FROM customer")
def kv_map_values_function(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    return kv.map_values_with(c, "k", lambda r: (int(r["c_acctbal"] >= 0), round(abs(r["c_acctbal"]), 2)), "sign int, v double")


@query("SELECT o_orderkey AS k FROM orders WHERE length(o_orderstatus) + o_custkey % 5 > 3")
def kv_filter_function(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_custkey")
    return kv.filter_with(o, lambda r: len(r["o_orderstatus"]) + r["o_custkey"] % 5 > 3).select("k")


@query("SELECT o_orderkey AS k, unnest(range(0, CAST(o_custkey % 3 AS BIGINT))) AS v FROM orders")
def kv_flat_map_function(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return kv.flat_map_with(o, lambda r: ((r["o_orderkey"], i) for i in range(r["o_custkey"] % 3)), "k long, v long")


@query("SELECT o_custkey % 11 AS k, sum(o_orderkey) + max(length(o_orderstatus)) - max(length(o_orderstatus)) AS v FROM orders GROUP BY 1")
def kv_map_reduce_partitions(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey")
    return kv.map_reduce_partitions(o, lambda r: [(r["o_custkey"] % 11, r["o_orderkey"])], lambda a, b: a + b, "k long, v long")


@query("SELECT o_orderkey AS k, o_totalprice * 2 AS v FROM orders")
def kv_map_partitions(spark, d):
    def twice(frames):
        for f in frames:
            yield f.assign(v=f["v"] * 2)

    return kv.map_partitions(t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")), twice, "k long, v double")


@query("SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(v), 2) AS v FROM (SELECT count(*) AS n, sum(o_totalprice) AS v FROM orders)")
def kv_apply_partitions(spark, d):
    one = kv.apply_partitions(t(spark, d, "orders"), {"n": F.count("*"), "v": F.sum("o_totalprice")})
    return one.agg(F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("v"))


@query(_SIDES + "SELECT coalesce(l.k, r.k) AS k, CASE WHEN l.k IS NULL THEN -r.v ELSE l.v END AS v FROM l FULL JOIN r ON l.k = r.k WHERE l.k IS NULL OR r.k IS NULL")
def kv_sorted_merge(spark, d):
    return kv.sorted_merge(*_sides(spark, d), "k", left_only=lambda a: a, right_only=lambda b: -b)


@query("SELECT p_partkey, p_size + length(p_brand) AS a, p_size % 7 AS b FROM part")
def apply_row_function(spark, d):
    f = part_frame(spark, d, ["p_size", "p_brand"])
    return f.apply_row(lambda r: (r["p_size"] + len(r["p_brand"]), r["p_size"] % 7), "x long, y long", columns=["a", "b"]).df


@query("SELECT p_partkey, p_retailprice AS price, p_size AS label FROM part")
def label_assigned(spark, d):
    f = part_frame(spark, d, ["p_retailprice"]).rename({"p_retailprice": "price"})
    return f.with_role("label", part_frame(spark, d, ["p_size"])).df


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part")
def promoted_types(spark, d):
    return part_frame(spark, d, ["p_size", "p_retailprice"]).promoted().df


@query("SELECT p_partkey AS row_id, unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS x FROM part")
def frame_as_tensor(spark, d):
    return part_frame(spark, d, ["p_size", "p_retailprice"]).as_tensor().select("row_id", F.explode("v").alias("x"))


# Components
@query("SELECT p_partkey, round((p_size - a) / (b - a) * 4 - 2, 6) AS p_size, p_retailprice FROM part, (SELECT min(p_size) AS a, max(p_size) AS b FROM part)")
def component_scale(spark, d):
    made = components.create("feature_scale", method="min_max", scale_col=["p_size"], feature_range={"p_size": (-2, 2)})
    return made.train(part_frame(spark, d, ["p_size", "p_retailprice"])).df.withColumns(r6("p_size"))


@query("SELECT p_partkey, CASE WHEN p_size IS NULL THEN NULL ELSE CAST(p_size > 10 AS INTEGER) + CAST(p_size > 30 AS INTEGER) END AS p_size, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand FROM part")
def component_binning_manual(spark, d):
    made = components.create("feature_binning", method="manual", bin_col=["p_size"], category_col=["p_brand"], split_pt_dict={"p_size": [10, 30, 50]}, transform_method="bin_idx")
    return made.train(part_frame(spark, d, ["p_size", "p_brand"])).df


@query("WITH k AS (" + _sql["kfold5"] + "), j AS (SELECT fold, o_totalprice AS y, o_custkey AS x FROM k JOIN orders USING (o_orderkey)), w AS (SELECT f.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS fold) f JOIN j ON j.fold <> f.fold GROUP BY 1) SELECT j.fold, 'rmse' AS metric, round(sqrt(avg(pow(y - a * x - b, 2))), 2) AS value FROM j JOIN w USING (fold) GROUP BY 1")
def component_cross_validation(spark, d):
    f = Frame.from_spark(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", label="o_totalprice")
    return components.create("linear_regression").cross_validation(f, 5).where("metric = 'rmse'").withColumn("value", F.round("value", 2))


# Tensors that meet
@query("SELECT vec_id AS row_id, CAST(i - 1 AS INTEGER) AS col, round(CAST(embedding[i] AS DOUBLE) - CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)")
def tensor_broadcast(spark, d):
    v = _vectors(spark, d)
    return tensor.binary(v, tensor.columns(v, [0]), "sub").select("row_id", F.posexplode("v").alias("col", "x")).withColumn("x", F.round("x", 6) + 0.0)


@query("SELECT vec_id AS row_id, CAST(i - 1 AS INTEGER) AS col, CAST(round(CAST(embedding[i] AS DOUBLE) * 1024) AS BIGINT) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)")
def tensor_fixed_point(spark, d):
    return tensor.fixed_point(_vectors(spark, d), 10).select("row_id", F.posexplode("v").alias("col", "x"))


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(CAST(embedding[i + 1] AS DOUBLE) * CAST(embedding[j + 1] AS DOUBLE)), 4) + 0.0 AS x FROM embeddings, (SELECT unnest(range(0, 64)) AS i), (SELECT unnest(range(0, 64)) AS j) GROUP BY 1, 2")
def tensor_matmul_distributed(spark, d):
    v = _vectors(spark, d)
    own = tiles.from_rows(v)
    made = tiles.cells(tiles.product(tiles.transposed(own), own))  # the transpose, whose rows are as long as the table
    return made.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (F.round("x", 4) + 0.0).alias("x"))


@query("SELECT vec_id // 100 AS shard, CAST(i - 1 AS INTEGER) AS col, round(sum(CAST(embedding[i] AS DOUBLE)), 5) + 0.0 AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2")
def tensor_shards(spark, d):
    return tensor.map_reduce(_vectors(spark, d), lambda v: v, "add", 100).withColumn("x", F.round("x", 5) + 0.0)


# Extensions: the reference has no event-time operators.
@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark, d):
    return streams.tumbling(t(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def ext_session(spark, d):
    return streams.sessions(t(spark, d, "events"))
