"""Histogram gradient boosting: one pass over the rows for each layer of a tree.

Binned features, labels and scores are written after each tree, so the plan does not grow with the trees. Partitions add up dense
histograms (operators.dense); those of a layer, whose size is that of the schema, are scanned by NumPy for the best splits. Of two
children only the smaller one's histogram comes from rows; the other is its parent's less that. A missing value goes right.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..names import free, quoted
from ..operators.bins import bucket, histogram
from ..operators.dense import dense_sums
from ..operators.quantile import at_ranks, cut_lists, quantiles
from ..operators.sampling import numbered
from ..storage import kept
from .forest import Forest

#: Nodes of a layer whose histograms are added up in one pass.
NODES_AT_ONCE = 64


def gradients(objective: str, score: Column, label: Column) -> tuple[Column, Column]:
    if objective == "binary:bce":
        p = 1 / (1 + F.exp(-score))
        return p - label, p * (1 - p)
    if objective == "regression:l2":
        return 2 * (score - label), F.lit(2.0)
    raise ValueError(f"unknown objective {objective}")


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    parts = [F.exp(s - top) for s in scores]
    whole = sum(parts[1:], parts[0])
    return [x / whole for x in parts]


def class_gradients(scores: list[Column], label: Column) -> list[tuple[Column, Column]]:
    """Of the cross-entropy of a softmax, for each class (labels 0, 1, ...)."""
    return [(p - (label == k).cast("double"), 2 * p * (1 - p)) for k, p in enumerate(softmax(scores))]


def goss(df: DataFrame, sample_id: str, g: str, top: float = 0.2, other: float = 0.1, by: str = "signed", seed: int = 42) -> DataFrame:
    """int(rows * top) rows of largest gradient (``by``: signed or abs) and int(rows * other) of the rest, with column ``top``.

    The gradient of the last top row is found by rank, so the rows aren't sorted; ties go in digest order.
    """
    n = df.count()
    k, m = int(n * top), int(n * other)
    p = free(df)
    own, side = f"{p}g", f"{p}side"
    d = df.withColumn(own, (F.col(g) if by == "signed" else F.abs(g)).cast("double"))
    found = at_ranks(d, [own], lambda _, rows: [(0, max(1, rows - k + 1))]).first() if k else None
    least = F.lit(found["value"] if found else float("inf"))
    over = d.where(F.col(own) > least).count()
    d = numbered(d.withColumn(side, F.when(F.col(own) > least, 2).when(F.col(own) == least, 1).otherwise(0)), sample_id, seed, [side])
    d = d.withColumn("top", (F.col(side) == 2) | ((F.col(side) == 1) & (F.col("_n") <= k - over))).drop("_n")
    return numbered(d, sample_id, seed, ["top"]).where(F.col("top") | (F.col("_n") <= m)).drop("_n", side, own)


def shrunk(g, l1: float):
    """Soft threshold of a sum of gradients; columns or numbers."""
    if isinstance(g, Column):
        return g if l1 == 0 else F.when(g > l1, g - l1).when(g < -l1, g + l1).otherwise(0.0)
    return math.copysign(max(abs(g) - l1, 0.0), g)


def floored(x):
    return F.floor(x * 1e10) / 1e10 if isinstance(x, Column) else math.floor(x * 1e10) / 1e10


def gains(hist: DataFrame, l1: float = 0.0, l2: float = 0.1) -> DataFrame:
    """(node, feature, bin, gain, sums) of each split "bin or below goes left" of histograms, floored to 10 decimals."""
    values = ["g", "h", "cnt"]
    along = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = hist.select("node", "feature", "bin", *[F.sum(v).over(along).alias(v) for v in values])
    whole = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = c.withColumns({f"{v}_all": F.last(v).over(whole) for v in values})

    def part(a: Column, b: Column) -> Column:
        a, b = shrunk(floored(a), l1), floored(b)
        return F.try_divide(a * a, b + l2)

    gain = part(F.col("g"), F.col("h")) + part(F.col("g_all") - F.col("g"), F.col("h_all") - F.col("h")) - part(F.col("g_all"), F.col("h_all"))
    out = c.withColumn("gain", floored(gain)).where("cnt < cnt_all")
    return out.select("node", "feature", "bin", "gain", "g", "h", "cnt", "g_all", "h_all", "cnt_all")


def split_gains(df: DataFrame, features: list[str], node: Column, g: Column, h: Column, l2: float = 0.1, l1: float = 0.0) -> DataFrame:
    return gains(histogram(df, features, {"g": g, "h": h, "cnt": F.lit(1)}, node), l1, l2)


@dataclass
class Limits:
    """What a split must keep to."""

    max_depth: int = 3
    l1: float = 0.0
    l2: float = 0.1
    min_gain: float = 0.01
    min_leaf: int = 1
    min_child_weight: float = 1.0
    min_sample_split: int = 2

    def weight(self, g: float, h: float) -> float:
        return floored(-shrunk(g, self.l1) / (h + self.l2))


@dataclass
class Model:
    cuts: dict[str, list[float]]
    learning_rate: float
    objective: str
    start: float
    classes: int = 1
    trees: list[dict] = field(default_factory=list)  # node: (feature, bin, left, right, gain) or its weight; class k has trees k, k + classes, ...

    def to_dict(self) -> dict:
        """Plain values for JSON; ``from_dict`` makes the same model of them."""
        trees = [[[n, *(list(here) if isinstance(here, tuple) else [here])] for n, here in sorted(t.items())] for t in self.trees]
        cuts = {f: [None if math.isinf(x) else x for x in c] for f, c in self.cuts.items()}
        return {"cuts": cuts, "learning_rate": self.learning_rate, "objective": self.objective, "start": self.start, "classes": self.classes, "trees": trees}

    @classmethod
    def from_dict(cls, values: dict) -> Model:
        trees = [{n: tuple(here) if len(here) > 1 else float(here[0]) for n, *here in t} for t in values["trees"]]
        cuts = {f: [math.inf if x is None else x for x in c] for f, c in values["cuts"].items()}
        return cls(cuts, values["learning_rate"], values["objective"], values["start"], values["classes"], trees)

    def leaf(self, tree: dict, binned: dict[str, Column], node: int = 0) -> Column:
        """The weight of a row's leaf in one tree, from columns of bins."""
        here = tree[node]
        if not isinstance(here, tuple):
            return F.lit(float(here))
        f, b, left, right = here[:4]
        return F.when(binned[f] <= b, self.leaf(tree, binned, left)).otherwise(self.leaf(tree, binned, right))

    def scores(self) -> list[Column]:
        """Raw scores, one for each class of a multi-class model."""
        raw = Forest(self).raw()
        return [F.get(raw, k) for k in range(self.classes)]

    def probabilities(self) -> list[Column]:
        s = self.scores()
        return softmax(s) if self.classes > 1 else [1 / (1 + F.exp(-s[0]))] if self.objective == "binary:bce" else s

    def predict(self, df: DataFrame, name: str = "predict_score") -> DataFrame:
        """The probability (or value); of several classes the highest, with column ``predict_result`` for its class."""
        p = self.probabilities()
        if self.classes == 1:
            return df.withColumn(name, p[0])
        best = F.greatest(*p)
        return df.withColumns({name: best, "predict_result": F.coalesce(*[F.when(x == best, F.lit(k)) for k, x in enumerate(p)])})

    def importance(self, kind: str = "split") -> dict[str, float]:
        """By feature the number of splits, or the sum of their gains (``gain``)."""
        out: dict[str, float] = {}
        for tree in self.trees:
            for here in tree.values():
                if isinstance(here, tuple):
                    out[here[0]] = out.get(here[0], 0) + (1 if kind == "split" else here[4])
        return out


def best_split(hist: np.ndarray, starts: np.ndarray, limits: Limits) -> tuple | None:
    """(feature, bin, gain, sums left, sums right) of the best split "bin or below goes left"; of equal gains, of the first feature and least bin."""
    total = hist[:, : starts[1]].sum(1)
    if total[2] < limits.min_sample_split:
        return None
    left = np.cumsum(hist, axis=1)
    before = np.concatenate([np.zeros((3, 1)), left], axis=1)[:, starts[:-1]]
    left = left - np.repeat(before, np.diff(starts), axis=1)
    right = total[:, None] - left

    def part(sums: np.ndarray) -> np.ndarray:
        g = np.floor(sums[0] * 1e10) / 1e10
        g = np.sign(g) * np.maximum(np.abs(g) - limits.l1, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return g * g / (np.floor(sums[1] * 1e10) / 1e10 + limits.l2)

    gain = np.floor((part(left) + part(right) - part(total)) * 1e10) / 1e10
    least = max(1, limits.min_leaf)
    able = (left[2] >= least) & (right[2] >= least) & (left[1] >= limits.min_child_weight) & (right[1] >= limits.min_child_weight) & (gain >= limits.min_gain)
    able[starts[1:] - 1] = False
    if not able.any():
        return None
    at = int(np.argmax(np.where(able, gain, -np.inf)))
    k = int(np.searchsorted(starts, at, side="right")) - 1
    return k, at - int(starts[k]), float(gain[at]), left[:, at], right[:, at]


def grow(rows: DataFrame, features: dict[str, str], cuts: dict[str, list[float]], g: Column, h: Column, limits: Limits) -> dict:
    """One tree; ``features`` names the column of integer bins of each, ``cuts`` has their upper ends."""
    names, columns = list(features), list(features.values())
    node_of = f"{free(rows)}node"
    values = {"g": g, "h": h, "cnt": F.lit(1)}
    shape = {c: (0, len(cuts[f])) for f, c in features.items()}
    starts = np.concatenate([[0], np.cumsum([len(cuts[f]) + 1 for f in names])])
    tree: dict = {0: 0.0}
    at = {f: F.col(b) for f, b in features.items()}

    def place(n: int = 0) -> Column:
        """The node where a row stands."""
        here = tree[n]
        return F.when(at[here[0]] <= here[1], place(here[2])).otherwise(place(here[3])) if isinstance(here, tuple) else F.lit(n)

    def sums(nodes: list[int]) -> dict[int, np.ndarray]:
        """g, h and cnt of each node by place; the last place of a feature is for missing values."""
        out = {n: np.zeros((3, starts[-1])) for n in nodes}
        for low in range(0, len(nodes), NODES_AT_ONCE):
            own = nodes[low : low + NODES_AT_ONCE]
            some = rows if own == [0] else rows.withColumn(node_of, place()).where(F.col(node_of).isin(own))
            found = dense_sums(some, columns, shape, values, F.lit(0) if own == [0] else F.col(node_of)).toArrow()  # a row for each cell of these nodes
            node, feature = found.column("node").to_numpy(), found.column("place").to_numpy()
            bin_ = found.column("bin").fill_null(-1).to_numpy()
            cell = starts[feature] + np.where(bin_ < 0, np.diff(starts)[feature] - 1, bin_)
            for n in own:
                mine = node == n
                out[n][:, cell[mine]] = [found.column(v).to_numpy()[mine] for v in values]
        return out

    hist = sums([0])
    whole = hist[0][:, : starts[1]].sum(1)
    tree[0] = limits.weight(*whole[:2])
    next_id = 1
    for depth in range(limits.max_depth):
        wanted, after = [], []
        for n in sorted(hist):
            best = best_split(hist[n], starts, limits)
            if best is None:
                continue
            k, b, gain, left_sums, right_sums = best
            left, right = next_id, next_id + 1
            tree[n] = (names[k], b, left, right, gain)
            tree[left], tree[right] = limits.weight(*left_sums[:2]), limits.weight(*right_sums[:2])
            small, large = (left, right) if left_sums[2] <= right_sums[2] else (right, left)
            wanted.append(small)
            after.append((n, small, large))
            next_id += 2
        if not wanted or depth + 1 == limits.max_depth:
            break
        found = sums(wanted)
        hist = {k: v for n, small, large in after for k, v in ((small, found[small]), (large, hist[n] - found[small]))}
    return tree


def fit(
    df: DataFrame, features: list[str], label: str, objective: str = "binary:bce", num_trees: int = 3, max_depth: int = 3, learning_rate: float = 0.3, max_bin: int = 32, l2: float = 0.1,
    min_leaf: int = 1, min_gain: float = 0.01, l1: float = 0.0, min_child_weight: float = 1.0, min_sample_split: int = 2, goss_rates: tuple[float, float] | None = None,
    sample_id: str | None = None, classes: int | None = None, seed: int = 42, callback=None, warm_start: Model | None = None,
) -> Model:
    """Boosted trees; ``multi:ce`` grows one for each class in a round (labels 0, 1, ...).

    ``goss_rates`` (top, other) grows each tree on a one-side sample of the rows, which needs ``sample_id``.
    ``callback(model, round)`` may return True to stop. ``warm_start`` is a model to go on from: its cuts and start hold, its scores are worked out
    once, and ``num_trees`` rounds are added to its own.
    """
    limits = Limits(max_depth, l1, l2, min_gain, min_leaf, min_child_weight, min_sample_split)
    if warm_start is not None:
        if list(warm_start.cuts) != features or (warm_start.objective, warm_start.learning_rate) != (objective, learning_rate):
            raise ValueError("a model goes on with its own features, objective and learning rate")
        model = Model.from_dict(warm_start.to_dict())
        start, k = model.start, model.classes
    else:
        found = quantiles(df, features, [i / max_bin for i in range(max_bin)])
        start = float(df.agg(F.avg(label)).first()[0] or 0.0) if objective == "regression:l2" else 0.0
        k = 1
        if objective == "multi:ce":
            k = classes or int(df.agg(F.max(label)).first()[0]) + 1
        model = Model(cut_lists(found, features, "q"), learning_rate, objective, start, k)
        for f in features:
            model.cuts.setdefault(f, []).append(float("inf"))
    bins = {f: f"b{i}" for i, f in enumerate(features)}
    state = df.select(*[bucket(F.col(quoted(f)), model.cuts[f]).alias(b) for f, b in bins.items()], F.col(quoted(label)).cast("double").alias("y"), *([F.col(quoted(sample_id)).alias("id")] if sample_id else []), *[x.alias(f"s{j}") for j, x in enumerate(model.scores() if model.trees else [F.lit(start)] * k)])
    state = kept(state)
    for round_ in range(len(model.trees) // k, len(model.trees) // k + num_trees):
        scores = [F.col(f"s{j}") for j in range(k)]
        pairs = class_gradients(scores, F.col("y")) if k > 1 else [gradients(objective, scores[0], F.col("y"))]
        grown = []
        for g, h in pairs:
            rows = state.withColumns({"g0": g, "h0": h})
            if goss_rates:
                if sample_id is None:
                    raise ValueError("one-side sampling needs a sample id")
                rows = kept(goss(rows, "id", "g0", *goss_rates, seed=seed))
            grown.append(grow(rows, bins, model.cuts, F.col("g0"), F.col("h0"), limits))
        model.trees += grown
        at = {f: F.col(b) for f, b in bins.items()}
        state = kept(state.withColumns({f"s{j}": F.col(f"s{j}") + learning_rate * model.leaf(t, at) for j, t in enumerate(grown)}))
        if callback is not None and callback(model, round_):
            break
    return model
