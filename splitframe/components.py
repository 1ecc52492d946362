"""Components: named steps with parameters as a user sets them, and train, predict and cross_validation stages.

A component is a class with the stages it has as methods. ``component`` registers it by name, so a user's own
class runs like the ones here. A fitted component keeps its model as plain values (``model``), which go to and come from JSON.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import Frame
from .functions import evaluate
from .ml import gbdt, glm
from .names import quoted
from .operators import align, bins, encode, follow, quantile, sampling, stat
from .party import Exchange
from .sources import readers

STAGES = ("train", "predict", "cross_validation")
_known: dict[str, type] = {}


def component(name: str) -> Callable[[type], type]:
    """Register a class under a name; it has at least one stage."""

    def add(cls: type) -> type:
        if not any(callable(getattr(cls, s, None)) for s in STAGES):
            raise ValueError(f"{name} has no stage")
        if name in _known:
            raise ValueError(f"{name} is registered")
        _known[name] = cls
        cls.name = name
        return cls

    return add


def names() -> list[str]:
    return sorted(_known)


def create(name: str, **parameters):
    """The component with these parameters; unknown names and parameters are errors."""
    if name not in _known:
        raise ValueError(f"unknown component {name}")
    return _known[name](**parameters)


def describe(name: str) -> dict:
    """Stages and parameters with their defaults."""
    cls = _known[name]
    parameters = {p.name: None if p.default is p.empty else p.default for p in list(inspect.signature(cls.__init__).parameters.values())[1:]}
    return {"name": name, "stages": [s for s in STAGES if hasattr(cls, s)], "parameters": parameters}


def chosen(frame: Frame, columns: list[str] | None, use_anonymous: bool = False) -> list[str]:
    """Columns by name or anonymous name; all features where none are named."""
    if columns is None:
        return frame.columns
    return frame.anonymous_columns(columns).columns if use_anonymous else frame[columns].columns


@component("feature_scale")
class FeatureScale:
    """standard: to mean 0 and deviation 1. min_max: to ``feature_range``, one range for all or by column; ``strict_range`` clips."""

    def __init__(self, method: str = "standard", scale_col: list[str] | None = None, feature_range=(0.0, 1.0), strict_range: bool = True, use_anonymous: bool = False):
        if method not in ("standard", "min_max"):
            raise ValueError(f"unknown method {method}")
        self.method, self.scale_col, self.feature_range, self.strict_range, self.use_anonymous = method, scale_col, feature_range, strict_range, use_anonymous
        self.model: dict | None = None

    def train(self, frame: Frame) -> Frame:
        own = chosen(frame, self.scale_col, self.use_anonymous)
        both = (F.avg, F.stddev_samp) if self.method == "standard" else (F.min, F.max)
        row = frame.df.agg(*[f(quoted(c)).cast("double").alias(f"{i}{k}") for i, c in enumerate(own) for k, f in zip("ab", both)]).first()
        self.model = {c: [row[f"{i}a"], row[f"{i}b"]] for i, c in enumerate(own)}
        return self.predict(frame)

    def predict(self, frame: Frame) -> Frame:
        def scaled(c: str, a: float | None, b: float | None):
            x = frame.cells[c].cast("double")
            if a is None or b is None:
                return F.lit(None).cast("double")
            if self.method == "standard":
                return F.try_divide(x - a, F.lit(b))
            low, high = self.feature_range[c] if isinstance(self.feature_range, dict) else self.feature_range
            out = (x - a) * ((high - low) / (b - a if b - a >= 1e-6 else 1.0)) + low
            return F.greatest(F.least(out, F.lit(float(high))), F.lit(float(low))) if self.strict_range else out

        return frame._row({c: scaled(c, *ends) for c, ends in self.model.items()})


@component("feature_binning")
class FeatureBinning:
    """Cuts by quantile, of equal width (bucket) or given (manual); category columns are their own bins.

    ``train`` finds cuts and WOE tables, ``predict`` turns cells into bin numbers (``bin_idx``) or WOE. The IV of a column is the sum over its bins
    but the first, or over all without ``skip_first_bin``. ``relative_error`` takes cuts from a mergeable sketch instead of exact ranks.
    """

    def __init__(
        self, method: str = "quantile", n_bins: int = 10, bin_col: list[str] | None = None, category_col: list[str] | None = None, split_pt_dict: dict[str, list[float]] | None = None,
        transform_method: str | None = None, skip_metrics: bool = False, adjustment_factor: float = 0.5, use_anonymous: bool = False, relative_error: float | None = None, skip_first_bin: bool = True,
    ):
        if method not in ("quantile", "bucket", "manual"):
            raise ValueError(f"unknown method {method}")
        if transform_method not in (None, "bin_idx", "woe"):
            raise ValueError(f"unknown transform {transform_method}")
        if method == "manual" and not split_pt_dict:
            raise ValueError("manual binning needs split points")
        self.method, self.n_bins, self.bin_col, self.category_col, self.split_pt_dict = method, n_bins, bin_col, category_col, split_pt_dict
        self.transform_method, self.skip_metrics, self.adjustment_factor, self.use_anonymous = transform_method, skip_metrics, adjustment_factor, use_anonymous
        self.relative_error, self.skip_first_bin = relative_error, skip_first_bin
        self.model: dict | None = None

    def train(self, frame: Frame) -> Frame:
        categories = chosen(frame, self.category_col, self.use_anonymous) if self.category_col else []
        own = [c for c in chosen(frame, self.bin_col, self.use_anonymous) if c not in categories]
        if self.method == "manual":
            missing = [c for c in own if c not in self.split_pt_dict]
            if missing:
                raise ValueError(f"no split points for {missing}")
            cuts = {c: sorted(map(float, self.split_pt_dict[c])) for c in own}
        elif self.method == "quantile":
            cuts = quantile.cut_lists(quantile.quantiles(frame.df, own, [i / self.n_bins for i in range(1, self.n_bins + 1)], self.relative_error is not None, self.relative_error or 1e-4), own, "q") if own else {}
        else:
            cuts = quantile.cut_lists(quantile.equal_width_cuts(frame.df, own, self.n_bins).withColumnRenamed("cut", "value"), own, "i") if own else {}
        self.model = {"cuts": cuts, "categories": {c: encode.categories(frame.df, c) for c in categories}, "woe": {}, "iv": {}}
        if not self.skip_metrics and frame.roles.label:
            binned = self._binned(frame)
            table = bins.woe_table(binned.df, [*cuts, *categories], frame.roles.label, self.adjustment_factor)
            self.metrics = table
            for r in table.collect():  # a row for each bin
                self.model["woe"].setdefault(r["feature"], {})[str(r["bin"])] = r["woe"]
            self.model["iv"] = {r["feature"]: r["iv"] for r in bins.column_iv(table, self.skip_first_bin).collect()}  # a row for each column
        return self.predict(frame)

    def _binned(self, frame: Frame) -> Frame:
        cells = {c: bins.bucket(frame.cells[c], cuts) for c, cuts in self.model["cuts"].items()}
        for c, values in self.model["categories"].items():
            place = F.lit(None).cast("int")
            for k, v in enumerate(values):
                place = F.when(frame.cells[c] == v, k).otherwise(place)
            cells[c] = place
        return frame._row(cells)

    def predict(self, frame: Frame) -> Frame:
        if self.transform_method is None:
            return frame
        binned = self._binned(frame)
        if self.transform_method == "bin_idx":
            return binned
        cells = {}
        for c, woe in self.model["woe"].items():
            pairs = [x for b, v in woe.items() for x in (F.lit(int(b)), F.lit(v))]
            cells[c] = F.try_element_at(F.create_map(*pairs), binned.cells[c]) if pairs else F.lit(None).cast("double")
        return frame._row(cells)


@component("feature_selection")
class FeatureSelection:
    """Columns that pass all ``methods``: manual, iv and statistic, each with its parameters; ``keep_one`` leaves the best if none does.

    manual: {"filter_out_col": [...], "keep_col": [...]}. iv and statistic: {"filter_type": threshold, top_k or
    top_percentile, "threshold": x, "take_high": True}, and for statistic "metrics": [...].
    """

    def __init__(self, methods: list[str], manual: dict | None = None, iv: dict | None = None, statistic: dict | None = None, keep_one: bool = True):
        unknown = [m for m in methods if m not in ("manual", "iv", "statistic")]
        if unknown:
            raise ValueError(f"unknown methods: {unknown}")
        self.methods, self.keep_one = methods, keep_one
        self.parameters = {"manual": manual or {}, "iv": iv or {}, "statistic": statistic or {}}
        self.model: dict | None = None

    @staticmethod
    def passed(values: dict[str, float], filter_type: str = "threshold", threshold: float = 1.0, take_high: bool = True) -> set[str]:
        if filter_type == "threshold":
            return {c for c, v in values.items() if v is not None and (v >= threshold if take_high else v <= threshold)}
        n = len(values)
        k = {"top_k": n if threshold == 0 else int(threshold), "top_percentile": math.ceil(n * threshold)}[filter_type]
        known = [c for c in values if values[c] is not None]
        return set(sorted(known, key=lambda c: (-values[c] if take_high else values[c], c))[:k])

    def train(self, frame: Frame, binning: FeatureBinning | None = None) -> Frame:
        left, best, sign, manual = set(frame.columns), {}, -1, self.parameters["manual"]
        for method in self.methods:
            given = dict(self.parameters[method])
            if method == "manual":
                left &= set(encode.manual(frame.columns, manual.get("keep_col"), manual.get("filter_out_col")))
                continue
            if method == "iv":
                if binning is None or not binning.model["iv"]:
                    raise ValueError("selection by iv needs a binning with metrics")
                tables = [binning.model["iv"]]
            else:
                metrics = given.pop("metrics", ["mean"])
                found = stat.statistics(frame.df, frame.columns, metrics).collect()  # a row for each column and metric
                tables = [{r["column"]: r["value"] for r in found if r["metric"] == m} for m in metrics]
            for values in tables:
                left &= self.passed({c: v for c, v in values.items() if c in frame.columns}, **given) | set(manual.get("keep_col", ()))
                if not best:
                    best, sign = values, -1 if given.get("take_high", True) else 1
        if not left and self.keep_one and best:
            known = {c: v for c, v in best.items() if v is not None and c in frame.columns}
            left = {min(known, key=lambda c: (sign * known[c], c))}
        self.model = {"selected": [c for c in frame.columns if c in left]}
        return self.predict(frame)

    def predict(self, frame: Frame) -> Frame:
        return frame[self.model["selected"]]

    def mask(self, frame: Frame) -> DataFrame:
        """(column, kept) by anonymous name: what another party may be told of its own columns."""
        alias = frame.roles.anonymous()
        return frame.df.sparkSession.createDataFrame([(alias[c], c in self.model["selected"]) for c in frame.columns], "column string, kept boolean")

    @staticmethod
    def by_mask(frame: Frame, mask: DataFrame) -> Frame:
        """The columns of a frame that a mask by anonymous names keeps."""
        return frame.anonymous_columns([r["column"] for r in mask.where("kept").collect()])


@component("statistics")
class Statistics:
    def __init__(self, metrics: list[str] | None = None, use_columns: list[str] | None = None, skip_col: list[str] | None = None, ddof: int = 1, bias: bool = True, use_anonymous: bool = False, compat_kurt: bool = False):
        self.metrics, self.use_columns, self.skip_col, self.ddof, self.bias, self.use_anonymous = metrics or ["mean", "min", "max", "std"], use_columns, skip_col or [], ddof, bias, use_anonymous
        self.compat_kurt = compat_kurt

    def train(self, frame: Frame) -> DataFrame:
        own = [c for c in chosen(frame, self.use_columns, self.use_anonymous) if c not in self.skip_col]
        return stat.statistics(frame.df, own, self.metrics, self.ddof, self.bias, self.compat_kurt)


@component("feature_correlation")
class FeatureCorrelation:
    """Pearson correlations of local columns, and of these with another party's aligned ones; VIF of the local ones."""

    def __init__(self, use_columns: list[str] | None = None, skip_col: list[str] | None = None, calc_local_vif: bool = True, local_only: bool = False, use_anonymous: bool = False):
        self.use_columns, self.skip_col, self.calc_local_vif, self.local_only, self.use_anonymous = use_columns, skip_col or [], calc_local_vif, local_only, use_anonymous

    def train(self, frame: Frame, other: Frame | None = None) -> dict[str, DataFrame]:
        own = [c for c in chosen(frame, self.use_columns, self.use_anonymous) if c not in self.skip_col]
        out = {"local": stat.correlation(frame.df, own)}
        if self.calc_local_vif:
            out["vif"] = stat.vif(frame.df, own)
        if other is not None and not self.local_only:
            both = Frame.hstack([frame[own], other])
            out["across"] = stat.correlation(both.df, both.columns).where(F.col("x").isin(own) & F.col("y").isin(other.columns))
        return out


class _Led:
    """What a guest sends to its hosts, and how a host follows."""

    def lead(self, frame: Frame, exchange: Exchange, hosts: list[str], name: str = "selection") -> dict[str, Frame]:
        """The guest's parts; the hosts are sent the row index and the ranges of the parts."""
        roles = frame.roles
        leader = follow.Leader(exchange, frame.df, roles.sample_id, roles.match_id or roles.sample_id, hosts, self.random_state)
        return {part: frame._with(df.drop(follow.NUMBER)) for part, df in leader.select(name, self.ranges(leader.total)).items()}

    def follow(self, frame: Frame, exchange: Exchange, host: str, name: str = "selection") -> dict[str, Frame]:
        """A host's rows of the guest's parts."""
        made = follow.Follower(exchange, host, frame.df, frame.roles.match_id or frame.roles.sample_id).select(name)
        return {part: frame._with(df.drop(follow.NUMBER)) for part, df in made.items()}


@component("sample")
class Sample(_Led):
    """n or a share of rows, of each label for a dict of shares; with ``replace``, drawn with replacement. ``lead`` and ``follow`` sample aligned tables of several parties alike."""

    def ranges(self, total: int) -> dict[str, list[tuple[int, int]]]:
        if self.replace or isinstance(self.frac, dict):
            raise ValueError("a sample that hosts follow is drawn once from all rows")
        return follow.sample_range(total, self.n, self.frac)

    def __init__(self, n: int | None = None, frac: float | dict | None = None, replace: bool = False, random_state: int = 42):
        if (n is None) == (frac is None):
            raise ValueError("give n or frac")
        self.n, self.frac, self.replace, self.random_state = n, frac, replace, random_state

    def train(self, frame: Frame) -> Frame:
        sid = frame.roles.sample_id
        if isinstance(self.frac, dict):
            return frame._with(sampling.sample_by_label(frame.df, sid, frame.roles.label, self.frac, self.random_state))
        if self.replace:
            n = self.n if self.n is not None else max(1, int(frame.count() * self.frac))
            return frame._with(sampling.resample(frame.df.withColumn(sid, F.col(quoted(sid)).cast("string")), sid, n, self.random_state))
        return frame._with(sampling.sample(frame.df, sid, self.n, self.frac, self.random_state))


@component("data_split")
class DataSplit(_Led):
    """train, validate and test rows. ``lead`` and ``follow`` split aligned tables of several parties alike."""

    def ranges(self, total: int) -> dict[str, list[tuple[int, int]]]:
        if self.stratified:
            raise ValueError("a split that hosts follow is not stratified")
        return follow.split_ranges(total, *self.sizes)

    def __init__(self, train_size=None, validate_size=None, test_size=None, stratified: bool = False, random_state: int = 42):
        self.sizes, self.stratified, self.random_state = (train_size, validate_size, test_size), stratified, random_state

    def train(self, frame: Frame) -> tuple[Frame, Frame, Frame]:
        made = sampling.split(frame.df, frame.roles.sample_id, *self.sizes, seed=self.random_state, label=frame.roles.label if self.stratified else None)
        return tuple(frame._with(made.where(F.col("split") == s).drop("split")) for s in ("train", "validate", "test"))


@component("union")
class Union:
    """Rows of several frames with the same columns, one frame after the other."""

    def train(self, frames: list[Frame]) -> Frame:
        return Frame.vstack(frames)


@component("reader")
class Reader:
    """A frame from a file or table at an address such as file:///folder or s3a://bucket/key, with roles of its columns."""

    def __init__(self, uri: str, sample_id: str, match_id: str | None = None, label: str | None = None, weight: str | None = None):
        self.uri, self.roles = uri, {"sample_id": sample_id, "match_id": match_id, "label": label, "weight": weight}

    def train(self, spark: SparkSession) -> Frame:
        return Frame.from_spark(readers.load(spark, self.uri), **self.roles)


@component("psi")
class Alignment:
    """Rows of the guest whose match id every host has; the guest's ids and labels stay."""

    def train(self, guest: Frame, hosts: list[Frame]) -> Frame:
        tables = [(h.df.select(quoted(h.roles.match_id or h.roles.sample_id), *map(quoted, h.columns)), h.roles.match_id or h.roles.sample_id) for h in hosts]
        df = align.align(guest.df, tables, guest.roles.sample_id, guest.roles.match_id or guest.roles.sample_id)
        return guest._with(df, [*guest.columns, *(c for h in hosts for c in h.columns)])


@component("evaluation")
class Evaluation:
    def __init__(self, default_eval_setting: str = "binary", metrics: list[str] | None = None, predict_column: str = "predict_score", label_column: str = "label", by: str | None = None):
        self.task, self.metrics, self.predict_column, self.label_column, self.by = default_eval_setting, metrics, predict_column, label_column, by

    def train(self, df: DataFrame) -> DataFrame:
        return evaluate.evaluate(df, self.task, self.predict_column, self.label_column, self.metrics, self.by)


class _Learner:
    """A model with train and predict; cross_validation trains on all folds but one, in turn."""

    def metrics_of(self, df: DataFrame, label: str) -> DataFrame:
        raise NotImplementedError

    def cross_validation(self, frame: Frame, n_splits: int = 5, shuffle: bool = True, random_state: int = 42, output_cv_data: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
        """(fold, metric, value); with ``output_cv_data`` also every row with its fold and its prediction by the others."""
        sid, label = frame.roles.sample_id, frame.roles.label
        folds = sampling.k_fold(frame.df, sid, n_splits, random_state, shuffle)
        metrics, data = None, None
        for k in range(n_splits):
            one = type(self)(**self.parameters)
            one.train(frame._with(folds.where(F.col("fold") != k).drop("fold")))
            predicted = one.predict(frame._with(folds.where(F.col("fold") == k).drop("fold")))
            own = one.metrics_of(predicted, label).select(F.lit(k).alias("fold"), "metric", "value")
            metrics = own if metrics is None else metrics.unionByName(own)
            rows = predicted.withColumn("fold", F.lit(k))
            data = rows if data is None else data.unionByName(rows)
        return (metrics, data) if output_cv_data else metrics


def _in_batches(frame: Frame, kind: str, parameters: dict, features: list[str], warm_start: dict | None) -> dict:
    """The state of mini-batch training: a model that training can go on from."""
    options = {k: parameters[k] for k in ("lr", "batch_size")} | ({"penalty": "l2", "alpha": parameters["l2"]} if parameters["l2"] else {})
    return glm.fit_mini_batch(frame.df, features, frame.roles.label, frame.roles.sample_id, epochs=parameters["epochs"] or 1, kind=kind, method=parameters["optimizer"], warm_start=warm_start, **options)


@component("linear_regression")
class LinearRegression(_Learner):
    """Exact, or with ``epochs`` by steps over all rows or, with ``batch_size``, over batches of rows; the latter go on from a fitted component."""

    def __init__(self, epochs: int | None = None, lr: float = 0.01, l2: float = 0.0, batch_size: int | None = None, optimizer: str = "sgd"):
        self.parameters = {"epochs": epochs, "lr": lr, "l2": l2, "batch_size": batch_size, "optimizer": optimizer}
        self.model: dict | None = None

    def train(self, frame: Frame, warm_start: LinearRegression | None = None) -> DataFrame:
        p = self.parameters
        if p["batch_size"]:
            self.model = {"features": frame.columns, **_in_batches(frame, "linear", p, frame.columns, warm_start and warm_start.model)}
            return self.predict(frame)
        self.model = {"features": frame.columns, "weights": glm.fit_linear(frame.df, frame.columns, frame.roles.label, p["epochs"], p["lr"], p["l2"])}
        return self.predict(frame)

    def predict(self, frame: Frame) -> DataFrame:
        return glm.predict(frame.df, self.model["weights"])

    def metrics_of(self, df, label):
        return evaluate.evaluate(df, "regression", "predict_score", label)


@component("logistic_regression")
class LogisticRegression(_Learner):
    """Two classes, or more of them one against all others; ``party`` trains by rounds over the parties' own rows.

    With ``batch_size`` two classes are trained in batches of rows, and training goes on from a fitted component.
    """

    def __init__(self, epochs: int = 20, lr: float = 0.15, l2: float = 0.0, threshold: float = 0.5, classes: list | None = None, party: str | None = None, optimizer: str = "sgd", batch_size: int | None = None):
        self.parameters = {"epochs": epochs, "lr": lr, "l2": l2, "threshold": threshold, "classes": classes, "party": party, "optimizer": optimizer, "batch_size": batch_size}
        self.model: dict | None = None

    def train(self, frame: Frame, warm_start: LogisticRegression | None = None) -> DataFrame:
        p, label = self.parameters, frame.roles.label
        features = [c for c in frame.columns if c != p["party"]]
        if p["classes"] and len(p["classes"]) > 2:
            self.model = {"classes": p["classes"], "models": glm.fit_one_vs_rest(frame.df, features, label, p["classes"], epochs=p["epochs"], lr=p["lr"], l2=p["l2"])}
        elif p["party"]:
            self.model = {"weights": glm.fit_homo_logistic(frame.df, features, label, p["party"], p["epochs"], p["lr"], p["optimizer"], "l2" if p["l2"] else None, p["l2"])}
        elif p["batch_size"]:
            self.model = _in_batches(frame, "logistic", p, features, warm_start and warm_start.model)
        else:
            self.model = {"weights": glm.fit_logistic(frame.df, features, label, p["epochs"], p["lr"], p["l2"])}
        return self.predict(frame)

    def predict(self, frame: Frame) -> DataFrame:
        if "models" in self.model:
            return glm.predict_class(frame.df, self.model["models"])
        scored = glm.predict(frame.df, self.model["weights"], logistic=True)
        return evaluate.predict_detail(scored, F.col("predict_score"), self.parameters["threshold"])

    def metrics_of(self, df, label):
        return evaluate.evaluate(df, "multi" if "models" in self.model else "binary", "predict_result" if "models" in self.model else "predict_score", label)


@component("boosted_trees")
class BoostedTrees(_Learner):
    def __init__(self, objective: str = "binary:bce", num_trees: int = 3, max_depth: int = 3, learning_rate: float = 0.3, max_bin: int = 32, **options):
        self.parameters = {"objective": objective, "num_trees": num_trees, "max_depth": max_depth, "learning_rate": learning_rate, "max_bin": max_bin, **options}
        self.model: dict | None = None

    def train(self, frame: Frame, warm_start: BoostedTrees | None = None) -> DataFrame:
        """``warm_start``: a fitted component whose trees come first."""
        before = None if warm_start is None else gbdt.Model.from_dict(warm_start.model)
        self.model = gbdt.fit(frame.df, frame.columns, frame.roles.label, sample_id=frame.roles.sample_id, warm_start=before, **self.parameters).to_dict()
        return self.predict(frame)

    def predict(self, frame: Frame) -> DataFrame:
        return gbdt.Model.from_dict(self.model).predict(frame.df)

    def metrics_of(self, df, label):
        task = {"binary": "binary", "multi": "multi", "regression": "regression"}[self.parameters["objective"].split(":")[0]]
        return evaluate.evaluate(df, task, "predict_result" if task == "multi" else "predict_score", label)
